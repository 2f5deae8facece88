"""Predicates over conversations; other rows pass untouched."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.functions import text as X
from loamsift.operators.base import Context, Stage, StageOutput, split
from loamsift.schema import INSTRUCTION, RESPONSE, is_conversation


class Normalise(Stage):
    """Strip instruction and response; hashes stay those of the source row."""

    name, action = "02_normalize", "transformed"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        inner = F.col("payload.conversation").withField("instruction", X.strip(F.col(INSTRUCTION))).withField("response", X.strip(F.col(RESPONSE)))
        return StageOutput(df.withColumn("payload", F.when(is_conversation(), F.col("payload").withField("conversation", inner)).otherwise(F.col("payload"))))


def length_reason(instruction: Column, response: Column, lo_i: int, hi_i: int, lo_r: int, hi_r: int) -> Column:
    """First bound that fails, in code points; bounds are inclusive."""
    i, r = F.length(instruction), F.length(response)
    return (
        F.when(i < lo_i, "instruction_too_short").when(i > hi_i, "instruction_too_long").when(r < lo_r, "response_too_short").when(r > hi_r, "response_too_long")
    )


@dataclass
class Length(Stage):
    min_instruction_chars: int = 10
    max_instruction_chars: int = 4096
    min_response_chars: int = 10
    max_response_chars: int = 16384
    name: str = "02a_length_filter"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        why = length_reason(F.col(INSTRUCTION), F.col(RESPONSE), self.min_instruction_chars, self.max_instruction_chars, self.min_response_chars, self.max_response_chars)
        return split(df, self, F.when(is_conversation(), why))


@dataclass
class Language(Stage):
    """By script: with English allowed, at least 70 % of an instruction's letters are Latin. Other sets keep all."""

    allowed: list[str] = field(default_factory=lambda: ["en"])
    name: str = "02b_language_filter"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        if "en" not in self.allowed:
            return StageOutput(df, df.limit(0), stats={"warning": "no test for these languages; all rows pass"})
        return split(df, self, F.when(is_conversation() & (X.latin_share(F.col(INSTRUCTION)) < 0.7), "language_mismatch"))


@dataclass
class SentenceVariance(Stage):
    min_cv: float = 0.15
    name: str = "02f_sentence_variance"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        low = X.variation(X.sentence_lengths(F.col(RESPONSE))) < self.min_cv
        return split(df, self, F.when(is_conversation() & low, "low_sentence_variance"))


@dataclass
class Canary(Stage):
    """Rows that hold a canary phrase leak it; the first phrase in the given order is the detail."""

    phrases: list[str] = field(default_factory=list)
    name: str = "02g_canary_filter"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        if not self.phrases:
            return StageOutput(df)
        found = X.first_phrase(F.concat_ws("\n", INSTRUCTION, RESPONSE), self.phrases)
        return split(df, self, F.when(is_conversation() & found.isNotNull(), "canary_leak"), found)


def evol_reason(child: Column, parent: Column, min_edit: int = 20, min_chars: int = 20, refusals: tuple[str, ...] = ("I cannot", "I'm unable", "As an AI")) -> Column:
    """Why a rewritten instruction is no use, first reason first; null if it is."""
    return (
        F.when(X.normalised(child) == X.normalised(parent), "evol_identical_to_parent").when(X.holds_any(child, list(refusals)), "evol_refusal")
        .when(F.length(X.strip(child)) < min_chars, "evol_instruction_too_short").when(F.levenshtein(child, parent) < min_edit, "evol_edit_distance_too_small")
    )


def chain(df: DataFrame, stages: list[Stage], ctx: Context | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Run stages in order; the rows kept and each stage's dropped rows."""
    gone = []
    for s in stages:
        out = s.transform(df, ctx or Context())
        df = out.kept
        if out.dropped is not None:
            gone.append(out.dropped)
    return df, gone
