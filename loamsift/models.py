"""Text models and embedders behind small protocols, with deterministic stand-ins for tests and offline runs.

A model has ``complete(messages) -> str`` and, for log-probabilities, ``score(prompt, response) -> list[float]``. It must
pickle, as partitions call it. Errors are values: a failed call gives a code in the result's error field, not a failed job.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class ModelError(Exception):
    """code: auth_error, retryable, invalid_structured, or anything else."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


LABEL_ERRORS = {"auth_error": "label_auth_failure", "retryable": "label_retryable_api_failure", "invalid_structured": "invalid_structured"}
CAPABILITIES = {"openai": {"json_schema": True, "logprobs": True}, "openai_compatible": {"json_schema": False, "logprobs": False}, "fake": {"json_schema": True, "logprobs": True}}


class TextModel(Protocol):
    name: str

    def complete(self, messages: list[dict]) -> str: ...

    def score(self, prompt: str, response: str) -> list[float]: ...


def unit(text: str) -> float:
    """A number in [0, 1) that depends on the text alone."""
    return int(hashlib.sha256(text.encode()).hexdigest()[:12], 16) / 16**12


class FakeModel:
    """Answers from a function of the messages; by default echoes the last message's digest."""

    def __init__(self, answer: Callable[[list[dict]], str] | None = None, name: str = "fake") -> None:
        self.answer, self.name = answer, name

    def complete(self, messages: list[dict]) -> str:
        if self.answer:
            return self.answer(messages)
        body = messages[-1]["content"]
        return json.dumps({"instruction": f"Explain topic {int(unit(body) * 1e6)} step by step", "response": f"An answer about {int(unit(body[::-1]) * 1e6)} in some detail."})

    def score(self, prompt: str, response: str) -> list[float]:
        return [-round(unit(prompt + "\x1f" + w), 6) for w in response.split()]


def call(model: TextModel, messages: list[dict], retries: int = 3, wait: float = 1.0) -> str:
    """One completion; retryable errors are tried again after 1, 2, 4, up to 8 seconds."""
    for n in range(max(1, retries)):
        try:
            return model.complete(messages)
        except ModelError as e:
            if e.code != "retryable" or n + 1 >= retries:
                raise
            time.sleep(min(8.0, wait * 2**n))
    raise ModelError("retryable")


def ask(model: TextModel, messages: Column, workers: int = 8, retries: int = 3, wait: float = 1.0) -> Column:
    """struct(text, error) of each row's JSON list of messages; a partition has at most ``workers`` calls open.

    Not deterministic as far as the planner knows, so it isn't called twice for one row; hold the frame before splitting it.
    """

    def one(body: str | None) -> tuple[str | None, str | None]:
        if body is None:
            return None, None
        try:
            return call(model, json.loads(body), retries, wait), None
        except ModelError as e:
            return None, e.code

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for part in parts:
                yield pd.DataFrame(list(pool.map(one, part)), columns=["text", "error"], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "text string, error string").asNondeterministic()(messages)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(*parts: Column) -> Column:
    return F.to_json(F.array(*parts))


def log_probability(model: TextModel, prompt: Column, response: Column) -> Column:
    """Mean log-probability of a response's tokens, to 6 digits; null without tokens."""

    def run(prompts: pa.Array, responses: pa.Array) -> pa.Array:
        totals, counts = [], []
        for p, r in zip(prompts, responses):  # a row at a time: its numbers go before the next row's are made
            total, n = 0.0, 0
            for x in model.score(p.as_py() or "", r.as_py() or ""):
                total, n = total + x, n + 1  # in order, as sum() rounds otherwise
            totals.append(total)
            counts.append(n)
        return pa.StructArray.from_arrays([pa.array(totals, pa.float64()), pa.array(counts, pa.int64())], ["total", "n"])

    run.__annotations__ = {"prompts": pa.Array, "responses": pa.Array, "return": pa.Array}
    lps = F.arrow_udf(run, "total double, n long").asNondeterministic()(prompt, response)
    return F.element_at(F.transform(F.array(lps), lambda x: F.when(x["n"] > 0, F.round(x["total"] / x["n"], 6))), 1)


class HashEmbedder:
    """Deterministic bag-of-words vectors: each word adds a signed one at a hashed place."""

    def __init__(self, dim: int = 64, name: str = "hash") -> None:
        self.dim, self.name = dim, name
        self.prefix = f"{name}:{dim}:"

    def vector(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for w in text.lower().split():
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4]) % self.dim] += 1.0 if d[4] & 1 else -1.0
        return v

    def column(self, text: Column) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else self.vector(t))

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "array<double>")(text)


def merged_override(base: dict, override: dict | None) -> dict:
    """A stage's own model settings over the pipeline's, whatever of them is set."""
    return {**base, **{k: v for k, v in (override or {}).items() if v is not None}}
