"""Scores by models, gates on them, selection, and deltas to parents."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.functions import text as X
from loamsift.models import LABEL_ERRORS, ask, log_probability, message, messages
from loamsift.operators.base import Context, Stage, StageOutput, split
from loamsift.schema import CRITIC, INSTRUCTION, RESPONSE, SCORES, is_conversation


def scored(df: DataFrame, **values: Column) -> DataFrame:
    """Set fields of scores; the others stay."""
    s = F.coalesce("scores", F.from_json(F.lit("{}"), SCORES))
    for name, value in values.items():
        s = s.withField(name, value)
    return df.withColumn("scores", s)


def judge_messages(rubric: dict) -> Column:
    """System message with the rubric and its examples, user message with the pair."""
    lines = [f"Score the pair below on each dimension of the rubric {rubric.get('description', '')}."]
    lines += [f"{d['name']} ({d['scale_min']} to {d['scale_max']}): {d.get('description', '')} {d.get('criteria', '')}" for d in rubric["dimensions"]]
    for shot in rubric.get("few_shot", []):
        lines.append(f"Example. Instruction: {shot['instruction']} Response: {shot['response']} Scores: {json.dumps(shot['scores'])} Verdict: {shot['expected_verdict']}")
    lines.append('Answer in JSON: {"scores": {dimension: number}, "reasoning": text}.')
    pair = F.concat(F.lit("Instruction:\n"), F.col(INSTRUCTION), F.lit("\n\nResponse:\n"), F.col(RESPONSE))
    return messages(message("system", F.lit("\n".join(lines))), message("user", pair))


def judged(df: DataFrame, ctx: Context, rubric: dict) -> DataFrame:
    """Adds _dims (map), _overall and _error to conversations, and the scores themselves. Held, so models run once."""
    body = F.when(is_conversation(), judge_messages(rubric))
    out = ctx.held(df.withColumn("_answer", ask(ctx.model, body)))
    dims = F.from_json(X.json_part(F.col("_answer.text")), "struct<scores:map<string,double>>")["scores"]
    whole = F.lit(True)
    for name in rubric["overall_weights"]:
        whole = whole & F.try_element_at(dims, F.lit(name)).isNotNull()
    codes = F.create_map(*[F.lit(x) for kv in LABEL_ERRORS.items() for x in kv])
    failed = F.coalesce(F.try_element_at(codes, F.col("_answer.error")), F.lit("label_parse_failure"))
    out = out.withColumn("_error", F.when(is_conversation() & F.col("_answer.error").isNotNull(), failed).when(is_conversation() & (dims.isNull() | ~whole), "label_parse_failure"))
    out = out.withColumn("_overall", F.when(is_conversation() & F.col("_error").isNull(), X.weighted(dims, rubric["overall_weights"]))).withColumn("_dims", dims)
    some = F.col("_overall").isNotNull()
    keep = lambda name, value: F.when(some, value).otherwise(F.col(f"scores.{name}"))
    return scored(
        out, quality=keep("quality", F.col("_overall")), dims=keep("dims", F.col("_dims")), rubric_hash=keep("rubric_hash", F.lit(rubric.get("hash"))), rubric_version=keep("rubric_version", F.lit(str(rubric.get("version", "")))),
        judge_model=keep("judge_model", F.lit(ctx.model.name)), judge_prompt_hash=keep("judge_prompt_hash", F.sha2(F.get_json_object(judge_messages(rubric), "$[0].content"), 256)),
    )


@dataclass
class LabelQuality(Stage):
    rubric: dict = field(default_factory=dict)
    min_overall_score: float | None = None
    name: str = "03_label_quality"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        out = judged(df, ctx, self.rubric)
        low = F.col("_overall") < F.lit(self.min_overall_score or 0.0)
        parts = split(out, self, F.coalesce(F.col("_error"), F.when(low, "low_quality_score")), F.concat(F.lit("overall="), F.col("_overall").cast("string")))
        gone = ["_answer", "_error", "_overall", "_dims"]
        return StageOutput(parts.kept.drop(*gone), parts.dropped.drop(*gone))


@dataclass
class LabelScore(Stage):
    """Annotates, never drops."""

    rubric: dict = field(default_factory=dict)
    name: str = "02s_label_score"
    action: str = "scored"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        return StageOutput(judged(df, ctx, self.rubric).drop("_answer", "_error", "_overall", "_dims"))


@dataclass
class Ifd(Stage):
    """Instruction-following difficulty: how much the instruction raises the response's mean log-probability."""

    min_score: float = 0.2
    name: str = "02e_ifd_filter"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        if not hasattr(ctx.model, "score"):
            raise ValueError("the model gives no log-probabilities")
        given, alone = log_probability(ctx.model, F.col(INSTRUCTION), F.col(RESPONSE)), log_probability(ctx.model, F.lit(""), F.col(RESPONSE))
        out = ctx.held(df.withColumn("_a", F.when(is_conversation(), given)).withColumn("_b", F.when(is_conversation(), alone)))
        out = out.withColumn("_ifd", F.round(F.col("_a") - F.col("_b"), 4))
        out = scored(out, ifd=F.coalesce("_ifd", "scores.ifd"))
        parts = split(out, self, F.when(F.col("_ifd") < self.min_score, "low_ifd"), F.concat(F.lit("ifd="), F.col("_ifd").cast("string")))
        return StageOutput(parts.kept.drop("_a", "_b", "_ifd"), parts.dropped.drop("_a", "_b", "_ifd"))


@dataclass
class RewardScore(Stage):
    """A number from the reward model; anything else fails the run."""

    min_score: float | None = None
    name: str = "02r_reward_score"
    action: str = "scored"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        pair = messages(message("user", F.col(INSTRUCTION)), message("assistant", F.col(RESPONSE)))
        out = ctx.held(df.withColumn("_answer", ask(ctx.model, F.when(is_conversation(), pair))))
        value = F.trim("_answer.text").cast("double")  # ANSI: text that is no number raises
        out = scored(out.withColumn("_reward", F.when(is_conversation(), value)), reward_model=F.coalesce("_reward", "scores.reward_model"))
        why = F.when(F.col("_reward") < self.min_score, "low_reward_score") if self.min_score is not None else F.lit(None).cast("string")
        parts = split(out, self, why)
        return StageOutput(parts.kept.drop("_answer", "_reward"), parts.dropped.drop("_answer", "_reward"))


def critic_messages(positive: bool) -> Column:
    ask_for = "Is the response right and useful for the instruction?" if positive else "Is there anything wrong, unsafe or missing in the response?"
    pair = F.concat(F.lit("Instruction:\n"), F.col(INSTRUCTION), F.lit("\n\nResponse:\n"), F.col(RESPONSE), F.lit(f'\n\n{ask_for} Answer in JSON: {{"verdict": "yes" or "no", "reason": text}}.'))
    return messages(message("user", pair))


@dataclass
class DoubleCritic(Stage):
    """Kept if one critic says the pair is right and the other, asked for faults, says there are none."""

    name: str = "03_double_critic"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        on = is_conversation()
        out = ctx.held(df.withColumn("_yes", ask(ctx.model, F.when(on, critic_messages(True)))).withColumn("_no", ask(ctx.model, F.when(on, critic_messages(False)))))
        read = lambda c: F.from_json(X.json_part(F.col(f"{c}.text")), "struct<verdict:string,reason:string>")
        yes, no = read("_yes"), read("_no")
        audit = F.struct(F.lower(yes["verdict"]).alias("yes_verdict"), F.lower(no["verdict"]).alias("no_verdict"), yes["reason"].alias("yes_reason"), no["reason"].alias("no_reason")).cast(CRITIC)
        out = scored(out, double_critic=F.when(on, audit).otherwise(F.col("scores.double_critic")))
        failed = F.col("_yes.error").isNotNull() | F.col("_no.error").isNotNull() | yes["verdict"].isNull() | no["verdict"].isNull()
        agreed = (F.col("scores.double_critic.yes_verdict") == "yes") & (F.col("scores.double_critic.no_verdict") == "no")
        parts = split(out, self, F.when(on & failed, "double_critic_llm_error").when(on & ~agreed, "double_critic_disagreement"))
        return StageOutput(parts.kept.drop("_yes", "_no"), parts.dropped.drop("_yes", "_no"))


def score_of(name: str) -> Column:
    """A score by name: a field of scores, else a dimension."""
    if name in ("quality", "ifd", "reward_model", "complexity_elo"):
        return F.col(f"scores.{name}")
    return F.try_element_at(F.col("scores.dims"), F.lit(name))


@dataclass
class PairDelta(Stage):
    """Rows must beat their parent: first parent found in parent_ids order, response length ratio, then score delta."""

    score_field: str = "quality"
    min_delta: float = 0.30
    length_ratio_max: float | None = None
    name: str = "04_pair_delta"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        parents = ctx.parents if ctx.parents is not None else df
        side = parents.groupBy(F.col("id").alias("_pid")).agg(F.max_by(F.struct(score_of(self.score_field).alias("score"), F.length(RESPONSE).alias("chars")), "_seq").alias("_p"))
        links = df.select("_seq", F.posexplode("lineage.parent_ids").alias("pos", "pid"))
        found = links.join(side, F.col("pid") == F.col("_pid")).groupBy(F.col("_seq").alias("_s")).agg(F.min_by("_p", "pos").alias("_parent"))
        out = df.join(found, F.col("_seq") == F.col("_s"), "left")
        mine, theirs = score_of(self.score_field), F.col("_parent.score")
        on = is_conversation() & F.col("_parent").isNotNull() & mine.isNotNull() & theirs.isNotNull()
        why = F.when(on & (mine - theirs < self.min_delta), "insufficient_delta")
        if self.length_ratio_max is not None:
            long = (F.col("_parent.chars") > 0) & (F.length(RESPONSE) / F.col("_parent.chars") > self.length_ratio_max)
            why = F.when(on & long, "length_ratio_exceeded").otherwise(why)
        parts = split(out, self, why)
        return StageOutput(parts.kept.drop("_s", "_parent"), parts.dropped.drop("_s", "_parent"))


@dataclass
class CompositeSelect(Stage):
    """The best target_count rows by weighted scores, a missing one counting 0; ties go to the earlier row."""

    weights: dict[str, float] = field(default_factory=dict)
    target_count: int | None = None
    name: str = "05_composite_select"
    action: str = "selected"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        if not self.weights or not self.target_count:
            return StageOutput(df)
        total = F.lit(0.0)
        for name, w in self.weights.items():
            total = total + F.coalesce(score_of(name), F.lit(0.0)) * w
        out = df.withColumn("_composite", total)
        # a top-k keeps target_count rows per partition, not one task with all rows; its last row is the bar for the rest
        last = out.select("_composite", "_seq").orderBy(F.desc("_composite"), "_seq").limit(self.target_count).agg(F.min(F.struct(F.col("_composite").alias("c"), (-F.col("_seq")).alias("s"))).alias("_bar"))
        marked = out.crossJoin(F.broadcast(last))  # one row
        inside = F.struct(F.col("_composite").alias("c"), (-F.col("_seq")).alias("s")) >= F.col("_bar")
        parts = split(marked, self, F.when(~inside, "composite_select"), F.concat(F.lit("score="), F.round("_composite", 6).cast("string")))
        return StageOutput(parts.kept.drop("_composite", "_bar"), parts.dropped.drop("_composite", "_bar"))
