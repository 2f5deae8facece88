"""From a configuration to the ordered stages; each stage carries its own settings."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.operators import dedup, filters, generate, scoring, similarity
from loamsift.operators.base import Context, Stage, StageOutput
from loamsift.operators.taxonomy import load_taxonomy
from loamsift.sources import readers


class Source(Stage):
    """Rows that were handed in, of the source's own kind, else the configured file."""

    name, action = "01_source", "sourced"

    def __init__(self, spark: SparkSession, config: dict[str, Any], root: str) -> None:
        self.spark, self.config, self.root = spark, config, root

    def transform(self, df: DataFrame | None, ctx: Context) -> StageOutput:
        d = self.config["data_source"]
        kind = "ConversationRecord" if d["type"] == "seeds" else "GroundedChunkRecord"
        if df is not None and df.limit(1).count():
            return StageOutput(df.where(F.col("record_type") == kind))
        path = os.path.join(self.root, d["path"])
        if d["type"] == "seeds":
            good, bad = readers.read_seeds(self.spark, path, ctx.config_hash)
            return StageOutput(good, None, {"rejected": bad})
        pages = readers.read_pdf(self.spark, path)
        return StageOutput(readers.chunk_records(pages, F.col("path"), F.col("text"), F.col("n_pages"), d["chunk_size_chars"], d["chunk_overlap_chars"]))


def generator_stages(config: dict[str, Any], root: str) -> list[Stage]:
    g = config["generator"]
    if g["type"] == "prompt_based":
        return [generate.PromptGenerator(g["target_count"], g["generation_multiplier"], g["prompt_template"] or generate.TEMPLATE)]
    if g["type"] == "transform":
        return [generate.TransformGenerator(g["input_field"], g["output_field"], g["prompt_template"] or "{value}", g["preserve_original"])]
    if g["type"] == "evol_instruct":
        f = g["filter"]
        return [
            generate.EvolRound(r, g["branching_factor"], g["operators"], f["min_edit_distance_chars"], f["min_instruction_chars"], tuple(f["refusal_keywords"])) for r in range(1, g["rounds"] + 1)
        ]
    if g["type"] == "taxonomy_prompt":
        return [generate.TaxonomyGenerator(load_taxonomy(os.path.join(root, g["taxonomy_path"])), g["target_count"], g["generation_multiplier"])]
    raise ValueError(f"unknown generator type {g['type']}")


def filter_stage(s: dict[str, Any], config: dict[str, Any], root: str) -> Stage:
    own = {k: v for k, v in s.items() if k not in ("type", "llm_override", "strategy", "rubric_path")}
    kinds = {
        "length": filters.Length, "language": filters.Language, "sentence_variance": filters.SentenceVariance, "canary": filters.Canary, "semantic_similarity": similarity.SemanticSimilarity,
        "ifd": scoring.Ifd, "reward_model": scoring.RewardScore, "pair_delta": scoring.PairDelta, "select": scoring.CompositeSelect, "double_critic": scoring.DoubleCritic, "complexity_elo": generate.ComplexityElo,
    }
    if s["type"] == "labeling_engine":
        path = s["rubric_path"] or config["labeling_engine"]["rubric_path"]
        if not path:
            raise ValueError("labeling needs a rubric_path")
        return scoring.LabelQuality(readers.load_rubric(os.path.join(root, path)), s["min_overall_score"])
    return kinds[s["type"]](**own)


def build(spark: SparkSession, config: dict[str, Any], root: str = ".") -> list[Stage]:
    """Source, normalise, generate, dedup, filters, in the order of the configuration. Equal names get a number."""
    stages: list[Stage] = [Source(spark, config, root)]
    if config["data_source"]["type"] == "seeds":
        stages.append(filters.Normalise())
    stages += generator_stages(config, root)
    for d in config["dedup"]:
        rest = {k: v for k, v in d.items() if k != "type"}
        stages.append(dedup.ExactDedup() if d["type"] == "exact" else dedup.NearDedup(**rest))
    stages += [filter_stage(s, config, root) for s in config["filters"]["stages"]]
    seen: dict[str, int] = {}
    for s in stages:
        seen[s.name] = seen.get(s.name, 0) + 1
        if seen[s.name] > 1:
            s.name = f"{s.name}_{seen[s.name]}"
    return stages
