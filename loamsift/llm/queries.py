"""The queries of the training-data operators, with SQL where SQL can express them. Each runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm import decontam, licences, linededup, mixing, nearjoin, outliers, quality, sanitise, toxicity, warc
from loamsift.llm.kernel import crc_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.find(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).drop("lang", "source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    out = toxicity.scored_ids(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= toxicity.CUT).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_similar", "component_id")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_sanitise, op2_line_dedup, op2_passages, op3_decontaminate, op4_outliers, op5_toxicity, op6_quality, op7_mix, op8_near_join, op9_licences, op10_warc)}
ORACLE_SQL = {"op2_line_dedup": linededup.SQL, "op7_mix": mixing.SQL, "op8_near_join": nearjoin.SQL, "op10_warc": warc.SQL}
