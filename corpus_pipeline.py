"""The corpus pipeline: documents pass five operators in turn; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamsift.llm import decontam, linededup, mixing, nearjoin, toxicity
from loamsift.llm.kernel import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts score the model's bias and stay unless that is above the cut; repeated rows are scored alike;
    without positive labels nothing goes.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of three lines, or of fewer that hold 50 words or a whole text, go from all texts but the first.

    A document of which nothing is left but blanks goes whole. Null and empty texts stay; rows equal in id and text are
    one document and are cut alike; of copies the smallest id keeps the passage, null ids come last.
    """
    return linededup.strip(docs, short=True)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, of equal ids that of the smallest text hash.

    Null, empty and wordless texts are like none and stay; rows equal in id and text leave one row; null ids come last.
    """
    return nearjoin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go. Null and empty texts hold none; repeated rows go or stay together."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by ``copy`` (``copy_number`` if documents have a ``copy``).

    Null texts have size 0, a null source is a source, repeated rows are documents each, whatever other columns are called.
    """
    return mixing.emit(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near duplicates", keep_one_of_each), ("decontamination", decontaminate), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier of the first stage can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
