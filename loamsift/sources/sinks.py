"""Writers: exports, stage artifacts and run documents."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.schema import compat, is_conversation, payload_json

FORMATS = ("jsonl", "chatml", "alpaca")


def line_jsonl() -> Column:
    return payload_json()


def line_chatml() -> Column:
    """{"messages": [system?, user, assistant]}; rows that are no conversations keep their payload."""
    c = "payload.conversation"
    turn = lambda role, f: F.when(F.col(f"{c}.{f}").isNotNull(), F.struct(F.lit(role).alias("role"), F.col(f"{c}.{f}").alias("content")))
    turns = F.filter(F.array(turn("system", "system"), turn("user", "instruction"), turn("assistant", "response")), lambda x: x.isNotNull())
    return F.when(is_conversation(), F.to_json(F.struct(turns.alias("messages")))).otherwise(payload_json())


def line_alpaca() -> Column:
    c = "payload.conversation"
    row = F.struct(F.col(f"{c}.instruction").alias("instruction"), F.lit("").alias("input"), F.col(f"{c}.response").alias("output"))
    return F.when(is_conversation(), F.to_json(row)).otherwise(payload_json())


LINES = {"jsonl": line_jsonl, "chatml": line_chatml, "alpaca": line_alpaca}


def export(df: DataFrame, path: str, kind: str = "jsonl") -> None:
    """A directory of JSON-lines parts, in the order of _seq across parts."""
    ordered = df.orderBy("_seq") if "_seq" in df.columns else df
    ordered.select(LINES[kind]().alias("value")).write.mode("overwrite").text(path)


def export_file(df: DataFrame, path: str, kind: str = "jsonl") -> int:
    """One local file, streamed through the driver a partition at a time; for data sets that one machine should hold."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for row in df.orderBy("_seq").select(LINES[kind]().alias("value")).toLocalIterator():
            f.write(row.value + "\n")
            n += 1
    return n


def write_stage(df: DataFrame, folder: str, dropped: DataFrame | None = None, clusters: DataFrame | None = None, write_empty: bool = True) -> None:
    """data, dropped and clusters of a stage; without write_empty an empty dropped table is left out."""
    compat(df, seq=True).write.mode("overwrite").parquet(f"{folder}/data")
    if dropped is not None and (write_empty or dropped.limit(1).count()):
        compat(dropped, dropped=True).write.mode("overwrite").parquet(f"{folder}/dropped")
    if clusters is not None:
        clusters.write.mode("overwrite").parquet(f"{folder}/clusters")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names; a single machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/loamsift-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside goes to Python in batches of so many rows; both sides hold a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def held(df: DataFrame) -> DataFrame:
    """Written to a scratch folder and read again, so that models are asked once and lost executors cost nothing."""
    path = f"{scratch(df.sparkSession)}/held"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(value: object, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, default=str)
    os.replace(path + ".new", path)


def append_raw_responses(df: DataFrame, path: str) -> None:
    """Answers so far, appended; with ``remaining`` a stopped run goes on where it was."""
    df.write.mode("append").parquet(path)


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select("plan_index"), "plan_index", "left_anti")
