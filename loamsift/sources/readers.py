"""Readers: seeds as JSON lines or CSV, PDF, text chunks, stage artifacts, raw responses and YAML."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.functions import text as X
from loamsift.schema import CHUNK, CONV, CONVERSATION, GROUNDED, LINEAGE, SOURCE, as_records, conversation, fields, from_compat, hashed, nulls, with_event

MAX_CHARS, MAX_BYTES = 16384, 50 << 20


def placed(df: DataFrame) -> DataFrame:
    """Adds _f, _b and _m: the file, where in it the part of it starts that one read takes, and a number that ascends within a part and over partitions."""
    try:
        at = df.withColumn("_f", F.input_file_name()).withColumn("_b", F.input_file_block_start())
    except AnalysisException:  # of several sources no file is known
        at = df.withColumn("_f", F.lit("")).withColumn("_b", F.lit(-1).cast("long"))
    return at.withColumn("_m", F.monotonically_increasing_id())


def _natural(path: str) -> list:
    """Numbers in a path by size, as part-100000 comes after part-99999."""
    return [int(x) if k % 2 else x for k, x in enumerate(re.split(r"([0-9]+)", path))]


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """_seq from 0 in file order, or in the given order. Two passes: counts per part, then offsets; no single task.

    Files are packed into partitions by size, so parts of files are put in order by path and place. Ranges are drawn from a
    sample that is another one in each run, so what is sorted is kept, and counted as it is.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_f", F.lit("")).withColumn("_b", F.lit(-1).cast("long")).withColumn("_m", F.monotonically_increasing_id()).persist()
    elif "_m" not in df.columns:
        df = placed(df)
    df = df.withColumn("_p", F.shiftright("_m", 33))
    parts = df.groupBy("_f", "_b", "_p").agg(F.count("*").alias("n"), F.min("_m").alias("first")).collect()  # a row per part
    before, starts = 0, []
    for x in sorted(parts, key=lambda x: (_natural(x["_f"]), x["_b"], x["_p"])):
        starts.append((x["_f"], x["_b"], x["_p"], before - x["first"]))
        before += x["n"]
    if not starts:
        return df.withColumn("_seq", F.lit(0).cast("long")).drop("_f", "_b", "_m", "_p")
    offsets = df.sparkSession.createDataFrame(starts, "_f string, _b long, _p long, _o long")
    out = df.join(F.broadcast(offsets), ["_f", "_b", "_p"])
    return out.withColumn("_seq", F.col("_m") + F.col("_o")).drop("_f", "_b", "_m", "_p", "_o")


def seed_records(df: DataFrame, seed_file_hash: str | None = None, config_hash: str | None = None) -> DataFrame:
    """Records of (instruction, response) rows: stripped, at most 16,384 characters each, sourced."""
    cut = lambda c: F.substring(X.strip(F.col(c)), 1, MAX_CHARS)
    rows = df.where("instruction is not null and response is not null").withColumn("payload", conversation(cut("instruction"), cut("response")))
    rows = rows.withColumn("record_type", F.lit(CONV)).withColumn("source", fields(SOURCE, type=F.lit("seed"), seed_file_hash=F.lit(seed_file_hash)))
    rows = rows.withColumn("lineage", fields(LINEAGE, parent_ids=F.array().cast("array<string>"), operator=F.lit("seed"), round=F.lit(0), depth=F.lit(0)))
    rows = hashed(rows).withColumn("config_hash", F.lit(config_hash)).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = rows.withColumn("lineage", F.col("lineage").withField("root_id", F.col("id")))
    return with_event(as_records(rows), "01_source", "sourced")


def file_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def read_seeds(spark: SparkSession, path: str, config_hash: str | None = None, max_bytes: int | None = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, rejected rows with a reason) of a JSON-lines or CSV file; files beyond max_bytes are an error."""
    local = os.path.isfile(path)
    if local and max_bytes and os.path.getsize(path) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path).withColumn("_bad", F.lit(None).cast("string"))
        missing = {"instruction", "response"} - set(raw.columns)
        if missing:
            raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    else:
        raw = spark.read.schema("instruction string, response string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = numbered(placed(raw.select("instruction", "response", "_bad")).persist())
    blank = lambda c: F.col(c).isNull() | (F.length(X.strip(F.col(c))) == 0)
    why = F.when(F.col("_bad").isNotNull(), "malformed").when(blank("instruction"), "instruction_missing").when(blank("response"), "response_missing")
    tagged = raw.withColumn("reason", why)
    good = tagged.where("reason is null")
    return seed_records(good.select("_seq", "instruction", "response"), file_hash(path) if local else None, config_hash), tagged.where("reason is not null").select("_seq", "reason", "instruction", "response")


def pairs_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, response): user turns that the assistant answers next."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumn("_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
    return nxt.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "response")


def chunk_rows(df: DataFrame, text: Column, size: int = 3000, overlap: int = 300) -> DataFrame:
    """Fixed-size windows of a text column: chunk_idx, char_start, char_end, chunk, word_count; blank chunks use up their index."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    out = df.where(F.length(text) > 0).withColumn("_text", text).select("*", F.posexplode(starts).alias("chunk_idx", "char_start"))
    out = out.withColumn("chunk", X.strip(F.substring("_text", F.col("char_start") + 1, F.lit(size)))).where(F.length("chunk") > 0)
    return out.withColumn("char_end", F.col("char_start") + F.length("chunk")).withColumn("word_count", F.size(X.words(F.col("chunk")))).drop("_text")


def chunk_records(df: DataFrame, doc_id: Column, text: Column, pages: Column | None = None, size: int = 3000, overlap: int = 300) -> DataFrame:
    """Grounded chunk records; a chunk's pages are its document's, 1 to N."""
    n = pages if pages is not None else F.lit(1)
    rows = chunk_rows(df.withColumn("_doc", doc_id.cast("string")).withColumn("_pages", n), text, size, overlap)
    chunk = fields(
        CHUNK, text=F.col("chunk"), doc_id=F.col("_doc"), chunk_idx=F.col("chunk_idx"), page_start=F.lit(1), page_end=F.col("_pages"), char_start=F.col("char_start"), char_end=F.col("char_end"),
        word_count=F.col("word_count"), chunk_strategy=F.lit("fixed"),
    )
    rows = rows.withColumn("payload", F.struct(nulls(CONVERSATION).alias("conversation"), chunk.alias("chunk"))).withColumn("record_type", F.lit(GROUNDED))
    rows = rows.withColumn("id", F.sha2(F.to_json("payload.chunk"), 256)).withColumn("content_hash", F.sha2("chunk", 256))
    rows = rows.withColumn("source", fields(SOURCE, type=F.lit("pdf"), doc_id=F.col("_doc"), chunk_id=F.col("id"), page_start=F.lit(1), page_end=F.col("_pages"), char_start=F.col("char_start"), char_end=F.col("char_end")))
    rows = rows.withColumn("lineage", fields(LINEAGE, root_id=F.col("id"), parent_ids=F.array().cast("array<string>"), operator=F.lit("chunk"), round=F.lit(0), depth=F.lit(0)))
    return with_event(as_records(numbered(rows, "_doc", "chunk_idx") if "_seq" not in rows.columns else rows), "01_source", "sourced")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """path, n_pages, text of PDF files: each page's text stripped, non-empty pages joined by blank lines."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package") from e

    def extract(parts):
        import io

        import pandas as pd
        import pypdf

        for part in parts:
            rows = []
            for p, b in zip(part["path"], part["content"]):
                pages = [(x.extract_text() or "").strip() for x in pypdf.PdfReader(io.BytesIO(b)).pages]
                text = "\n\n".join(x for x in pages if x)
                if not text:
                    raise ValueError(f"{p} holds no text")
                rows.append((p, len(pages), text))
            yield pd.DataFrame(rows, columns=["path", "n_pages", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, "path string, n_pages int, text string")


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Records of a stage artifact at rest, in the order they were written in if it was kept."""
    df = spark.read.parquet(path)
    return from_compat(df if "_seq" in df.columns else numbered(df))


RAW = "plan_index int, seed_id string, generated_text string, prompt_hash string, model string, latency_ms int, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,cost_usd:double>"


def read_raw_responses(spark: SparkSession, path: str) -> DataFrame:
    """Logged answers by plan_index. A cut-off last line is left out; any other malformed line is an error."""
    raw = numbered(spark.read.text(path).where("trim(value) <> ''"))
    parsed = raw.withColumn("r", F.from_json("value", RAW + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})).persist()
    last = parsed.agg(F.max("_seq")).first()[0]
    if parsed.where((F.col("r._bad").isNotNull() | F.col("r.plan_index").isNull()) & (F.col("_seq") != F.lit(last))).limit(1).count():
        raise ValueError(f"{path} has a malformed line before its last")
    good = parsed.where("r._bad is null and r.plan_index is not null")
    return good.select("r.*").drop("_bad").orderBy("plan_index")


def load_yaml(path: str, env: dict[str, str] | None = None) -> dict:
    """YAML (or JSON) with ${NAME} filled from the environment; a name that isn't set is an error."""
    env = dict(os.environ) if env is None else env
    with open(path, encoding="utf-8") as f:
        text = f.read()

    def put(m: re.Match) -> str:
        if m[1] not in env:
            raise ValueError(f"environment variable {m[1]} is not set")
        return env[m[1]]

    text = re.sub(r"\$\{([A-Z0-9_]+)\}", put, text)
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def load_rubric(path: str) -> dict:
    """A rubric with its hash; weights must name exactly the dimensions, verdicts are pass or fail."""
    rubric = load_yaml(path)
    names = [d["name"] for d in rubric["dimensions"]]
    if set(names) != set(rubric["overall_weights"]) or len(set(names)) != len(names):
        raise ValueError("overall_weights must name the dimensions, each once")
    for shot in rubric.get("few_shot", []):
        if shot.get("expected_verdict") not in ("pass", "fail"):
            raise ValueError("expected_verdict must be pass or fail")
    rubric["hash"] = hashlib.sha256(json.dumps(rubric, sort_keys=True).encode()).hexdigest()
    return rubric
