"""Vector operators: most similar seed, pairwise distances, diversity."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.functions import text as X
from loamsift.operators.base import Context, Stage, StageOutput, split
from loamsift.schema import INSTRUCTION, RESPONSE, is_conversation
from loamsift.sources.sinks import batches_of, held

BLOCK = 512  # with 64 numbers a vector, a pair of blocks is half a megabyte
PAIRS = 16  # of blocks in a batch


def packed(df: DataFrame, key: str | None, vector: str) -> DataFrame:
    """Unit vectors in blocks of up to ``BLOCK``: ids (if there is a key), dim and the matrix as one binary value. Null vectors are left out."""
    kind = df.schema[key].dataType.simpleString() if key else "long"

    def full(batches):
        """Blocks of BLOCK rows, whatever the batches; the last one is shorter."""
        rest, n = [], 0
        for batch in batches:
            part = batch.filter(batch.column(1).is_valid())
            rest, n = [*rest, part], n + part.num_rows
            if n >= BLOCK:
                table = pa.Table.from_batches(rest).combine_chunks()
                whole = n - n % BLOCK
                yield from (table.slice(k, BLOCK) for k in range(0, whole, BLOCK))
                rest, n = [x for x in table.slice(whole).to_batches() if x.num_rows], n - whole
        if n:
            yield pa.Table.from_batches(rest)

    def pack(batches):
        for part in full(batches):
            m = np.asarray(part.column(1).to_pylist(), np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays(part.column(0).chunks))
            yield pa.record_batch([ids, pa.array([m.shape[1]]), pa.array([m.tobytes()])], names=["ids", "dim", "block"])

    return df.select(F.col(key) if key else F.lit(0).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(pack, f"ids array<{kind}>, dim long, block binary")


def max_similarity(rows: DataFrame, seeds: DataFrame, key: str, vector: str, seed_vector: str | None = None) -> DataFrame:
    """key, best: each row's largest cosine with any seed.

    The seeds are a query set held against all rows in blocks: both sides are packed into blocks of unit vectors, and a
    pair of blocks is one row of the join and one matrix product; the maximum is aggregated. Neither side has to fit in
    memory. A batch has few pairs, whatever the tables' size, which holds while it runs; so the result is held.
    """

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer()).reshape(-1, batch.column(1)[k].as_py()) for c in (2, 3))
                yield pa.record_batch([batch.column(0)[k].values, pa.array((a @ b.T).max(1))], names=[key, "b"])

    kind = rows.schema[key].dataType.simpleString()
    met = packed(rows, key, vector).join(packed(seeds, None, seed_vector or vector).select(F.col("block").alias("seeds")))
    best = met.select("ids", "dim", "block", "seeds").mapInArrow(compare, f"`{key}` {kind}, b double").groupBy(key).agg(F.max("b").alias("best"))
    with batches_of(rows.sparkSession, PAIRS):
        return held(best)


@dataclass
class SemanticSimilarity(Stage):
    """Generated rows too close to a seed go. Seeds are an input of their own (``Context.seeds``)."""

    threshold: float = 0.9
    name: str = "02h_semantic_similarity_filter"
    action: str = "filtered"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        if ctx.embedder is None or ctx.seeds is None:
            return StageOutput(df)
        text = F.concat_ws("\n", INSTRUCTION, RESPONSE)
        embed = ctx.embedder.column
        rows = df.where(is_conversation() & ~F.col("source.type").eqNullSafe("seed")).select("_seq", embed(text).alias("v"))
        seeds = ctx.seeds.where(is_conversation()).select(embed(text).alias("v"))
        best = max_similarity(ctx.held(rows), ctx.held(seeds), "_seq", "v").select(F.col("_seq").alias("_s"), "best")
        marked = df.join(best, F.col("_seq") == F.col("_s"), "left")
        out = split(marked, self, F.when(F.col("best") > self.threshold, "high_semantic_similarity"), F.concat(F.lit("similarity="), F.round("best", 4).cast("string")))
        return StageOutput(out.kept.drop("_s", "best"), out.dropped.drop("_s", "best"))


def average_distance(df: DataFrame, key: str, vector: str, first: int = 200) -> DataFrame:
    """Mean of 1 - cosine over the pairs of the first rows by key; 0 for fewer than two. At most first ** 2 / 2 pairs."""
    top = df.orderBy(key).limit(first).select(key, vector)
    packed = top.agg(F.sort_array(F.collect_list(F.struct(key, vector))).alias("r"))
    one = packed.select(F.posexplode("r").alias("i", "x"), "r")
    pairs = one.select(F.col("x").getField(vector).alias("a"), F.explode(F.slice("r", F.col("i") + 2, F.lit(first))).alias("y")).select("a", F.col("y").getField(vector).alias("b"))
    norm1 = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    dot = F.aggregate(F.zip_with("a", "b", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    unit = lambda v: F.when(norm1(v) == 0, F.lit(1.0)).otherwise(norm1(v))
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.coalesce(F.avg(1 - dot / (unit(F.col("a")) * unit(F.col("b")))), F.lit(0.0)), 6).alias("avg_distance"))


def entropy(df: DataFrame, label: str, k: int) -> DataFrame:
    """Normalised entropy of the labels' shares over ln k, to 4 digits; null for fewer than two rows."""
    n = df.groupBy(label).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"))
    p = F.col("c") / F.col("t")
    return n.join(total).agg(F.when(F.max("t") >= 2, F.round(-F.sum(p * F.log(p + 1e-10)) / math.log(max(2, k)), 4)).alias("diversity"))


def kmeans_labels(vectors: np.ndarray, k: int, steps: int = 20, seed: int = 0) -> np.ndarray:
    """Lloyd's iterations from seeded rows; an empty cluster takes a random row; stops when labels repeat."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    labels = np.full(len(vectors), -1)
    for _ in range(steps):
        d = (vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1)
        now = d.argmin(1)
        if (now == labels).all():
            break
        labels = now
        for c in range(k):
            own = vectors[labels == c]
            centres[c] = own.mean(0) if len(own) else vectors[rng.integers(len(vectors))]
    return labels


def diversity(df: DataFrame, vector: str) -> DataFrame:
    """k-means with min(50, n) centres, then the entropy of the labels; distributed, by Spark's own KMeans."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    if n < 2:
        return df.sparkSession.sql("select cast(null as double) as diversity")
    k = min(50, n)
    data = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return entropy(KMeans(k=k, maxIter=20, seed=0).fit(data).transform(data), "prediction", k)


def cached_embeddings(rows: DataFrame, cache: DataFrame, embedder, key_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all rows with vectors, the new cache entries): looks up by content key, embeds only what is missing."""
    keyed = rows.withColumn("cache_key", F.concat(F.lit(embedder.prefix), F.sha2(F.col(key_column), 256)))
    hit = keyed.join(cache.select(F.col("cache_key").alias("_k"), F.col("vector").alias("_v")), F.col("cache_key") == F.col("_k"), "left").drop("_k")
    fresh = hit.where("_v is null").dropDuplicates(["cache_key"]).select("cache_key", embedder.column(F.col(key_column)).alias("vector"))
    out = hit.join(fresh.select(F.col("cache_key").alias("_k"), F.col("vector").alias("_n")), F.col("cache_key") == F.col("_k"), "left")
    return out.withColumn("vector", F.coalesce("_v", "_n")).drop("_k", "_v", "_n"), fresh
