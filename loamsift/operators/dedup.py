"""Exact and near dedup that keep the first row, and their clusters."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.functions import digests
from loamsift.functions import text as X
from loamsift.operators.base import Context, Stage, StageOutput, split
from loamsift.schema import INSTRUCTION

GROUP = 2048  # nodes of a block that are compared with each other


def first_seen(df: DataFrame, key: str, seq: str = "_seq", value: str = "id") -> DataFrame:
    """Adds _first (value of the key's first row) and _repeat. An aggregate and a join: a hot key is never one window."""
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min_by(value, seq).alias("_first"), F.min(seq).alias("_at"))
    out = df.join(first, F.col(key).eqNullSafe(F.col("_k")))
    return out.withColumn("_repeat", F.col(seq) > F.col("_at")).drop("_k", "_at")


def clusters(df: DataFrame, representative: Column, seq: str = "_seq", value: str = "id") -> DataFrame:
    """Clusters of two and more: cluster_id, representative_id, member_count, member_ids_json in order of _seq."""
    grouped = df.groupBy(representative.alias("representative_id")).agg(F.count("*").alias("member_count"), F.sort_array(F.collect_list(F.struct(seq, value))).alias("m"))
    members = F.to_json(F.transform("m", lambda x: x[value]))
    return grouped.where("member_count >= 2").select(F.sha2("representative_id", 256).alias("cluster_id"), "representative_id", "member_count", members.alias("member_ids_json"))


@dataclass
class ExactDedup(Stage):
    name: str = "02c_exact_dedup"
    action: str = "deduplicated"

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        marked = first_seen(df, "content_hash")
        out = split(marked, self, F.when(F.col("_repeat"), "exact_duplicate"), F.concat(F.lit("duplicate_of="), F.col("_first")))
        extra = clusters(marked, F.col("_first"))
        return StageOutput(out.kept.drop("_first", "_repeat"), out.dropped.drop("_first", "_repeat"), {"clusters": extra})


def signatures(df: DataFrame, text: Column, shingle: int, hashes: int, hash_name: str) -> DataFrame:
    """_seq, sig for rows with tokens. The generator between keeps the planner from computing the shingles once per hash."""
    sh = df.select("_seq", F.explode(F.array(X.shingles(X.tokens(text), shingle))).alias("s")).where(F.size("s") > 0)
    return sh.select("_seq", X.minhash(F.col("s"), hashes, hash_name).alias("sig"))


def packed(sigs: DataFrame) -> DataFrame:
    """Signatures of hexadecimal strings as 8 bytes a hash."""
    return sigs.withColumn("sig", F.unhex(F.array_join(F.transform("sig", lambda x: F.lpad(x, 16, "0")), "")))


def near_edges(sigs: DataFrame, n_bands: int, hashes: int, threshold: float) -> DataFrame:
    """(a, b), a < b, for distinct signatures that share a band and agree in at least the threshold.

    Equal signatures are one node (their first row), so copies don't multiply pairs. Of a band's groups only those of two
    and more get the signatures; large ones are cut into pairs of blocks. A pair is given by its first band alone, so
    pairs are never shuffled. Hashes beyond bands x rows are in no band.
    """
    rows = hashes // n_bands
    nodes = sigs.groupBy("sig").agg(F.min("_seq").alias("node"))
    part = lambda b: F.xxhash64(F.lit(b), F.substring("sig", 8 * rows * b + 1, 8 * rows))
    keyed = nodes.select("node", F.posexplode(F.array(*[part(b) for b in range(n_bands)])).alias("band", "key"))
    many = keyed.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = keyed.join(many, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = met.select("key", "band", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(nodes, "node")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "band", "node")

    def edges(node: np.ndarray, band: int, block: np.ndarray, sig: np.ndarray):
        """Of one cell: pairs within a block, or between two."""
        lone = block.min() == block.max()
        for k in range(len(node) - 1):
            rest = np.arange(k + 1, len(node))
            rest = rest if lone else rest[block[rest] != block[k]]
            same = sig[rest] == sig[k]
            near = np.flatnonzero(same.sum(1) / hashes >= threshold)
            whole = same[near, : rows * n_bands].reshape(-1, n_bands, rows).all(2)
            found = node[rest[near[whole.any(1) & (whole.argmax(1) == band)]]]
            if len(found):
                yield pa.record_batch([np.minimum(found, node[k]), np.maximum(found, node[k])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            columns = [now[c].to_numpy() for c in ("key", "i", "j", "band")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            starts = np.concatenate(([0], cut)).tolist()
            for start, end in zip(starts, starts[1:]):
                yield from compared(now.slice(start, end - start))
            held = now.slice(starts[-1])
        if held is not None:
            yield from compared(held)

    def compared(cell: pa.Table):
        if cell.num_rows > 1 and (cell["i"][0].as_py() == cell["j"][0].as_py() or len(set(cell["block"].to_pylist())) > 1):
            sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint64).reshape(cell.num_rows, hashes)
            block = cell["block"].to_numpy() if cell["i"][0].as_py() != cell["j"][0].as_py() else np.zeros(cell.num_rows, int)
            yield from edges(cell["node"].to_numpy(), cell["band"][0].as_py(), block, sig)

    return cells.mapInArrow(run, "a long, b long")


def greedy(nodes: DataFrame, edges: DataFrame, hold) -> DataFrame:
    """node, kept, by: what a scan in order that compares each row with the rows kept so far would decide.

    In rounds: a row with a kept earlier neighbour goes, citing the lowest; a row whose earlier neighbours are all gone
    stays. Each round is held, so plans don't grow.
    """
    state = hold(nodes.select("node", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast("long").alias("by")))
    while state.where("kept is null").limit(1).count():
        near = edges.join(state.select(F.col("node").alias("a"), F.col("kept").alias("ka")), "a")
        seen = near.groupBy("b").agg(F.min(F.when(F.col("ka"), F.col("a"))).alias("low"), F.count_if(F.col("ka").isNull()).alias("open"), F.min(F.when(F.col("ka").isNull(), F.col("a"))).alias("low_open"))
        out = state.join(seen, F.col("node") == F.col("b"), "left")
        sure = F.col("low").isNotNull() & (F.col("low_open").isNull() | (F.col("low_open") > F.col("low")))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(sure, False).when(F.col("low").isNull() & (F.coalesce("open", F.lit(0)) == 0), True)
        by = F.when(F.col("by").isNotNull(), F.col("by")).when(F.col("kept").isNull() & sure, F.col("low"))
        state = hold(out.select("node", now.alias("kept"), by.alias("by")))
    return state


def candidates(texts: DataFrame, shingle: int, sketched: bool, hold) -> tuple[DataFrame, DataFrame]:
    """(_seq, _class) of rows with tokens, a class being the first row of equal tokens, and (_seq, label) of classes to sign.

    With sketches these are the classes that share a band of cheap minima with another; without, all. Rows of a label
    (mostly a cluster's first row) have shingles in common.
    """

    def sketch(batches):
        for batch in batches:
            keep = [k for k, t in enumerate(batch.column("t").to_pylist()) if t]
            rows = [(batch.column("_seq")[k].as_py(), batch.column("t")[k].as_py().encode()) for k in keep]
            for own in digests.parts_of([t for _, t in rows]):
                seqs, few = zip(*rows[own])
                keys = list(digests.band_keys(few, shingle)) if sketched else [[]] * len(few)
                yield pa.record_batch([pa.array(seqs, pa.int64()), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in few], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_seq", "th", "keys"])

    marked = hold(texts.mapInArrow(sketch, "_seq long, th binary, keys array<long>"))
    classes = marked.groupBy("th").agg(F.min("_seq").alias("_class"))
    members = marked.select("_seq", "th").join(classes, "th").select("_seq", "_class")
    if not sketched:
        return members, classes.select(F.col("_class").alias("_seq"), F.col("_class").alias("label"))
    keyed = marked.join(classes.select(F.col("_class").alias("_seq")), "_seq").select("_seq", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("_seq").alias("low"), F.max("_seq").alias("high")).where("low < high").select("key", "low")
    return members, keyed.join(shared, "key").groupBy("_seq").agg(F.min("low").alias("label"))


def digested(texts: DataFrame, shingle: int, hashes: int, hash_name: str) -> DataFrame:
    """_seq and packed signature of (_seq, t, label); rows of a label stand together, so what they share is digested once."""
    if hash_name != "sha256":
        sh = texts.select("_seq", F.explode(F.array(X.shingles(F.split("t", " "), shingle))).alias("s"))
        return packed(sh.select("_seq", X.minhash(F.col("s"), hashes, hash_name).alias("sig")))
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def sign(batches):
        for batch in batches:
            rows = [t.encode() for t in batch.column("t").to_pylist()]
            for own in digests.parts_of(rows):
                sigs = digests.minima(rows[own], shingle, hashes)
                yield pa.record_batch([batch.column("_seq").slice(own.start, own.stop - own.start), pa.array([x.tobytes() for x in np.ascontiguousarray(sigs)], pa.binary())], names=["_seq", "sig"])

    return texts.repartitionByRange(tasks, "label", "_seq").sortWithinPartitions("label", "_seq").select("_seq", "t").mapInArrow(sign, "_seq long, sig binary")


@dataclass
class NearDedup(Stage):
    """MinHash over token shingles of the instruction, banded; kept rows are those a greedy scan in order would keep."""

    shingle_size: int = 5
    num_hashes: int = 128
    lsh_bands: int = 16
    jaccard_threshold: float = 0.7
    hash_name: str = "sha256"
    name: str = "02d_near_dedup"
    action: str = "deduplicated"

    def __post_init__(self) -> None:
        if not 1 <= self.lsh_bands <= self.num_hashes:
            raise ValueError("lsh_bands must be between 1 and num_hashes")

    def transform(self, df: DataFrame, ctx: Context) -> StageOutput:
        hold = ctx.hold or (lambda x: x.persist())
        tokens = F.array_join(X.tokens(F.col(INSTRUCTION)), " ")
        texts = hold(df.where(F.col(INSTRUCTION).isNotNull()).select("_seq", tokens.alias("t")))
        members, likely = candidates(texts, self.shingle_size, digests.sketches_suffice(self.num_hashes, self.jaccard_threshold), hold)
        sigs = hold(digested(texts.join(likely, "_seq"), self.shingle_size, self.num_hashes, self.hash_name))
        edges = hold(near_edges(sigs, self.lsh_bands, self.num_hashes, self.jaccard_threshold))
        nodes = sigs.groupBy("sig").agg(F.min("_seq").alias("node"))
        state = greedy(nodes, edges, hold)
        found = sigs.join(nodes, "sig").join(state, "node").select(F.col("_seq").alias("_class"), F.when(F.col("kept"), F.col("node")).otherwise(F.col("by")).alias("_found"))
        rows = members.join(found, "_class", "left").select(F.col("_seq").alias("_s"), F.coalesce("_found", "_class").alias("_rep"))
        ids = df.select(F.col("_seq").alias("_s2"), F.col("id").alias("_rep_id"))
        marked = df.join(rows, F.col("_seq") == F.col("_s"), "left").join(ids, F.col("_rep") == F.col("_s2"), "left")
        out = split(marked, self, F.when(F.col("_rep") != F.col("_seq"), "near_duplicate_minhash"), F.concat(F.lit("duplicate_of="), F.col("_rep_id")))
        gone = ["_s", "_rep", "_s2", "_rep_id"]
        return StageOutput(out.kept.drop(*gone), out.dropped.drop(*gone), {"clusters": clusters(marked.where("_rep is not null"), F.col("_rep_id"))})
