"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Documents are put in order of
size within their source, the expected copies are summed along that order from one random offset per source, and a
document is emitted once for each integer the running sum crosses. Neighbours in that order have like sizes, so the
words taken stay within about the largest document's size of the target.

Defined cases: null text has size 0; a null source is a source, last in order; equal rows are separate documents; an
empty table gives an empty mix; sources of size 0 have target 0; names of extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.llm.kernel import WORD, written
from loamsift.llm.ranks import ranked

SHARE, CAP, WEIGHTS, SEED = 1.5, 2, (3, 1, 2), "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: Column, seed: str) -> Column:
    """A source's random offset in [0, 1): 48 bits of a digest of its name, so that reruns agree."""
    name = F.when(source.isNull(), F.lit(f"{seed}|")).otherwise(F.concat(F.lit(f"{seed}|="), source))
    return F.conv(F.substring(F.sha2(name, 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size) rows -> source, source_size, target.

    Targets are weight x level, with a level that spends share x total; a source whose target passes cap x its size is
    held there, and the level rises for the others until none is above. Each round is one aggregate over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = ranked(per, [], [F.col("source").asc_nulls_last()], "_k")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    per = written(per.withColumn("_w", pick).drop("_k"), "sources")
    spend = share * float(per.agg(F.sum("source_size")).first()[0] or 0)
    left, heavy, held = spend, 0.0, -1
    while True:
        level = F.lit(left) / F.lit(heavy) if heavy else F.lit(0.0)
        above = F.col("_w") * level > cap * F.col("source_size")
        n, taken, w = per.agg(F.count_if(above), F.sum(F.when(above, cap * F.col("source_size"))), F.sum(F.when(~above, F.col("_w")))).first()
        if n == held:
            break
        left, heavy, held = spend - float(taken or 0), float(w or 0), n
    target = F.when(above, (cap * F.col("source_size")).cast("double")).otherwise(F.col("_w") * F.lit(left) / F.lit(heavy or 1.0))
    return per.select("source", "source_size", target.alias("target"))


def copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """rows: doc_id, source, size, _rid (a number of its own for each row) -> also source_size, target, copies."""
    goal = targets(rows, weights, share, cap).withColumnRenamed("source", "_source")
    order = [F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("_rid").asc()]
    at = ranked(rows, ["source"], order, "_k").join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = at.withColumn("_r", rate).withColumn("_u", offset_of(F.col("source"), seed))
    crossed = F.floor((F.col("_k") + 1) * F.col("_r") + F.col("_u")) - F.floor(F.col("_k") * F.col("_r") + F.col("_u"))
    return at.withColumn("copies", F.least(crossed, F.ceil("_r")).cast("long")).drop("_k", "_r", "_u")


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows with a number of their own, written so that the numbers hold whatever is computed again later."""
    return written(docs.select(*[F.col(c) for c in keep], size_of(F.col("text")).alias("size")).withColumn("_rid", F.monotonically_increasing_id()), "numbered")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken (copies x size)."""
    return copies(numbered(docs, "doc_id", "source"), **how).withColumn("taken", F.col("copies") * F.col("size")).drop("_rid")


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, numbered by ``copy``; columns of docs stay."""
    names = [c for c in docs.columns]
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").alias("text"), F.col("doc_id"), F.col("source"))
    kept = [f"c{i}" for i, c in enumerate(names) if c not in ("text", "doc_id", "source")]
    rows = numbered(flat, "doc_id", "source", "text", *kept)
    n = copies(rows.select("doc_id", "source", "size", "_rid"), **how).where("copies > 0").select(F.col("_rid").alias("_r2"), "copies")
    out = rows.join(n.hint("shuffle_hash"), F.col("_rid") == F.col("_r2"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    own = {c: (F.col(c) if c in ("text", "doc_id", "source") else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)}
    return out.select(*own.values(), F.col("_copy").alias("copy" if "copy" not in own else "copy_number"))


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as s from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as k from s),
w as (select *, case k % 3 when 0 then 3 when 1 then 1 else 2 end as w from r),
o as (select *, row_number() over (order by 2.0 * s / w, k) as j from w),
p as (select j, 1.5 * (select sum(s) from o)::double - coalesce(sum(2 * s) over (order by j rows between unbounded preceding and 1 preceding), 0)::double as lft,
             sum(w) over (order by j rows between current row and unbounded following)::double as hvy, s, w from o),
f as (select lft, hvy from p where w * (lft / hvy) <= 2 * s order by j limit 1),
t as (select source, s, case when w * (lft / hvy) > 2 * s then (2 * s)::double else w * lft / hvy end as target,
             ('0x' || substr(sha256(case when source is null then 'mix-1|' else 'mix-1|=' || source end), 1, 12))::bigint / 281474976710656.0 as u from w, f),
n as (select d.*, t.s as source_size, t.target, t.u, case when t.s > 0 then t.target / t.s else 0.0 end as rate,
             row_number() over (partition by d.source order by size, doc_id nulls last) - 1 as k from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (least(floor((k + 1) * rate + u) - floor(k * rate + u), ceil(rate)) * size)::bigint as taken from n
"""
