"""Report aggregates, text statistics and the order-dependent Elo fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_reasons(dropped: DataFrame) -> DataFrame:
    last = F.element_at("stage_events", -1)
    return dropped.groupBy(last["stage"].alias("stage"), last["reason_code"].alias("reason")).agg(F.count("*").alias("n_rows"))


def distribution(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Mean, population standard deviation (0 for one value), least and largest, to 4 digits."""
    v = value.cast("double")
    return df.where(value.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max")
    )


def elo_distribution(df: DataFrame, value: Column) -> DataFrame:
    return df.where(value.isNotNull()).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.when(F.count("*") > 1, F.stddev_samp(value)).alias("stdev")
    )


def cost(df: DataFrame, value: Column) -> DataFrame:
    """Sum of the known costs to 6 digits; null if none is known."""
    return df.agg(F.round(F.sum(value), 6).alias("cost_usd"))


def text_stats(df: DataFrame, text: Column, *by: str) -> DataFrame:
    n = F.length(text)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 4).alias("mean_chars"), F.median(n).alias("median_chars"))


def stage_yields(parts: list[tuple[str, DataFrame, DataFrame | None]]) -> DataFrame:
    """(stage, kept, dropped) -> stage, count_in, count_out, dropped_count, one aggregate per frame."""
    rows = None
    for i, (stage, kept, gone) in enumerate(parts):
        one = kept.agg(F.count("*").alias("count_out")).join(gone.agg(F.count("*").alias("dropped_count")) if gone is not None else kept.sparkSession.range(1).select(F.lit(0).cast("long").alias("dropped_count")))
        one = one.select(F.lit(i).alias("stage_idx"), F.lit(stage).alias("stage"), (F.col("count_out") + F.col("dropped_count")).alias("count_in"), "count_out", "dropped_count")
        rows = one if rows is None else rows.unionAll(one)
    return rows


def pairs_of_ranked(df: DataFrame, batch: str, ranked: str) -> DataFrame:
    """Ordered pairs i < j of each ranked batch: batch, i, j, winner, loser."""
    first = df.select(batch, ranked, F.posexplode(ranked).alias("i", "winner"))
    both = first.select(batch, "i", "winner", F.posexplode(ranked).alias("j", "loser"))
    return both.where("i < j").select(batch, "i", "j", "winner", "loser")


def elo_fold(pairs: DataFrame, batch: str = "batch", k: float = 32.0, start: float = 400.0) -> DataFrame:
    """Ratings after all pairs in order (batch, i, j): id, elo to 2 digits.

    Every update depends on the one before it, so this is sequential by definition: one task reads the ordered pairs as
    a stream of batches and holds a number per rated row.
    """
    import pyarrow as pa

    ordered = pairs.orderBy(batch, "i", "j").select("winner", "loser").coalesce(1)

    def fold(batches):
        rating: dict = {}
        for part in batches:
            for w, lo in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = rating.get(w, start), rating.get(lo, start)
                gain = k * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
                rating[w], rating[lo] = a + gain, b - gain
        yield pa.record_batch([pa.array(list(rating.keys()), pa.string()), pa.array([round(x, 2) for x in rating.values()], pa.float64())], names=["id", "elo"])

    return ordered.select(F.col("winner").cast("string"), F.col("loser").cast("string")).mapInArrow(fold, "id string, elo double")
