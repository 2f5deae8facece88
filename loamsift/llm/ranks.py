"""Global ranks and prefix sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.llm.kernel import written


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows from 0 within each group, in the given order, whatever a group's size.

    Rows are range-partitioned by group and order, so a hot group spans many partitions; each partition numbers its
    rows, and the groups' counts per partition (as many rows as partitions and groups together) give the offsets.
    ``order`` should end in a column that tells rows apart, or equal rows share a partition.
    """
    keys = [F.col(g).asc_nulls_last() for g in group] + order
    rows = written(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked",
    )
    per = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).drop("_n", "_low")
    per = per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p2"), "_base")
    on = F.col("_part") == F.col("_p2")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(per, on).withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_p2", "_base", *[f"_g{i}" for i in range(len(group))])
