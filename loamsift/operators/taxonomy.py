"""Taxonomies as edge tables, and how much of one a set of rows covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.sources.readers import load_yaml


def check_bundle(bundle: dict) -> dict:
    """Unique factors, unique siblings, strategies that name known factors; a default strategy over all if none is given."""
    names = [f["name"] for f in bundle["factors"]]
    if len(set(names)) != len(names):
        raise ValueError("factor names must differ")

    def siblings(node: dict) -> None:
        kids = [c["name"] for c in node.get("children") or []]
        if len(set(kids)) != len(kids):
            raise ValueError(f"children of {node['name']} must differ")
        for c in node.get("children") or []:
            siblings(c)

    for f in bundle["factors"]:
        siblings(f["root"])
    bundle.setdefault("strategies", [{"name": "default", "include_factors": names}])
    for s in bundle["strategies"]:
        unknown = sorted(set(s["include_factors"]) - set(names))
        if unknown:
            raise ValueError(f"strategy {s['name']} names unknown factors {unknown}")
    return bundle


def load_taxonomy(path: str) -> dict:
    return check_bundle(load_yaml(path))


def edges(spark: SparkSession, bundle: dict) -> DataFrame:
    """factor, depth (1 below the root), path, node."""
    rows: list[tuple] = []

    def walk(factor: str, node: dict, above: list[str]) -> None:
        for c in node.get("children") or []:
            path = [*above, c["name"]]
            rows.append((factor, len(path), path, c["name"]))
            walk(factor, c, path)

    for f in bundle["factors"]:
        walk(f["name"], f["root"], [])
    return spark.createDataFrame(rows, "factor string, depth int, path array<string>, node string")


def visited(rows: DataFrame, tree: DataFrame, nodes: str = "nodes") -> tuple[DataFrame, DataFrame]:
    """(covered, unknown): each row's paths as far as they exist, and the first node of each that doesn't.

    rows: a map factor -> path. Prefixes are looked up by (factor, path) in the edge table.
    """
    each = rows.select(F.explode(nodes).alias("factor", "path")).groupBy("factor", "path").agg(F.count("*").alias("n"))
    prefixes = each.where(F.size("path") > 0).select("factor", "n", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
    prefixes = prefixes.withColumn("prefix", F.slice("path", F.lit(1), F.col("depth")))
    t = tree.select(F.col("factor").alias("tf"), F.col("path").alias("tp"), "node")
    found = prefixes.join(t, (F.col("factor") == F.col("tf")) & (F.col("prefix") == F.col("tp")), "left")
    covered = found.where("tf is not null").select("factor", "depth", "node", "n")
    missing = found.where("tf is null").groupBy("factor", "path").agg(F.min("depth").alias("depth"), F.first("n").alias("n"))
    return covered, missing.select("factor", "depth", F.element_at("path", F.col("depth")).alias("node"), "n")


def coverage(rows: DataFrame, tree: DataFrame, nodes: str = "nodes") -> tuple[DataFrame, DataFrame]:
    """(by factor and level: covered, total, ratio; by level: mean ratio over the factors that have it)."""
    covered, _ = visited(rows, tree, nodes)
    seen = covered.groupBy("factor", "depth").agg(F.countDistinct("node").alias("covered"))
    total = tree.groupBy("factor", "depth").agg(F.countDistinct("node").alias("total"))
    per = total.join(seen, ["factor", "depth"], "left").select("factor", "depth", F.coalesce("covered", F.lit(0)).alias("covered"), "total")
    per = per.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 6))
    return per, per.groupBy("depth").agg(F.round(F.avg(F.col("covered") / F.col("total")), 6).alias("coverage"))
