"""What a run produced, in numbers, and several runs side by side."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.operators.aggregates import text_stats
from loamsift.operators.similarity import average_distance
from loamsift.sources import readers

FIRST = 200  # rows whose pairs are compared


def export_text(line: Column) -> Column:
    """Readable text of an exported line: ``role: content`` for each message, else instruction and response, else the line."""
    m = F.from_json(line, "struct<messages:array<struct<role:string,content:string>>,instruction:string,response:string>")
    turns = F.array_join(F.transform(m["messages"], lambda x: F.concat(F.coalesce(x["role"], F.lit("?")), F.lit(": "), F.coalesce(x["content"], F.lit("")))), "\n")
    i, r = F.coalesce(m["instruction"], F.lit("")), F.coalesce(m["response"], F.lit(""))
    return F.when(m["messages"].isNotNull(), turns).when((i != "") | (r != ""), F.concat(i, F.lit("\n"), r)).otherwise(line)


def metrics(spark: SparkSession, export: str, report: dict[str, Any], embedder: Any = None, name: str | None = None) -> dict[str, Any]:
    """Rows, text lengths, mean cosine distance of the first rows (null without an embedder) and the stages' counts."""
    lines: DataFrame = readers.numbered(spark.read.text(export).where("trim(value) <> ''")).withColumn("text", export_text(F.col("value")))
    s = text_stats(lines, F.col("text")).first()
    apart = None
    if embedder is not None:
        apart = average_distance(lines.withColumn("v", embedder.column(F.col("text"))), "_seq", "v", FIRST).first()["avg_distance"]
    out: dict[str, Any] = {"name": name or report["run_id"], "export": export, "final_count": s["n"], "avg_pairwise_cosine_distance": apart}
    if s["n"]:
        out |= {f"text_chars_{k}": s[f"{k}_chars"] for k in ("min", "max", "mean", "median")}
    reasons = report.get("stage_drop_reasons", {})
    out["stages"] = {y["stage"]: {**{k: y[k] for k in ("count_in", "count_out", "dropped_count")}, "drop_reasons": reasons.get(y["stage"], {})} for y in report["stage_yields"]}
    return out


def table(head: list[str], rows: list[list[Any]]) -> str:
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows])


def comparison(runs: list[dict[str, Any]]) -> str:
    """Markdown: headline numbers, yields by stage and drop reasons of each run."""
    names = [m["name"] for m in runs]
    shown = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else v
    heads = ("final_count", "avg_pairwise_cosine_distance", "text_chars_min", "text_chars_median", "text_chars_max")
    stages = sorted({s for m in runs for s in m["stages"]})
    flow = lambda s: f"{s['count_in']} to {s['count_out']}, {s['dropped_count']} dropped" if s else "-"
    parts = ["# Runs compared", table(["number", *names], [[h, *(shown(m.get(h)) for m in runs)] for h in heads]), "## Stages", table(["stage", *names], [[s, *(flow(m["stages"].get(s)) for m in runs)] for s in stages]), "## Drop reasons"]
    for m in runs:
        lost = [f"- {s}, {why}: {n}" for s, v in sorted(m["stages"].items()) for why, n in sorted(v["drop_reasons"].items())]
        parts.append("\n".join([f"### {m['name']}", *(lost or ["- none"])]))
    return "\n\n".join(parts) + "\n"
