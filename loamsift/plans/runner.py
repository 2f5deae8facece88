"""Runs the stages, keeps each stage's artifact, resumes, and reports."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.operators.aggregates import distribution, elo_distribution
from loamsift.operators.base import Context, Stage
from loamsift.plans import config as C
from loamsift.schema import is_conversation, with_event
from loamsift.sources import readers, sinks

DISTRIBUTIONS = {"03_label_quality": "quality", "02s_label_score": "quality", "02r_reward_score": "reward_model", "02e_ifd_filter": "ifd"}


class State:
    """Runs, stage runs and artifacts of a project, in one JSON file that only the driver writes."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.data: dict[str, Any] = {"runs": {}, "stages": {}}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.data = json.load(f)

    def put(self, table: str, key: str, **values: Any) -> None:
        self.data[table][key] = {**self.data[table].get(key, {}), **values}
        sinks.write_json(self.data, self.path)

    def stage(self, run_id: str, name: str) -> dict[str, Any]:
        return self.data["stages"].get(f"{run_id}/{name}", {})

    def stages_of(self, run_id: str) -> list[dict[str, Any]]:
        return [v for k, v in sorted(self.data["stages"].items()) if k.startswith(f"{run_id}/")]


class Runner:
    def __init__(self, spark: SparkSession, root: str, config: dict[str, Any], stages: list[Stage], model: object = None, embedder: object = None) -> None:
        self.spark, self.root, self.config, self.stages, self.model, self.embedder = spark, root, config, stages, model, embedder
        self.hash = C.config_hash(config)

    def run(self, run_id: str | None = None, resume: bool = False, rows: DataFrame | None = None) -> dict[str, Any]:
        """The run's report. A failing stage is recorded, the report still written, and the error raised again."""
        run_id = run_id or self.config.get("run_id") or str(uuid.uuid4())
        folder = os.path.join(self.root, "runs", run_id)
        state = State(os.path.join(self.root, "state.json"))
        state.put("runs", run_id, status="running", config_hash=self.hash, started=time.time())
        sinks.write_json(C.without_secrets(self.config), f"{folder}/config.resolved.json")
        reports: list[dict[str, Any]] = []
        upstream, seeds, parents = self.hash, None, None
        df = rows
        try:
            for stage in self.stages:
                path = f"{folder}/stages/{stage.name}"
                known = state.stage(run_id, stage.name)
                upstream = hashlib.sha256(f"{upstream}/{stage.name}".encode()).hexdigest()
                if resume and known.get("status") in ("completed", "resumed") and known.get("upstream") == upstream and os.path.exists(f"{path}/data/_SUCCESS"):
                    df = readers.read_stage(self.spark, f"{path}/data")
                    report = {**known["report"], "status": "resumed", "resumed": True}
                else:
                    started = time.time()
                    before = None if df is None else df.count()
                    ctx = Context(self.model, self.embedder, seeds, parents, self.holder(path), self.hash)
                    out = stage.transform(df, ctx)
                    kept = with_event(out.kept, stage.name, stage.action) if stage.name != "01_source" else out.kept
                    sinks.write_stage(kept, path, out.dropped, out.extras.get("clusters"), write_empty=False)
                    df = readers.read_stage(self.spark, f"{path}/data")
                    report = self.report(stage, before, df, out, path) | {"seconds": round(time.time() - started, 3)}
                    sinks.write_json(report, f"{path}/stats.json")
                state.put("stages", f"{run_id}/{stage.name}", status=report["status"], upstream=upstream, path=path, report=report)
                reports.append(report)
                if stage.name in ("01_source", "02_normalize"):
                    seeds = df
                parents = df if parents is None else parents.unionByName(df)
            count = sinks.export_file(df, os.path.join(self.root, self.config["output"]["path"]), self.config["output"]["format"])
            state.put("runs", run_id, status="completed", finished=time.time())
            return self.finish(folder, run_id, reports, df, count, None)
        except Exception as e:
            state.put("stages", f"{run_id}/{stage.name}", status="failed", error=str(e)[:2000])
            state.put("runs", run_id, status="failed", finished=time.time())
            self.finish(folder, run_id, reports, None, 0, f"{stage.name}: {e}")
            raise

    def holder(self, path: str):
        """Writes a frame under the stage's folder and reads it back: models run once, and lost executors cost nothing."""
        count = [0]

        def hold(df: DataFrame) -> DataFrame:
            count[0] += 1
            df.write.mode("overwrite").parquet(f"{path}/held/{count[0]}")
            return self.spark.read.parquet(f"{path}/held/{count[0]}")

        return hold

    def report(self, stage: Stage, before: int | None, df: DataFrame, out, path: str) -> dict[str, Any]:
        reasons: dict[str, int] = {}
        if os.path.exists(f"{path}/dropped"):
            rows = self.spark.read.parquet(f"{path}/dropped").groupBy("drop_reason").count().collect()
            reasons = {r["drop_reason"]: r["count"] for r in rows}
        n = df.count()
        base = stage.name.rsplit("_", 1)[0] if stage.name.rsplit("_", 1)[-1].isdigit() and not stage.name.startswith(("03_evol", "04_evol")) else stage.name
        report: dict[str, Any] = {"stage": stage.name, "status": "completed", "resumed": False, "count_in": n if before is None else before, "count_out": n, "dropped_count": sum(reasons.values()), "drop_reasons": reasons, **out.stats}
        if base in DISTRIBUTIONS:
            field = DISTRIBUTIONS[base]
            d = distribution(df.where(is_conversation()), F.col(f"scores.{field}")).first()
            key = {"quality": "quality_distribution", "reward_model": "reward_distribution", "ifd": "ifd_distribution"}[field]
            report |= {key: {k: d[k] for k in ("mean", "std", "min", "max")} if d and d["n"] else None, "scored_count": d["n"] if d else 0}
        if base == "02s_complexity_elo":
            report["complexity_elo_distribution"] = elo_distribution(df, F.col("scores.complexity_elo")).first().asDict()
        if os.path.exists(f"{path}/clusters"):
            report["cluster_count"] = self.spark.read.parquet(f"{path}/clusters").count()
        return report

    def finish(self, folder: str, run_id: str, reports: list[dict[str, Any]], df: DataFrame | None, count: int, error: str | None) -> dict[str, Any]:
        reasons: dict[str, int] = {}
        for r in reports:
            for k, v in r["drop_reasons"].items():
                reasons[k] = reasons.get(k, 0) + v
        quality = [r["quality_distribution"] for r in reports if r.get("quality_distribution")]
        costs = [r["cost_usd"] for r in reports if r.get("cost_usd") is not None]
        report = {
            "run_id": run_id, "status": "failed" if error else "completed", "error": error, "config_hash": self.hash, "final_count": count, "drop_reasons": reasons,
            "stage_yields": [{k: r.get(k) for k in ("stage", "count_in", "count_out", "dropped_count", "status", "resumed")} for r in reports],
            "stage_drop_reasons": {r["stage"]: r["drop_reasons"] for r in reports if r["drop_reasons"]},
            "quality_distribution": quality[-1] if quality else None, "cost_usd": round(sum(costs), 6) if costs else None, "canaries": self.canaries(folder),
        }
        sinks.write_json(report, f"{folder}/run_report.json")
        sinks.write_json({"run_id": run_id, "config_hash": self.hash, "stages": [r["stage"] for r in reports], "output": self.config["output"]["path"]}, f"{folder}/manifest.json")
        if df is not None:
            sinks.write_json(sample(df), f"{folder}/samples.json")
        return report

    def canaries(self, folder: str) -> dict[str, Any]:
        """The rubric's first passing and first failing example by their weighted scores; ``pass`` if the bad one is lower."""
        path = f"{folder}/canaries.json"
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        found: dict[str, Any] = {}
        for stage in self.stages:
            rubric = getattr(stage, "rubric", None)
            if rubric:
                total = lambda s: round(sum(s["scores"].get(k, 0) * w for k, w in rubric["overall_weights"].items()), 4)  # noqa: B023, E731
                good = next((total(s) for s in rubric.get("few_shot", []) if s["expected_verdict"] == "pass"), None)
                bad = next((total(s) for s in rubric.get("few_shot", []) if s["expected_verdict"] == "fail"), None)
                if good is not None and bad is not None:
                    found = {"known_good": good, "known_bad": bad, "status": "pass" if bad < good else "warn"}
        sinks.write_json(found, path)
        return found


def sample(df: DataFrame, n: int = 20, seed: int = 0) -> list[dict[str, Any]]:
    """At most n payloads, chosen by their place in the order with a seeded generator."""
    total = df.count()
    at = list(range(total)) if total <= n else random.Random(seed).sample(range(total), n)
    rows = readers.numbered(df.withColumnRenamed("_seq", "_s"), "_s").where(F.col("_seq").isin(at)).select("_seq", F.to_json("payload").alias("p")).collect()
    by = {r["_seq"]: json.loads(r.p) for r in rows}
    return [by[i] for i in at if i in by]
