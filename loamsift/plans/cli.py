"""python -m loamsift.plans.cli --config FILE [--run-id ID] [--resume] [--dry-run] [--offline]"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Sequence

from loamsift.models import FakeModel, HashEmbedder
from loamsift.plans import config as C
from loamsift.plans.planner import build
from loamsift.plans.runner import Runner


def run_id_of(given: str | None, configured: str | None) -> str:
    return given or configured or str(uuid.uuid4())


def main(argv: Sequence[str] | None = None, spark=None, model=None, embedder=None) -> int:
    p = argparse.ArgumentParser(prog="loamsift", description="Run a curation pipeline.")
    p.add_argument("--config", required=True)
    p.add_argument("--run-id")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--offline", action="store_true", help="answer prompts with the deterministic stand-in")
    a = p.parse_args(argv)
    try:
        config = C.load(a.config)
        root = os.path.dirname(os.path.abspath(a.config))
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.getOrCreate()
        stages = build(spark, config, root)
        if a.dry_run:
            print("\n".join(s.name for s in stages))
            return 0
        if model is None and not a.offline:
            raise ValueError("no model: pass one to main(), or --offline for made-up answers")
        report = Runner(spark, root, config, stages, model or FakeModel(), embedder or HashEmbedder()).run(run_id_of(a.run_id, config["run_id"]), a.resume)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for y in report["stage_yields"]:
        print(f"{y['stage']}: {y['count_in']} -> {y['count_out']} ({y['dropped_count']} dropped, {y['status']})")
    print(f"{report['final_count']} rows in {config['output']['path']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
