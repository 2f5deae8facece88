"""Configuration, planning, running, resuming, the command line; streams; the registered queries against DuckDB."""

from __future__ import annotations

import json
import os

import pytest

from loamsift import catalog, catalog_stages  # noqa: F401 (registers more queries)
from loamsift.models import FakeModel, HashEmbedder
from loamsift.operators.base import Context, Stage, StageOutput
from loamsift.plans import cli, evaluate
from loamsift.plans import config as C
from loamsift.plans.planner import build
from loamsift.plans.runner import Runner
from loamsift.streaming import events
from tests.conftest import SF

BASE = {
    "version": "1", "llm": {"provider": "openai", "model": "m", "api_key": "${TEST_KEY}", "base_url": "https://example.com"}, "executor": {}, "data_source": {"type": "seeds", "path": "seeds.jsonl"},
    "generator": {"type": "prompt_based", "target_count": 6}, "dedup": [{"type": "exact"}, {"type": "near", "num_hashes": 16, "lsh_bands": 4}],
    "filters": {"target_count": 3, "stages": [{"type": "length"}, {"type": "canary", "phrases": ["NOPE"]}, {"type": "length", "min_response_chars": 5}]}, "output": {"format": "chatml", "path": "out/data.jsonl"},
}


@pytest.fixture
def project(tmp_path, monkeypatch):
    monkeypatch.setenv("TEST_KEY", "sk-secret")
    (tmp_path / "seeds.jsonl").write_text("".join(json.dumps({"instruction": f"Describe object {i} in detail", "response": f"It is object {i}, made of wood."}) + "\n" for i in range(3)))
    (tmp_path / "c.yaml").write_text(json.dumps(BASE))
    return tmp_path


def test_config_problems():
    with pytest.raises(C.ConfigError) as e:
        C.resolve({**BASE, "colour": 1, "dedup": {"exact": {}}, "generator": {"type": "evol_instruct", "operators": ["x"]}, "filters": {"stages": [{"type": "magic"}]}})
    text = str(e.value)
    for part in ("colour: unknown", "dedup: must be a list", "generator.rounds", "no such operator x", "filters.target_count", "filters.stages[0].type"):
        assert part in text
    ok = C.resolve(BASE)
    assert ok["dedup"][1]["jaccard_threshold"] == 0.7 and ok["filters"]["stages"][0]["min_instruction_chars"] == 10 and ok["executor"]["max_workers"] == 4
    assert "api_key" not in C.without_secrets(ok)["llm"]
    pdf = C.resolve({**BASE, "data_source": {"type": "pdf", "path": "x.pdf"}})
    assert pdf["data_source"]["chunk_size_chars"] == 3000


def test_missing_environment(project):
    with pytest.raises(ValueError, match="TEST_KEY"):
        C.load(str(project / "c.yaml"), {})


def test_run_resume_and_failure(spark, project):
    calls = []
    config = C.load(str(project / "c.yaml"))
    stages = build(spark, config, str(project))
    assert [s.name for s in stages] == ["01_source", "02_normalize", "02_generate", "02c_exact_dedup", "02d_near_dedup", "02a_length_filter", "02g_canary_filter", "02a_length_filter_2"]
    report = Runner(spark, str(project), config, stages, FakeModel(), HashEmbedder()).run("r1")
    assert report["status"] == "completed" and report["stage_yields"][2]["count_out"] == 6
    lines = (project / "out/data.jsonl").read_text().splitlines()
    assert len(lines) == report["final_count"] and json.loads(lines[0])["messages"][0]["role"] == "user"
    run = project / "runs/r1"
    assert "sk-secret" not in "".join(p.read_text() for p in run.rglob("*.json")) and (run / "samples.json").exists()

    class Counting(Stage):
        name, action = "09_custom", "filtered"

        def transform(self, df, ctx):
            calls.append(1)
            if len(calls) == 1:
                raise RuntimeError("once")
            return StageOutput(df)

    more = [*build(spark, config, str(project)), Counting()]
    with pytest.raises(RuntimeError):
        Runner(spark, str(project), config, more, FakeModel(), HashEmbedder()).run("r1", resume=True)
    assert json.loads((run / "run_report.json").read_text())["status"] == "failed"
    again = Runner(spark, str(project), config, more, FakeModel(), HashEmbedder()).run("r1", resume=True)
    assert all(y["resumed"] for y in again["stage_yields"][:-1]) and not again["stage_yields"][-1]["resumed"]


def test_command_line(spark, project, capsys):
    assert cli.main(["--config", str(project / "c.yaml"), "--dry-run"], spark=spark) == 0
    assert "02d_near_dedup" in capsys.readouterr().out
    assert cli.main(["--config", str(project / "none.yaml")], spark=spark) == 1
    assert cli.main(["--config", str(project / "c.yaml")], spark=spark) == 1 and "no model" in capsys.readouterr().err
    assert cli.main(["--config", str(project / "c.yaml"), "--offline"], spark=spark) == 0
    assert cli.run_id_of("a", "b") == "a" and cli.run_id_of(None, "b") == "b" and cli.run_id_of(None, None)


def test_runs_compared(spark, project):
    config = C.load(str(project / "c.yaml"))
    runs = []
    for name in ("one", "two"):
        report = Runner(spark, str(project), config, build(spark, config, str(project)), FakeModel(), HashEmbedder()).run(name)
        runs.append(evaluate.metrics(spark, str(project / "out/data.jsonl"), report, HashEmbedder()))
    lines = [json.loads(x)["messages"] for x in (project / "out/data.jsonl").read_text().splitlines()]
    lengths = [len("\n".join(f"{m['role']}: {m['content']}" for m in x)) for x in lines]
    assert runs[0]["final_count"] == len(lines) and runs[0]["text_chars_max"] == max(lengths) and 0 <= runs[0]["avg_pairwise_cosine_distance"] <= 1
    text = evaluate.comparison(runs)
    assert "| number | one | two |" in text and "### two" in text and f"| final_count | {len(lines)} | {len(lines)} |" in text
    empty = project / "none.txt"
    empty.write_text("")
    assert evaluate.metrics(spark, str(empty), {"run_id": "x", "stage_yields": []})["final_count"] == 0


def test_streams_match_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), table.schema, 10)
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("select * from windows").collect())) == sorted(map(str, events.windowed(table).collect()))
    q = events.first_of_key(stream, "event_id").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from firsts").count() == table.select("event_id").distinct().count()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def value(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(value(r[c]) for c in columns) for r in df.collect()]
    if name in catalog.ORACLE_SQL:
        got = duck.execute(catalog.ORACLE_SQL[name])
        order = [c[0] for c in got.description]
        assert sorted(order) == columns
        want = [tuple(value(r[order.index(c)]) for c in columns) for r in got.fetchall()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
