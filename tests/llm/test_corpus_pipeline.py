"""Each stage of the pipeline against a brute-force version, on what its predecessor kept."""

from __future__ import annotations

import collections
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loamsift.llm import mixing, toxicity
from loamsift.llm.kernel import written
from tests.conftest import SF
from tests.llm.data import SCHEMA, messy
from tests.llm.test_operators import WORD, naive_lines, naive_near, texts

D = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], D), "step"))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "mixing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and steps[-1].columns == [*steps[0].columns, "copy"]


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = toxicity.fit(steps[0], labels)
    slots = toxicity.Slots()
    w, b = model
    want = {i for i, t in texts(steps[0]) if 1 / (1 + math.exp(-(float(w[toxicity.features(t, slots)].sum()) + b))) < toxicity.CUT}
    assert {i for i, _ in texts(steps[1])} == want and 0 < len(want) < steps[0].count()


def test_passages_go(steps):
    rows = [(r.doc_id, r.text, r.h) for r in steps[1].select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    cut = naive_lines(rows, short=True)
    want = {i: cut[i, t] for i, t, _ in rows if cut[i, t] == t or WORD.search(cut[i, t])}
    assert dict(texts(steps[2])) == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_group_stays(steps):
    rows = texts(steps[2])
    want = sorted(i for (i, n, _, first), k in naive_near(rows).items() if i == first or n == 0)
    assert sorted(i for i, _ in texts(steps[3])) == want and len(want) < len(rows)


def test_leaks_go(spark, steps):
    items = [WORD.findall(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    rows = {i: "\x00".join(WORD.findall(t)) for i, t in texts(steps[3])}
    want = {i for i, t in rows.items() if not any("\x00".join(w[1:-1]) in t for w in items)}
    assert {i for i, _ in texts(steps[4])} == want and len(want) < len(rows)


def test_mix(steps):
    n = {r.doc_id: r.copies for r in mixing.mix(steps[4]).collect() if r.copies}
    assert collections.Counter(i for i, _ in texts(steps[5])) == n
    size = sum(len(WORD.findall(t)) for _, t in texts(steps[4]))
    taken = sum(len(WORD.findall(t)) for _, t in texts(steps[5]))
    assert abs(taken - 1.5 * size) < 0.2 * size


def test_messy_rows(spark, tmp_path):
    for name, df in (("documents", spark.createDataFrame(messy(), SCHEMA)), ("labels", spark.createDataFrame([(1, 1, 1), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, "a benchmark item of some words that nothing in these rows contains at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, str(empty)).count() == 0
