"""What shows only on larger tables: order over many files, work and memory that stay in proportion."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from loamsift import models
from loamsift.functions import digests
from loamsift.operators import base, dedup, similarity
from loamsift.sources import readers, sinks


def test_numbers_follow_files_whatever_their_sizes(spark, tmp_path):
    """Spark packs the largest parts first."""
    lines = [f"line {k}" for k in range(3000)]
    for name, part in (("part-00000", lines[:1]), ("part-00001", lines[1:2900]), ("part-00002", lines[2900:2990]), ("part-100000", lines[2990:])):
        (tmp_path / f"{name}.txt").write_text("\n".join(part) + "\n")
    got = readers.numbered(spark.read.text(str(tmp_path))).collect()
    assert [r["value"] for r in sorted(got, key=lambda r: r["_seq"])] == lines
    assert sorted(r["_seq"] for r in got) == list(range(3000))


def test_numbers_by_order_are_whole_over_many_ranges(spark):
    """Ranges come from a sample; counting them in one run and numbering in another gave gaps."""
    n = 200_000
    df = spark.range(n, numPartitions=8).selectExpr("id * 7919 % 1000003 as k")
    got = readers.numbered(df, "k").selectExpr("count(distinct _seq) as d", "min(_seq) as low", "max(_seq) as high").first()
    assert (got["d"], got["low"], got["high"]) == (n, 0, n - 1)


def test_salted_minima_are_those_of_hashlib():
    texts = [b"a", b"a b", b"a b c d e f g", b"x" * 200 + b" y", b"a b c d e f g h " + b"z" * 60]
    got = digests.minima(texts, 5, 128)
    for i, text in enumerate(texts):
        words = text.split()
        own = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        for k in range(128):
            assert int(got[i, k]) == min(int.from_bytes(hashlib.sha256(b"%d:" % k + s).digest()[:8]) for s in own)
    many = b" ".join(b"w%d" % (k * 7919 % 100003) for k in range(9000))  # enough for the arrays
    words = many.split()
    want = min(hashlib.sha256(b"12:" + b" ".join(words[k : k + 5])).digest()[:8] for k in range(len(words) - 4))
    assert int(digests.minima([many], 5, 13)[0, 12]) == int.from_bytes(want)


def test_near_dedup_signs_only_what_may_have_a_partner(spark):
    """128 digests a shingle of every text took more than the time limit over 0.1 GB."""
    words = lambda seed, n: [f"w{seed}x{k}" for k in range(n)]
    rows = [(k, " ".join(words(k, 60))) for k in range(200)]
    rows += [(200, " ".join(words(7, 58))), (201, rows[3][1]), (202, ""), (203, None)]
    texts = spark.createDataFrame(rows, "_seq long, t string")
    members, likely = dedup.candidates(texts, 5, digests.sketches_suffice(128, 0.7), lambda x: x.persist())
    assert sorted(r["_seq"] for r in likely.collect()) == [7, 200]
    assert {r["_seq"]: r["_class"] for r in members.collect()} == {k: 3 if k == 201 else k for k in range(202)}
    assert not digests.sketches_suffice(32, 0.03)  # then all are signed


def test_models_and_pairs_of_blocks_get_small_batches(spark, monkeypatch):
    """Python held batches of 10,000 rows: of half a megabyte for pairs of blocks, of lists of numbers for log-probabilities."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    default = spark.conf.get(key)

    def hold(df):
        seen.append(int(spark.conf.get(key)))
        return df

    assert base.Context(hold=hold).held(spark.range(1)).count() == 1
    monkeypatch.setattr(similarity, "held", hold)
    similarity.max_similarity(spark.createDataFrame([(1, [1.0, 0.0])], "k long, v array<double>"), spark.createDataFrame([([1.0, 1.0],)], "v array<double>"), "k", "v")
    assert seen == [500, similarity.PAIRS] and spark.conf.get(key) == default


def test_blocks_are_full_whatever_the_batches(spark):
    df = spark.range(1300, numPartitions=1).selectExpr("id as k", "if(id = 5, null, array(double(id), 1d)) as v")
    with sinks.batches_of(spark, 7):
        got = similarity.packed(df, "k", "v").selectExpr("size(ids) as n", "length(block) as b", "ids").collect()
    assert [(r["n"], r["b"]) for r in got] == [(512, 8192), (512, 8192), (275, 4400)]
    assert [x for r in got for x in r["ids"]] == [k for k in range(1300) if k != 5]


def test_log_probability_is_the_mean_in_order(spark):
    class Numbers:
        def score(self, prompt, response):
            return [float(x) for x in response.split()]

    rows = [("1 2 4",), ("",), ("1e16 1 -1e16",), (None,)]
    df = spark.createDataFrame(rows, "r string")
    got = [r["x"] for r in df.select(models.log_probability(Numbers(), F.lit("p"), F.col("r")).alias("x")).collect()]
    assert got == [2.333333, None, 0.0, None]


def test_near_edges_of_large_groups_in_blocks(spark, monkeypatch):
    """Pairs are given once, by their first band, and no exchange holds pairs with signatures."""
    rng = random.Random(3)
    sigs = [[rng.randrange(3) for _ in range(8)] for _ in range(60)]
    sigs[9] = sigs[4]
    df = spark.createDataFrame([(k, bytearray(b"".join(x.to_bytes(8) for x in s))) for k, s in enumerate(sigs)], "_seq long, sig binary")
    first = {tuple(s): k for k, s in reversed(list(enumerate(sigs)))}
    nodes = sorted(first.values())
    near = lambda a, b: any(a[k : k + 2] == b[k : k + 2] for k in (0, 2, 4)) and sum(x == y for x, y in zip(a, b)) >= 3
    want = [(a, b) for a in nodes for b in nodes if a < b and near(sigs[a], sigs[b][:])]
    bands = lambda: dedup.near_edges(df, 3, 8, 3 / 8)
    assert sorted(map(tuple, bands().collect())) == want
    monkeypatch.setattr(dedup, "GROUP", 3)
    assert sorted(map(tuple, bands().collect())) == want
    plan = bands()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition") and "Deduplicate" not in plan and "Aggregate" not in plan[: plan.index("Repartition")]
