"""Stages on small records with known answers."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loamsift.functions import text as X
from loamsift.models import FakeModel, HashEmbedder, ModelError
from loamsift.operators import aggregates, dedup, filters, generate, scoring, similarity
from loamsift.operators import taxonomy as tax
from loamsift.operators.base import Context
from loamsift.schema import CONV, INSTRUCTION, LINEAGE, RESPONSE, SOURCE, as_records, compat, conversation, fields, from_compat, hashed, with_event
from loamsift.sources import readers, sinks


def records(spark, rows, **scores):
    """(instruction, response) or (instruction, response, id, parents) rows."""
    full = [(i, *r, *(("r%d" % (i + 1),) if len(r) < 3 else ()), *(([],) if len(r) < 4 else ())) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "_seq long, i string, r string, name string, parents array<string>")
    df = df.withColumn("record_type", F.lit(CONV)).withColumn("payload", conversation(F.col("i"), F.col("r")))
    df = df.withColumn("lineage", fields(LINEAGE, parent_ids=F.col("parents"), root_id=F.col("name"))).withColumn("source", fields(SOURCE, type=F.lit("seed")))
    return as_records(hashed(df).withColumn("id", F.col("name")))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def reasons(df):
    return {r.id: (r.e.reason_code, r.e.details) for r in df.select("id", F.element_at("stage_events", -1).alias("e")).collect()}


def test_normalise_and_events(spark):
    df = with_event(records(spark, [("  Say hello ", "\tHello\n")]), "01_source", "sourced")
    out = filters.Normalise().transform(df, Context()).kept
    row = with_event(out, "02_normalize", "transformed").first()
    assert (row.payload.conversation.instruction, row.payload.conversation.response) == ("Say hello", "Hello")
    assert row.content_hash == df.first().content_hash and [e.seq for e in row.stage_events] == [1, 2]


def test_length_bounds_and_first_reason(spark):
    df = records(spark, [("x" * 10, "y" * 10), ("x" * 9, "y"), ("x" * 4097, "y" * 10), ("\U0001f600" * 10, "y" * 9), ("x" * 10, "y" * 16385)])
    out = filters.Length().transform(df, Context())
    assert ids(out.kept) == ["r1"]
    assert {k: v[0] for k, v in reasons(out.dropped).items()} == {"r2": "instruction_too_short", "r3": "instruction_too_long", "r4": "response_too_short", "r5": "response_too_long"}


def test_language(spark):
    df = records(spark, [("hello there", "a"), ("привет как дела", "a"), ("1234 !!", "a"), ("abc привет", "a")])
    assert ids(filters.Language().transform(df, Context()).kept) == ["r1", "r3"]
    assert ids(filters.Language(["de"]).transform(df, Context()).kept) == ["r1", "r2", "r3", "r4"]


def test_sentence_variance(spark):
    df = records(spark, [("i", "Short. A much longer sentence with several extra words. Tiny."), ("i", "Same length here. " * 4), ("i", "no terminator")])
    assert ids(filters.SentenceVariance().transform(df, Context()).kept) == ["r1", "r3"]


def test_canary(spark):
    df = records(spark, [("tell", "the SECRET plan"), ("tell", "the secret plan")])
    out = filters.Canary(["PLAN", "SECRET"]).transform(df, Context())
    assert ids(out.kept) == ["r2"] and reasons(out.dropped) == {"r1": ("canary_leak", "SECRET")}
    assert filters.Canary([]).transform(df, Context()).dropped is None


def test_exact_dedup(spark):
    df = records(spark, [("a", "b"), ("a", "b"), ("c", "d")])
    out = dedup.ExactDedup().transform(df, Context())
    assert ids(out.kept) == ["r1", "r3"] and reasons(out.dropped) == {"r2": ("exact_duplicate", "duplicate_of=r1")}
    c = out.extras["clusters"].collect()
    assert len(c) == 1 and c[0].representative_id == "r1" and c[0].member_count == 2 and json.loads(c[0].member_ids_json) == ["r1", "r2"]


def test_near_dedup(spark):
    base = " ".join(f"word{i}" for i in range(44))
    df = records(spark, [(base, "x"), (base.replace("word40", "other"), "y"), ("quite another short text", "z"), ("", "q")])
    out = dedup.NearDedup().transform(df, Context())
    assert ids(out.kept) == ["r1", "r3", "r4"] and reasons(out.dropped)["r2"] == ("near_duplicate_minhash", "duplicate_of=r1")
    with pytest.raises(ValueError):
        dedup.NearDedup(lsh_bands=200)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_equals_a_scan(spark, seed):
    r = random.Random(seed)
    n = 14
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.2]
    kept, by = [], {}
    for b in range(n):
        near = [a for a in kept if (a, b) in pairs]
        if near:
            by[b] = near[0]
        else:
            kept.append(b)
    state = dedup.greedy(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "a long, b long"), lambda x: spark.createDataFrame(x.collect(), x.schema)).collect()
    assert {s.node for s in state if s.kept} == set(kept) and {s.node: s.by for s in state if not s.kept} == by


def test_semantic_similarity(spark):
    class Table:
        prefix = "t:"

        @staticmethod
        def column(text):
            return F.when(F.contains(text, F.lit("x")), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))

    seeds = records(spark, [("x", "x")])
    made = records(spark, [("x", "x"), ("y", "y")]).withColumn("source", F.col("source").withField("type", F.lit("generated")))
    out = similarity.SemanticSimilarity(0.9).transform(made, Context(embedder=Table, seeds=seeds))
    assert ids(out.kept) == ["r2"] and reasons(out.dropped)["r1"][0] == "high_semantic_similarity"


def test_distribution_and_elo(spark):
    d = aggregates.distribution(spark.createDataFrame([(0.2,), (0.4,), (0.6,)], "v double"), F.col("v")).first()
    assert (d["mean"], d["std"], d["min"], d["max"]) == (0.4, 0.1633, 0.2, 0.6)
    d = aggregates.distribution(spark.createDataFrame([(5.0,), (4.0,), (1.0,)], "v double"), F.col("v")).first()
    assert (d["mean"], d["std"], d["min"], d["max"]) == (3.3333, 1.6997, 1.0, 5.0)
    one = spark.range(1).select(X.elo_updated(F.lit(1300.0), F.lit(1700.0), F.lit(1.0)).alias("a"), X.elo_updated(F.lit(1700.0), F.lit(1300.0), F.lit(0.0)).alias("b")).first()
    assert one.a - 1300 > 16 and abs(one.a + one.b - 3000) < 1e-9


def test_elo_fold_is_in_order(spark):
    r = random.Random(1)
    ranked = [(b, r.sample([f"p{i}" for i in range(9)], 4)) for b in range(20)]
    rating = {}
    for _, x in ranked:
        for i in range(4):
            for j in range(i + 1, 4):
                a, b = rating.get(x[i], 400.0), rating.get(x[j], 400.0)
                g = 32 * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
                rating[x[i]], rating[x[j]] = a + g, b - g
    df = spark.createDataFrame(ranked, "batch long, ranked array<string>").repartition(4)
    got = {x.id: x.elo for x in aggregates.elo_fold(aggregates.pairs_of_ranked(df, "batch", "ranked")).collect()}
    assert got == {k: round(v, 2) for k, v in rating.items()}


def with_scores(df, rows):
    s = df.sparkSession.createDataFrame([(i, q, d) for i, (q, d) in enumerate(rows)], "k long, q double, d map<string,double>")
    return scoring.scored(df.join(s, F.col("_seq") == F.col("k")), quality=F.col("q"), dims=F.col("d")).drop("k", "q", "d")


def test_composite_select(spark):
    df = with_scores(records(spark, [("a", "b")] * 3), [(0.9, {"x": 0.8}), (0.3, {"x": 0.2}), (0.7, {"x": 0.6})])
    out = scoring.CompositeSelect({"quality": 0.5, "x": 0.5}, 2).transform(df, Context())
    assert ids(out.kept) == ["r1", "r3"] and reasons(out.dropped)["r2"][0] == "composite_select"
    df = with_scores(records(spark, [("a", "b")] * 2), [(0.8, None), (0.3, {"x": 0.9})])
    assert ids(scoring.CompositeSelect({"quality": 0.5, "x": 0.5}, 1).transform(df, Context()).kept) == ["r2"]
    tie = with_scores(records(spark, [("a", "b")] * 3), [(0.5, None)] * 3)
    assert ids(scoring.CompositeSelect({"quality": 1.0}, 2).transform(tie, Context()).kept) == ["r1", "r2"]
    assert scoring.CompositeSelect({}, 2).transform(tie, Context()).dropped is None


def test_pair_delta(spark):
    rows = [("a", "b" * 10, "p", []), ("a", "b" * 10, "better", ["p"]), ("a", "b" * 10, "same", ["none", "p"]), ("a", "b", "orphan", ["gone"]), ("a", "b" * 14, "long", ["p"])]
    df = with_scores(records(spark, rows), [(0.3, None), (0.8, None), (0.4, None), (0.1, None), (0.9, None)])
    out = scoring.PairDelta(length_ratio_max=1.3).transform(df, Context())
    assert ids(out.kept) == ["better", "orphan", "p"]
    assert {k: v[0] for k, v in reasons(out.dropped).items()} == {"same": "insufficient_delta", "long": "length_ratio_exceeded"}


RUBRIC = {
    "version": 1, "description": "d", "dimensions": [{"name": n, "scale_min": 1, "scale_max": 5} for n in ("a", "b")], "overall_weights": {"a": 0.4, "b": 0.6},
    "few_shot": [{"instruction": "i", "response": "r", "scores": {"a": 5, "b": 5}, "expected_verdict": "pass"}, {"instruction": "i", "response": "r", "scores": {"a": 1, "b": 1}, "expected_verdict": "fail"}],
}


def answer_scores(messages):
    body = messages[-1]["content"]
    if "broken" in body:
        return "not json"
    if "partial" in body:
        return '{"scores": {"a": 5}}'
    if "denied" in body:
        raise ModelError("auth_error")
    n = 5 if "good" in body else 1
    return f'```json\n{{"scores": {{"a": {n}, "b": {n}}}}}\n```'


def test_label_quality(spark):
    df = records(spark, [("good", "x"), ("bad", "x"), ("broken", "x"), ("partial", "x"), ("denied", "x")])
    df = scoring.scored(df, ifd=F.lit(0.5))
    out = scoring.LabelQuality(RUBRIC, 3.0).transform(df, Context(model=FakeModel(answer_scores)))
    assert ids(out.kept) == ["r1"] and out.kept.first().scores.ifd == 0.5 and out.kept.first().scores.quality == 5.0
    assert {k: v[0] for k, v in reasons(out.dropped).items()} == {"r2": "low_quality_score", "r3": "label_parse_failure", "r4": "label_parse_failure", "r5": "label_auth_failure"}
    assert scoring.LabelScore(RUBRIC).transform(df, Context(model=FakeModel(answer_scores))).kept.count() == 5


def test_double_critic_and_reward(spark):
    def critic(m):
        body = m[-1]["content"]
        wrong = "wrong" in body.split("Response:")[1].split("\n")[1]
        if "crash" in body:
            raise ModelError("retryable")
        asks_faults = "anything wrong" in body
        return json.dumps({"verdict": "yes" if asks_faults == wrong else "no", "reason": "x"})

    df = records(spark, [("q", "fine"), ("q", "wrong")])
    out = scoring.DoubleCritic().transform(df, Context(model=FakeModel(critic)))
    assert ids(out.kept) == ["r1"] and reasons(out.dropped)["r2"][0] == "double_critic_disagreement"
    out = scoring.RewardScore(0.5).transform(df, Context(model=FakeModel(lambda m: "0.9" if m[1]["content"] == "fine" else " 0.1\n")))
    assert ids(out.kept) == ["r1"] and reasons(out.dropped)["r2"][0] == "low_reward_score"
    with pytest.raises(Exception):
        scoring.RewardScore().transform(df, Context(model=FakeModel(lambda m: "n/a"))).kept.collect()


def test_ifd(spark):
    class M(FakeModel):
        def score(self, prompt, response):
            return {("i", "a"): [-0.4], ("", "a"): [-0.8], ("i", "b"): [-1.0], ("", "b"): [-1.1]}[prompt, response]

    out = scoring.Ifd(0.2).transform(records(spark, [("i", "a"), ("i", "b")]), Context(model=M()))
    assert ids(out.kept) == ["r1"] and out.kept.first().scores.ifd == 0.4 and reasons(out.dropped)["r2"] == ("low_ifd", "ifd=0.1")


def test_generators(spark):
    seeds = records(spark, [("one", "1"), ("two", "2")])
    out = generate.PromptGenerator(3, 2).transform(seeds, Context(model=FakeModel()))
    rows = out.kept.orderBy("_seq").collect()
    assert [r.lineage.parent_ids[0] for r in rows] == ["r1", "r2"] * 3 and rows[0].stage_events[-1].action == "generated"
    bad = generate.PromptGenerator(2).transform(seeds, Context(model=FakeModel(lambda m: '{"instruction": "broken"}')))
    assert bad.kept.count() == 0 and {v[0] for v in reasons(bad.dropped).values()} == {"generator_parse_failure"}
    done = spark.createDataFrame([(0, '{"instruction": "kept", "response": "answer"}')], "plan_index long, text string")
    again = generate.PromptGenerator(2, done=done).transform(seeds, Context(model=FakeModel())).kept.orderBy("_seq").collect()
    assert again[0].payload.conversation.instruction == "kept" and len(again) == 2
    t = generate.TransformGenerator(preserve_original=True).transform(seeds, Context(model=FakeModel(lambda m: " NEW ")))
    row = t.kept.orderBy("_seq").first()
    assert row.payload.conversation.response == "NEW" and json.loads(row.payload.conversation.system)["response"] == "1" and row.lineage.round == 1


def test_evol_rounds(spark):
    seeds = records(spark, [("Explain how rivers shape valleys over time", "r")])
    same = generate.EvolRound(1, 1, ["deepen"]).transform(seeds, Context(model=FakeModel(lambda m: "Explain how  rivers shape VALLEYS over time")))
    assert {v[0] for v in reasons(same.dropped).values()} == {"evol_identical_to_parent"} and same.kept.count() == 1
    refusal = generate.EvolRound(1, 1, ["deepen"]).transform(seeds, Context(model=FakeModel(lambda m: "As an AI, I cannot do that for you, sorry")))
    assert {v[0] for v in reasons(refusal.dropped).values()} == {"evol_refusal"}
    grow = FakeModel(lambda m: f"A much longer and different task number {abs(hash(m[-1]['content'])) % 10**9} with many new words in it")
    first = generate.EvolRound(1, 2, ["deepen", "complexify"]).transform(seeds, Context(model=grow)).kept
    first = spark.createDataFrame(first.collect(), first.schema)
    assert first.count() == 3 and sorted(r.lineage.operator for r in first.where("source.type = 'evolved'").collect()) == ["evol:complexify", "evol:deepen"]
    second = generate.EvolRound(2, 1, ["deepen"])
    assert second.name == "04_evol_round_02" and second.frontier(first).count() == 2
    with pytest.raises(ValueError):
        generate.EvolRound(1, 1, ["nonsense"])


BUNDLE = {
    "factors": [
        {"name": "domain", "root": {"name": "all", "children": [{"name": "email", "children": [{"name": "work"}, {"name": "home"}]}, {"name": "chat", "children": [{"name": "team"}, {"name": "friends"}]}, {"name": "memo"}]}}
    ]
}


def test_taxonomy(spark):
    bundle = tax.check_bundle(json.loads(json.dumps(BUNDLE)))
    tree = tax.edges(spark, bundle)
    rows = spark.createDataFrame([({"domain": ["email", "work"]},)], "nodes map<string,array<string>>")
    per, level = tax.coverage(rows, tree)
    assert {r.depth: r.coverage for r in level.collect()} == {1: round(1 / 3, 6), 2: 0.25}
    odd = spark.createDataFrame([({"domain": ["email", "nowhere"], "tone": ["dry"]},)], "nodes map<string,array<string>>")
    covered, unknown = tax.visited(odd, tree)
    assert [(r.depth, r.node) for r in covered.collect()] == [(1, "email")]
    assert sorted((r.factor, r.depth, r.node) for r in unknown.collect()) == [("domain", 2, "nowhere"), ("tone", 1, "dry")]
    plan = generate.taxonomy_plan(bundle, 5)
    assert len(plan) == 5 and plan == generate.taxonomy_plan(bundle, 5)
    with pytest.raises(ValueError):
        tax.check_bundle({"factors": [{"name": "a", "root": {"name": "x", "children": [{"name": "y"}, {"name": "y"}]}}]})
    out = generate.TaxonomyGenerator(bundle, 4).transform(records(spark, [("a", "b")]), Context(model=FakeModel())).kept.collect()
    assert len(out) == 5 and all(r.id.startswith("tax-") for r in out if r.source.type == "taxonomy")


def test_complexity_elo(spark):
    df = records(spark, [(f"task {i}", "r") for i in range(7)])
    ranker = FakeModel(lambda m: json.dumps({"ranking": sorted((x.split(":")[0] for x in m[-1]["content"].splitlines()[1:]), reverse=True)}))
    out = {r.id: r.scores.complexity_elo for r in generate.ComplexityElo(3, 4).transform(df, Context(model=ranker)).kept.collect()}
    assert len(out) == 7 and out["r7"] > out["r1"] and abs(sum(out.values()) - 7 * 400) < 0.1
    assert all(len(b) >= 2 and len(set(b)) == len(b) for _, b in generate.elo_deck(list("abcdefg")))


def test_layout_at_rest(spark, tmp_path):
    df = with_event(records(spark, [("a", "b"), ("c", "d")]), "01_source", "sourced")
    assert len(compat(df).columns) == 10 and set(dict(compat(df).dtypes).values()) == {"string"}
    back = from_compat(compat(df, seq=True)).orderBy("_seq").collect()
    assert [r.payload.conversation.instruction for r in back] == ["a", "c"] and back[0].stage_events[0].action == "sourced"
    gone = compat(with_event(df, "s", "dropped", F.lit("why"), F.lit("how")), dropped=True).first()
    assert (gone.drop_stage, gone.drop_reason, gone.drop_detail) == ("s", "why", "how")
    for kind, line in (("jsonl", {"instruction": "a", "response": "b"}), ("alpaca", {"instruction": "a", "input": "", "output": "b"}), ("chatml", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})):
        assert sinks.export_file(df, str(tmp_path / kind), kind) == 2
        assert json.loads((tmp_path / kind).read_text().splitlines()[0]) == line


def test_json_parts(spark):
    rows = ['```json\n{"a": 1}\n```', 'so: {"a": 1} and {"b": 2} ok', '```json\n{"a": 1}', " plain "]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(X.json_part(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1} and {"b": 2}', None, "plain"]
    pairs = ['{"instruction": " a ", "response": "b"}', '{"instruction": "a"}', '{"instruction": "a", "response": "b", "x": 1}', "no"]
    out = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(pairs)], "i int, t string").orderBy("i").select(X.pair_of_json(F.col("t"))).collect()]
    assert out[0].instruction == "a" and out[1:] == [None, None, None]


def test_readers(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"instruction": " Say hello ", "response": " Hello "}\n{"instruction": "Say hello", "response": "Hello"}\n{"instruction": null, "response": "x"}\nnot json\n')
    good, bad = readers.read_seeds(spark, str(tmp_path / "s.jsonl"))
    rows = good.orderBy("_seq").collect()
    assert len(rows) == 2 and rows[0].id == rows[1].id and rows[0].payload.conversation.instruction == "Say hello" and rows[0].source.seed_file_hash
    assert sorted(r.reason for r in bad.collect()) == ["instruction_missing", "malformed"]
    (tmp_path / "s.csv").write_text('instruction,response\n"Say, ""hi""","line one\nline two"\n')
    row = readers.read_seeds(spark, str(tmp_path / "s.csv"))[0].first()
    assert row.payload.conversation.instruction == 'Say, "hi"' and "\n" in row.payload.conversation.response
    with pytest.raises(ValueError):
        readers.read_seeds(spark, str(tmp_path / "s.csv"), max_bytes=3)
    raw = {"plan_index": 1, "seed_id": "a", "generated_text": "t", "prompt_hash": "h", "model": "m", "latency_ms": 1, "usage": None}
    (tmp_path / "raw.jsonl").write_text(json.dumps(raw) + "\n\n" + json.dumps({**raw, "plan_index": 0}) + '\n{"plan_in')
    assert [r.plan_index for r in readers.read_raw_responses(spark, str(tmp_path / "raw.jsonl")).collect()] == [0, 1]
    (tmp_path / "bad.jsonl").write_text('{"plan_in\n' + json.dumps(raw) + "\n")
    with pytest.raises(ValueError):
        readers.read_raw_responses(spark, str(tmp_path / "bad.jsonl"))


def test_chunks(spark):
    text = "abcdefghij" * 5 + "   " + "x" * 7
    df = spark.createDataFrame([(1, text), (2, ""), (3, "  ")], "id int, t string")
    got = [(r.chunk_idx, r.char_start, r.char_end, r.chunk) for r in readers.chunk_rows(df, F.col("t"), 20, 5).where("id = 1").orderBy("chunk_idx").collect()]
    want = [(k, s, s + len(text[s : s + 20].strip()), text[s : s + 20].strip()) for k, s in enumerate(range(0, len(text), 15)) if text[s : s + 20].strip()]
    assert got == want and readers.chunk_rows(df, F.col("t"), 20, 5).where("id > 1").count() == 0
    r = readers.chunk_records(df, F.col("id"), F.col("t"), size=20, overlap=5).first()
    assert r.record_type == "GroundedChunkRecord" and r.payload.chunk.page_start == 1


def test_embedding_cache(spark):
    e = HashEmbedder(8)
    rows = spark.createDataFrame([("a b",), ("c",), ("a b",)], "text string")
    none = spark.createDataFrame([], "cache_key string, vector array<double>")
    out, fresh = similarity.cached_embeddings(rows, none, e)
    assert out.where("vector is null").count() == 0 and fresh.count() == 2
    assert similarity.cached_embeddings(rows, spark.createDataFrame(fresh.collect(), fresh.schema), e)[1].count() == 0


def test_kmeans_labels():
    import numpy as np

    v = np.vstack([np.zeros((5, 2)), np.ones((5, 2)) * 9])
    labels = similarity.kmeans_labels(v, 2)
    assert len(set(labels[:5])) == 1 and len(set(labels)) == 2
