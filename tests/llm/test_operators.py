"""Each operator against a brute-force version, on messy rows, on the test tables and on nothing."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from loamsift.llm import components, decontam, licences, linededup, mixing, nearjoin, outliers, quality, ranks, sanitise, toxicity, warc
from tests.conftest import SF
from tests.llm.data import SCHEMA, messy, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


# ---- 1
def naive_base(text):
    t = text or ""
    out = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if "@" in t else "")]]  # a long word without @ takes minutes
    out.append([m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))])
    out.append([m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and sanitise.luhn(d)])
    out.append([m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15])
    return [(k, s, e) for k, spans in enumerate(out) for s, e in spans]


@pytest.mark.parametrize("seed", range(40))
def test_base_spans(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "@", ".", "1", "4", "-", " ", "+", "(", "b.c@d.e", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", "é", "999"]) for _ in range(200))
    assert sanitise.base_spans(text) == naive_base(text)


def test_find_private(docs, real):
    for df in (docs, real):
        got = counted(r[:7] for r in sanitise.find(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect())
        want = collections.Counter()
        for i, t in texts(df):
            spans = naive_base(t)
            n = collections.Counter(k for k, _, _ in spans)
            want[(i, n[0], n[1], n[2], n[3], hashlib.sha256(sanitise.digest(spans).encode()).hexdigest())] += 1
        assert collections.Counter(x[:6] for x in got.elements()) == want


def test_disclosing_terms(spark, none):
    rows = [(i, f"zanzibar expert ann@x.org wrote. {prose(i, 30)}") for i in range(4)] + [(i, f"{prose(i, 30)} expert") for i in range(4, 40)]
    out = {r.doc_id: r for r in sanitise.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:0:8" in out[0].spans and "term:9:15" not in out[0].spans  # zanzibar tells, expert doesn't
    assert all(out[i].n_term == 0 for i in range(4, 40))
    # brute force of the disclosure
    near = collections.defaultdict(set)
    held = collections.defaultdict(set)
    df = collections.defaultdict(set)
    for i, t in rows:
        for w in WORD.findall(t):
            df[w.lower().strip(sanitise.EDGES)].add(i)
        for term, e, s, stop in sanitise.near_terms(t, sanitise.base_spans(t)):
            near[term.lower(), e].add(i)
            held[e].add(i)
    flagged = set()
    for (t, e), d in near.items():
        ic = math.log(len(rows) / len(held[e]))
        if len(d) >= 2 and math.log(len(rows) * len(d) / len(df[t]) / len(held[e])) / ic >= sanitise.GENERALISE:
            flagged.add((t, e))
    want = {i: sum((t.lower(), e) in flagged for t, e, _, _ in sanitise.near_terms(x, sanitise.base_spans(x))) for i, x in rows}
    assert {i: r.n_term for i, r in out.items()} == want
    clean = {r.doc_id: r.text for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "ann@x.org" not in clean[0] and "<EMAIL>" in clean[0] and "zanzibar" not in clean[0] and clean[7] == rows[7][1]
    assert sanitise.find(none).count() == 0 and sanitise.sanitise(none).columns == none.columns


# ---- 2
def naive_lines(rows, short=False):
    """(id, text) -> text without later windows; short: also runs of one or two lines of 50 words, and whole texts of so few."""
    seen, out = {}, {}
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for i, t, h in sorted({r for r in rows if r[1] is not None}, key=key):
        lines = t.split("\n")
        full = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for n in (3, 2, 1) if short else (3,):
            for k in range(len(full) - n + 1):
                w = tuple(x for _, x in full[k : k + n])
                if n < 3 and n != len(full) and len(WORD.findall(" ".join(w))) < 50:
                    continue
                if seen.get(w, (i, h, k)) != (i, h, k):
                    gone |= set(range(full[k][0], full[k + n - 1][0] + 1))
                else:
                    seen[w] = (i, h, k)
        out[i, t] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_line_dedup(docs, real, none):
    from pyspark.sql import functions as F

    for df in (docs, real):
        rows = [(r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
        want = naive_lines(rows)
        got = linededup.dedup(df)
        assert got.columns == [*df.columns, "n_lines", "n_removed"]
        assert counted(got.select("doc_id", "text").collect()) == collections.Counter((i, None if t is None else want[i, t]) for i, t, _ in rows)
    assert linededup.dedup(none).count() == 0
    gone = {r.doc_id: r.n_removed for r in linededup.dedup(docs).collect()}
    assert gone[8] == 6 and gone[17] == 12 and gone[7] == 0


# ---- 3
def test_decontamination(spark, docs, none):
    item = "If Maria buys 12 apples and 7 pears at the market for 3 dollars each, how many pieces of fruit does Maria carry home in 5 km?"
    other = "Each of the long wooden tables in the hall seats eight guests, and the cook needs two loaves of bread for every table that is full."
    bench = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None), (None, item), (5, item)], "item_id long, text string")
    again = item.replace("Maria", "Ines").replace("12", "40").replace("7", "9").replace("km", "miles")
    mixed = item.replace("Maria buys", "Ines buys").replace("12", "40")
    rows = [(1, prose(1, 50) + ". " + item + " " + prose(2, 40)), (2, prose(3, 40) + ". " + again), (3, prose(4, 90)), (4, other[:40]), (5, other.lower()), (6, ""), (7, None), (7, None), (8, mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in decontam.find(df, bench).collect()}
    assert {i for i, r in out.items() if r.contaminated} >= {1, 2, 5} and not any(out[i].contaminated for i in (3, 4, 6, 7))
    assert out[1]["items"] == "1" and out[1].verbatim and not out[2].verbatim and out[5]["items"] == "2"
    assert sorted(r.doc_id for r in decontam.keep_clean(df, bench).collect() if r.doc_id != 8) == [3, 4, 6, 7, 7]
    assert decontam.find(docs, bench).count() == docs.count() and decontam.find(none, bench).count() == 0
    assert decontam.find(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.keep_clean(docs, bench).columns == docs.columns


def test_inconsistent_slots(spark):
    names = "when Anna met Bruno the friend of Anna asked if Bruno knew that Anna and Bruno had once shared a house in the old town near the sea"
    bench = spark.createDataFrame([(1, "so " + names)], "item_id long, text string")
    swap = "so " + names.replace("Anna", "Clara").replace("Bruno", "Diego")
    k = iter("Clara Diego Emil Fritz Greta Hugo".split())
    jumble = "so " + re.sub("Anna|Bruno", lambda m: next(k), names)
    out = {r.doc_id: r.contaminated for r in decontam.find(spark.createDataFrame([(1, swap), (2, jumble)], "doc_id long, text string"), bench).collect()}
    assert out == {1: True, 2: False}


def test_decontamination_finds_every_planted_item(spark):
    d = SF.replace("0.001", "0.01")
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    items = [(r.item_id, WORD.findall(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        flat = "\x00".join(WORD.findall(r.text or ""))
        if any("\x00".join(w[1:-1]) in flat for _, w in items):
            want.add(r.doc_id)
    assert {r.doc_id for r in decontam.find(docs, bench).where("contaminated").collect()} == want and want


# ---- 4
def naive_stats(text):
    t = text or ""
    w = WORD.findall(t)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_statistics(docs, real, none):
    for df in (docs, real):
        out = outliers.judge(df).collect()
        got = counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
        assert got == collections.Counter((i, *naive_stats(t)) for i, t in texts(df))
        assert not any(r.kept and r.base_failed for r in out)
    assert outliers.judge(none).count() == 0


def naive_mcd(x):
    """Centre, inverse scatter and scale of a group, with the quantiles that percentile_approx gives for few rows."""
    at = lambda v, q: np.sort(v)[max(1, math.ceil(len(v) * q)) - 1]
    low, mu, high = (np.array([at(c, q) for c in x.T]) for q in (0.25, 0.5, 0.75))
    inv = np.diag(1 / np.square(np.maximum((high - low) / 1.349, outliers.FLOORS)))
    was = math.inf
    for _ in range(outliers.STEPS):
        d = np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)
        near = x[d <= at(d, outliers.HALF)]
        cov = np.cov(near.T, bias=True).reshape(outliers.D, outliers.D) + np.diag(np.square(outliers.FLOORS))
        mu, inv, now = near.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        if abs(now - was) <= outliers.STILL:
            break
        was = now
    return mu, inv, at(np.einsum("ij,jk,ik->i", x - mu, inv, x - mu), 0.5) / outliers.chi2_quantile(0.5, outliers.D)


def test_mcd_against_numpy(spark):
    r = np.random.default_rng(0)
    good, bad = r.normal(size=(600, outliers.D)) + 1, r.normal(size=(90, outliers.D)) * 0.3 + 9
    df = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([good, bad])], "grp string, " + ", ".join(f"{x} double" for x in outliers.X))
    m = outliers.fit(df).first()
    mu, inv, scale = naive_mcd(np.vstack([good, bad]))
    assert np.allclose(m.mu, mu) and np.allclose(m.inv, outliers._triangle(inv)) and math.isclose(m.scale, scale) and abs(np.array(m.mu) - good.mean(0)).max() < 0.3


def naive_kept(rows):
    """(id, text, lang, source) -> (id, distance, kept): groups, MCD, distances and cut without Spark."""
    ids = outliers.Ids()
    got = [(i, lang, source, s[:5], np.array(s[5:])) for i, t, lang, source in rows for s in [outliers.text_stats(t, ids)]]
    fine = [g for g in got if not (g[3][0] < 50 or 100 * g[3][4] > 50 * g[3][0])]
    n = collections.Counter((g[1], g[2]) for g in fine)
    pool = collections.Counter()
    for (lang, _), k in n.items():
        if k < outliers.MIN_ROWS:
            pool[lang] += k
    name = lambda lang, source: ("own", lang, source) if n[lang, source] >= outliers.MIN_ROWS else ("pool", lang) if pool[lang] >= outliers.MIN_ROWS else "rest"
    groups = collections.defaultdict(list)
    for g in fine:
        groups[name(g[1], g[2])].append(g[4])
    if 0 < len(groups["rest"]) < outliers.MIN_ROWS:
        groups["rest"] = [g[4] for g in fine]
    model = {k: naive_mcd(np.array(v)) for k, v in groups.items() if v}
    far = []
    for g in fine:
        mu, inv, scale = model[name(g[1], g[2])]
        far.append((g[0], math.sqrt((g[4] - mu) @ inv @ (g[4] - mu) / max(scale, 1.0))))
    cut = outliers.cut_of(collections.Counter(math.floor(math.log(max(d * d, 1e-9)) * outliers.BINS / 2) for _, d in far))
    return sorted((i is None, i or 0, d, d <= cut) for i, d in far)


def test_verdicts_against_brute_force(spark, docs, real):
    junk = [(9000 + i, " ".join(f"{w}%%%###" for w in prose(i, 120).split()), "en", "a") for i in range(6)]
    many = spark.createDataFrame([(i, prose(i, 60 + i % 90), "en", "ab"[i % 2]) for i in range(500)] + junk, "doc_id long, text string, lang string, source string")
    for df in (docs, real, many):
        out = outliers.judge(df).where("not base_failed").collect()
        want = naive_kept([tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()])
        got = sorted((r.doc_id is None, r.doc_id or 0, r.distance, r.kept) for r in out)
        assert len(got) == len(want) and all(a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 0.001 for a, b in zip(got, want))


def test_cut():
    normal = collections.Counter(np.floor(np.log(np.linalg.norm(np.random.default_rng(1).normal(size=(5000, outliers.D)), axis=1)) * outliers.BINS).astype(int).tolist())
    assert 5 < outliers.cut_of(normal) < 9 and outliers.cut_of({}) == outliers.cut_of({3: 7}) > 5
    tail = collections.Counter(np.floor(np.random.default_rng(2).normal(-0.4, 0.94, 5000) * outliers.BINS).astype(int).tolist())
    tail.update({b: 15 for b in range(int(math.log(15) * outliers.BINS), int(math.log(20) * outliers.BINS))})
    assert 9 < outliers.cut_of(tail) < 15


def test_outliers_are_rejected(spark):
    rows = [(i, prose(i, 120), "en", "a") for i in range(400)] + [(1000 + i, " ".join(f"{w}%%%###" for w in prose(i, 120).split()), "en", "a") for i in range(20)]
    out = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(out[i] for i in range(400)) >= 398 and not any(out[1000 + i] for i in range(20))


# ---- 5, 6
def fold(i):
    return zlib.crc32(str(i).encode()) % 3


@pytest.fixture(scope="module")
def larger(spark):
    d = SF.replace("0.001", "0.1")
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_toxicity_held_out(larger, docs, none, spark):
    df, labels = larger
    model = toxicity.fit(df, labels)
    lab = {r.doc_id: r.toxic for r in labels.collect()}
    out = [(lab[r.doc_id], r.toxicity_score) for r in toxicity.scored_ids(df.select("doc_id", "text"), model).collect() if r.doc_id in lab and fold(r.doc_id) == 1]
    caught, wrong = sum(y and s >= 0.7 for y, s in out) / sum(y for y, _ in out), sum(not y and s >= 0.7 for y, s in out) / len(out)
    assert caught > 0.8 and wrong < 0.03  # 300 positives to learn from
    assert toxicity.keep_clean(docs, labels).columns == docs.columns and toxicity.keep_clean(none, labels).count() == 0
    empty = labels.limit(0)
    assert toxicity.fit(df, empty) is None and toxicity.keep_clean(docs, empty).count() == docs.count()
    again = toxicity.scored_ids(docs.select("doc_id", "text"), model)
    assert again.count() == docs.count() and again.where("toxicity_score is null").count() == 0


def test_nn_risk_separates():
    r = np.random.default_rng(0)
    noise = lambda: list(r.integers(100, 3000, 30))
    positive = [np.unique(np.array(noise() + [7, int(r.integers(8, 12))], np.int32)) for _ in range(300)]
    unlabelled = [np.unique(np.array(noise() + ([7, int(r.integers(8, 12))] if i % 10 == 0 else []), np.int32)) for i in range(1500)]
    w, b = toxicity.train(positive, unlabelled, 0.1)
    s = [1 / (1 + np.exp(-(w[x].sum() + b))) for x in unlabelled]
    assert min(s[::10]) > 0.7 and max(x for i, x in enumerate(s) if i % 10) < 0.5


def test_quality_held_out(larger, docs, none, spark):
    df, labels = larger
    model = quality.fit(df, labels)
    lab = {r.doc_id: r.quality for r in labels.collect()}
    out = [(lab[r.doc_id], r.score >= 0.5) for r in quality.score(df, model).collect() if r.doc_id in lab and fold(r.doc_id) == 1]
    assert sum(y == p for y, p in out) / len(out) > 0.98
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, model).count() == 0 and quality.score(docs, quality.fit(df, labels.limit(0))).where("score = 0.5").count() == docs.count()


# ---- 7
def test_mixing(docs, real, none):
    for df in (docs, real):
        out = mixing.mix(df).collect()
        assert counted((r.doc_id, r.size) for r in out) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t in texts(df))
        size, goal, taken, most = collections.Counter(), {}, collections.Counter(), collections.Counter()
        for r in out:
            assert r.taken <= 2 * r.size
            size[r.source] += r["size"]
            goal[r.source] = r.target
            taken[r.source] += r.taken
            most[r.source] = max(most[r.source], r["size"])
            assert r.source_size >= size[r.source]
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight, left, free = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), set(order)
        want = {}
        while True:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * level > 2 * size[s]}
            if not over:
                break
            for s in over:
                want[s], left = 2.0 * size[s], left - 2 * size[s]
            free -= over
        want |= {s: weight[s] * level for s in free}
        assert all(math.isclose(goal[s], want[s]) for s in order)
        assert all(abs(taken[s] - goal[s]) <= 2 * most[s] for s in order)
        assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df).collect()))
        made = mixing.emit(df)
        assert counted(made.groupBy("doc_id").count().collect()) == counted((k, v) for k, v in collections.Counter({i: sum(r.copies for r in out if r.doc_id == i) for i in {r.doc_id for r in out}}).items() if v)
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 10 < 9 then 'hot' else 'cold' end g")
    from pyspark.sql import functions as F

    rows = ranks.ranked(df, ["g"], [F.col("id").desc()]).collect()
    for g in ("hot", "cold"):
        own = sorted((r for r in rows if r.g == g), key=lambda r: -r.id)
        assert [r["rank"] for r in own] == list(range(len(own)))


# ---- 8
def naive_near(rows):
    sets = []
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        sets.append({tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    link = collections.defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                link[a].add(b)
                link[b].add(a)
    out = collections.Counter()
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[rows[a][0], len(sets[a]), len(link[a]), min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)] += 1
    return out


def family(n: int, copies: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for f in range(n):
        base = [r.choice(WORDS_) for _ in range(r.choice([4, 12, 40, 150]))]
        for c in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 8)):
                w[r.randrange(len(w))] = r.choice(WORDS_)
            rows.append((len(rows), " ".join(w)))
    return rows


WORDS_ = [f"{a}{b}" for a in "ka lo mi ne ru sa te vo".split() for b in "ba do fi gu na pe ri".split()]


def near_columns(df):
    return counted(nearjoin.near_duplicates(df).select("doc_id", "n_shingles", "n_similar", "component_id").collect())


@pytest.mark.parametrize("block", [256, 8])
def test_near_join(spark, docs, block, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK", block)
    monkeypatch.setattr(nearjoin, "SKETCH_BLOCK", block)
    monkeypatch.setattr(nearjoin, "SHORT", 16 if block > 8 else 4)
    df = spark.createDataFrame(family(12, 25, block), "doc_id long, text string").repartition(5)
    assert near_columns(df) == naive_near(texts(df))
    assert near_columns(docs) == naive_near(texts(docs))


def test_near_join_real(real, none, docs):
    assert near_columns(real) == naive_near(texts(real))
    assert nearjoin.near_duplicates(none).count() == 0
    one = nearjoin.keep_one(docs)
    assert one.columns == docs.columns
    kept = sorted((r.doc_id for r in one.collect()), key=lambda i: (i is None, i))
    assert kept == [1, 4, 5, 6, 7, 9, 10, 12, 13, 14, 15, 15, 16, None]


def test_pieces_never_miss():
    r = np.random.default_rng(0)
    weight = np.ones(nearjoin.COUNTERS, np.uint8)
    for _ in range(400):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop, more = int(r.integers(0, 1 + n // 5)), int(r.integers(0, 1 + n // 5))
        b = np.unique(np.concatenate((r.permutation(a)[drop:], r.integers(0, 2**64, more, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 70 * (len(a) + len(b) - both):
            assert np.intersect1d(nearjoin.keys_of(a, weight), nearjoin.keys_of(b, weight)).size


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_components(spark, chunk, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", chunk)
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}
    top = lambda x: x if up.setdefault(x, x) == x else top(up[x])
    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


# ---- 9
def naive_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licences(spark, docs, real, none):
    extra = ["Under the MIT License. under-the mit\nlicense; Apache License, Version 2.0, CC BY-NC 4.0 cc by nc cc by nc", "under the mit licensee", "éunder the mit license", "CC0-1.0"]
    more = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    for df in (docs, real, more):
        got = counted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan(df).collect())
        assert got == collections.Counter((i, *naive_licences(t)) for i, t in texts(df))
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in licences.scan(df).collect())
    assert licences.scan(none).count() == 0


def test_expressions():
    assert licences.parse("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert licences.evaluate(licences.parse("(MIT OR GPL-3.0-only) AND Apache-2.0"))[1] and not licences.evaluate(licences.parse("MIT AND GPL-3.0-only"))[1]
    assert licences.evaluate(licences.parse("GPL-2.0 WITH Classpath-exception-2.0"))[0] == {"gpl-2.0 with classpath-exception-2.0"}
    for bad in ("MIT OR", "(MIT", "OR MIT", "MIT)", "", "(MIT OR ISC) WITH x", "MIT WITH (x AND y)", "MIT WITH x WITH y"):
        with pytest.raises(ValueError):
            licences.parse(bad)
    a = licences.automaton()
    assert "mit" in licences.scan_text("# SPDX-License-Identifier: MIT OR Apache-2.0\n", a)[5].split(",")
    assert "unparsed" in licences.scan_text("SPDX-License-Identifier: (MIT OR\n", a)[5]


# ---- 10
def test_archives(spark):
    big, small = "<p>" + "é" * 600, "<p>tiny"
    rows = [(1, "http://a.org/x", big), (2, "https://www.a.org/x/", big), (2, "https://www.a.org/x/", big), (3, "http://b.org", small), (4, "http://b.org", small), (5, None, None), (None, "u\r\nv", big), (6, "", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, position int").repartition(3)
    out = warc.archive(df)
    got = counted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect())
    want = collections.Counter()
    for i, _, html in rows:
        b = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "").encode() == b and j is not None), default=None)
        refers = top if len(b) >= 1000 and (i is None or i < top) else None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert got == want and warc.archive(df.limit(0)).count() == 0


@pytest.mark.parametrize("fan_in", [128, 2])
def test_histories_are_in_order(spark, monkeypatch, fan_in):
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(7)
    out = warc.archive(pages).collect()
    order = sorted(out, key=lambda r: r.position)
    assert len(out) == pages.count() and [(r.url_key, r.ts, r.page_id) for r in order] == sorted((r.url_key, r.ts, r.page_id) for r in out)


def test_loser_tree():
    r = random.Random(0)
    for k in range(0, 9):
        runs = [sorted((f"{r.randrange(50):02d}", "t", r.randrange(9), 0, "", "", None, "f", 0) for _ in range(r.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted((x for run in runs for x in run), key=warc.sort_key)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/a/?b=2&a=1#f") == "com,example)/a?a=1&b=2" == warc.url_key("http://example.com/a?a=1&b=2")
