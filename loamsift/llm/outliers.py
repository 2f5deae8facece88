"""Quality rules with robust multivariate outliers.

Fixed rules come first (too few words, too much repetition). The rest is judged against its own language and source: a
vector of transformed statistics per text, the minimum-covariance-determinant (MCD) estimate of centre and scatter of
each group, and a cut on the Mahalanobis distance. MCD is computed by concentration steps over all rows until the
determinants stand still: each step takes the distances under the present estimate, their quantile per group, and the
moments of the rows inside it, all as map-side combined aggregates, so a hot group is never gathered.

The cut comes from the distances, not from labels. Their tails are heavier than a normal law's, so a log-normal law is
fitted to their quartiles, and the cut lies where they are sparsest between its ``TAILS``; never below the distance that
a normal law passes once in 10,000.

Defined cases: null or empty texts have no words and fail the fixed rules; null language or source is a value of its
own; groups below ``MIN_ROWS`` rows are pooled by language, and what is still small over all languages; if that pool is
small too, its rows are judged against all rows of the table, however few; repeated rows count each; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.llm.kernel import as_bytes, discard, map_arrow, written

SYMBOLS, BLANK = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), b"0123456789", b".,;:!?"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_ROWS, HALF, STEPS, STILL = 200, 0.75, 50, 0.01
TAILS, BINS, SPARSE = (2.8, 3.3), 50, 4  # standard deviations; bins of the logarithm, and how many are looked at together
FLOORS = (0.05, 0.25, 0.06, 0.15, 0.08, 0.35, 0.08)  # least standard deviation of each statistic
D = len(FLOORS)
X = [f"x{i}" for i in range(D)]
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{x} double" for x in X)
IDS = 1 << 21
REST = "*"  # the last pool; names of the others begin otherwise


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def repeat_words(words: list[bytes], ids: Ids) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    if len(ids) > IDS // 4:
        ids.clear()
    if n + len(ids) >= IDS:
        ids.clear()
    h = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if len(ids) > IDS:  # more distinct words than three of them fit in 64 bits: number the pairs first
        pair = np.unique(h[:-1] * (n + len(ids)) + h[1:], return_inverse=True)[1]
        key = pair[:-1] * np.int64(len(ids)) + h[2:]
    else:
        key = (h[:-2] << 42) | (h[1:-1] << 21) | h[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(key, twice)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def text_stats(text: str | None, ids: Ids) -> tuple:
    b = as_bytes(text)
    words = b.split()
    n = len(words)
    count = lambda chars: len(b) - len(b.translate(None, chars))
    word_chars, symbols = len(text or "") - count(BLANK), count(SYMBOLS)
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup, repeat = len(lines) - len(set(lines)), repeat_words(words, ids)
    if not n:
        return (0, 0, 0, 0, 0, *[0.0] * D)
    x = (
        math.log(word_chars / n), math.log1p(100 * symbols / n), math.sqrt(count(UPPER) / len(b)), math.sqrt(dup / len(lines)), math.sqrt(repeat / n),
        math.log1p(100 * count(DIGITS) / n), math.sqrt(count(STOPS) / n),
    )
    return (n, word_chars, symbols, dup, repeat, *x)


def statistics(docs: DataFrame) -> DataFrame:
    def make():
        ids = Ids()

        def step(batch: pa.RecordBatch) -> dict:
            got = [text_stats(t, ids) for t in batch.column("text").to_pylist()]
            columns = list(zip(*got)) if got else [[]] * (5 + D)
            return {c: batch.column(c) for c in ("doc_id", "lang", "source")} | dict(zip(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *X], map(list, columns)))

        return step

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(source as string) source", "text"), STATS, make)


def chi2_quantile(p: float, d: int) -> float:
    """Wilson-Hilferty quantile of chi-squared."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


def distance(mu: str = "mu", inv: str = "inv") -> Column:
    """Squared Mahalanobis distance of the row's statistics; inv holds the upper triangle, off-diagonals doubled."""
    z = [F.col(X[i]) - F.col(mu)[i] for i in range(D)]
    terms, k = [], 0
    for i in range(D):
        for j in range(i, D):
            terms.append(z[i] * z[j] * F.col(inv)[k])
            k += 1
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _triangle(inverse: np.ndarray) -> list[float]:
    return [float(inverse[i, j]) * (1 if i == j else 2) for i in range(D) for j in range(i, D)]


def _solve(moments: DataFrame) -> DataFrame:
    """Moments per group -> centre and inverse scatter; the floors keep constant statistics from a singular scatter."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            mus, invs, logs = [], [], []
            for row in batch.to_pylist():
                m = np.array([row[f"m{i}"] for i in range(D)])
                c = np.zeros((D, D))
                for i in range(D):
                    for j in range(i, D):
                        c[i, j] = c[j, i] = row[f"c{i}_{j}"]
                c += np.diag(np.square(FLOORS))
                mus.append(m.tolist())
                invs.append(_triangle(np.linalg.inv(c)))
                logs.append(float(np.linalg.slogdet(c)[1]))
            return {"grp2": batch.column("grp"), "mu": mus, "inv": invs, "log_det": logs}

        return step

    return map_arrow(moments, "grp2 string, mu array<double>, inv array<double>, log_det double", make)


def fit(rows: DataFrame) -> DataFrame:
    """rows: grp and statistics -> grp2, mu, inv, scale, by MCD concentration steps from coordinatewise medians.

    The steps end when no group's log-determinant moves by more than ``STILL``; ``STEPS`` only guards against a cycle, as
    quantiles are approximate.
    """
    mid = rows.groupBy("grp").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in X])
    spread = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(FLOORS[i])) for i, x in enumerate(X)]
    zero = F.lit(0.0)
    first = F.array(*[1 / (spread[i] * spread[i]) if i == j else zero for i in range(D) for j in range(i, D)])
    now = written(mid.select(F.col("grp").alias("grp2"), F.array(*[F.col(x)[1] for x in X]).alias("mu"), first.alias("inv"), F.lit(float("inf")).alias("log_det")), "mcd")
    for _ in range(STEPS):
        far = rows.join(now, F.col("grp") == F.col("grp2")).select("grp", *X, distance().alias("d2"))
        cut = far.groupBy(F.col("grp").alias("grp3")).agg(F.percentile_approx("d2", HALF, 2000).alias("q"))
        near = far.join(cut, F.col("grp") == F.col("grp3")).where("d2 <= q")
        moments = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
        moments += [F.covar_pop(X[i], X[j]).alias(f"c{i}_{j}") for i in range(D) for j in range(i, D)]
        was, now = now, written(_solve(near.groupBy("grp").agg(*moments)), "mcd")
        before = was.select(F.col("grp2").alias("grp3"), F.col("log_det").alias("before"))
        moved = now.join(before, F.col("grp2") == F.col("grp3")).agg(F.max(F.abs(F.col("log_det") - F.col("before")))).first()[0]
        discard(was)
        if moved is None or moved <= STILL:
            break
    far = rows.join(now, F.col("grp") == F.col("grp2")).select("grp", distance().alias("d2"))
    scale = far.groupBy("grp").agg((F.percentile_approx("d2", 0.5, 2000) / chi2_quantile(0.5, D)).alias("scale"))
    return written(now.join(scale, F.col("grp") == F.col("grp2")).drop("grp", "log_det"), "mcd")


def cut_of(counts: dict[int, int]) -> float:
    """The cut, from how many distances fall into each bin of their logarithm; at least what a normal law allows."""
    least = math.sqrt(chi2_quantile(0.9999, D))
    if not counts:
        return least
    bins = np.array(sorted(counts))
    up = np.cumsum([counts[b] for b in bins.tolist()])
    low, mid, high = (int(bins[np.searchsorted(up, q * up[-1])]) for q in (0.25, 0.5, 0.75))
    spread = max((high - low) / 1.349, 1.0)
    start, stop = (round(mid + t * spread) for t in TAILS)
    near = {b: sum(counts.get(b + k, 0) for k in range(-SPARSE // 2, SPARSE // 2 + 1)) for b in range(start, stop + 1)}
    fewest = min(near.values())
    return max(least, math.exp(max(b for b, n in near.items() if n == fewest) / BINS))


def judge(docs: DataFrame, most: float | None = None) -> DataFrame:
    """Per document: the base statistics, base_failed, distance (null where they failed) and kept. most: a cut of one's own."""
    stats = statistics(docs)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.regexp_replace(c, r"\|", "||")), F.lit("-"))
    stats = stats.withColumn("_lang", name("lang")).withColumn("_own", F.concat(name("lang"), F.lit("|."), name("source")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = written(stats.withColumn("base_failed", failed), "stats")
    sizes = written(stats.where("not base_failed").groupBy("_lang", "_own").agg(F.count("*").alias("_n")), "sizes")
    pools = sizes.where(F.col("_n") < MIN_ROWS).groupBy(F.col("_lang").alias("_l2")).agg(F.sum("_n").alias("_pool"))
    left = pools.where(F.col("_pool") < MIN_ROWS).agg(F.sum("_pool")).first()[0] or 0
    groups = sizes.join(pools, F.col("_lang") == F.col("_l2"), "left").select(
        F.col("_own").alias("_o2"), F.when(F.col("_n") >= MIN_ROWS, F.col("_own")).when(F.col("_pool") >= MIN_ROWS, F.col("_lang")).otherwise(REST).alias("grp")
    )
    rows = stats.join(groups, F.col("_own") == F.col("_o2"), "left").drop("_o2")
    slim = rows.where("not base_failed").select("grp", *X)
    if 0 < left < MIN_ROWS:
        slim = slim.where(F.col("grp") != REST).unionByName(slim.withColumn("grp", F.lit(REST)))
    slim = written(slim, "vectors")
    model = fit(slim)
    out = rows.join(model, F.col("grp") == F.col("grp2"), "left")
    d2 = F.when(~F.col("base_failed"), distance() / F.greatest(F.col("scale"), F.lit(1.0)))
    out = out.withColumn("distance", d2)
    if most is None:
        place = F.floor(F.log(F.greatest(F.col("distance"), F.lit(1e-9))) * (BINS / 2)).cast("int")
        most = cut_of({r.b: r.n for r in out.where("distance is not null").groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()})  # a few hundred bins
    kept = ~F.col("base_failed") & (F.col("distance") <= most * most)
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round(F.sqrt("distance"), 3).alias("distance"))
