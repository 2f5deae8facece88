"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; every other text, toxic or not, is unlabelled. A linear model over hashed
word presence is trained in numpy with the class-prior-corrected risk  pi R+(P) + max(0, R-(U) - pi R-(P)); where the
second part turns negative, its gradient is stepped up again, as the non-negative estimator does. Only words that
several positives share, and more than unlabelled texts do, get a weight, so that long texts don't gather noise.

Bounds: at most ``MAX_POSITIVE`` positives and about ``MAX_UNLABELLED`` unlabelled texts train the model, chosen by a
hash of the document's id, one text an id however often that is repeated; every text is scored. Defined cases: null and empty texts score the model's bias; ids with
several labels are toxic if one says so; null labels are none; without positives all texts score 0; repeated rows are
scored alike; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.kernel import MEMO_WORDS, as_bytes, crc_fold, list_array, map_arrow

BITS = 18
MAX_POSITIVE, MAX_UNLABELLED, MIN_SUPPORT = 4000, 12000, 3
MIN_Z, STEPS, RATE, DECAY, CUT = 4.0, 500, 0.1, 1e-4, 0.7
EDGES = b".,;:!?()[]{}\"'*_-"


class Slots(dict):
    """Word -> feature; upper and lower case and the punctuation around it don't matter."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(EDGES).lower()) & ((1 << BITS) - 1)
        return value


def features(text: str | None, slots: Slots) -> np.ndarray:
    if len(slots) > MEMO_WORDS:
        slots.clear()
    words = set(as_bytes(text).split())
    return np.unique(np.fromiter(map(slots.__getitem__, words), np.int32, len(words)))


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk with logistic loss, by Adam on the full sample."""
    size = 1 << BITS
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    df_p, df_u = (np.bincount(np.concatenate(r), minlength=size) for r in (positive, unlabelled))
    usual = (df_u + 1) / (len(unlabelled) + 2)
    support = (df_p >= MIN_SUPPORT) & (df_p / len(positive) - usual > MIN_Z * np.sqrt(usual * (1 - usual) / len(positive)))
    (rp, cp), (ru, cu) = _joined(positive), _joined(unlabelled)
    keep_p, keep_u = support[cp], support[cu]
    rp, cp, ru, cu = rp[keep_p], cp[keep_p], ru[keep_u], cu[keep_u]
    n_p, n_u = len(positive), len(unlabelled)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z_p = np.bincount(rp, w[cp], n_p) + b
        z_u = np.bincount(ru, w[cu], n_u) + b
        s_p, s_u = 1 / (1 + np.exp(-np.clip(z_p, -30, 30))), 1 / (1 + np.exp(-np.clip(z_u, -30, 30)))
        rest = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        if rest >= 0:
            g_p, g_u = prior * (s_p - 1) / n_p - prior * s_p / n_p, s_u / n_u
        else:
            g_p, g_u = prior * s_p / n_p, -s_u / n_u
        g = np.bincount(cp, g_p[rp], size) + np.bincount(cu, g_u[ru], size) + DECAY * w / 100
        gb = g_p.sum() + g_u.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * DECAY, 0)
    return w.astype(np.float32), float(b)


def featurised(docs: DataFrame) -> DataFrame:
    """id, positive and features of one text an id (that of the smallest hash), chosen before anything is gathered."""

    def make():
        slots = Slots()

        def step(batch: pa.RecordBatch) -> dict:
            got = [features(t, slots) for t in batch.column("text").to_pylist()]
            x = list_array([len(g) for g in got], np.concatenate(got), pa.int32()) if got else []
            return {"id": batch.column("id"), "th": batch.column("th"), "positive": batch.column("positive"), "x": x}

        return step

    rows = map_arrow(docs.select("id", F.xxhash64("text").alias("th"), "positive", "text"), "id string, th long, positive boolean, x array<int>", make)
    return rows.groupBy("id").agg(F.max("positive").alias("positive"), F.min_by("x", "th").alias("x"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Train on the folds that may be learnt from (crc32 of the id, mod 3, is not 1); None without positives."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("id2")).agg(F.max("toxic").alias("toxic"))
    ids = ids.where(crc_fold(F.col("id2")) != 1)
    known, toxic = ids.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return None
    prior = min(0.5, (toxic + 1) / (known + 20))  # a few labels can't say that most texts are toxic
    chosen = ids.where("toxic = 1").orderBy(F.xxhash64("id2"), "id2").limit(MAX_POSITIVE).select("id2", F.lit(True).alias("positive"))
    share = min(1.0, MAX_UNLABELLED / max(1, docs.count()))
    lot = F.pmod(F.xxhash64(F.lit("unlabelled"), F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000)
    # at most MAX_POSITIVE rows of an id and a flag: that bound is what makes the broadcast safe
    rows = docs.select("doc_id", "text").where(crc_fold(F.col("doc_id")) != 1).join(F.broadcast(chosen), F.col("doc_id") == F.col("id2"), "left")
    rows = rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("positive", F.lit(False)).alias("positive"), lot.alias("lot")).where("positive or lot")
    table = featurised(rows).sort("id").toArrow()
    x, flag = table["x"].combine_chunks(), table["positive"].to_pylist()
    ends, flat = x.offsets.to_numpy(), x.values.to_numpy()
    sample = [flat[a:b] for a, b in zip(ends, ends[1:])]
    positive = [r for r, f in zip(sample, flag) if f]
    unlabelled = [r for r, f in zip(sample, flag) if not f] + positive[: int(len(sample) * share * prior)]
    if not positive or not unlabelled:
        return None
    return train(positive, unlabelled, prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, drop_text: bool = False) -> DataFrame:
    """docs with the column toxicity_score (0 to 1) added; docs must not have it already."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the corpus

    def make():
        slots, model = Slots(), sent.value

        def step(batch: pa.RecordBatch) -> dict:
            columns = {n: batch.column(n) for n in batch.schema.names if not (drop_text and n == "text")}
            if model is None:
                return columns | {"toxicity_score": [0.0] * batch.num_rows}
            w, b = model
            z = [float(w[features(t, slots)].sum(dtype=np.float64)) + b for t in batch.column("text").to_pylist()]
            return columns | {"toxicity_score": 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))}

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if not (drop_text and f.name == "text"))
    return map_arrow(docs, f"{fields}, toxicity_score double", make)


def scored_ids(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """doc_id and toxicity_score of every text; texts don't travel back."""
    return score(docs, model, drop_text=True).select("doc_id", "toxicity_score")


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs without those that score at least ``cut``; text and columns stay as they were."""
    names = docs.columns
    flat = docs.select(F.col("text").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"])
    kept = score(flat, fit(docs, labels)).where(F.col("toxicity_score") < cut)
    return kept.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])
