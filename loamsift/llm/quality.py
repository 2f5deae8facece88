"""Quality classifier: logistic regression over hashed word 1- and 2-grams, trained by follow-the-regularised-leader.

A text is a sparse vector of the hashes of its words and neighbouring word pairs and of the words' shapes, each weighted
by its share of the text's grams, so that length says nothing. FTRL-proximal keeps a per-coordinate learning rate and an L1 term that
leaves most weights zero. A score is the logistic of a sparse dot product.

Bounds: at most ``MAX_ROWS`` labelled texts train it, chosen by a hash of the document's id, one text an id however often
that is repeated; every text is scored.
Defined cases: null and empty texts score the bias; ids with several labels are good only if all are; null labels are
none; without labels all texts score 0.5; repeated rows are scored alike; an empty table gives an empty result; extra
columns don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.kernel import MEMO_WORDS, as_bytes, crc_fold, list_array, map_arrow, mix

BITS, MAX_ROWS, EPOCHS = 18, 8000, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.1
MASK = np.uint64((1 << BITS) - 1)
RUN = re.compile(rb"(.)\1+", re.S)
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


class Grams(dict):
    """Word -> its place in two arrays: hashes of the words, and of their shapes."""

    def __init__(self) -> None:
        self.word, self.shape = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        if place == len(self.word):
            self.word, self.shape = np.resize(self.word, 2 * place), np.resize(self.shape, 2 * place)
        self.word[place] = xxhash.xxh3_64_intdigest(word.lower())
        self.shape[place] = xxhash.xxh3_64_intdigest(RUN.sub(rb"\1", word.translate(SHAPE)), seed=1)
        return place


def features(text: str | None, memo: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values; the values of each family have a Euclidean norm of 1."""
    if len(memo) > MEMO_WORDS:
        memo.clear()
    words = as_bytes(text).split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
    h, shape = memo.word[at], memo.shape[at]
    index, value = [], []
    for family in (h, mix(h[:-1] * np.uint64(3) + h[1:]), shape, mix(shape[:-1] * np.uint64(3) + shape[1:])):
        if len(family):
            ordered = np.sort((family & MASK).astype(np.int32))
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            n = np.diff(np.append(first, len(ordered))).astype(np.float32)
            index.append(ordered[first])
            value.append(n / np.sqrt(n @ n))
    return np.concatenate(index), np.concatenate(value)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows, in the order given; the bias is one more coordinate, without regularisation."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        if i[-1] == size - 1:
            w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
        return w

    for _ in range(EPOCHS):
        for i, x, y in rows:
            i, k = np.unique(np.append(i, size - 1), return_inverse=True)
            x = np.bincount(k, np.append(x, 1.0))
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def featurised(docs: DataFrame) -> DataFrame:
    """lot, id, label and features of one text an id (that of the smallest hash), chosen before anything is gathered."""

    def make():
        memo = Grams()

        def step(batch: pa.RecordBatch) -> dict:
            got = [features(t, memo) for t in batch.column("text").to_pylist()]
            sizes = [len(i) for i, _ in got]
            flat = [np.concatenate(c) if got else np.zeros(0) for c in zip(*got)] or [np.zeros(0), np.zeros(0)]
            return {c: batch.column(c) for c in ("lot", "id", "th", "good")} | {"i": list_array(sizes, flat[0], pa.int32()), "x": list_array(sizes, flat[1], pa.float32())}

        return step

    rows = map_arrow(docs.select("lot", "id", F.xxhash64("text").alias("th"), "good", "text"), "lot long, id string, th long, good int, i array<int>, x array<float>", make)
    one = rows.groupBy("lot", "id").agg(F.min("good").alias("good"), F.min_by(F.struct("i", "x"), "th").alias("f"))
    return one.select("lot", "id", "good", "f.i", "f.x")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on the folds that may be learnt from (crc32 of the id, mod 3, is not 1)."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id2")).agg(F.min("quality").alias("good"))
    chosen = ids.where(crc_fold(F.col("id2")) != 1).select("id2", "good", F.xxhash64("id2").alias("lot")).orderBy("lot", "id2").limit(MAX_ROWS)
    # at most MAX_ROWS rows of an id and a label: that bound is what makes the broadcast safe
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id2")).withColumn("id", F.col("id2").cast("string"))
    table = featurised(rows).sort("lot", "id").toArrow()
    i, x, y = (table[c].combine_chunks() for c in ("i", "x", "good"))
    sample = [(i[k].values.to_numpy(), x[k].values.to_numpy(), int(y[k].as_py())) for k in range(len(y))]
    return train(sample) if sample else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the corpus

    def make():
        memo = Grams()
        w, b = sent.value

        def step(batch: pa.RecordBatch) -> dict:
            z = []
            for t in batch.column("text").to_pylist():
                i, x = features(t, memo)
                z.append(float(w[i] @ x) + b)
            return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))}

        return step

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, score double", make)
