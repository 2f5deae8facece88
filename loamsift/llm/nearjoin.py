"""N-gram Jaccard join by prefixes of rare shingles.

A document's set is its distinct 3-word shingles (64-bit hashes). Sets of a <= b shingles with Jaccard of at least 70 %
share 7 (a + b) / 17 or more, which is at least 14 a / 17 and 7 b / 10. In an order common to all, the first
a - 14 a / 17 + 1 shingles of the smaller and the first b - 7 b / 10 + 1 of the larger therefore have one in common. So a
class has the first 18 % of its shingles indexed for larger ones to find, and with the first 30 % it probes for smaller
ones. The order puts rare shingles first. A shingle is as rare as its words make it, or more common if it is counted
more often than a counter's usual load; words and shingles are counted in all texts, in counters of fixed size. Words
tell rare shingles from common ones however many there are, and counters those of rare words that many texts repeat. The
order decides how much is compared, never what is found.

Documents with equal sets are one class from the start. Classes that share a key form a run. Short runs list their
pairs (at most ``SHORT`` / 2 rows a member), and a pair whose bit sketches differ in more bits than the sets may goes.
``SHORT`` is so large that passages which counters don't tell from chance (at a load of 350, as over 6 GB, 75 texts) are
listed: each connects texts that are otherwise unrelated, and texts with several such passages would chain the corpus.
Longer runs are only chained, and what a batch holds of one is chained before the shuffle and sent on as one row for each
range of sizes; the chains' components are cut into blocks of about ``SKETCH_BLOCK`` classes, and pairs of blocks compare
their bit sketches in memory, which leaves a spanning forest of the pairs that may link. The components of all that is
left are compared exactly, again in pairs of blocks, by a row of bits for each class. So no large group's pairs are ever
rows, no partner is skipped, and a pair of blocks bounds a task's memory.

Defined cases: null or wordless texts have empty sets, are linked with nothing and stand alone; texts of one or two
words have one shingle; repeated rows are documents each; a null doc_id is counted, but names a component only if all in
it are null; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.bitmap import bitmap, may_hold
from loamsift.llm.components import components
from loamsift.llm.kernel import batches_of, discard, list_array, map_arrow, pieces, shingle_hashes, shuffles_end, word_hashes, written

WORDS, BLOCK, SKETCH_BLOCK = 3, 1024, 2048
BLOCK_SHINGLES, SKETCH_SHINGLES = 1 << 18, 1 << 22  # of a block, at most, unless one class has more
SHORT = 128  # classes of a run whose pairs are listed
LISTS = ("keys", "probes", "hot", "upto", "cu", "cv")
COUNTERS, WORD_COUNTERS, SLICE = 1 << 22, 1 << 21, 1 << 16
ROWS = 1000  # of a batch with texts
MOST_BITS = 1 << 27  # that a cell has for its sets
STEP = np.log(1.5)


class Memo:
    """Hashes of words in a list, as ``word_hashes`` has them."""

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return word_hashes(pa.array([b" ".join(words)], pa.binary()).cast(pa.string()))[0]


def shingle_sets(column: pa.Array, words: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The documents' sets, ascending, and, if words' rarities are given, how rare each shingle is by its words."""
    h, lengths = word_hashes(column)
    every = shingle_hashes(h, WORDS)
    bits = None if words is None else words[h & np.uint64(WORD_COUNTERS - 1)].astype(np.int64)
    rare = None if bits is None else np.sum([bits[k : k + len(every)] for k in range(WORDS)], axis=0) if len(h) >= WORDS else bits
    for end, k in zip(np.cumsum(lengths).tolist(), lengths.tolist()):
        own = slice(end - k, end - WORDS + 1)
        s, r = every[own], None if rare is None else rare[own]
        if k < WORDS:  # one shingle, of all its words
            s, r = shingle_hashes(h[end - k : end], WORDS), None if bits is None else np.sum(bits[end - k : end], keepdims=True)[:k]
        order = np.argsort(s)
        s = s[order]
        first = np.concatenate(([True], s[1:] != s[:-1]))[: len(s)]
        yield s[first], None if r is None else r[order][first]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def indexed(n: np.ndarray) -> np.ndarray:
    """How many of the rarest shingles of sets of these sizes find partners of any size."""
    return n - -(-14 * n // 17) + 1


def probed(n: np.ndarray) -> np.ndarray:
    """How many find smaller partners, by what those have indexed."""
    return n - -(-7 * n // 10) + 1


def keys_of(s: np.ndarray, weight: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """The rarest shingles of an ascending set, rarest first; of equally rare ones the smallest hashes.

    weight: by counter, in 1/8 bit; words: by shingle, in 1/256 bit. The lower counts.
    """
    rare = 32 * weight[s & np.uint64(COUNTERS - 1)].astype(np.int64)
    if words is not None:
        rare = np.minimum(rare, words)
    return s[np.argsort((8192 - rare).astype(np.uint16), kind="stable")[: probed(len(s))]]


def counted(docs: DataFrame) -> np.ndarray:
    """How often words (by ``WORD_COUNTERS`` counters) and shingles (by ``COUNTERS``) stand in all texts, and the number of texts.

    A task counts in an array of fixed size and sends that in slices, a byte a counter and larger numbers besides; what
    a slice sums to comes to the driver as 1024 times its logarithm, in two bytes.
    """
    size = WORD_COUNTERS + COUNTERS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)

        def add(at: np.ndarray) -> None:
            at = np.sort(at.astype(np.int32))
            start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            total[at[start]] += np.diff(np.append(start, len(at))).astype(np.uint32)

        for batch in batches:
            for part in pieces(batch):
                h, lengths = word_hashes(part.column("text"))
                ends = np.cumsum(lengths)
                total[-1] += np.count_nonzero(lengths)
                if len(h):
                    add(h & np.uint64(WORD_COUNTERS - 1))
                if len(h) >= WORDS:
                    own = np.ones(len(h) - WORDS + 1, bool)
                    for k in range(1, WORDS):  # no shingle of the end of one text and the start of the next
                        own[(at := ends - k)[(at >= 0) & (at < len(own))]] = False
                    if own.any():
                        add((shingle_hashes(h, WORDS)[own] & np.uint64(COUNTERS - 1)) + np.uint64(WORD_COUNTERS))
        for k in range(0, size, SLICE) if total[-1] else ():
            n = total[k : k + SLICE]
            over = np.flatnonzero(n > 255)
            yield pa.record_batch([[k // SLICE], [np.minimum(n, 255).astype(np.uint8).tobytes()], [over.astype(np.int32).tobytes()], [(n[over] - 255).tobytes()]], names=["slice", "n", "at", "more"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n, at, more in zip(batch["slice"].to_pylist(), batch["n"], batch["at"], batch["more"]):
                low = np.frombuffer(n.as_buffer(), np.uint8)
                out = sums.setdefault(k, np.zeros(len(low), np.int64))
                out += low
                out[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(more.as_buffer(), np.uint32)
        for k, n in sums.items():
            yield pa.record_batch([[k], [np.round(1024 * np.log2(n + 1)).astype(np.uint16).tobytes()]], names=["slice", "n"])

    spark, out = docs.sparkSession, np.zeros(size, np.uint16)
    with shuffles_end(spark), batches_of(spark, 250):
        slices = docs.select("text").mapInArrow(count, "slice long, n binary, at binary, more binary").repartition("slice")
        table = slices.mapInArrow(total, "slice long, n binary").toArrow()
    for k, n in zip(table["slice"].to_pylist(), table["n"]):
        out[k * SLICE : (k + 1) * SLICE] = np.frombuffer(n.as_buffer(), np.uint16)
    return out


def weights(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How rare shingles are by their counters, in 1/8 bit, and words by theirs, in 1/256 bit; only the order of pieces depends on these."""
    n = np.exp2(counted(docs).astype(np.float32) / 1024) - 1
    words, shingles, texts = n[:WORD_COUNTERS], n[WORD_COUNTERS:-1], max(float(n[-1]), 1.0)
    every = max(float(words.sum(dtype=np.float64)), 1.0)
    # a shingle's bits are the sum of its words', less those of the places that a text has for it
    by_word = 256 * (np.log2(every / np.maximum(words, 1)) - np.log2(max(every / texts, 1)) / WORDS)
    load = float(np.median(shingles))
    more = shingles - load
    known = more > max(0.5, 4 * load**0.5)
    weight = np.full(COUNTERS, 255, np.uint8)
    weight[known] = np.clip(8 * np.log2(texts / more[known]), 0, 254)
    return weight, np.clip(by_word, 0, 1 << 14).astype(np.int16)


def dealt(keys: list[np.ndarray], cid: np.ndarray, n: np.ndarray, own: np.ndarray | None = None) -> dict[str, pa.ListArray]:
    """A batch's keys: those of more than ``SHORT`` classes are chained here, and one class for each range of sizes keeps the key.

    own: how many of a row's keys are indexed (the first ones; all if not given). keys, probes and the lists beside them
    are those of each row: indexed keys here and others; hot and upto, keys of many and the largest size in the range;
    cu and cv, the chain's edges.
    """
    rows = len(keys)
    lengths = np.array([len(k) for k in keys], np.int64)
    flat, owner = np.concatenate(keys) if rows else np.zeros(0, np.int64), np.repeat(np.arange(rows), lengths)
    index = np.ones(len(flat), bool) if own is None else np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < own[owner]
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(flat) else np.zeros(0, np.int64)
    many = np.repeat((size := np.diff(np.append(start, len(flat)))) > SHORT, size)
    at, rest = order[many], order[~many]
    at = at[np.lexsort((cid[owner[at]], ~index[at], n[owner[at]], flat[at]))]
    key, who, mine = flat[at], owner[at], index[at]
    last = last_indexed(mine)
    same = (last >= 0) & (key[last] == key) & (7 * n[who].astype(np.int64) <= 10 * n[who[last]].astype(np.int64))
    rest = np.sort(np.concatenate((rest, at[~same & ~mine])))  # what only probes, and finds nothing in the batch, goes on as it is
    key, who, last, mine, same = key[keep := same | mine], who[keep], who[last][keep], mine[keep], same[keep]
    head = np.flatnonzero(~same)
    tail = np.append(head[1:], len(key))[: len(head)] - 1
    a, b = cid[last[same]], cid[who[same]]

    def by_row(row: np.ndarray, *values: tuple[np.ndarray, pa.DataType]) -> list[pa.ListArray]:
        turn, lengths = np.argsort(row, kind="stable"), np.bincount(row, minlength=rows)
        return [list_array(lengths, v[turn], kind) for v, kind in values]

    long = pa.int64()
    hot, upto = by_row(who[head], (key[head], long), (n[who[tail]].astype(np.int64), long))
    cu, cv = by_row(who[same], (np.maximum(a, b), long), (np.minimum(a, b), long))
    (few,), (probes,) = (by_row(owner[x], (flat[x], long)) for x in (rest[index[rest]], rest[~index[rest]]))
    return {"keys": few, "probes": probes, "hot": hot, "upto": upto, "cu": cu, "cv": cv}


def last_indexed(index: np.ndarray) -> np.ndarray:
    """For each row the last one before it that is indexed, or -1."""
    return np.concatenate(([-1], np.maximum.accumulate(np.where(index, np.arange(len(index)), -1))[:-1])) if len(index) else np.zeros(0, np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, class, set size and the class's keys (once a task, else none), as ``dealt`` gives them."""
    sent = docs.sparkSession.sparkContext.broadcast(weights(docs))  # of fixed size, whatever the corpus

    def make():
        seen, (weight, words) = set(), sent.value

        def step(batch: pa.RecordBatch) -> dict:
            if len(seen) > 1_000_000:
                seen.clear()
            cid, size, sketch, keys = [], [], [], []
            for s, rare in shingle_sets(batch.column("text"), words):
                c = signed(xxhash.xxh3_64_intdigest(s.tobytes()))
                cid.append(c)
                size.append(len(s))
                sketch.append(bit_sketch(s))
                keys.append(keys_of(s, weight, rare).view(np.int64) if len(s) and c not in seen else np.zeros(0, np.int64))
                seen.add(c)
            n = np.array(size, np.int32)
            return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "cid": cid, "n": size, "sketch": sketch} | dealt(keys, np.array(cid, np.int64), n, indexed(n.astype(np.int64)))

        return step

    lists = ", ".join(f"{c} array<long>" for c in LISTS)
    with batches_of(docs.sparkSession, ROWS):
        out = written(map_arrow(docs, f"doc_id long, th long, cid long, n int, sketch binary, {lists}", make), "signatures")
    sent.destroy()
    return out


def runs(sigs: DataFrame) -> DataFrame:
    """u, v, chain: pairs of classes in a short run, neighbours in size of a long one, unless sizes rule a link out.

    Runs are sorted by size. A class that has the key indexed is paired with all larger ones, unless the key's places rule
    out that it is the first one in common, and a long run chains each
    class to the last smaller one that has it indexed; where these are too far apart no pair across the gap links. A row
    stands for a range of sizes: of one class, or of many that are chained already.
    """
    span = lambda hi, probe, many: F.shiftleft(F.col("n").cast("long"), 33) + F.shiftleft(hi.cast("long"), 2) + F.lit(2 * probe + many)
    n_indexed = F.expr("cast(n - (14L * n + 16) div 17 + 1 as long)")  # as indexed()

    def lone(c: str, before, probe: int) -> DataFrame:
        """With the key's place in the set's order, or less where keys before it are chained already."""
        return sigs.where(f"size({c}) > 0").select("n", "cid", F.posexplode(c).alias("at", "key")).select("key", span(F.col("at") + before, probe, 0).alias("span"), "cid")

    more = sigs.where("size(hot) > 0").select(F.explode(F.arrays_zip("hot", "upto")).alias("x"), "n", "cid")
    rows = lone("keys", F.lit(0), 0).unionAll(lone("probes", n_indexed, 1)).unionAll(more.select("x.hot", span(F.col("x.upto"), 0, 1), "cid"))
    rows = rows.repartition("key").sortWithinPartitions("key", F.shiftright("span", 33), "cid")  # in the same order in each run, so that long ones have edges in common

    def edges(key: np.ndarray, n: np.ndarray, cid: np.ndarray, upto: np.ndarray, left: np.ndarray, index: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
        """upto: the largest size so far in the run; left: how many shingles a set has from the key on."""
        found = []

        def add(a: np.ndarray, b: np.ndarray, ok: np.ndarray, chain: int) -> None:
            ok &= cid[a] != cid[b]
            a, b = cid[a[ok]], cid[b[ok]]
            found.append(np.stack((np.minimum(a, b), np.maximum(a, b), np.full(len(a), chain)), 1))

        for d in range(1, SHORT):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~long[d:])
            if not len(i):
                break
            i = i[index[i]]
            # the first key that sets have in common leaves each enough for what linked sets share
            add(i, i + d, (10 * n[i] >= 7 * n[i + d]) & (17 * np.minimum(left[i], left[i + d]) >= 7 * (n[i] + n[i + d])), 0)
        last = last_indexed(index)
        i = np.flatnonzero(long & (last >= 0) & (key[last] == key))
        add(last[i], i, 10 * upto[last[i]] >= 7 * n[i], 1)
        e = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        return pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(e[:, 2] == 1)], names=["u", "v", "chain"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_long = None, False  # the last run, until its end is seen: all its rows if short, its last indexed one if long
        for batch in batches:
            key, span, cid = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "span", "cid"))
            n, field, many = span >> 33, (span >> 2) & 0x7FFFFFFF, span & 1
            now = [key, n, cid, np.where(many, field, n), n - np.where(many, 0, field), (span >> 1) & 1 == 0, many]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            key = now[0]
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            is_long = (size > SHORT) | (np.add.reduceat(now[6], start) > 0)
            is_long[0] |= held_long and held is not None
            base = np.repeat(np.arange(len(start)), size) << 32
            now[3] = np.maximum.accumulate(now[3] + base) - base
            held_long = bool(is_long[-1])
            done = len(key) if held_long else int(start[-1])
            long = np.repeat(is_long, size)
            yield edges(*(x[:done] for x in now[:6]), long[:done])
            if held_long:
                mine = np.flatnonzero(now[5][start[-1] :])
                done = int(start[-1] + mine[-1]) if len(mine) else len(key) - 1
            held = [x[done : done + 1] if held_long else x[done:] for x in now]
        if held is not None and not held_long:
            yield edges(*held[:6], np.zeros(len(held[0]), bool))

    chained = sigs.where("size(cu) > 0").select(F.explode(F.arrays_zip("cu", "cv")).alias("x")).select("x.cu", "x.cv", F.lit(True))
    return rows.mapInArrow(run, "u long, v long, chain boolean").unionAll(chained).distinct()


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) whose bit sketches don't rule a link out."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            a, b = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            most = 3 * (batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()) // 17
            keep = pa.array(np.fromiter(map(hamming, a, b), np.int64, len(a)) <= most)
            return {"u": batch.column("u").filter(keep), "v": batch.column("v").filter(keep)}

        return step

    joined = pairs.join(side("a"), F.col("u") == F.col("a")).join(side("b"), F.col("v") == F.col("b"))
    return map_arrow(joined.select("u", "v", "na", "nb", "sa", "sb"), "u long, v long", make)


def cells(nodes: DataFrame, block: int, most: int) -> DataFrame:
    """nodes: cid, th, root, n, mult, sketch -> a row for each cell that a class enters, with its side (its block).

    A block has about block classes and most shingles. A component of up to that is one cell. A larger one is cut by size steps of 1.5, as classes that link are
    at most one step apart, and each step into blocks by hash; a cell is a pair of blocks.
    """
    needed = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(most))).cast("int")
    size = nodes.groupBy(F.col("root").alias("r2")).agg(needed.alias("c"))
    nodes = nodes.join(size, F.col("root") == F.col("r2")).drop("r2")
    nodes = nodes.withColumn("s", F.when(F.col("c") > 1, F.floor(F.log(F.col("n").cast("double")) / F.lit(STEP))).otherwise(0).cast("int"))
    per = nodes.groupBy(F.col("root").alias("r2"), "s").agg(needed.alias("nb"))
    per = per.groupBy("r2").agg(F.map_from_entries(F.collect_list(F.struct("s", "nb"))).alias("nb"))  # a root has a few dozen size steps
    nodes = nodes.join(per, F.col("root") == F.col("r2")).drop("r2")
    at = lambda s: F.coalesce(F.try_element_at("nb", s), F.lit(0))
    nodes = nodes.withColumn("b", F.pmod(F.xxhash64("cid"), at(F.col("s"))).cast("int"))
    blocks = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    spot = lambda s1, b1, s2, b2: F.struct(s1.alias("s1"), b1.alias("b1"), s2.alias("s2"), b2.alias("b2"))
    s, b = F.col("s"), F.col("b")
    within = F.transform(blocks(at(s)), lambda j: spot(s, F.least(b, j), s, F.greatest(b, j)))
    above = F.transform(blocks(at(s + 1)), lambda j: spot(s, b, s + 1, j))
    below = F.transform(blocks(at(s - 1)), lambda j: spot(s - 1, j, s, b))
    return nodes.select("root", "cid", "th", "n", "mult", "sketch", (F.shiftleft(s.cast("long"), 32) + b).alias("side"), F.explode(F.concat(within, above, below)).alias("spot"))


def sets_of(docs: DataFrame, sent) -> DataFrame:
    """The sets of documents (th) that a sent bitmap of the chosen ones lets by: cid, th, s."""

    def make():
        bits = sent.value

        def step(batch: pa.RecordBatch) -> dict | None:
            th = batch.column("th").to_numpy()
            rows = np.flatnonzero(may_hold(bits, th.view(np.uint64)))
            if not len(rows):
                return None
            got = [s for s, _ in shingle_sets(batch.column("text").take(pa.array(rows)))]
            cid = [signed(xxhash.xxh3_64_intdigest(s.tobytes())) for s in got]
            return {"cid": cid, "th": th[rows], "s": list_array([len(s) for s in got], np.concatenate(got).view(np.int64), pa.int64())}

        return step

    return map_arrow(docs, "cid long, th long, s array<long>", make)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles per bucket; the buckets are a power of two, two to four times the set's size."""
    bits = max(512, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 512
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def folded(x: np.ndarray) -> np.ndarray:
    """The sketch with half the buckets."""
    half = x.shape[-1] // 2
    return x[..., :half] ^ x[..., half:]


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = folded(x)
    while len(y) > len(x):
        y = folded(y)
    return int(np.bitwise_count(x ^ y).sum())


def linked_in(cid: np.ndarray, n: np.ndarray, mult: np.ndarray, side: np.ndarray, sketches: list[bytes], sets: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a cell: the smallest class it hangs together with there, and the documents linked directly.

    Without sets, what the sketches don't rule out counts as linked.
    """
    k = len(cid)
    order = np.lexsort((cid, n))
    cid, n, mult, side = cid[order], n[order].astype(np.int64), mult[order], side[order]
    width = np.array([len(sketches[i]) for i in order.tolist()])  # ascending, as sizes are
    of, half = {}, {}
    for w in np.unique(width).tolist():
        rows = order[width == w].tolist()
        of[w] = np.frombuffer(b"".join(sketches[i] for i in rows), np.uint64).reshape(len(rows), -1)
        half[w] = folded(of[w])
    first = {w: int(np.searchsorted(width, w)) for w in of}
    sets = sets and [sets[i] for i in order.tolist()]
    bits = sets and set_bits(sets)
    two = len(np.unique(side)) > 1
    piece, add = np.arange(k), np.zeros(k, np.int64)
    for i in range(k - 1):
        stop = int(np.searchsorted(7 * n, 10 * n[i], "right"))
        if stop <= i + 1:
            continue
        w = int(width[i])
        own = of[w][i - first[w]]
        edge = min(stop, first[w] + len(of[w]))
        far = [np.bitwise_count(of[w][i + 1 - first[w] : edge - first[w]] ^ own).sum(1)]
        if edge < stop:  # sizes up to 10 / 7 apart: buckets at most double
            far.append(np.bitwise_count(half[2 * w][: stop - edge] ^ own).sum(1))
        ok = np.concatenate(far) <= 3 * (n[i] + n[i + 1 : stop]) // 17
        if two:
            ok &= side[i + 1 : stop] != side[i]
        j = np.flatnonzero(ok) + i + 1
        if sets and len(j):
            both = np.array([in_both(sets[i], sets[x]) for x in j.tolist()]) if bits is None else np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
            j = j[100 * both >= 70 * (n[i] + n[j] - both)]
        if len(j):
            add[i] += mult[j].sum()
            add[j] += mult[i]
            met = np.unique(np.append(piece[j], piece[i]))
            if len(met) > 1:
                piece[np.isin(piece, met)] = met[0]
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, piece, cid)
    back, more = np.empty(k, np.int64), np.empty(k, np.int64)
    back[order], more[order] = least[piece], add
    return back, more


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def set_bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """A row of bits for each set, a bit for each shingle that several sets have; none if that takes more than ``MOST_BITS``."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    words = int((times > 1).sum() + 63) // 64
    if not 0 < 64 * words * len(sets) <= MOST_BITS:
        return None
    shared = times[at] > 1
    at, owner = (np.cumsum(times > 1) - 1)[at[shared]], owner[shared]
    place = owner * words + at // 64  # ascending, as sets are
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    out = np.zeros(len(sets) * words, np.uint64)
    out[place[start]] = np.bitwise_or.reduceat(np.uint64(1) << (at % 64).astype(np.uint64), start)
    return out.reshape(len(sets), words)


def links(entries: DataFrame, exact: bool) -> DataFrame:
    """entries: root, spot, side, cid, n, mult, sketch and, if exact, s -> cid, peer, n_linked for those that have links."""

    def compare(table: pa.Table) -> pa.Table:
        cid = table["cid"].to_numpy()
        keep = np.unique(cid, return_index=True)[1]  # a class may come from several repeated rows
        table = table.take(pa.array(keep)).combine_chunks()
        cid, n, mult, side = (table[c].to_numpy() for c in ("cid", "n", "mult", "side"))
        sets = None
        if exact:
            s = table["s"].combine_chunks()
            s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
            sets = [s[i].values.to_numpy().view(np.uint64) for i in range(len(s))]
        peer, add = linked_in(cid, n, mult, side, table["sketch"].to_pylist(), sets)
        return pa.table({"cid": cid, "peer": peer, "n_linked": add})

    # one grouping column: a partitioning by root would put all cells of a large component in one task
    return entries.withColumn("cell", F.struct("root", "spot")).drop("root", "spot").groupBy("cell").applyInArrow(compare, "cid long, peer long, n_linked long").where("n_linked > 0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: its set's size, class, the number of other documents linked directly, and its component, by its smallest id and by a number of its own."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("th", F.xxhash64("doc_id", "text"))
    keyed = signatures(slim)
    sigs = written(keyed.drop(*LISTS), "members")
    edges = written(runs(keyed), "edges")
    discard(keyed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f")
    classes = sigs.where("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.count("*").alias("mult"), F.max("sketch").alias("sketch"), first)
    classes = written(classes.select("cid", "n", "mult", "sketch", "f.doc_id", "f.th"), "classes")
    at_root = lambda roots: classes.join(roots, F.col("cid") == F.col("node")).drop("node")
    rough = cells(at_root(components(edges.where("chain"))), SKETCH_BLOCK, SKETCH_SHINGLES).drop("th")
    may = links(rough, exact=False).select(F.col("cid").alias("u"), F.col("peer").alias("v"))
    nodes = written(at_root(components(close(edges.where("not chain"), classes).unionAll(may))), "nodes")
    sent = slim.sparkSession.sparkContext.broadcast(bitmap(nodes, "th"))  # of fixed size; it leaves out nearly all others
    sets = sets_of(slim, sent).select(F.col("cid").alias("c2"), F.col("th").alias("t2"), "s")
    entries = cells(nodes, BLOCK, BLOCK_SHINGLES).join(sets, (F.col("cid") == F.col("c2")) & (F.col("th") == F.col("t2"))).drop("c2", "t2", "th")
    with batches_of(slim.sparkSession, ROWS):
        found = written(links(entries, exact=True), "links")
    sent.destroy()
    discard(edges)
    discard(nodes)
    joined = components(found.select(F.col("cid").alias("u"), F.col("peer").alias("v")))
    counts = found.groupBy(F.col("cid").alias("c3")).agg(F.sum("n_linked").alias("n_linked"))
    per = classes.join(joined, F.col("cid") == F.col("node"), "left").join(counts, F.col("cid") == F.col("c3"), "left")
    per = per.select("cid", "mult", "doc_id", F.coalesce("root", "cid").alias("root"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    least = per.groupBy(F.col("root").alias("r2")).agg(F.min("doc_id").alias("component_id"))
    per = per.join(least, F.col("root") == F.col("r2")).select(F.col("cid").alias("c4"), (F.col("mult") - 1 + F.col("n_linked")).alias("n_similar"), "component_id", F.col("root").alias("group_id"))
    out = sigs.join(per, F.col("cid") == F.col("c4"), "left")
    return out.select(
        "doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cid").alias("class_id"), "group_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest id, and of equal ids that of the smallest text hash.

    Rows equal in id and text are one document and leave one row. Documents with a null id stand for a component only if
    all of its documents have none. Columns stay as they were.
    """
    names = docs.columns
    near = near_duplicates(docs)
    lone = F.when(F.col("n_shingles") > 0, F.col("group_id")).otherwise(F.coalesce("doc_id", F.col("th")))  # several components may have an id in common
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    chosen = near.groupBy((F.col("n_shingles") > 0).alias("any"), lone.alias("group")).agg(F.min(place).alias("f")).select(F.col("f.th").alias("t2"), F.col("f.doc_id").alias("d2"))
    rows = near.groupBy(F.col("th").alias("t3")).agg(F.count("*").alias("rows"))
    chosen = chosen.join(rows, F.col("t2") == F.col("t3")).drop("t3")
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"], F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body"))
    flat = flat.withColumn("th", F.xxhash64("id", "body"))
    left = flat.join(chosen.hint("shuffle_hash"), (F.col("th") == F.col("t2")) & F.col("id").eqNullSafe(F.col("d2")))
    # only rows that are repeated take the way through a distinct
    left = left.where("rows = 1").unionByName(left.where("rows > 1").dropDuplicates(["th", "id"]))
    return left.select(*[F.col("body" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])


SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end as g from d, unnest(generate_series(1, greatest(len(w) - 2, 1))) t(i) where len(w) > 0),
n as (select r, count(*) as n from s group by r),
p as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by a.r, b.r),
l as (select x, y from p join n a on a.r = x join n b on b.r = y where 100 * c >= 70 * (a.n + b.n - c)),
reach as (select r as x, r as y from d union select reach.x, l.y from reach join l on l.x = reach.y),
c as (select reach.x, min(d.doc_id) as component_id from reach join d on d.r = reach.y group by reach.x),
k as (select x, count(*) as n_similar from l group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(k.n_similar, 0)::bigint as n_similar, c.component_id
from d join c on c.x = d.r left join n on n.r = d.r left join k on k.x = d.r
"""
