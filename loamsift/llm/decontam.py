"""Benchmark decontamination by template canonicalisation.

Words lose the punctuation around them and their case. Numbers, units of measure and names (capitalised words inside a
sentence) become typed placeholders; a number glued to a unit becomes both. Windows of ``WINDOW`` template tokens (an
item's whole template where it is shorter) are joined between documents and items by hash and then by the template
itself. Windows of which less than half of the tokens are words, and items below ``MIN_ITEM`` tokens, say too little as
templates: they match word for word only, whatever their length, so an item of one word is found wherever that stands.
Along one alignment of a document with an item, the slots must agree: one value in the item stands for one value in the
document, up to ``MIN_CONSISTENT`` of the values. A document is contaminated by an item of which it holds ``MIN_COVERAGE``
at a consistent alignment: of the template windows, whatever the numbers and names in it, or of all windows.

A template that several items share is held against the slots of each. Items whose whole templates are equal are one
item, named by the smallest id, but only once documents have been found. Documents are filtered by a bitmap of fixed
size before they are joined.

Defined cases: rows equal in id and text are one document; null and empty texts hold nothing; items with null text or
id are ignored; an empty benchmark contaminates nothing; an empty table gives an empty result; extra columns are carried
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.bitmap import bitmap, may_hold
from loamsift.llm.kernel import MEMO_WORDS, as_bytes, map_arrow, mix, written

WINDOW, MIN_ITEM, MIN_COVERAGE, MIN_CONSISTENT = 13, 8, 0.3, 0.8
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t lb lbs pound pounds oz ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years % percent $ € £ usd eur dollar dollars cent cents euro euros mph kmh hz khz mhz ghz kb mb gb tb w kw kwh v j kj cal kcal k c f °c °f".split()
)
EDGES = b".,;:!?()[]{}\"'`*_"
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,/:]*\Z")
GLUED = re.compile(r"([+-]?[0-9][0-9.,]*)([^0-9.,].*)\Z")
LITERAL, NUM, UNIT, NAME = range(4)
PLACE = ("", "<NUM>", "<UNIT>", "<NAME>")
B = 0x9E3779B97F4A7C15
SCHEMA = "doc long, key long, at int, whash long, template string, slots array<string>, exact boolean"


def tokens_of(word: bytes) -> list[tuple[int, str]]:
    """(kind, value) of a word: none for bare punctuation, two for a number glued to a unit."""
    text = word.strip(EDGES).decode("utf-8", "replace")
    low = text.lower()
    if not text:
        return []
    if NUMBER.match(low):
        return [(NUM, low.replace(",", ""))]
    glued = GLUED.match(low)
    if glued and glued[2] in UNITS:
        return [(NUM, glued[1].replace(",", "")), (UNIT, glued[2])]
    if low in UNITS and len(low) > 1 or low in ("%", "$", "€", "£"):
        return [(UNIT, low)]
    return [(NAME if text[0].isupper() else LITERAL, low)]


class Words(dict):
    """Word -> place in arrays of what its tokens are; names carry both hashes, as a sentence's first word is none."""

    def __init__(self) -> None:
        self.first, self.second = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.value, self.value2 = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.kind, self.kind2 = np.zeros(1 << 12, np.int8), np.zeros(1 << 12, np.int8)
        self.count, self.ends = np.zeros(1 << 12, np.int8), np.zeros(1 << 12, bool)
        self.fixed = [np.uint64(mix(np.array([k + 1], np.uint64))[0]) for k in range(4)]

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        if place == len(self.first):
            for a in ("first", "second", "value", "value2", "kind", "kind2", "count", "ends"):
                setattr(self, a, np.resize(getattr(self, a), 2 * place))
        tokens = tokens_of(word)
        self.count[place], self.ends[place] = len(tokens), word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")
        for k, (kinds, hashes, values) in enumerate(((self.kind, self.first, self.value), (self.kind2, self.second, self.value2))):
            if k < len(tokens):
                kinds[place] = tokens[k][0]
                values[place] = xxhash.xxh3_64_intdigest(tokens[k][1].encode())
                hashes[place] = self.fixed[tokens[k][0]] if tokens[k][0] in (NUM, UNIT) else values[place]
        return place


class Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", B), ("down", pow(B, -1, 1 << 64))):
                a = np.full(size, np.uint64(base), np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self.up[:n], self.down[:n]


def scanner(lengths: list[int], exact_lengths: list[int], bits: np.ndarray | None, all_firsts: bool) -> Callable[[list[str | None]], list[tuple]]:
    """texts -> (text's number, first token, hash, template, slots, exact) of every window of the lengths that ``bits`` lets by.

    lengths are those of windows that match by their template, exact_lengths of those that match word for word.

    all_firsts: a text's first token is also read as a name, as it would be in the middle of another text.
    """
    memo, powers = Words(), Powers()
    lens, salt = sorted({*lengths, *exact_lengths}), np.uint64(1 << 32)

    def scan(texts: list[str | None]) -> list[tuple]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        split = [as_bytes(t).split() for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        flat = [w for words in split for w in words]
        at = np.fromiter(map(memo.__getitem__, flat), np.int64, len(flat))
        if not len(at):
            return []
        of = np.repeat(np.arange(len(texts)), n_words)
        initial = np.ones(len(at), bool)
        initial[1:] = memo.ends[at[:-1]] | (of[1:] != of[:-1])
        count = memo.count[at]
        wi = np.repeat(np.arange(len(at)), count)
        if not len(wi):
            return []
        two = np.zeros(len(wi), bool)
        two[1:] = wi[1:] == wi[:-1]
        place = at[wi]
        kind = np.where(two, memo.kind2[place], memo.kind[place])
        h = np.where(two, memo.second[place], memo.first[place])
        name = (kind == NAME) & ~initial[wi]
        h = np.where(name, memo.fixed[NAME], h)
        literal = (kind == LITERAL) | ((kind == NAME) & initial[wi])
        of = of[wi]
        up, down = powers.upto(len(h))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up)))
        if exact_lengths:
            h_exact = np.where(two, memo.value2[place], memo.value[place])
            total_exact = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h_exact * up)))
        words = np.concatenate((np.zeros(1, np.int64), np.cumsum(literal)))
        begin = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1))
        out = []

        def emit(i: int, n: int, value: int, as_name: bool, exact: bool = False) -> None:
            template, slots = [], []
            for j in range(i, i + n):
                k, v = tokens_of(flat[wi[j]])[int(two[j])]
                if k == NAME and initial[wi[j]] and not (exact or as_name and j == i):  # what matches word for word is read alike everywhere
                    k = LITERAL
                template.append(v if exact else PLACE[k] or v)
                if k:
                    slots.append(v)
            out.append((int(of[i]), int(i - begin[np.searchsorted(begin, i, "right") - 1]), value, " ".join(template), slots, exact))

        for n in lens:
            if len(h) < n:
                continue
            inside = of[n - 1 :] == of[: len(of) - n + 1]
            wordy = (2 * (words[n:] - words[:-n]) >= n) & (n >= MIN_ITEM)
            if n in lengths:
                hashes = mix((total[n:] - total[:-n]) * down[: len(h) - n + 1] + np.uint64(n))
                good = inside & wordy
                if bits is not None:
                    good &= may_hold(bits, hashes)
                for i in np.flatnonzero(good).tolist():
                    emit(i, n, int(hashes[i].astype(np.int64)), False)
            if n in exact_lengths:
                rest = inside & ~wordy
                if all_firsts:  # what has too few words with its first token read as a name
                    rest[begin[begin < len(rest)]] = True
                    rest &= inside
                at_rest = np.flatnonzero(rest)
                hashes_exact = mix((total_exact[at_rest + n] - total_exact[at_rest]) * down[at_rest] + np.uint64(n) + salt)
                if bits is not None:
                    let = may_hold(bits, hashes_exact)
                    at_rest, hashes_exact = at_rest[let], hashes_exact[let]
                for i, x in zip(at_rest.tolist(), hashes_exact.view(np.int64).tolist()):
                    if wordy[i] and not (kind[i] == NAME and 2 * (words[i + n] - words[i] - 1) < n):
                        continue
                    emit(i, n, x, False, True)
            if all_firsts and n >= MIN_ITEM:
                for i in begin.tolist():
                    if kind[i] == NAME and i + n <= len(h) and of[i] == of[i + n - 1] and 2 * (words[i + n] - words[i] - 1) >= n:
                        changed = total[i + n : i + n + 1] - total[i : i + 1] + up[i : i + 1] * (memo.fixed[NAME] - h[i : i + 1])
                        emit(i, n, int(mix(changed * down[i] + np.uint64(n)).astype(np.int64)[0]), True)
        return out

    return scan


def template_key(text: str) -> int:
    """Hash of a text's whole template."""
    out, initial = [], True
    for word in as_bytes(text).split():
        out += [v if k == LITERAL or k == NAME and initial else PLACE[k] for k, v in tokens_of(word)]
        initial = word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")
    return xxhash.xxh3_64_intdigest(" ".join(out).encode()) - (1 << 63)


def windows(texts: DataFrame, lengths: list[tuple[bool, int]] | None, bits: np.ndarray | None) -> DataFrame:
    """texts: doc, key, text -> windows. lengths: (exact, length); None: each text's own, as for items; key is the template's then."""

    def make():
        own = {n: scanner([n], [n], None, True) for n in range(1, WINDOW + 1)} if lengths is None else None
        shared = None if lengths is None else scanner([n for x, n in lengths if not x], [n for x, n in lengths if x], bits, False)

        def step(batch: pa.RecordBatch) -> dict | None:
            texts, key = batch.column("text").to_pylist(), batch.column("key")
            if shared is not None:
                found = shared(texts)
            else:
                found, key = [], pa.array([template_key(t) for t in texts], pa.int64())
                for r, t in enumerate(texts):
                    n = min(WINDOW, sum(len(tokens_of(w)) for w in as_bytes(t).split()))
                    found += [(r, *x[1:]) for x in own[n]([t])] if n else []
            if not found:
                return None
            rows, at, whash, template, slots, exact = map(list, zip(*found))
            take = pa.array(rows)
            return {"doc": batch.column("doc").take(take), "key": key.take(take), "at": at, "whash": whash, "template": template, "slots": slots, "exact": exact}

        return step

    return map_arrow(texts, SCHEMA, make)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc, key, text -> doc, key, item, coverage, verbatim for contaminated ones."""
    items = benchmark.where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("doc")).withColumn("key", F.lit(0).cast("long"))
    every = written(windows(items, None, None), "items")
    owned = every.groupBy(F.col("whash").alias("wh"), F.col("template").alias("tp"), F.col("doc").alias("item"), F.col("slots").alias("item_slots"), F.col("exact").alias("word_for_word"))
    owned = written(owned.agg(F.min("at").alias("item_at"), F.min("key").alias("item_key")), "owned")
    size = F.size(F.split("tp", " "))
    lengths = [(r[0], r[1]) for r in owned.select("word_for_word", size.alias("n")).distinct().collect()]  # 2 WINDOW - MIN_ITEM + 1 at most
    by_template = lambda at: F.countDistinct(F.when(~F.col("word_for_word"), at))
    per_item = owned.groupBy(F.col("item").alias("i2"), F.col("item_key").alias("k2")).agg(F.countDistinct("item_at").alias("n_owned"), by_template(F.col("item_at")).alias("n_templates"))
    names = owned.groupBy(F.col("item_key").alias("k3")).agg(F.min("item").alias("name"))
    per_item = per_item.join(names, F.col("k2") == F.col("k3")).select("i2", "n_owned", "n_templates", "name")
    found = windows(docs, lengths, bitmap(owned, "wh")) if lengths else every.limit(0)
    pairs = found.join(owned, (F.col("whash") == F.col("wh")) & (F.col("template") == F.col("tp")))
    pairs = pairs.withColumn("slot", F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))
    lined = pairs.groupBy("doc", "key", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.countDistinct("item_at").alias("n"), by_template(F.col("item_at")).alias("n_t"), F.array_distinct(F.flatten(F.collect_set("slot"))).alias("slot")
    )
    values = F.size(F.array_distinct(F.transform("slot", lambda s: s["a"])))
    good = (F.size("slot") == 0) | (values >= MIN_CONSISTENT * F.size("slot"))
    same = F.forall("slot", lambda s: s["a"] == s["b"])
    lined = lined.where(good).join(per_item, F.col("item") == F.col("i2")).withColumn("coverage", F.greatest(F.col("n") / F.col("n_owned"), F.when(F.col("n_templates") > 0, F.col("n_t") / F.col("n_templates"))))
    return lined.where(F.col("coverage") >= MIN_COVERAGE).groupBy("doc", "key", F.col("name").alias("item")).agg(F.max("coverage").alias("coverage"), F.max(same).alias("verbatim"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: contaminated, n_items, items (ids, ascending), verbatim (an item stands there as it is), coverage."""
    per = hits(_keyed(docs), benchmark).groupBy(F.col("doc").alias("d2"), F.col("key").alias("k2")).agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.max("verbatim").alias("verbatim"), F.round(F.max("coverage"), 4).alias("coverage")
    )
    out = _keyed(docs).select("doc", "key").join(per, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2")), "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"), F.coalesce("verbatim", F.lit(False)).alias("verbatim"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, columns as they were."""
    bad = hits(_keyed(docs), benchmark).select(F.col("doc").alias("d2"), F.col("key").alias("k2")).distinct()
    names = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"))
    left = flat.join(bad.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2")), "left_anti")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
