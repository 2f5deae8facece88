"""Personal data, and the terms that give it away.

Addresses of mail and network, card and phone numbers are found by pattern. Terms are judged by what the corpus says:
with N documents, a term in n(t), an entity in n(e) and both in n(t, e) of them, anywhere in the text, the disclosure is
PMI(t, e) / IC(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)), which is 1 when the term occurs with the entity only.
Where it reaches ``GENERALISE`` with some entity the term is replaced by its kind, at ``REMOVE`` it is removed, wherever
it stands in the corpus. Pairs seen in fewer than ``MIN_PAIR`` documents are no evidence. Words that touch an entity's
span are no terms there.

As n(t, e) <= n(e), a term of n(t) > N ^ (1 - GENERALISE) n(e) ^ GENERALISE can't reach it; such pairs are never listed.
Terms are counted among the documents that hold entities first: what is too common or too rare there is never counted in
the others, and a bitmap of fixed size keeps the rest of the corpus's words out of the shuffle.

Keys and passwords reveal by themselves, whatever stands beside them: a run of 16 characters or more that mixes letters and
digits, of ``MIN_BITS`` bits of entropy a character, is a secret and is removed.

Defined cases: null text counts as empty; repeated rows count as documents each; an empty table gives an empty result;
other columns are carried by ``sanitise`` whatever their names, and ignored by ``find``.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.bitmap import BITS, bitmap
from loamsift.llm.kernel import MEMO_WORDS, as_bytes, discard, map_arrow, written

MIN_PAIR, GENERALISE, REMOVE = 2, 0.85, 0.98
KINDS = ("email", "ip", "card", "phone", "secret", "term")
MIN_BITS, MIN_CHANGES, MOST_SENT = 2.75, 4, 1 << 20
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}")
KEY_ID = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z")
CHANGE = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?()[]{}\"'"
EDGE_BYTES = EDGES.encode()
BLANK = " \t\n\x0b\x0c\r"
GENERAL = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
FOUND = "doc_id long, text_key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:int,stop:int>>, secrets array<struct<start:int,stop:int>>, entities array<long>, terms array<long>"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: what stands before it is the local part, as far back as allowed."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCALS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Spans of keys and passwords: long runs of letters and digits in turn that look drawn at random."""
    if not any(len(w) > 15 and not w.isalpha() for w in text.split()):
        return []
    out = []
    for m in SECRET.finditer(text):
        run = m[0]
        mixed = len(CHANGE.findall(run)) >= MIN_CHANGES and -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= MIN_BITS
        if mixed or KEY_ID.match(run):
            out.append((m.start(), m.end()))
    return out


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The distinct entities of a text's spans."""
    return list(dict.fromkeys(KINDS[k] + ":" + (text[s:e].lower() if k == 0 else text[s:e] if k == 1 else NOT_DIGIT.sub("", text[s:e])) for k, s, e in spans))


def whole(text: str, word: str) -> Iterator[tuple[int, int]]:
    """Where a word stands between blanks."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if (not at or text[at - 1] in BLANK) and (end == len(text) or text[end] in BLANK):
            yield at, end
        at = text.find(word, end)


def places(text: str, spans: list[tuple[int, int, int]], words: list[str] | None = None) -> list[tuple[str, int, int]]:
    """(term, start, end) of a text's words, or of those given, without the punctuation around them; words that touch a span are no terms."""
    order = sorted((s, e) for _, s, e in spans)
    reach = []  # furthest end of the spans up to each, so that one look tells whether a word touches any
    for s, e in order:
        reach.append(max(e, reach[-1] if reach else 0))
    out = []
    for start, stop in (m.span() for m in WORDS.finditer(text)) if words is None else (x for w in words for x in whole(text, w)):
        word = text[start:stop].lstrip(EDGES)
        ws = stop - len(word)
        word = word.rstrip(EDGES)
        we = ws + len(word)
        i = bisect.bisect_left(order, (we, 0))
        if word and not (i and reach[i - 1] > ws):
            out.append((word, ws, we))
    return out


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(term, entity, start, end) of every term of a text with each of its entities; the plan counts these pairs without listing them."""
    return [(w, x, s, e) for x in entities(text, spans) for w, s, e in places(text, spans)]


def hashed(value: str) -> int:
    return xxhash.xxh3_64_intdigest(as_bytes(value))


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


class Terms(dict):
    """Word as it stands -> hash of its term, 0 for bare punctuation and for terms that aren't sought; starts anew when full.

    sought: the hashes in order, or a bitmap that lets by all of them and few others.
    """

    def __init__(self, sought: np.ndarray, exact: bool) -> None:
        self.sought, self.bits = (sought, None) if exact else (None, sought.tobytes())

    def has(self, h: int) -> bool:
        if self.bits is not None:
            low = h & ((1 << BITS) - 1)
            return bool(self.bits[low >> 3] >> (low & 7) & 1)
        at = int(np.searchsorted(self.sought, np.uint64(h)))
        return at < len(self.sought) and int(self.sought[at]) == h

    def __missing__(self, word: bytes) -> int:
        if word.isascii():
            term = word.strip(EDGE_BYTES).lower()
        else:
            term = as_bytes(word.decode("utf-8", "surrogatepass").strip(EDGES).lower())
        h = xxhash.xxh3_64_intdigest(term) if term else 0
        value = self[word] = h if h and self.has(h) else 0
        return value

    def words(self, text: str) -> list[bytes]:
        """The text's distinct words whose terms are sought."""
        if len(self) > 2 * MEMO_WORDS:  # nearly all values are 0, which takes no room
            self.clear()
        get = self.__getitem__
        return [w for w in set(as_bytes(text).split()) if get(w)]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))


def findings(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "secrets", "entities", "terms")}
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for k, n in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                    rows[n].append(sum(s[0] == k for s in spans))
                rows["base_sha256"].append(hashlib.sha256(digest(spans).encode()).hexdigest())
                rows["base"].append([{"kind": k, "start": s, "stop": e} for k, s, e in spans])
                rows["secrets"].append([{"start": s, "stop": e} for s, e in secrets(text)])
                rows["entities"].append(signed([hashed(x) for x in entities(text, spans)]))
                rows["terms"].append(signed([hashed(t) for t in {w.lower() for w, _, _ in places(text, spans)}] if spans else []))
            return {c: batch.column(c) for c in ("doc_id", "text_key")} | rows

        return step

    return map_arrow(keyed(docs), FOUND, make)


def term_counts(docs: DataFrame, sent) -> DataFrame:
    """t2, n_t: documents per term, of the terms that the sent bitmap lets by."""

    def make():
        memo = Terms(sent.value, False)

        def step(batch: pa.RecordBatch) -> dict | None:
            out = [h for t in batch.column("text").to_pylist() for h in {memo[w] for w in memo.words(t)}]
            return {"t2": signed(out)} if out else None

        return step

    return map_arrow(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), "t2 long", make).groupBy("t2").agg(F.count("*").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """t, disclosure: the terms whose disclosure of some entity is too high, with the highest."""
    total = float(max(found.count(), 1))
    # copies of a text are counted before they are unfolded, so a hot text is one row here
    weight = found.where(F.size("entities") > 0).groupBy("text_key").agg(F.count("*").alias("n_docs"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    weight = written(weight, "holders")
    held = weight.select("text_key", "n_docs", F.explode("entities").alias("e"))
    n_e = written(held.groupBy(F.col("e").alias("e2")).agg(F.sum("n_docs").alias("n_e")).where((F.col("n_e") >= MIN_PAIR) & (F.col("n_e") < total)), "entities")
    most = lambda n: F.pow(F.lit(total), F.lit(1 - GENERALISE)) * F.pow(n, F.lit(GENERALISE)) * (1 + 1e-9)
    top = n_e.agg(F.max("n_e")).first()[0] or 0
    there = weight.select("n_docs", F.explode("terms").alias("t3")).groupBy("t3").agg(F.sum("n_docs").alias("n_h"))
    there = written(there.where((F.col("n_h") >= MIN_PAIR) & (F.col("n_h") <= most(F.lit(float(top))))), "rare")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(there, "t3"))
    n_t = term_counts(docs, sent).where(F.col("n_t") <= most(F.lit(float(top)))).join(there, F.col("t2") == F.col("t3"), "left_semi")
    terms = weight.select("text_key", F.explode("terms").alias("t")).join(n_t, F.col("t") == F.col("t2")).select(F.col("text_key").alias("k2"), "t", "n_t")
    both = held.join(n_e, F.col("e") == F.col("e2")).join(terms, F.col("text_key") == F.col("k2")).where(F.col("n_t") <= most(F.col("n_e")))
    scored = both.groupBy("t", "e").agg(F.sum("n_docs").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")).where(F.col("n_te") >= MIN_PAIR)
    ic = F.log(F.lit(total) / F.col("n_e"))
    pmi = F.log(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    flagged = scored.select("t", F.least(pmi / ic, F.lit(1.0)).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    out = written(flagged.groupBy("t").agg(F.max("disclosure").alias("disclosure")), "flagged")
    sent.destroy()
    discard(there)
    discard(weight)
    discard(n_e)
    return out


def standing(docs: DataFrame, sent, exact: bool) -> DataFrame:
    """text_key, t3, start, stop: where the sent terms stand; not exact: those that the sent bitmap lets by."""

    def make():
        memo = Terms(sent.value, exact)

        def step(batch: pa.RecordBatch) -> dict | None:
            rows, t3, start, stop = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                words = memo.words(text)
                if not words:
                    continue
                for word, s, e in places(text, base_spans(text), [w.decode("utf-8", "surrogatepass") for w in words]):
                    rows.append(r)
                    t3.append(hashed(word.lower()))
                    start.append(s)
                    stop.append(e)
            if not rows:
                return None
            return {"text_key": batch.column("text_key").take(pa.array(rows)), "t3": signed(t3), "start": start, "stop": stop}

        return step

    return map_arrow(keyed(docs), "text_key string, t3 long, start int, stop int", make)


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """text_key -> terms: the flagged spans of that text with their disclosure.

    Up to ``MOST_SENT`` flagged terms are sent to the tasks, beyond that a bitmap of fixed size; the join decides in either case.
    """
    flagged = disclosing(docs, found)
    exact = flagged.count() <= MOST_SENT
    known = np.sort(flagged.select("t").toArrow()["t"].to_numpy().view(np.uint64)) if exact else bitmap(flagged, "t")
    hits = standing(docs, docs.sparkSession.sparkContext.broadcast(known), exact).distinct().join(flagged, F.col("t3") == F.col("t"))
    return hits.groupBy(F.col("text_key").alias("key2")).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "disclosure"))).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans with secrets and disclosing terms, and whether there are any."""
    found = written(findings(docs), "found")
    out = found.drop("entities", "terms").join(term_spans(docs, found), F.col("text_key") == F.col("key2"), "left")
    name = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"]))
    extra = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,disclosure:double>>")), lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["stop"]))
    hidden = F.transform("secrets", lambda s: F.concat_ws(":", F.lit("secret"), s["start"], s["stop"]))
    n_term = F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms")).cast("long")
    n_secret = F.size("secrets").cast("long")
    private = (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + n_secret + n_term) > 0
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(F.concat(base, hidden, extra), ",").alias("spans"), n_term.alias("n_term"), n_secret.alias("n_secret"), private.alias("private")
    )


def redact(text: str | None, terms: list[dict] | None) -> str | None:
    """The text with base spans generalised and disclosing terms generalised or removed, the longest span first."""
    if text is None:
        return None
    marks = [(s, e, GENERAL[KINDS[k]]) for k, s, e in base_spans(text)] + [(s, e, "") for s, e in secrets(text)]
    for t in terms if terms is not None else []:
        word = text[t["start"] : t["stop"]]
        kind = "<NUMBER>" if word.isdigit() else "<NAME>" if word[:1].isupper() else "<TERM>"
        marks.append((t["start"], t["stop"], "" if t["disclosure"] >= REMOVE else kind))
    out, at = [], 0
    for s, e, put in sorted(marks, key=lambda m: (m[0], -m[1])):
        if s >= at:
            out += [text[at:s], put]
            at = e
        elif e > at:  # the spans overlap: what sticks out goes too
            at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with their text sanitised; all columns stay."""
    found = written(findings(docs), "found")
    spans = term_spans(docs, found)
    clean = F.pandas_udf(lambda t, s: pd.Series([redact(a, b) for a, b in zip(t, s)], dtype=object), "string")
    names = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"], F.col("text").alias("body"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    out = flat.join(spans, F.col("key") == F.col("key2"), "left").withColumn("new", clean("body", "terms"))
    return out.select(*[F.col("new" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])
