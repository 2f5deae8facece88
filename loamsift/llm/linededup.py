"""Line dedup by overlapping three-line windows.

A text's lines that hold a word, trimmed of blanks, form windows of three consecutive ones. Windows that are equal
anywhere in the corpus are found by hash (128 bits); all but the first occurrence, in order of document id, text hash
and position, are removed: the raw lines from a later window's first to its last, overlapping windows merged. The earliest
copy of a line is never inside a later window, so no line vanishes from the corpus.

With ``short``, runs of one or two lines that hold ``MIN_WORDS`` words are windows too, and so is a whole text of one or
two lines, whatever it holds. The SQL is that of three-line windows alone, so this is off unless asked for.

Defined cases: rows equal in id and text are one document and are treated alike; of different texts of one id that of the smaller hash comes first; null ids come last; null texts stay
null and empty texts empty, as they have no windows; without ``short`` texts of one or two lines have no windows either; a text all of
whose lines are removed becomes empty; an empty table gives an empty result; extra columns are carried whatever their
names.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.llm.kernel import as_bytes, map_arrow, written

WINDOW, MIN_WORDS = 3, 50


def content_lines(b: bytes) -> list[tuple[int, bytes]]:
    """Numbers and trimmed contents of the lines that hold a word."""
    return [(i, x) for i, x in enumerate(line.strip() for line in b.split(b"\n")) if x]


def runs(lines: list[tuple[int, bytes]], short: bool) -> list[tuple[int, int]]:
    """First line of each window, as a place in lines, and how many it has."""
    out = [(k, WINDOW) for k in range(len(lines) - WINDOW + 1)]
    if short:
        words = [len(x.split()) for _, x in lines]
        out += [(k, n) for n in range(1, WINDOW) for k in range(len(lines) - n + 1) if n == len(lines) or sum(words[k : k + n]) >= MIN_WORDS]
    return out


def windows(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs: doc_id, key, text -> a row for each window: hash (two halves), document, first and last raw line."""

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            a, b, rows, first, last = [], [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                lines = content_lines(as_bytes(text))
                for k, n in runs(lines, short):
                    d = xxhash.xxh3_128_intdigest(b"\n".join([x for _, x in lines[k : k + n]]))
                    a.append((d >> 64) - (1 << 63))
                    b.append((d & ((1 << 64) - 1)) - (1 << 63))
                    rows.append(r)
                    first.append(lines[k][0])
                    last.append(lines[k + n - 1][0])
            if not rows:
                return None
            at = pa.array(rows)
            return {"a": a, "b": b, "doc": batch.column("doc_id").take(at), "key": batch.column("key").take(at), "first": first, "last": last}

        return step

    return map_arrow(docs, "a long, b long, doc long, key long, first int, last int", make)


def removals(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs: doc_id, key, text -> doc, key and spans (raw lines, ends included) to remove, one row per document."""
    found = written(windows(docs, short), "windows")
    place = F.struct(F.col("doc").isNull().alias("n"), F.col("doc").alias("d"), F.col("key").alias("k"), F.col("first").alias("f"))
    firsts = found.groupBy(F.col("a").alias("a2"), F.col("b").alias("b2")).agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p != q")
    later = found.join(firsts, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).where(place != F.col("p"))
    return later.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in spans:
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def cut(text: str, spans) -> tuple[str, int]:
    """The text without the lines of the spans, and how many went."""
    lines, kept, at = text.split("\n"), [], 0
    for first, last in merged((s["first"], s["last"]) for s in spans):
        kept += lines[at:first]
        at = last + 1
    kept += lines[at:]
    return "\n".join(kept), len(lines) - len(kept)


def shortened(docs: DataFrame, short: bool) -> DataFrame:
    """docs' columns by place (c0, c1, ...; that of the text is ``body``), the new text, and how many lines there were and went."""
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"], F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    keyed = keyed.withColumn("hash", F.xxhash64("body"))
    gone = removals(keyed.select(F.col("id").alias("doc_id"), F.col("hash").alias("key"), F.col("body").alias("text")), short)
    out = keyed.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("key")), "left")

    @F.pandas_udf("text string, n int")
    def shorten(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(t, 0) if s is None or t is None else cut(t, s) for t, s in zip(text, spans)], columns=["text", "n"])

    # only texts that lose lines go through Python
    lost = F.col("spans").isNotNull()
    out = out.withColumn("cut", shorten(F.when(lost, F.col("body")), F.col("spans")))
    out = out.withColumn("new", F.when(lost, F.col("cut.text")).otherwise(F.col("body")))
    n_lines = F.coalesce(F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return out.withColumn("lines", n_lines).withColumn("removed", F.when(lost, F.col("cut.n")).otherwise(0).cast("long"))


def dedup(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs with repeated passages removed from their text, and n_lines and n_removed added.

    Where docs has a column of such a name, that stays and the added one gets as many underscores as it takes.
    """
    names = docs.columns
    own = [F.col("new" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)]
    for c, name in (("lines", "n_lines"), ("removed", "n_removed")):
        while name in names:
            name += "_"
        own.append(F.col(c).alias(name))
    return shortened(docs, short).select(*own)


def strip(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs with repeated passages removed from their text, and n_chars, where there is one, brought up to date.

    A document that loses lines and of which nothing but blanks is left goes whole; empty and null texts stay.
    """
    lost = F.col("removed") > 0
    out = shortened(docs, short).where(~lost | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = lambda c: F.when(lost, F.length("new").cast("long")).otherwise(F.col(c))
    own = lambda i, c: F.col("new") if c == "text" else n_chars(f"c{i}") if c == "n_chars" else F.col(f"c{i}")
    return out.select(*[own(i, c).alias(c) for i, c in enumerate(docs.columns)])


SQL = r"""
with d as (select distinct doc_id, text from documents),
l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d where text is not null),
t as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as x from l),
w as (select doc_id, text, i as f, lead(i, 2) over o as e, x || chr(10) || lead(x, 1) over o || chr(10) || lead(x, 2) over o as k
      from t where x <> '' window o as (partition by doc_id, text order by i)),
r as (select *, row_number() over (partition by k order by doc_id nulls last, text, f) as n from w where e is not null),
gone as (select distinct t.doc_id, t.text, t.i from t join r on r.doc_id is not distinct from t.doc_id and r.text = t.text and t.i between r.f and r.e where r.n > 1),
kept as (select t.doc_id, t.text, coalesce(string_agg(t.line, chr(10) order by t.i) filter (where g.i is null), '') as rest, count(*) as n_lines, count(g.i) as n_removed
         from t left join gone g on g.doc_id is not distinct from t.doc_id and g.text = t.text and g.i = t.i group by t.doc_id, t.text)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed, k.rest as text
from documents d left join kept k on k.doc_id is not distinct from d.doc_id and k.text = d.text
"""
