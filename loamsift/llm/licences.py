"""License scans: one Aho-Corasick pass over the words, and a shunting-yard parser for and/or/with expressions.

Texts are lower-cased (A-Z) and cut to words of ASCII letters and digits and of anything beyond ASCII. The automaton
holds notice phrases and the identifier tag, both with blanks around, and runs over the words joined by one blank; a
match's word number is the number of blanks before it. A tag's expression is read from the text
behind it, up to the next tag or the line's end.

Defined cases: null or empty texts have no words, labels or places and score 0; a malformed expression gives the label
``unparsed``, as does a ``with`` between anything but one licence and one exception; repeated rows are scanned each; extra columns don't matter.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from loamsift.llm.kernel import as_bytes, map_arrow

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3", "mozilla public license": "mpl-2", "all rights reserved": "all-rights-reserved", "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by 4 0": "cc-by", "cc0 1 0": "cc0", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit-text", "the unlicense": "unlicense", "bsd 3 clause": "bsd-3", "bsd 2 clause": "bsd-2", "public domain": "public-domain",
}
TAG = "spdx license identifier"
MARK = r"spdx[^0-9a-z\n]+license[^0-9a-z\n]+identifier"
EXPRESSION = re.compile(MARK + r"[^0-9a-z\n(]*((?:(?!(?<![0-9a-z])" + MARK + r"(?![0-9a-z]))[^\n\"'<>*])*+)", re.I)
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "cc0", "unlicense", "cc-by-4", "cc-by-3", "0bsd", "public-domain", "python", "boost", "bsl-1")
RANK = {"or": 1, "and": 2, "with": 3}
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def parse(expression: str) -> list[str]:
    """Shunting-yard: an SPDX-like expression in postfix order. Raises ValueError if it isn't well formed."""
    out: list[str] = []
    ops: list[str] = []
    operand, last = True, ""  # what must come next; the token before
    for token in re.findall(r"[()]|[A-Za-z0-9.+:-]+", expression):
        low = token.lower()
        if low in RANK:
            if operand:
                raise ValueError("operator without a left side")
            if low == "with" and (last == ")" or ops[-1:] == ["with"]):
                raise ValueError("with takes one licence")
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif token == "(":
            if not operand or last == "with":
                raise ValueError("( after a licence")
            ops.append(token)
        elif token == ")":
            if operand:
                raise ValueError(") without a licence")
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError(") without (")
            ops.pop()
        else:
            if not operand:
                break  # prose behind the expression
            out.append(low)
            operand = False
        last = low
    if operand or "(" in ops:
        raise ValueError("it ends early")
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Licences named, and whether some choice of the or-branches leaves permissive terms only."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in RANK:
            (b, ok_b), (a, ok_a) = stack.pop(), stack.pop()
            if token == "with":  # an exception only widens what the licence grants
                stack.append(({f"{x} with {y}" for x in a for y in b}, ok_a))
            else:
                stack.append((a | b, (ok_a or ok_b) if token == "or" else (ok_a and ok_b)))
        else:
            stack.append(({token}, token.startswith(PERMISSIVE) and "-nc" not in token))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in (BASE | NOTICES).items():
        a.add_word(f" {phrase} ", (len(phrase), label, phrase in BASE))
    a.add_word(f" {TAG} ", (len(TAG), None, False))
    a.make_automaton()
    return a


def scan_text(text: str | None, a: ahocorasick.Automaton) -> tuple:
    words = as_bytes(text).translate(TABLE).split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, labels, found, tagged, permitted = [], set(), set(), [], False, True
    for end, (length, label, is_base) in a.iter(joined):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            starts.append(end - length - 1)
    if tagged:
        for m in EXPRESSION.finditer(text):
            try:
                names, ok = evaluate(postfix := parse(m[1]))
                labels |= names
                permitted &= ok
                found.append(" ".join(postfix))
            except ValueError:
                labels.add("unparsed")
                permitted = False
    spots, k, last = [], 0, 0
    for s in sorted(starts):
        k += joined.count(" ", last, s)
        last = s
        spots.append(k)
    score = 0.0 if not labels else round(1 - 0.5 ** (len(starts) + 2 * len(found) + len(labels - base)), 6)
    return len(words), len(starts), spots[0] if spots else None, spots[-1] if spots else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(found) + ("" if permitted else ";restricted")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: words, base places, labels, confidence that terms are stated, and the expressions in postfix."""

    def make():
        a = automaton()

        def step(batch: pa.RecordBatch) -> dict:
            got = [scan_text(t, a) for t in batch.column("text").to_pylist()]
            columns = list(zip(*got)) if got else [[]] * 8
            return {"doc_id": batch.column("doc_id")} | dict(zip(("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"), map(list, columns)))

        return step

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), SCHEMA, make)
