"""Small messy tables for the training-data operators."""

from __future__ import annotations

import random

WORDS = "river stone garden window yellow quiet market copper signal winter letter bridge candle forest silver engine harbor meadow pencil rocket".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def messy() -> list[tuple]:
    """doc_id, text, lang, source, n_chars, and extra columns with names that operators use themselves."""
    base = prose(1, 80)
    near = base.replace("river", "brook", 1)
    lines = "\n".join(prose(100 + i, 8) for i in range(6))
    rows = [
        (1, base, "en", "a"), (2, near, "en", "a"), (2, near, "en", "a"), (3, base, "de", None), (4, "", "en", "a"), (5, None, None, "b"), (None, base, "en", "a"), (None, None, None, None),
        (6, prose(2, 30_000), "en", "b"), (7, lines, "en", "b"), (8, prose(9, 3) + "\r\n" + lines.replace("\n", "\r\n") + "\n\n", "en", "c"), (9, "one", "en", "c"), (10, "One two", "en", "c"), (11, "one two", "en", "c"),
        (12, " \t\n\x0b\x0c\r ", "en", "c"), (13, "naïve café ÀÉ 日本語 \U0001f600 a b", "fr", "c"), (14, prose(3, 60) + " mail bob.smith@example.com now, 10.0.0.1 and +1 (202) 555-0101", "en", "a"),
        (15, prose(4, 60), "en", "a"), (15, prose(5, 60), "en", "a"), (16, "x" * 300_000, "en", "a"), (17, lines + "\n" + lines, "en", "a"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, 1, 2, 3, "s", 4.0) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, cid long, size long, copy string, key double"
