"""Evolved instructions: every pair gets a verdict, whatever its letters."""

from __future__ import annotations

import re

from loamsift import catalog


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def reason(child: str, parent: str) -> str | None:
    plain = lambda t: re.sub(r"\s+", " ", t.strip().lower())
    if plain(child) == plain(parent):
        return "evol_identical_to_parent"
    if any(x in child.lower() for x in ("i cannot", "i'm unable", "as an ai")):
        return "evol_refusal"
    if len(child.strip()) < 20:
        return "evol_instruction_too_short"
    return "evol_edit_distance_too_small" if edits(child, parent) < 20 else None


def test_every_pair_gets_a_verdict(spark, tmp_path):
    asked = [
        "Erkläre, wie man Äpfel über den Winter lagert", "Erkläre, wie man Äpfel ÜBER den Winter lagert", "Erkläre, wie man Öfen über den Winter heizt", "Où est l'été ?", "Décris en détail la forêt où naît la rivière dorée",
        "Décris en détail la forêt où naît la rivière dorée et ce qu'on y pêche à l'été", "日本語の文章を二十文字以上になるように書いてくださいね", "一" * 30, "二" * 19 + "一" * 11, "三" * 20 + "一" * 10, "Plain words without any accent at all, as many",
    ]
    rows = [(1, 2 * k + n, role, text) for k, t in enumerate(asked) for n, (role, text) in enumerate((("user", t), ("assistant", "réponse")))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = sorted(((1000 + 2 * k, reason(asked[k], asked[k - 1])) for k in range(1, len(asked))), key=str)
    got = sorted(map(tuple, catalog.evol_rejection(spark, str(tmp_path)).collect()), key=str)
    assert got == want and len({r for _, r in want}) == 4
