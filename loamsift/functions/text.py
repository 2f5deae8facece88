"""Text expressions, all built-in functions so that they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shingles(toks: Column, n: int) -> Column:
    """Distinct n-token shingles; fewer tokens make one, none make none."""
    count = F.greatest(F.size(toks) - n + 1, F.lit(1))
    return F.when(F.size(toks) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(toks, i, n), " "))))


def sentence_lengths(text: Column) -> Column:
    """Word counts of the parts between runs of . ! ?"""
    parts = F.filter(F.split(text, r"[.!?]+"), lambda s: F.length(strip(s)) > 0)
    return F.transform(parts, lambda s: F.size(words(s)).cast("double"))


def variation(xs: Column) -> Column:
    """Population standard deviation over mean; 1 for fewer than two values, 0 for a mean of 0. For whole numbers, as sums are exact.

    One aggregate with a finish, so that what makes the array is evaluated once.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))
    ratio = lambda a: F.sqrt(a["n"] * a["q"] - a["s"] * a["s"]) / a["s"]
    return F.aggregate(xs, zero, add, lambda a: F.when(a["n"] < 2, F.lit(1.0)).when(a["s"] == 0, F.lit(0.0)).otherwise(ratio(a)))


def latin_share(text: Column) -> Column:
    """Share of letters below code point 0x250; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^\p{L}]|[\x{0250}-\x{10FFFF}]", ""))
    return F.when(letters > 0, latin / letters)


def normalised(text: Column) -> Column:
    return F.regexp_replace(strip(F.lower(text)), f"{SPACE}+", " ")


def holds_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs, whatever the case."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(F.lower(text), F.lit(p.lower()))
    return found


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """First phrase in the given order that occurs, case counts; null if none."""
    out = F.lit(None).cast("string")
    for p in reversed(phrases):
        out = F.when(F.contains(text, F.lit(p)), F.lit(p)).otherwise(out)
    return out


def json_part(text: Column) -> Column:
    """The JSON in a model's answer: a fenced block, else the widest braces, else the text; an open fence gives null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", strip(fenced)).when(F.contains(text, F.lit("```")), F.lit(None)).when(braces != "", braces).otherwise(strip(text))


def pair_of_json(text: Column) -> Column:
    """struct(instruction, response) of strict JSON with exactly these two non-blank strings; null otherwise."""
    part = json_part(text)
    got = F.from_json(part, "struct<instruction:string,response:string>")
    keys = F.array_sort(F.json_object_keys(F.when(F.from_json(part, "map<string,string>").isNotNull(), part)))
    a, b = strip(got["instruction"]), strip(got["response"])
    ok = (keys == F.array(F.lit("instruction"), F.lit("response"))) & (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(ok, F.struct(a.alias("instruction"), b.alias("response")))


def fill(template: str, **values: Column) -> Column:
    """A template's {names} replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; norms are at least 1e-9."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-9))
    return dot(a, b) / (norm(a) * norm(b))


def minhash(shingle_list: Column, n: int, hash_name: str = "sha256") -> Column:
    """n minima of the salted shingles' hashes: 16 hex characters of SHA-256, or xxhash64 for speed."""
    if hash_name == "xxhash64":
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.hex(F.array_min(F.transform(shingle_list, lambda s: F.xxhash64(k, s)))))
    salted = lambda k, s: F.substring(F.sha2(F.concat(k.cast("string"), F.lit(":"), s), 256), 1, 16)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_min(F.transform(shingle_list, lambda s: salted(k, s))))


def agreement(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return same / F.size(a)


def weighted(values: Column, weights: dict[str, float]) -> Column:
    """Weighted sum over a map's entries, missing ones 0, to 4 digits."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(0.0)) * w
    return F.round(total, 4)


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def elo_updated(a: Column, b: Column, score: Column, k: float = 32.0) -> Column:
    return a + k * (score - elo_expected(a, b))
