"""String, hash, set and vector expressions; all but ``nfkc`` stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks that tokenisation drops, as real characters inside a class both regex dialects read.
BLANKS = "[\t\n\x0b\f\r    -     　﻿]"
# The marks that evidence comparison drops.
EVIDENCE_MARKS = "[，。、；：？！“”‘’（）《》〈〉…,.;:?!()'\"\\-—~·]"
# Particles a route signature drops.
ROUTE_PARTICLES = "的是了吗呢啊呀吧"
# Chinese digits.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_ONE, _TWO = "(?s).", "(?s)(?=(..))(?!\\p{Cs})"


def singles(text: Column | str) -> Column:
    """Code points of a string, as an array."""
    return F.regexp_extract_all(col(text), F.lit(_ONE), F.lit(0))


def pairs(text: Column | str) -> Column:
    """Adjacent pairs of code points: a look-ahead at every position that isn't inside a surrogate pair.

    One regex pass; explode it from a frame whose other columns are plain, since anything computed beside
    an explode is computed again for every row that comes out.
    """
    return F.regexp_extract_all(col(text), F.lit(_TWO), F.lit(1))


def without_blanks(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), BLANKS, "")


def trim_blanks(text: Column | str) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(col(text), f"^{BLANKS}+|{BLANKS}+$", "")


def tokens(text: Column | str) -> Column:
    """All characters, then all adjacent pairs, blanks dropped; null and empty give an empty array."""
    t = without_blanks(text)
    return F.concat(singles(t), pairs(t))


def token_count(text: Column | str) -> Column:
    n = F.length(without_blanks(text))
    return F.greatest(2 * n - 1, F.lit(0))


def bigram_set(text: Column | str) -> Column:
    """Distinct adjacent pairs; a single character stands for itself, an empty text has none."""
    t = F.coalesce(col(text), F.lit(""))
    return F.array_distinct(F.when(F.length(t) == 1, F.array(t)).otherwise(pairs(t)))


def nfkc(text: Column | str) -> Column:
    """Compatibility form, as an Arrow function: the JVM's expressions have none."""
    normalize = unicodedata.normalize

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else normalize("NFKC", t))

    return form(col(text))


def bank_form(text: Column | str) -> Column:
    """The question bank's comparison form: compatibility form, lower case, no blanks, no punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(nfkc(text)), BLANKS, ""), "\\p{P}", "")


def evidence_form(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), EVIDENCE_MARKS, ""), BLANKS, "")


def route_signature(form: Column | str) -> Column:
    """The bank form without particles."""
    return F.translate(col(form), ROUTE_PARTICLES, "")


def lexical_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance over the longer of two route signatures; 0 if either is empty, 1 if equal."""
    x, y = col(a), col(b)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def dice(shared: Column, a_size: Column, b_size: Column) -> Column:
    return F.when(a_size + b_size > 0, 2 * shared / (a_size + b_size)).otherwise(F.lit(0.0))


def fnv1a32(text: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes, as an unsigned 32-bit number in a bigint."""
    data = F.hex(F.encode(col(text), "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1)), F.lit(2))
    byte = lambda i: F.coalesce(F.conv(F.substring(data, i, F.lit(2)), 16, 10).cast("bigint"), F.lit(0))
    step = lambda h, i: ((h.bitwiseXOR(byte(i))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(col(text)) == 0, F.lit(2166136261)).otherwise(F.aggregate(at, F.lit(2166136261).cast("bigint"), step))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two numeric arrays in double precision; 0 when either has no length."""
    x, y = (F.transform(col(v), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    n = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0))


def fixed(value: Column, digits: int) -> Column:
    """Rounded the same way in every engine: floor of the scaled value and a half."""
    return F.floor(value * 10**digits + 0.5) / float(10**digits)


def tag_list(tags: Column | str) -> Column:
    """Tags of a ``|`` list, trimmed, blank ones dropped; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(col(tags), F.lit("")), "\\|"), lambda t: F.trim(t)), lambda t: t != "")


# Tag types whose name is stripped before indexing, and the endings two of them carry.
TAG_PREFIXES = ("人物之生-", "人物之死-", "武将单挑-", "战役-", "政治事件-", "谋略/计策-", "结盟/外交-", "典故事件-")
TAG_ENDINGS = {"人物之生-": "登场", "人物之死-": "之死"}


def strip_tag_type(tag: Column | str, prefixes: tuple[str, ...] = TAG_PREFIXES, endings: dict[str, str] = TAG_ENDINGS) -> Column:
    t = col(tag)
    out = None
    for p in prefixes:
        rest = F.substring(t, len(p) + 1, 1 << 20)
        if p in endings:
            rest = F.regexp_replace(rest, endings[p] + "$", "")
        out = F.when(t.startswith(p), rest) if out is None else out.when(t.startswith(p), rest)
    return out.otherwise(t)


CHUNK_ID = r"^[^:]+:(\d{4}):p(\d{4}):c(\d{2})$"


def inner_order(chunk_id: Column | str) -> Column:
    """(chapter, segment, sequence) of a chunk id; malformed ids sort last."""
    c = col(chunk_id)
    part = lambda i: F.coalesce(F.regexp_extract(c, CHUNK_ID, i).try_cast("int") if hasattr(c, "try_cast") else F.regexp_extract(c, CHUNK_ID, i).cast("int"), F.lit(2147483647))
    return F.struct(part(1).alias("chapter_no"), part(2).alias("segment_no"), part(3).alias("sequence_no"))


def cn2int(text: Column | str) -> Column:
    """Chinese numerals below a thousand to a number; null when another character occurs."""
    c = F.filter(F.split(col(text), ""), lambda x: x != "")
    digits = F.create_map(*[F.lit(v) for pair in NUMERALS.items() for v in pair])
    # (finished part, current digit, valid); ten without a digit before it counts once
    state = F.struct(F.lit(0).alias("done"), F.lit(0).alias("digit"), F.lit(True).alias("ok"))

    def step(s: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100).otherwise(0)
        times = F.when((ch == "十") & (s["digit"] == 0), 1).otherwise(s["digit"])
        value = F.element_at(digits, ch)
        return F.struct(
            F.when(unit > 0, s["done"] + times * unit).otherwise(s["done"]).alias("done"),
            F.when(unit > 0, 0).otherwise(F.coalesce(value, F.lit(0))).alias("digit"),
            (s["ok"] & ((unit > 0) | value.isNotNull())).alias("ok"),
        )

    return F.aggregate(c, state, step, lambda s: F.when(s["ok"], s["done"] + s["digit"]))


def run_id(prefix: str, at: Column | str, seconds: bool = False) -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(col(at), "yyyy-MM-dd-HHmmss" if seconds else "yyyy-MM-dd-HHmm"))


def clause_lengths(text: Column | str, marks: str = "[，。；！？：]") -> Column:
    return F.transform(F.filter(F.split(col(text), marks), lambda x: x != ""), lambda x: F.length(x))


def quote_depth(text: Column | str) -> Column:
    """(lowest, final) nesting of curly quotes; balanced text has (0, 0)."""
    marks = F.filter(F.split(F.regexp_replace(col(text), "[^“‘”’]", ""), ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("lowest"), F.lit(0).alias("final"))

    def step(s: Column, ch: Column) -> Column:
        now = s["final"] + F.when(ch.isin("“", "‘"), 1).otherwise(-1)
        return F.struct(F.least(s["lowest"], now).alias("lowest"), now.alias("final"))

    return F.aggregate(marks, start, step)


def size_bucket(n: Column | str) -> Column:
    n = col(n)
    return F.when(n == 1, "single").when(n <= 10, "several").otherwise("large")
