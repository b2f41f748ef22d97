"""One consistent form for texts that look alike.

A mapping from code point sequences to their canonical form is built once, from rules over the Unicode
character data plus short lists of fixed values, checked for conflicts and closed (no output is itself
rewritten), and compiled into a longest-match transducer over grapheme clusters that runs in one pass.

Folded: full and half widths, canonically equal encodings (composed and decomposed accents,
compatibility ideographs), radicals that stand for ideographs, all kinds of blanks to U+0020, line ends to
a line feed, invisible characters to nothing, and letters of other scripts with the same shape.
Kept apart: case, accents, digits, simplified and traditional or nearly alike ideographs, blank and no
blank, the number of blanks.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata as ud
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.batches import map_batches

# Invisible code points (soft hyphen, joiners, zero-width spaces, direction marks, BOM).
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Line ends other than the line feed.
LINE_ENDS = "\r\u0085  "
# Code points that choose a glyph variant of the letter before them.
INVISIBLE += "".join(map(chr, range(0xFE00, 0xFE10)))
# Letters of the same shape, other script -> Latin.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp", strict=True))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеорсухѕіјѵһӏҮүԁԛԝԚԜ", "ABESIJKMHOPCTXaeopcyxsijvhlYydqwQW", strict=True))
ARMENIAN = dict(zip("ՏՍՕհոսօցզ", "SUOhnuogq", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZRWSVSLCPKB", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
LATIN = {"ɡ": "g"}
# Hangul fillers: two without width, two as wide as a letter.
FILLERS = {"\u115f": "", "\u1160": "", "\u3164": " ", "\uffa0": " "}
# Kana of the same shape as an ideograph, and the two scripts' he.
KANA = dict(zip("エカニハロタト", "工力二八口夕卜", strict=True)) | {"ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
# Hyphens of one look.
HYPHENS = {"‐": "-", "‑": "-"}
# Sequences that render as one letter (Thai, Devanagari).
SEQUENCES = {"เเ": "แ", "ํา": "ำ", "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "एे": "ऐ"}
# The radicals supplement, U+2E80 onwards in order, with the ideograph of the same shape
# (a dot where there is none).
RADICALS = "⺀厂乛乚乙亻冂.刀刂卜㔾....尢.巳幺彑彐忄.扌攵.旡日月歺母民氵氺灬爫.丬牛犭王.目示礻竹糹纟罓罒....羊.耂.聿.臼艹..虎衤覀西见角.讠贝.车辶..阝钅長镸长门.阝雨青韦页风飞食.飠饣.马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟"


class Conflict(ValueError):
    """Two rules give one sequence different forms."""


def build_mapping() -> dict[str, str]:
    """Sequence -> canonical form, conflict-checked and closed under itself."""
    found: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if source == target:
            return
        if found.setdefault(source, target) != target:
            raise Conflict(f"{source!r}: {found[source]!r} or {target!r}")

    special = GREEK | CYRILLIC | ARMENIAN | CHEROKEE | LISU | LATIN | FILLERS | KANA | HYPHENS | {c: "" for c in INVISIBLE} | {c: "\n" for c in LINE_ENDS} | {"\t": " ", "\x0b": " ", "\x0c": " "}
    special |= {chr(0x2E80 + i): c for i, c in enumerate(RADICALS) if c != "." and c != chr(0x2E80 + i)}
    for c, to in special.items():
        add(c, to)
    for o in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x2F800, 0x2FA20)]:
        c = chr(o)
        if c in special:
            continue
        if ud.category(c) == "Zs":
            add(c, " ")
            continue
        kind, _, rest = ud.decomposition(c).partition(" ")
        if kind in ("<wide>", "<narrow>", "<noBreak>") or (kind == "<compat>" and 0x2F00 <= o < 0x2FE0):
            add(c, ud.normalize("NFC", chr(int(rest.split()[0], 16))))
        elif kind and kind[0] != "<" and ud.normalize("NFC", c) != c:
            add(c, ud.normalize("NFC", c))
    for source, to in SEQUENCES.items():
        add(source, to)
    for o in range(0xFF66, 0xFF9E):  # half-width kana with its half-width voicing mark is one letter
        for mark, wide in (("\uff9e", "\u3099"), ("\uff9f", "\u309a")):
            base = ud.normalize("NFKC", chr(o))
            if len(to := ud.normalize("NFC", base + wide)) == 1:
                add(chr(o) + mark, found.get(to, to))
    # composed letters: base and mark, for the base as written and for every look-alike of it
    alike: dict[str, list[str]] = {}
    for source, to in special.items():
        if to and to not in " \n":
            alike.setdefault(to, []).append(source)
    for o in range(0xC0, 0x3100):
        c = chr(o)
        kind, _, rest = ud.decomposition(c).partition(" ")
        if rest and kind[0] != "<" and ud.normalize("NFC", c) == c:
            base, mark = chr(int(kind, 16)), chr(int(rest, 16))
            to = found.get(c, c)
            for b in [base, *([found[base]] if found.get(base) else []), *alike.get(base, [])]:
                if found.get(b + mark, to) == to:
                    add(b + mark, to)
    for source in list(found):  # closure: a form that is rewritten further takes the last form
        seen = {source}
        while (to := found[source]) in found and to not in seen:
            seen.add(to)
            found[source] = found[to]
        if found[source] in found:
            raise Conflict(f"{source!r} never settles")
    return found


class Transducer:
    """Longest-match rewriting over grapheme clusters."""

    def __init__(self, mapping: dict[str, str]):
        self.trie: dict = {}
        for source, to in mapping.items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = to
        singles = {s for s in mapping if len(s) == 1}
        marks = {chr(o) for o in range(0x300, 0x3100) if ud.combining(chr(o))}
        self._marks = marks
        starts = {s[0] for s in mapping if len(s) > 1} - marks
        follows = {s[1] for s in mapping if len(s) > 1 and s[1] not in marks}
        quoted = lambda cs: "".join(re.escape(c) for c in sorted(cs))
        attached = quoted(marks | set(INVISIBLE))
        firsts, follow = quoted(starts & {s[0] for s in mapping if len(s) == 2 and s[1] in follows}), quoted(follows)
        #: clusters of one code point, nothing attached: the common case
        near, far = {c for c in singles if c < "\U00010000"}, quoted(c for c in singles if c >= "\U00010000") or "\U0010ffff"
        # (a class of the basic plane compiles to a bit table; one that also holds far code points is searched item by item)
        self._plain = re.compile(f"[{quoted(near - set(INVISIBLE) - {chr(13)})}]")
        #: whether a text has anything that attaches, joins into a sequence, or a two-part line end, or a code point that _plain lacks
        self._joined = re.compile(f"[{attached}{follow}\r]|[{far[0]}-{far[-1]}]")
        self._cluster = re.compile(f"\r\n|[^{attached}][{attached}]+[{follow}]?|[{firsts}][{follow}]|[{quoted(near | marks)}][{attached}]*|[{far[0]}-{far[-1]}][{attached}]*")
        self._memo: dict[str, str] = {"\r\n": "\n"}

    def _rewrite(self, cluster: str) -> str:
        visible, before = [], ""
        for c in cluster:  # joiners after a virama shape the letters, elsewhere they can't be seen
            if c in INVISIBLE and not (c in "‌‍" and before and ud.combining(before) == 9):
                continue
            visible.append(c)
            before = c
        text = ud.normalize("NFD", "".join(visible)) if len(visible) > 1 else "".join(visible)
        for once in (text, "".join(visible)):
            out, i = [], 0
            while i < len(once):
                node, best, end = self.trie, once[i], i + 1
                for j in range(i, len(once)):
                    node = node.get(once[j])
                    if node is None:
                        break
                    if "" in node and once[i] not in "‌‍":
                        best, end = node[""], j + 1
                out.append(best)
                i = end
            visible = ud.normalize("NFC", "".join(out))
            if once is text:
                first = visible
        return min(first, visible, key=len)

    def apply(self, text: str) -> str:
        if text.isascii() and not ("\r" in text or "\t" in text or "\x0b" in text or "\x0c" in text):
            return text
        memo = self._memo

        def form(m: re.Match) -> str:
            cluster = m.group()
            to = memo.get(cluster)
            if to is None:
                if len(memo) > 100_000:  # a bound for hostile input; every entry can be made again
                    memo.clear()
                to = memo[cluster] = self._rewrite(cluster)
            return to

        return (self._cluster if self._joined.search(text) else self._plain).sub(form, text)


@cache
def transducer() -> Transducer:
    return Transducer(build_mapping())


def canonical(text: str | None) -> str | None:
    """The consistent form of one text; null stays null, empty stays empty."""
    return text if not text else transducer().apply(text)


def canonical_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonical text, changed) of every row; null texts give null, empty ones empty."""

    def make():
        run = transducer().apply

        def convert(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            forms = [t if not t else run(t) for t in texts]
            return {id_col: batch.column(0), "canonical": forms, "changed": [a != b for a, b in zip(forms, texts, strict=True)]}

        return convert

    return map_batches(df.select(F.col(id_col).cast("bigint").alias(id_col), text_col), f"{id_col} bigint, canonical string, changed boolean", make)


def look_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, raw): 128-bit digests of the canonical form and of the text as stored.

    Rows with null or empty text have no look and are left out.
    """

    def make():
        run = transducer().apply

        def convert(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            raw = [digest(t) for t in texts]
            look = [r if (c := run(t)) == t else digest(c) for t, r in zip(texts, raw, strict=True)]
            return {"id": batch.column(0), "look": look, "raw": raw}

        return convert

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("t is not null and t <> ''")
    return map_batches(source, "id bigint, look binary, raw binary", make)


def lookalike_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (table_name, id_a, id_b) of one table with the same look and different text.

    ``keys``: (table_name, id, look, raw), written out. Exact copies pair with nothing among themselves;
    looks with only one spelling leave in a map-side aggregate before any pair is made, so a text that a
    third of the rows repeat stays one aggregate row.
    """
    several = keys.groupBy("table_name", "look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("table_name", "look")
    rows = keys.join(several, ["table_name", "look"], "left_semi")
    a = rows.select("table_name", "look", F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    b = rows.select("table_name", "look", F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["table_name", "look"]).where("raw_a <> raw_b and id_a < id_b").select("table_name", "id_a", "id_b")


def lookalike_classes(keys: DataFrame) -> DataFrame:
    """(table_name, id, class_id, links) of every row whose look has several spellings, without making pairs.

    ``keys`` as for ``lookalike_pairs``. ``class_id`` is the smallest id of the look; ``links`` the number of rows of the look
    that are spelled otherwise. Sizes are counted in aggregates, so a look that a third of the rows have splits freely.
    """
    spelled = keys.groupBy("table_name", "look", "raw").agg(F.count(F.lit(1)).alias("same"), F.min("id").alias("first"))
    looks = spelled.groupBy("table_name", "look").agg(F.sum("same").alias("rows"), F.count(F.lit(1)).alias("spellings"), F.min("first").alias("class_id")).where("spellings > 1")
    known = spelled.join(looks, ["table_name", "look"]).select("table_name", "raw", "class_id", (F.col("rows") - F.col("same")).alias("links"))
    return keys.select("table_name", "id", "raw").join(known, ["table_name", "raw"]).select("table_name", "id", "class_id", "links")
