"""Splitting oversized texts at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
import unicodedata as ud

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.batches import map_batches
from inkwell.llm.lookalike import INVISIBLE
from inkwell.llm.sentences import BLANK, NEWLINE, Learned, Periods, lang_name, sentence_units
from inkwell.llm.tokens import Encoder, _encoder, read_ranks

LIMIT = 600  # the reference's cap, in code points
OVERLAP = 60

_CLAUSE = re.compile("[，,、；;：:…—।。！？!?”」』）)》]+")
_GAP = re.compile(f"[{re.escape(BLANK + NEWLINE)}]+")
#: kinds of cuts, from the most to the least natural
KINDS = ("sentence", "clause", "blank", "hard")


def _clusters_back(text: str, at: int, floor: int) -> int:
    """The last position at or before ``at`` that doesn't separate a mark or joiner from its letter."""
    i = at
    while i > floor and (ud.combining(text[i]) or ud.category(text[i]) in ("Mn", "Mc") or text[i] in INVISIBLE):
        i -= 1
    return i if i > floor else at


def cut_points(text: str, boundaries: list[np.ndarray], sizes: np.ndarray | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at end) of pieces with a total size of at most ``limit``.

    ``boundaries``: sorted positions, one array per kind but the last; ``sizes``: the size of each code
    point, 1 if not given. Offsets are prefix sums of the sizes; the last boundary under the limit and the
    first within the overlap are found by binary search.
    """
    n = len(text)
    offset = np.arange(n + 1) if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
    every = np.unique(np.concatenate([b for b in boundaries if len(b)] or [np.empty(0, np.int64)]))
    out: list[tuple[int, int, str]] = []
    start = reached = 0
    while True:
        furthest = int(np.searchsorted(offset, offset[start] + limit, side="right")) - 1
        if furthest >= n:
            out.append((start, n, "end"))
            return out
        for kind, where in zip(KINDS, boundaries, strict=False):
            k = int(np.searchsorted(where, furthest, side="right")) - 1
            if k >= 0 and where[k] > reached:
                end = int(where[k])
                break
        else:
            kind, end = "hard", max(_clusters_back(text, furthest, reached), reached + 1)
        out.append((start, end, kind))
        back = int(np.searchsorted(offset, offset[end] - overlap, side="left"))
        k = int(np.searchsorted(every, back, side="left"))
        begin = int(every[k]) if overlap and k < len(every) and back <= every[k] < end else (back if overlap else end)
        if overlap and begin < end:
            begin = _clusters_back(text, begin, start) if begin == back else begin
        # a piece starts after the one before it and always brings something new
        start, reached = (begin if begin > start else end), end


def token_sizes(text: str, encoder: Encoder) -> np.ndarray:
    """How many tokens begin inside each code point of ``text``."""
    width = np.asarray([len(encoder.bytes_of(i)) for i in encoder.encode(text)], np.int64)
    begins = np.cumsum(width) - width
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bytes_before = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
    return np.bincount(np.searchsorted(bytes_before, begins, side="right"), minlength=len(text))


def text_boundaries(text: str, known: Periods) -> tuple[list[np.ndarray], int]:
    """Boundary arrays by kind (ends of sentence units, ends of clauses, ends of blanks) and the size of
    the largest sentence unit."""
    units = sentence_units(text, known)
    largest = max((e - s for s, e in units), default=0)
    asc = lambda xs: np.asarray(sorted(xs), dtype=np.int64)
    return [asc(e for _, e in units), asc(m.end() for m in _CLAUSE.finditer(text)), asc(m.end() for m in _GAP.finditer(text))], largest


def split_oversized(df: DataFrame, known: Learned | Periods, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, lang_col: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every row whose ``text`` has more than ``limit`` code points, whatever ``char_count`` says.

    ``df``: row_id, parent_id, seq_in_parent, text. One row per piece: row_id, parent_id, seq_in_parent,
    piece_no (from 1), piece_count, start_pos, end_pos, cut_kind (``sentence``, ``clause``, ``blank``,
    ``hard``; ``end`` for the last), unit_over (a sentence unit of the row exceeds the limit), text.
    Cuts stand at the last sentence end under the limit, else the last clause end, else the last blank,
    else they are hard, but never between a letter and its marks. A piece starts up to ``overlap`` code
    points before the end of the one before it, at a boundary if there is one. Null and short texts give no
    rows; null ``parent_id`` or ``seq_in_parent`` stay null; repeated rows are split each.
    With ``tokenizer`` (the path of a public vocabulary file) ``limit`` and ``overlap`` are in its tokens, counted
    where they begin; ``unit_over`` then stays in code points.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of the limit")
    columns = ["row_id", "parent_id", "seq_in_parent"]
    schema = "row_id bigint, parent_id string, seq_in_parent int, piece_no int, piece_count int, start_pos int, end_pos int, cut_kind string, unit_over boolean, text string"

    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer)) if tokenizer else None

    def make():
        encoder = _encoder(ranks.value) if ranks else None

        def convert(batch: pa.RecordBatch) -> dict | None:
            out: list[tuple] = []
            for *keys, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = token_sizes(text, encoder) if encoder else None
                if sizes is not None and sizes.sum() <= limit:
                    continue
                boundaries, largest = text_boundaries(text, known.of(lang, text))
                pieces = cut_points(text, boundaries, sizes, limit, overlap)
                over = largest > limit
                out += [(*keys, no, len(pieces), a, b, kind, over, text[a:b] if with_text else None) for no, (a, b, kind) in enumerate(pieces, 1)]
            if not out:
                return None
            names = [f.split()[0] for f in schema.split(", ")]
            return dict(zip(names, zip(*out, strict=True), strict=True))

        return convert

    # a token has at least one byte
    big = df.where((F.octet_length if tokenizer else F.char_length)("text") > limit).select(F.col("row_id").cast("bigint").alias("row_id"), "parent_id", F.col("seq_in_parent").cast("int").alias("seq_in_parent"), (lang_name(F.col(lang_col)) if lang_col else F.lit("")).alias("lang"), "text")
    return map_batches(big.select(*columns, "lang", "text"), schema, make)


def oversized_kinds(pieces: DataFrame) -> DataFrame:
    """(row_id, kind) per split row: ``inside`` if a sentence unit of it had to be cut, else ``between``."""
    return pieces.where("piece_no = 1").select("row_id", F.when(F.col("unit_over"), "inside").otherwise("between").alias("kind"))
