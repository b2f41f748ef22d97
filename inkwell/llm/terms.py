"""How characteristic each term is of its record: a parsimonious language model.

A record's words are a mixture of its own model and the collection's. Expectation-maximisation moves the
mass of what the collection explains out of the record's model, so common terms end at zero and rare ones
keep their share; the converged probabilities rank the record's terms. The rounds go to the exact fixed point:
in each, terms whose whole count the collection explains leave a record's model for good and the others'
probabilities are maximised together, until no term leaves. Terms are overlapping pairs of
letters in scripts without spaces, words in scripts with spaces, and the names of a dictionary wherever
they stand, also inside longer names.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.batches import map_batches
from inkwell.llm.blocks import in_blocks, with_answers
from inkwell.runtime import BROADCAST_BYTES, cut

SHARE = 0.1  # of the record's own model in the mixture
WORD, NAME = 1 << 62, 1 << 61  # marks of keys that aren't letter pairs
SLICE = 250_000  # code points handled at once inside a batch; their arrays stay in the processor's cache
_ROW_BYTES = 24


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point of the basic plane: class (0 none, 1 unspaced script, 2 spaced), lower case; powers."""
    kind, low = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for o in range(0x10000):
        c = chr(o)
        if ud.category(c)[0] in "LNM":
            unspaced = 0x0E00 <= o < 0x0F00 or 0x1000 <= o < 0x10A0 or 0x1780 <= o < 0x1800 or 0x2E80 <= o < 0x3040 or 0x3040 <= o < 0xA000 or 0xF900 <= o < 0xFB00
            kind[o] = 1 if unspaced else 2
            if len(x := c.lower()) == 1:
                low[o] = ord(x)
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    return kind, low, powers


def term_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, start, end) of every letter pair and word; positions are within the joined texts."""
    kind, low, powers = _tables()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    near = np.minimum(codes, 0xFFFF)
    cls = np.where(codes < 0x10000, kind[near], (codes >= 0x20000) & (codes < 0x40000)).astype(np.uint8)
    folded = np.where(codes < 0x10000, low[near], codes)
    same = row[1:] == row[:-1]
    i = np.flatnonzero((cls[:-1] == 1) & (cls[1:] == 1) & same)
    pairs = folded[i].astype(np.int64) << 21 | folded[i + 1]
    spaced = cls == 2
    starts = np.flatnonzero(spaced & np.concatenate([[True], ~spaced[:-1] | ~same])) if len(codes) else np.empty(0, np.int64)
    ends = np.flatnonzero(spaced & np.concatenate([~spaced[1:] | ~same, [True]])) + 1 if len(codes) else np.empty(0, np.int64)
    if len(starts):
        at = np.flatnonzero(spaced)
        first = np.repeat(starts, ends - starts)
        hashed = (folded[at].astype(np.uint64) + np.uint64(1)) * powers[(at - first) & 63]
        sums = np.add.reduceat(hashed, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
        words = (((sums ^ (sums >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(4)).astype(np.int64) | WORD
    else:
        words = np.empty(0, np.int64)
    return (
        np.concatenate([row[i], row[starts]]),
        np.concatenate([pairs, words]),
        np.concatenate([i, starts]),
        np.concatenate([i + 2, ends]),
    )


def _automaton(names: list[tuple[int, str]]) -> ahocorasick.Automaton | None:
    machine = ahocorasick.Automaton()
    for key, n in names:
        machine.add_word(n, key)
    if not names:
        return None
    machine.make_automaton()
    return machine


def name_hits(texts: list[str], machine: ahocorasick.Automaton | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, name key) of every occurrence, overlapping ones included."""
    if machine is None:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    found = [[k for _, k in machine.iter(t)] for t in texts]
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(f) for f in found])
    return rows, np.fromiter(chain.from_iterable(found), np.int64, count=len(rows))


def slices(batch: pa.RecordBatch, text_at: int, most: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) pieces of a batch of about ``most`` code points; null is the empty text."""
    texts = batch.column(text_at).to_pylist()
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i == len(texts) - 1:
            yield begin, [x or "" for x in texts[begin : i + 1]]
            begin, size = i + 1, 0


def _counted(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct pairs, sorted by row and key, with the distinct keys the terms index
    and the position of each key's first use. Rows and terms are packed into one number, so that one plain
    sort does."""
    keys, first, term = np.unique(key, return_index=True, return_inverse=True)
    packed = np.sort(row.astype(np.int64) << 32 | term)
    at = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    own = packed[at]
    return (own >> 32).astype(np.int32), (own & 0xFFFFFFFF).astype(np.int64), np.diff(np.concatenate([at, [len(packed)]])), keys, first


def converge(row: np.ndarray, tf: np.ndarray, background: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The fixed point of expectation-maximisation, for all records at once.

    ``row``: sorted record of each term; ``tf``: its count; ``background``: its collection probability.
    Returns the term's probability in the record's own model, and the part of its occurrences that model
    explains (the expectation step). At the fixed point a term with probability ``p`` keeps it through both
    steps, so ``p = tf / z - c * background`` with ``z`` the record's own mass and ``c = (1 - share) / share``;
    where that isn't positive the term's probability falls to zero. ``z`` only grows when such terms leave, so
    a round removes them and solves for the rest, and a record is done, exactly, when none leaves. A record's
    result doesn't depend on the records it is computed with.
    """
    p_out, part_out = np.zeros(len(row)), np.zeros(len(row))
    at, tf, q = np.arange(len(row)), tf.astype(np.float64), (1 - share) / share * background
    while len(at):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(row)]]))
        z = np.add.reduceat(tf, starts) / (1 + np.add.reduceat(q, starts))
        p = tf / np.repeat(z, lengths) - q
        stays = p > 0
        done = np.repeat(np.logical_and.reduceat(stays, starts), lengths)
        p_out[at[done]], part_out[at[done]] = p[done], p[done] / (p[done] + q[done])
        left = stays & ~done
        at, row, tf, q = at[left], row[left], tf[left], q[left]
    return p_out, part_out


class Names:
    """The dictionary in blocks of a bounded size; usually one. A name's key is a hash, the same in any block."""

    def __init__(self, entities: DataFrame, column: str, block_bytes: int = BROADCAST_BYTES // 4):
        distinct = entities.select(F.col(column).alias("name")).where("name is not null and name <> ''").distinct()
        size = distinct.select(F.sum(F.octet_length("name") + 64)).first()[0] or 0
        self.blocks = max(1, -(-int(size) // block_bytes))
        self._distinct = distinct.withColumn("key", F.xxhash64("name").bitwiseAND(F.lit(NAME - 1)).bitwiseOR(F.lit(NAME)))

    def each(self) -> Iterator[list[tuple[int, str]]]:
        """(key, name) of one block at a time."""
        for b in range(self.blocks):
            part = self._distinct.where(F.pmod(F.xxhash64("name"), F.lit(self.blocks)) == b)
            yield sorted((r.key, r.name) for r in part.collect())


def is_name(key: np.ndarray) -> np.ndarray:
    return (key & NAME != 0) & (key & WORD == 0)


COUNTS = "key bigint, cf bigint, name string, chunk_id string"


def collection_counts(df: DataFrame, names: Names, most: int | None = None) -> DataFrame:
    """What one scan of ``df(chunk_id, text)`` (one per dictionary block) finds in all texts, written out.

    (key, cf): occurrences of every term, summed in each batch. With ``most`` also (name, chunk_id): where the
    names stand; a batch sends at most ``most + 1`` chunk ids of a name, since more of them prove already that
    the name stands in too many.
    """
    spark = df.sparkSession
    source = df.select("chunk_id", "text").where("text <> ''")
    parts = []
    for b, block in enumerate(names.each()):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared, with_terms=b == 0):
            machine = _automaton(shared.value)
            spelled = dict(shared.value)

            def convert(batch: pa.RecordBatch) -> dict | None:
                chunks = batch.column(0).to_pylist() if most else None
                keys, counts, seen = [], [], {}
                for first, texts in slices(batch, 1):
                    row, named = name_hits(texts, machine)
                    u, n = np.unique(np.concatenate([term_keys(texts)[1], named]) if with_terms else named, return_counts=True)
                    keys.append(u)
                    counts.append(n)
                    if most:
                        for r, k in dict.fromkeys(zip(row.tolist(), named.tolist(), strict=True)):
                            if (chunk := chunks[first + r]) is not None and len(ids := seen.setdefault(k, set())) <= most:
                                ids.add(chunk)
                u, back = np.unique(np.concatenate(keys), return_inverse=True)
                pairs = [(spelled[k], c) for k, ids in seen.items() for c in ids]
                none, blank = [None] * len(u), [None] * len(pairs)
                cf = np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64)
                return {"key": [*u.tolist(), *blank], "cf": [*cf.tolist(), *blank], "name": none + [a for a, _ in pairs], "chunk_id": none + [c for _, c in pairs]}

            return convert

        parts.append(map_batches(source, COUNTS, make))
    return cut(reduce(DataFrame.unionByName, parts))


def background_of(counts: DataFrame) -> DataFrame:
    """(key, cf) over all texts."""
    return counts.where("key is not null").groupBy("key").agg(F.sum("cf").alias("cf"))


def names_within(counts: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """(term): names that stand in the texts of ``least`` to ``most`` different non-null chunk ids, exactly;
    ``counts`` were made with the same ``most``."""
    pairs = counts.where("name is not null").select(F.col("name").alias("term"), "chunk_id").distinct()
    return pairs.groupBy("term").count().where(F.col("count").between(least, most)).select("term")


SCORES = "row_id bigint, chunk_id string, term string, is_name boolean, tf int, score double, own_part double, rank int"


def _scored(texts: list[str], hits: tuple[np.ndarray, np.ndarray], spelled: dict[int, str], probability, only_names: bool, least_part: float, with_rank: bool) -> dict | None:
    """Columns of the scored terms of ``texts`` and ``row``, the text each belongs to.

    ``hits``: (row, key) of the names in them, ``spelled``: their spelling; ``probability(keys)``: the terms' in the collection.
    """
    row, key, start, end = term_keys(texts)
    name_row, named = hits
    all_rows = np.concatenate([row, name_row])
    if not len(all_rows):
        return None
    r, t, tf, own_keys, seen = _counted(all_rows, np.concatenate([key, named]))
    q = probability(own_keys)[t]
    p, part = converge(r, tf, q)
    named_key = is_name(own_keys)
    keep = np.flatnonzero(named_key[t] if only_names else part >= least_part)
    if not len(keep):
        return None
    if with_rank:
        # by probability to twelve digits; terms without any by how far the collection explains them; then by
        # key: the terms come sorted by row and key, and the sort is stable
        order = np.lexsort((-np.round(np.where(p > 0, p, -q / tf), 12), r))
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        rank = np.empty(len(r), np.int32)
        rank[order] = np.arange(len(r)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(r)]]))) + 1
    wanted = t[keep]
    there = np.zeros(len(own_keys), bool)
    there[wanted] = True
    used, place = np.flatnonzero(there), np.cumsum(there) - 1
    whole = "".join(texts)
    base = len(start)  # terms are spelled once, where they are first used
    words = [spelled[k] if n else whole[start[a] : end[a]].lower() for k, n, a in zip(own_keys[used].tolist(), named_key[used].tolist(), np.minimum(seen[used], max(base - 1, 0)).tolist(), strict=True)]
    return {
        "row": r[keep], "term": pa.array(words, pa.string()).take(pa.array(place[wanted])), "is_name": pa.array(named_key[wanted]), "tf": pa.array(tf[keep].astype(np.int32)),
        "score": pa.array(p[keep]), "own_part": pa.array(part[keep]), "rank": pa.array(rank[keep]) if with_rank else pa.nulls(len(keep), pa.int32()),
    }


def _rows(batch: pa.RecordBatch | pa.Table, score) -> dict | None:
    """The scored terms of a batch of (row_id, chunk_id, text, ..): ``score(first, texts)`` for each slice."""
    out: dict[str, list] = {f.split()[0]: [] for f in SCORES.split(", ")}
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    ids, chunks = whole(batch.column(0)), whole(batch.column(1))
    for first, texts in slices(batch, 2):
        if (got := score(first, texts)) is None:
            continue
        where = pa.array(got.pop("row").astype(np.int64) + first)
        for n, c in (got | {"row_id": ids.take(where), "chunk_id": chunks.take(where)}).items():
            out[n].append(c.cast(pa.string()) if n in ("chunk_id", "term") else c)
    return {n: pa.concat_arrays(cs) for n, cs in out.items()} if out["row_id"] else None


def characteristic_terms(df: DataFrame, names: Names, only_names: bool = False, least_part: float = 0.0, with_rank: bool = True, broadcast_bytes: int = BROADCAST_BYTES, counts: DataFrame | None = None) -> DataFrame:
    """Scores of the terms of every row of ``df(row_id, chunk_id, text)``.

    Columns: row_id, chunk_id, term, is_name, tf, score (the converged probability in the record's own
    model), own_part (the part of its occurrences that model explains), rank within the row (ties by term
    key; null without ``with_rank``). Every term comes out; those the collection explains have a score of zero and
    rank behind all others. A caller's ``least_part`` leaves out terms whose ``own_part`` is under it. With ``only_names`` every
    dictionary name of a row is kept whatever its score, and nothing else. ``counts``: ``collection_counts`` of
    the same frame and names, made here if not given.

    One model whatever the sizes: the counts go over all dictionary blocks, then each record converges with all
    its terms. The background and the dictionary are broadcast while the one fits ``broadcast_bytes`` and the
    other is one block; beyond that the records go in blocks that ask for their own terms only, by joins.
    Null and empty texts have no terms; repeated rows are scored each; a null chunk_id stays null.
    """
    spark = df.sparkSession
    source = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "text").where("text <> ''")
    if names.blocks == 1:
        background = cut(background_of(counts if counts is not None else collection_counts(source, names)))
        terms, total = background.agg(F.count(F.lit(1)), F.sum("cf")).first()
        if terms * _ROW_BYTES <= broadcast_bytes:
            got = background.toArrow()
            keys = got.column("key").to_numpy()
            order = np.argsort(keys)
            model = spark.sparkContext.broadcast((keys[order], got.column("cf").to_numpy()[order] / (total or 1)))
            dictionary = spark.sparkContext.broadcast(next(names.each()))

            def make():
                machine, spelled = _automaton(dictionary.value), dict(dictionary.value)
                keys, share = model.value

                def score(first: int, texts: list[str]) -> dict | None:
                    return _scored(texts, name_hits(texts, machine), spelled, lambda k: share[np.searchsorted(keys, k)], only_names, least_part, with_rank)

                return lambda batch: _rows(batch, score)

            return map_batches(source, SCORES, make)
    return _joined(source, names, only_names, least_part, with_rank)


def _joined(source: DataFrame, names: Names, only_names: bool, least_part: float, with_rank: bool) -> DataFrame:
    """The same when the background or the dictionary doesn't fit: blocks of records ask for their terms."""
    spark = source.sparkSession
    rows = in_blocks(source.withColumn("uid", F.monotonically_increasing_id()), "text")
    hits = []
    for block in names.each():
        shared = spark.sparkContext.broadcast(block)

        def make_hits(shared=shared):
            machine, spelled = _automaton(shared.value), dict(shared.value)

            def convert(batch: pa.RecordBatch) -> dict | None:
                row, key = name_hits(batch.column(2).to_pylist(), machine)
                if not len(row):
                    return None
                r, t, tf, keys, _ = _counted(row, key)
                where, k = pa.array(r), keys[t]
                return {"block": batch.column(0).take(where), "uid": batch.column(1).take(where), "key": pa.array(k), "n": pa.array(tf.astype(np.int64)), "name": [spelled[x] for x in k.tolist()]}

            return convert

        hits.append(map_batches(rows.select("block", "uid", "text"), "block bigint, uid bigint, key bigint, n bigint, name string", make_hits))
    named = cut(reduce(DataFrame.unionByName, hits))

    def make_vocabulary():
        def convert(batch: pa.RecordBatch) -> dict | None:
            blocks, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            out: dict[str, list] = {"block": [], "key": [], "n": []}
            for first, texts in slices(batch, 1):
                row, key, _, _ = term_keys(texts)
                own = at[row + first]
                for b in np.unique(own).tolist():
                    u, n = np.unique(key[own == b], return_counts=True)
                    for c, v in zip(out, (np.full(len(u), blocks[b]), u, n), strict=True):
                        out[c].append(v)
            return {c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in out.items()} if out["key"] else None

        return convert

    terms = map_batches(rows.select("block", "text"), "block bigint, key bigint, n bigint", make_vocabulary)
    vocabulary = cut(terms.unionByName(named.select("block", "key", "n")).groupBy("block", "key").agg(F.sum("n").alias("n")))
    background = vocabulary.groupBy("key").agg(F.sum("n").alias("cf"))
    total = vocabulary.agg(F.sum("n")).first()[0] or 1
    none = lambda kind: F.lit(None).cast(kind)
    answers = vocabulary.select("block", "key").join(background, "key").select("block", none("bigint").alias("uid"), "key", F.col("cf").alias("n"), none("string").alias("name")).unionByName(named)

    def convert(left: pa.Table, right: pa.Table) -> dict | None:
        uid, key, n = (right.column(c).to_numpy() for c in ("uid", "key", "n"))
        name_at = np.flatnonzero(~np.isnan(uid)) if uid.dtype.kind == "f" else np.arange(len(uid))
        name_uid = right.column("uid").take(pa.array(name_at)).to_numpy().astype(np.int64)
        texts_uid = left.column("uid").to_numpy()
        order = np.argsort(texts_uid)
        owner = order[np.searchsorted(texts_uid[order], name_uid)]
        by = np.argsort(owner, kind="stable")
        owner, name_at = owner[by], name_at[by]
        spelled = dict(zip(key[name_at].tolist(), right.column("name").take(pa.array(name_at)).to_pylist(), strict=True))
        is_cf = np.ones(len(uid), bool)
        is_cf[name_at] = False
        known, share = key[is_cf], n[is_cf] / total
        order = np.argsort(known)
        known, share = known[order], share[order]

        def score(first: int, texts: list[str]) -> dict | None:
            a, b = np.searchsorted(owner, [first, first + len(texts)])
            own, times = name_at[a:b], n[name_at[a:b]]
            hit = (np.repeat(owner[a:b] - first, times).astype(np.int32), np.repeat(key[own], times))
            return _scored(texts, hit, spelled, lambda k: share[np.searchsorted(known, k)], only_names, least_part, with_rank)

        return _rows(left, score)

    return with_answers(rows.select("row_id", "chunk_id", "text", "uid", "block"), answers, SCORES, convert)


def names_of_few(df: DataFrame, entities: DataFrame, column: str = "canonical", least: int = 2, most: int = 5, **options) -> DataFrame:
    """(chunk_id, canonical): names the model leaves a share in some record, in ``least`` to ``most`` chunks.

    The converged scores decide first: a name whose every occurrence the collection explains has a score of zero
    in all its records and goes. The exact count of its chunk ids follows as a check.
    """
    names = Names(entities, column)
    counts = collection_counts(df, names, most)
    scored = characteristic_terms(df, names, only_names=True, with_rank=False, counts=counts, **options).where("chunk_id is not null")
    kept = scored.join(names_within(counts, least, most), "term", "left_semi").groupBy("term").agg(F.collect_set("chunk_id").alias("ids"), F.max("score").alias("best"))  # at most `most` ids
    return kept.where("best > 0").select(F.explode("ids").alias("chunk_id"), F.col("term").alias(column))
