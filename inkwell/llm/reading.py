"""How demanding each document is to read: harmonic propagation over the document-word graph.

Documents and the words they contain form a bipartite graph. Documents with opinions are clamped to the median
opinion; every other node takes the weighted mean of its neighbours, until the difficulties settle. A word's
weight follows how well its documents agree and is taken anew in each round, so the rounds are those of an
iteratively re-weighted harmonic function, not of one fixed graph. A document's own level is then read off
its sentences, each scored by the settled difficulty of its words, so that a wrong opinion or a few easier or
harder sentences don't decide it.

Words are rows of a table. Documents lie in blocks that keep their words as places in the block's vocabulary;
in a round every block asks for its vocabulary by a join, and sends one sum per word back.
"""

from __future__ import annotations

import secrets
import warnings
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.batches import map_batches
from inkwell.llm.blocks import BLOCK, in_each_block, with_answers
from inkwell.llm.lookalike import canonical
from inkwell.llm.sentences import Learned, Periods, lang_name, learn_periods, unit_ends
from inkwell.llm.terms import slices, term_keys
from inkwell.runtime import buckets_for, cut, cut_by, maybe_broadcast

LEVELS = (1, 2, 3, 4)
ROUNDS = 60
SETTLED = 2e-3
MIDDLE = 2.5
#: weight of a propagated document against a clamped one, and smoothing of a word's difficulty and spread
FREE, PRIOR, SPREAD, SHARPNESS = 0.3, 0.1, 0.05, 1.5


@cache
def _letter_kinds() -> np.ndarray:
    """Per code point: 0 no letter (as all beyond the basic plane but ideographs), 1 ideograph, 2 kana, 3 Latin, 4 another letter."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[0x20000:0x40000] = 1
    for o in range(0x10000):
        if chr(o).isalpha():
            ideograph = 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00
            kinds[o] = 1 if ideograph else 2 if 0x3041 <= o < 0x3100 else 3 if o < 0x250 else 4
    return kinds


def languages(texts: list[str]) -> list[str | None]:
    """``zh``, ``en`` or None (another language or no letters) for each text, by the scripts of its letters.

    None when kana are more than a tenth of ideographs and kana and than a tenth of Latin letters, or when
    letters of other scripts are the majority. An ideograph counts as three Latin letters.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cell = np.repeat(np.arange(0, 5 * len(texts), 5), [len(t) for t in texts])
    cell += _letter_kinds()[codes]
    counts = np.bincount(cell, minlength=5 * len(texts)).reshape(-1, 5)
    out: list[str | None] = []
    for _, han, kana, latin, other in counts.tolist():
        total = han + kana + latin + other
        foreign = kana > 0.1 * (han + kana) and kana > 0.1 * latin or 2 * (han + latin) < total
        out.append(None if not total or foreign else "zh" if 3 * han > latin else "en")
    return out


def language(text: str) -> str | None:
    return languages([text])[0]


def opinions(labels: DataFrame) -> DataFrame:
    """(doc_id, opinion): the median of the distinct valid opinions on a document."""
    valid = labels.where(F.col("reading_level").isin(*LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", "rater", "labelled_at", "reading_level").distinct()
    return valid.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.percentile("reading_level", 0.5).alias("opinion"))


def _lists(values: np.ndarray, owner: np.ndarray, owners: int) -> pa.ListArray:
    """Values sorted by owner as one list per owner."""
    offsets = np.zeros(owners + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=owners), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _first_uses(edge: np.ndarray) -> np.ndarray:
    """Whether each edge stands for the first time. Edge and place are sorted as one number where they fit into one:
    a plain sort takes a fraction of the time of one that returns an order."""
    n = len(edge)
    used = np.zeros(n, bool)
    if n and int(edge.max()) < (1 << 62) // n:
        packed = np.sort(edge * n + np.arange(n))
        used[packed[np.flatnonzero(np.diff(packed // n, prepend=-1))] % n] = True
    else:
        used[np.unique(edge, return_index=True)[1]] = True
    return used


GRAPH = "block bigint, doc_id bigint, opinion double, words array<int>, lengths array<int>, vocabulary array<bigint>"


def document_graph(documents: DataFrame, opinion: DataFrame, known: Learned | Periods | None = None, lang_col: str | None = None, size: int = BLOCK) -> DataFrame:
    """The Chinese and English documents in blocks of about ``size`` code points, bucketed by ``block``.

    A document's row has its doc_id, opinion, ``words`` (one after another, as places in its block's vocabulary;
    its first use of a word is written as ``~place``, so these are its edges) and ``lengths`` (words of each
    sentence, cut with the learned periods ``known``). A block has one more row with ``vocabulary``, its words' keys.
    """
    known = known or Periods()
    lang = lang_name(F.col(lang_col)) if lang_col else F.lit("")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lang.alias("lang")).where("text is not null and text <> ''")
    joined = rows.join(maybe_broadcast(opinion, opinion.count(), 32), "doc_id", "left").select("doc_id", "opinion", "text", "lang")

    def make():
        def convert(batch: pa.RecordBatch) -> dict | None:
            out: dict[str, list] = {f.split()[0]: [] for f in GRAPH.split(", ")}
            langs = batch.column(3).to_pylist()
            for first, texts in slices(batch, 2, size):
                forms = [canonical(t) for t in texts]
                kept = [i for i, lang in enumerate(languages(forms)) if lang]
                if not kept:
                    continue
                forms = [forms[i] for i in kept]
                base = np.concatenate([[0], np.cumsum([len(t) for t in forms])])
                ends_of = [unit_ends(t, known.of(langs[first + i], t)) for i, t in zip(kept, forms, strict=True)]
                ends = np.concatenate([np.asarray(e, np.int64) + b for e, b in zip(ends_of, base[:-1], strict=True)])
                sentences = np.asarray([len(e) for e in ends_of])
                row, key, start, _ = term_keys(forms)
                order = np.argsort(start, kind="stable")  # words and letter pairs back into reading order
                row, start = row[order], start[order]
                coded = pa.array(key[order], pa.int64()).dictionary_encode()
                vocabulary, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                used = _first_uses(row.astype(np.int64) * max(len(vocabulary), 1) + place)
                words = np.where(used, ~place, place).astype(np.int32)
                sentence = np.searchsorted(ends, start, side="right")
                per = np.bincount(np.minimum(sentence, max(len(ends) - 1, 0)), minlength=len(ends)).astype(np.int32)
                n, where = len(forms), pa.array(np.asarray(kept, np.int64) + first)
                none = pa.nulls(1)
                of = lambda docs, block, kind: pa.concat_arrays([docs.cast(kind), block.cast(kind)])
                out["block"].append(pa.array(np.full(n + 1, secrets.randbits(62))))
                out["doc_id"].append(of(batch.column(0).take(where), none, pa.int64()))
                out["opinion"].append(of(batch.column(1).take(where), none, pa.float64()))
                out["words"].append(of(_lists(words, row, n), none, pa.list_(pa.int32())))
                out["lengths"].append(of(_lists(per, np.repeat(np.arange(n), sentences), n), none, pa.list_(pa.int32())))
                out["vocabulary"].append(of(pa.nulls(n), pa.array([vocabulary]), pa.list_(pa.int64())))
            return {n: pa.concat_arrays(c) for n, c in out.items()} if out["doc_id"] else None

        return convert

    size_of = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return cut_by(map_batches(joined, GRAPH, make), "block", buckets_for(documents.sparkSession, size_of))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, whatever its slices."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    offsets = whole.offsets.to_numpy()
    return whole.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _means(values: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Weighted mean of each list; NaN for lists without weight."""
    num = np.concatenate([[0.0], np.cumsum(values * weights)])
    den = np.concatenate([[0.0], np.cumsum(weights)])
    n, d = num[offsets[1:]] - num[offsets[:-1]], den[offsets[1:]] - den[offsets[:-1]]
    return np.where(d > 1e-9, n / np.maximum(d, 1e-9), np.nan)


def _model(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Difficulty and weight of a block's words, by place."""
    order = np.argsort(answers.column("place").to_numpy())
    return tuple(answers.column(c).to_numpy()[order] for c in ("mu", "w"))


def asked_words(graph: DataFrame) -> DataFrame:
    """(block, place, key) of every word of every block, bucketed by ``key``: every round asks for the same words, so
    they are laid out once."""
    spark = graph.sparkSession
    vocabulary = graph.where("vocabulary is not null")
    words = vocabulary.agg(F.sum(F.size("vocabulary"))).first()[0] or 0
    buckets = max(buckets_for(spark, words * 24), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_by(vocabulary.select("block", F.posexplode("vocabulary").alias("place", "key")), "key", buckets)


def _answers(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(block, place, mu, w) of every word of every block; words that nothing reached weigh nothing."""
    return asked.join(words.select("key", "mu", "w"), "key", "left").select("block", "place", F.coalesce("mu", F.lit(MIDDLE)).alias("mu"), F.coalesce("w", F.lit(0.0)).alias("w"))


def _round(graph: DataFrame, words: DataFrame | None, asked: DataFrame | None = None) -> DataFrame:
    """One harmonic step: documents from words, then (key, mu, w, moved) of the words from documents.

    The first step (``words`` None) has the clamped documents only and asks for no word. ``moved``: by how much the
    difficulty changed. ``asked``: ``asked_words``, made here where it isn't given.
    """

    def convert(rows: pa.Table, answers: pa.Table | None = None) -> dict | None:
        known = pc.is_valid(rows.column("vocabulary"))
        keys, _ = _flat(rows.filter(known).column("vocabulary"))
        rows = rows.filter(pc.invert(known))
        if not rows.num_rows:
            return None
        mu, w = _model(answers) if answers is not None else (np.full(len(keys), MIDDLE), np.zeros(len(keys)))
        places, offsets = _flat(rows.column("words"))
        size = np.diff(offsets)
        owner = np.repeat(np.arange(len(size)), size)
        first = places < 0
        nodes, owner = ~places[first], owner[first]
        edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])
        opinion = rows.column("opinion").to_numpy().astype(np.float64)
        clamped = ~np.isnan(opinion)
        free = _means(mu[nodes], w[nodes], edges)
        y = np.where(clamped, opinion, free)
        strength = np.where(clamped, 1.0, np.where(np.isnan(free), 0.0, FREE))
        y = np.where(strength > 0, y, 0.0)
        s, v = strength[owner], y[owner]
        n = np.bincount(nodes, s, len(keys))
        at = np.flatnonzero(n)
        return {"key": keys[at], "n": n[at], "s": np.bincount(nodes, s * v, len(keys))[at], "q": np.bincount(nodes, s * v * v, len(keys))[at], "old": mu[at]}

    schema, columns = "key bigint, n double, s double, q double, old double", ("block", "opinion", "words", "vocabulary")
    if words is None:
        sums = in_each_block(graph.where("opinion is not null or vocabulary is not null").select(*columns), schema, convert)
    else:
        sums = with_answers(graph.select(*columns), _answers(asked if asked is not None else asked_words(graph), words), schema, convert)
    total = sums.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("old").alias("old"))
    mu = (F.col("s") + MIDDLE * PRIOR) / (F.col("n") + PRIOR)
    disagree = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    w = F.pow(1 / (disagree + SPREAD + 1 / (F.col("n") + 1)), F.lit(SHARPNESS))
    return total.select("key", mu.alias("mu"), w.alias("w"), F.abs(mu - F.col("old")).alias("moved"))


class Settled:
    """Words (key, mu, w) after propagation, and by how much each round still moved them."""

    def __init__(self, words: DataFrame, moves: list[float], settled: bool):
        self.words, self.moves, self.settled = words, moves, settled


def word_difficulty(graph: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED, asked: DataFrame | None = None) -> Settled:
    """Difficulty and weight of every word once the propagation has settled: the weighted mean movement of the
    words in a round is under ``settled``. After ``rounds`` rounds it ends with a warning and ``settled`` false."""
    asked = asked if asked is not None else asked_words(graph)
    words = cut(_round(graph, None))
    moves: list[float] = []
    for _ in range(rounds):
        words = cut(_round(graph, words, asked))
        moved, mass = words.agg(F.sum(F.col("moved") * F.col("w")), F.sum("w")).first()
        moves.append(float(moved or 0) / max(float(mass or 0), 1e-9))
        if moves[-1] < settled:
            return Settled(words, moves, True)
    warnings.warn(f"difficulties still move by {moves[-1]:.2g} after {rounds} rounds", stacklevel=2)
    return Settled(words, moves, False)


def sentence_medians(graph: DataFrame, words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, opinion, difficulty): the median of the document's sentence difficulties."""

    def convert(rows: pa.Table, answers: pa.Table) -> dict:
        mu, w = _model(answers)
        places, _ = _flat(rows.column("words"))
        places = np.where(places < 0, ~places, places)
        lengths, sentences = _flat(rows.column("lengths"))
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        scores = _means(mu[places], w[places], offsets)
        owner = np.repeat(np.arange(rows.num_rows), np.diff(sentences))
        ok = ~np.isnan(scores)
        owner, scores = owner[ok], scores[ok]
        order = np.lexsort((scores, owner))
        scores = scores[order]
        count = np.bincount(owner, minlength=rows.num_rows)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        middle = np.full(rows.num_rows, MIDDLE)
        has = count > 0
        middle[has] = scores[(begin + (count - 1) // 2)[has]]
        return {"doc_id": rows.column("doc_id"), "opinion": rows.column("opinion"), "difficulty": middle}

    docs = graph.where("vocabulary is null").select("block", "doc_id", "opinion", "words", "lengths")
    return with_answers(docs, _answers(asked if asked is not None else asked_words(graph), words), "doc_id bigint, opinion double, difficulty double", convert)


def reading_levels(documents: DataFrame, labels: DataFrame, lang_col: str | None = None) -> DataFrame:
    """(doc_id, difficulty, reading_level) of every document written in Chinese or English.

    Left out: null, empty and letterless texts, other languages. Opinions outside 1..4, on missing
    documents or without a document id don't count; exact repetitions count once; null raters count.
    Repeated documents are scored each. Borders between levels lie halfway between the median difficulties
    of the documents with these opinions, or halfway between the levels where one has no opinions; without
    any opinion every document stays in the middle (level 2). ``lang_col`` says whose periods are learned together.
    """
    graph = document_graph(documents, opinions(labels), learn_periods(documents, "text", lang_col), lang_col)
    asked = asked_words(graph)
    scored = cut(sentence_medians(graph, word_difficulty(graph, asked=asked).words, asked))
    at = scored.where("opinion is not null and opinion = floor(opinion)").groupBy(F.col("opinion").cast("int").alias("level")).agg(F.percentile_approx("difficulty", 0.5, 10_000).alias("d"))
    centre = {r.level: r.d for r in at.collect()}
    borders = [(centre[a] + centre[a + 1]) / 2 if a in centre and a + 1 in centre and centre[a] < centre[a + 1] else a + 0.5 for a in LEVELS[:-1]]
    level = F.lit(1)
    for b in borders:
        level = level + (F.col("difficulty") > F.lit(float(b))).cast("int")
    return scored.select("doc_id", "difficulty", level.alias("reading_level"))


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and mean difficulty per source and level."""
    return (
        levels.join(documents.select("doc_id", "source"), "doc_id")
        .groupBy("source", "reading_level")
        .agg(F.count(F.lit(1)).alias("documents"), F.avg("difficulty").alias("mean_difficulty"))
    )
