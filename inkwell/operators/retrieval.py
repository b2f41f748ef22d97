"""Lexical, vector and tag recall, fusion and ranking; a batch of queries is a DataFrame.

Frames: ``chunks(doc, role, text, ...)``, ``queries(qid, text)``, ``vectors(doc, embedding)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as X
from inkwell.runtime import cut, maybe_broadcast, ship, spread

# Ranking constants.
K1, B = 1.5, 0.75
W_LEXICAL, W_VECTOR, W_TAG = 0.3, 0.6, 0.1
MIN_COSINE = 0.3
VECTOR_TOP, FALLBACK_TOP = 50, 20
POOL_CAP = 120
RERANK_WINDOW = 50
QUERY_BLOCK = 4096  # queries whose vectors are held at once


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n and avg_len over all chunks, whatever their role."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(X.token_count("text")).alias("avg_len"))


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc, len, term, tf) of body chunks, for all terms or those of ``terms(term)`` only."""
    # the length is its own step: beside the explode it would be computed again for every token
    sized = spread(chunks.where("role = 'body'").select("doc", "text")).select("doc", X.token_count("text").alias("len"), X.without_blanks("text").alias("text"))
    rows = sized.select("doc", "len", F.explode(X.tokens("text")).alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")  # before counting: with a small side other terms never leave their task
    return rows.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_df(chunks: DataFrame) -> DataFrame:
    return postings(chunks).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, distinct: bool = False) -> DataFrame:
    """(qid, term, times): repeated tokens count as often as they occur, or once."""
    rows = queries.select("qid", F.explode(X.tokens("text")).alias("term"))
    return rows.distinct().withColumn("times", F.lit(1)) if distinct else rows.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(queries: DataFrame, chunks: DataFrame, distinct: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """(qid, doc, bm25) of all lexical hits. ``extra(doc, term, tf)`` adds to term counts, not to lengths."""
    # written once: its size is then known, and decides between broadcasting it and shuffling the postings
    asked = cut(query_terms(queries, distinct))
    terms = asked.count()
    wanted = maybe_broadcast(asked.select("term").distinct(), terms, 64)
    post = postings(chunks, wanted)
    if extra is not None:
        more = extra.join(chunks.where("role = 'body'").select("doc", X.token_count("text").alias("len")), "doc").join(wanted, "term", "left_semi")
        post = post.unionByName(more.select("doc", "len", "term", "tf")).groupBy("doc", "len", "term").agg(F.sum("tf").alias("tf"))
    # tf is read here too, so that both uses need the same columns and share one shuffle of the postings
    df = post.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(corpus_stats(chunks))).select("qid", "term", "times", idf.alias("idf"), "avg_len")  # one row
    return post.join(maybe_broadcast(weighted, terms, 96), "term").groupBy("qid", "doc").agg(F.sum(F.col("times") * F.col("idf") * weight).alias("bm25"))


def min_max(scores: DataFrame, score: str, out: str, by: str = "qid") -> DataFrame:
    """Scale to 0..1 within ``by``; all equal gives 1. Extremes come from an aggregate, not from a window, so no
    task orders a whole group; the scores are written once because they are read twice."""
    scores = cut(scores)
    ends = scores.groupBy(by).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    return scores.join(ends, by).withColumn(out, F.when(F.col("__hi") > F.col("__lo"), (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(1.0))).drop("__lo", "__hi")


def top_k(scores: DataFrame, k: int, *order: Column, by: str = "qid") -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def cosine_scores(query_vectors: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, doc, cosine) of the ``k`` best rows of each batch of rows for every query.

    Queries are taken in blocks of ``QUERY_BLOCK`` whose matrix is broadcast (its size doesn't grow with the
    data); each block is one pass over the rows, multiplied as matrices in Arrow batches. A batch sends only what
    can still be among the best (ties by rounded cosine, then id), so ``top_k`` after it is exact. A query meets
    the rows of its own length; null vectors and vectors without length are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "qid bigint, doc bigint, cosine double"
    source = vectors.select(F.col("doc").cast("bigint").alias("doc"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    asked = query_vectors.where("embedding is not null").select(F.col("qid").cast("bigint").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = spark.createDataFrame([], schema)
    for block in _query_blocks(asked):
        by_length = {}
        for n in sorted({len(v) for _, v in block if len(v)}):
            ids = np.asarray([i for i, v in block if len(v) == n], np.int64)
            matrix = np.asarray([v for _, v in block if len(v) == n], np.float64)
            norms = np.linalg.norm(matrix, axis=1)
            by_length[n] = ids[norms > 0], matrix[norms > 0] / norms[norms > 0, None]
        out = out.unionByName(_scored(source, spark.sparkContext.broadcast(by_length), k, schema))
    return out


def _query_blocks(asked: DataFrame):
    """Blocks of at most ``QUERY_BLOCK`` (qid, vector), read from the driver one at a time."""
    block = []
    for r in asked.toLocalIterator():
        block.append((r.qid, r.embedding))
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _scored(source: DataFrame, shared, k: int, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            docs, lists = batch.column(0).to_numpy(), batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            for dims, (ids, q) in shared.value.items():
                ok = size == dims
                if not ok.any() or not len(ids):
                    continue
                x = lists.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                norm = np.linalg.norm(x, axis=1)
                x, own = x[norm > 0] / norm[norm > 0, None], docs[ok][norm > 0]
                scores = q @ x.T
                n = min(k, len(own))
                order = np.lexsort((np.broadcast_to(own, scores.shape), -np.floor(scores * 1e6 + 0.5)), axis=1)[:, :n]
                rows, cols = np.repeat(np.arange(len(ids)), n), order.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(own[cols]), pa.array(scores[rows, cols])], ["qid", "doc", "cosine"])

    return source.mapInArrow(run, schema)


def with_cosine(pairs: DataFrame, query_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs(qid, doc, ..)`` with ``cosine``, null where either vector is missing, has no length, or the lengths differ.

    Only the pairs at hand are computed: rows meet their two vectors, scaled to length 1 before, in two joins.
    """

    def unit(frame: DataFrame, key: str, out: str) -> DataFrame:
        v = F.transform("embedding", lambda e: e.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
        return frame.where("embedding is not null").select(key, v.alias("__v"), norm.alias("__n")).where("__n > 0").select(key, F.transform("__v", lambda e: e / F.col("__n")).alias(out))

    both = pairs.join(unit(query_vectors, "qid", "__q"), "qid", "left").join(unit(vectors, "doc", "__d"), "doc", "left")
    dot = F.aggregate(F.zip_with("__q", "__d", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    return both.withColumn("cosine", F.when(F.size("__q") == F.size("__d"), dot)).drop("__q", "__d")


def vector_top(query_vectors: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, doc, cosine, rank) of the ``k`` best rows by the cosine to six digits, then id."""
    return top_k(cosine_scores(query_vectors, vectors, k), k, X.fixed(F.col("cosine"), 6).desc(), F.col("doc"))


def gated_fallback(best: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """Queries whose best row doesn't reach ``least`` lose all rows; the others keep theirs."""
    passed = best.where((F.col("rank") == 1) & (F.col("cosine") >= least)).select("qid")
    return best.join(passed, "qid", "left_semi")


def vector_candidates(query_vectors: DataFrame, vectors: DataFrame, touched: DataFrame, limit: int = FALLBACK_TOP) -> DataFrame:
    """(qid, doc): the ``VECTOR_TOP`` nearest rows of queries that other routes ``touched(qid)``; of the others the
    first ``limit`` (``FALLBACK_TOP`` at least), and none where the nearest doesn't reach the gate."""
    ranked = vector_top(query_vectors, vectors, max(VECTOR_TOP, limit))
    known = ranked.join(touched.select("qid", F.lit(1).alias("__t")).distinct(), "qid", "left")
    alone = gated_fallback(known.where("__t is null").where(F.col("rank") <= max(limit, FALLBACK_TOP)))
    return known.where("__t is not null").where(F.col("rank") <= VECTOR_TOP).select("qid", "doc").unionByName(alone.select("qid", "doc"))


def tag_rows(tags: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, chunk_id, tag): tags of existing body chunks; dead keys and blank tags are dropped, repeats merge."""
    each = tags.where("chunk_id is not null").select("chunk_id", F.explode(X.tag_list("tags")).alias("tag")).distinct()
    return each.join(chunks.where("role = 'body' and chunk_id is not null").select("doc", "chunk_id"), "chunk_id").select("doc", "chunk_id", "tag")


# Types of the project's own tags, stripped before their content is indexed.
OWN_PREFIXES = ("登场-", "遗言-", *X.TAG_PREFIXES)


def tag_terms(tagged: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """(doc, term): distinct tokens of two or more characters of the tags' contents and of the canonical forms
    ``expanded(doc, canonical)`` that aliases in the tags stand for."""
    contents = tagged.select("doc", X.strip_tag_type("tag", OWN_PREFIXES).alias("t"))
    if expanded is not None:
        contents = contents.unionByName(expanded.select("doc", F.col("canonical").alias("t")))
    return contents.select("doc", F.explode(X.tokens("t")).alias("term")).where("length(term) >= 2").distinct()


def tag_hits(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, doc): chunks sharing a token of two or more characters with the query through ``terms(doc, term)`` of their tags."""
    asked = query_terms(queries, distinct=True).where("length(term) >= 2")
    return asked.join(terms, "term").select("qid", "doc").distinct()


def fuse(lexical: DataFrame, tagged: DataFrame, best: DataFrame, query_vectors: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """The pool with its parts and score.

    ``lexical(qid, doc, bm25, bm25_norm)``, ``tagged(qid, doc)``, ``best(qid, doc)`` vector candidates. A missing
    part counts 0 in the score and stays null in its column.
    """
    pool = (
        lexical.select("qid", "doc", "bm25", "bm25_norm", F.lit(0).alias("tag_hit"), F.lit(0).alias("vector_hit"))
        .unionByName(tagged.select("qid", "doc", F.lit(1).alias("tag_hit")), allowMissingColumns=True)
        .unionByName(best.select("qid", "doc", F.lit(1).alias("vector_hit")), allowMissingColumns=True)
        .groupBy("qid", "doc")
        .agg(F.max("bm25").alias("bm25"), F.max("bm25_norm").alias("bm25_norm"), F.coalesce(F.max("tag_hit"), F.lit(0)).alias("tag_hit"), F.coalesce(F.max("vector_hit"), F.lit(0)).alias("vector_hit"))
    )
    return with_score(with_cosine(pool, query_vectors, vectors) if vectors is not None and query_vectors is not None else pool.withColumn("cosine", F.lit(None).cast("double")))


def with_score(pool: DataFrame) -> DataFrame:
    score = (
        W_LEXICAL * F.coalesce("bm25_norm", F.lit(0.0))
        + W_VECTOR * F.coalesce(F.greatest(F.lit(0.0), (F.col("cosine") + 1) / 2), F.lit(0.0))
        + W_TAG * F.col("tag_hit")
    )
    return pool.withColumn("score", X.fixed(score, 6))


def funnel(pool: DataFrame) -> DataFrame:
    """Counts of each route and of their union, per query."""
    return pool.groupBy("qid").agg(
        F.count("bm25").alias("lexical"), F.sum("vector_hit").alias("vector"), F.sum("tag_hit").alias("tag"), F.count(F.lit(1)).alias("merged")
    )


def gap_to_next(ranked: DataFrame, limit: int) -> DataFrame:
    """(qid, last_score, next_score, gap): how far the first result outside the window is behind."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    two = ranked.where(F.col("rank").isin(limit, limit + 1)).groupBy("qid").agg(at(limit).alias("last_score"), at(limit + 1).alias("next_score"))
    return two.withColumn("gap", X.fixed(F.greatest(F.lit(0.0), F.col("last_score") - F.col("next_score")), 6))


def add_members(pool: DataFrame, members: DataFrame, lexical: DataFrame, tagged: DataFrame, query_vectors: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """Group members not yet in the pool join it with the score their parts give them."""
    new = members.select("qid", "doc").distinct().join(pool.select("qid", "doc"), ["qid", "doc"], "left_anti")
    parts = (
        new.join(lexical.select("qid", "doc", "bm25", "bm25_norm"), ["qid", "doc"], "left")
        .join(tagged.select("qid", "doc", F.lit(1).alias("tag_hit")), ["qid", "doc"], "left")
        .withColumn("tag_hit", F.coalesce("tag_hit", F.lit(0)))
        .withColumn("vector_hit", F.lit(0))
    )
    return pool.unionByName(with_score(with_cosine(parts, query_vectors, vectors) if vectors is not None and query_vectors is not None else parts.withColumn("cosine", F.lit(None).cast("double"))))


def cap_pool(pool: DataFrame, matched: DataFrame, cap: int = POOL_CAP) -> DataFrame:
    """Keep the ``cap`` best of a query's pool where a group matched (``matched(qid)``); others stay whole."""
    hit = matched.select("qid").distinct()
    best = top_k(pool.join(hit, "qid", "left_semi"), cap, F.desc("score"), F.col("doc")).drop("rank")
    return best.unionByName(pool.join(hit, "qid", "left_anti"))  # these are never ordered


def rescore(pool: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Pools of the queries in ``enhanced(qid, doc, bm25)``, lexical scores of other words, scored again: only the
    lexical part changes, scaled inside the pool."""
    inside = enhanced.join(pool.select("qid", "doc"), ["qid", "doc"], "left_semi")
    normed = min_max(inside, "bm25", "bm25_norm").select("qid", "doc", "bm25", "bm25_norm")
    return with_score(pool.drop("bm25", "bm25_norm", "score").join(normed, ["qid", "doc"], "left"))


def pinned_order(pool: DataFrame, pins: DataFrame, keep: int | None = None) -> DataFrame:
    """Pinned rows of the pool first, the rest by score, then id. Pins never add rows.

    ``pins(qid, doc, direction)``: a query's pins go by id (1 earlier first, -1 later first) or, with 0, by score;
    without the column earlier first. ``keep`` limits the ranks that come out: pins are ranked apart, and of the
    others only as many are ordered as can still be within it.
    """
    pins = pins if "direction" in pins.columns else pins.withColumn("direction", F.lit(1))
    marks = pins.groupBy("qid", "doc").agg(F.min("direction").alias("direction"))
    flagged = pool.join(marks, ["qid", "doc"], "left")
    by_id = F.when(F.col("direction") != 0, F.col("doc") * F.col("direction"))
    first = flagged.where("direction is not null").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(by_id.asc_nulls_last(), F.desc("score"), "doc")))
    rest = flagged.where("direction is null").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc")))
    if keep is not None:
        first, rest = first.where(F.col("rank") <= keep), rest.where(F.col("rank") <= keep)
    pinned = first.groupBy("qid").agg(F.max("rank").alias("__pinned"))
    placed = rest.join(pinned, "qid", "left").withColumn("rank", F.col("rank") + F.coalesce("__pinned", F.lit(0))).drop("__pinned")
    out = first.withColumn("pinned", F.lit(1)).unionByName(placed.withColumn("pinned", F.lit(0))).drop("direction")
    return out if keep is None else out.where(F.col("rank") <= keep)


def rerank_window(ranked: DataFrame, external: str | None, window: int = RERANK_WINDOW) -> DataFrame:
    """Inside the first ``window`` ranks the unpinned rows are ordered by ``external`` (a column), then rank;
    pinned rows stay ahead, rows beyond the window keep their ranks. ``degraded`` says why a query's order stays:
    ``no_scorer`` (no column), ``no_candidates`` (nothing unpinned in the window), or what ``reason``, a column
    of the scorer's, holds in one of its rows."""
    none = F.lit(None).cast("string")
    if external is None:
        return ranked.withColumn("final_rank", F.col("rank")).withColumn("degraded", F.lit("no_scorer"))
    inside = ranked.where(F.col("rank") <= window)
    beyond = ranked.where(F.col("rank") > window).withColumn("final_rank", F.col("rank")).withColumn("degraded", none)
    own = Window.partitionBy("qid")  # at most ``window`` rows
    reason = F.max("reason").over(own) if "reason" in ranked.columns else none
    why = F.when(F.min("pinned").over(own) == 1, "no_candidates").otherwise(reason)
    flagged = inside.withColumn("degraded", why)
    by = F.when((F.col("pinned") == 0) & F.col("degraded").isNull(), F.col(external))
    order = own.orderBy(F.desc("pinned"), by.desc_nulls_last(), F.col("rank"))
    return flagged.withColumn("final_rank", F.row_number().over(order)).unionByName(beyond)


def hit_labels(queries: DataFrame, tagged: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, doc, label): tags of ranked rows that share a token of two or more characters with the query."""
    terms = tagged.select("doc", "tag", F.explode(X.tokens(X.strip_tag_type("tag", OWN_PREFIXES))).alias("term")).where("length(term) >= 2").distinct()
    asked = query_terms(queries, distinct=True).where("length(term) >= 2").select("qid", "term")
    return asked.join(terms, "term").select("qid", "doc", F.col("tag").alias("label")).distinct().join(ranked.select("qid", "doc"), ["qid", "doc"], "left_semi")


def placed_members(matched: DataFrame, members: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, kind, eventid, group_size, placed, docs): matched groups, how many of their members were returned, and
    which: in order of result, those of L3 groups in inner order, as a list in one string.

    ``matched(qid, kind, eventid, group_type)``, ``members(kind, eventid, doc, place)``, ``ranked(qid, doc, rank)`` of a bounded rank.
    """
    of = matched.select("qid", "kind", "eventid", "group_type").join(members.select("kind", "eventid", "doc", "place"), ["kind", "eventid"])
    by = ["qid", "kind", "eventid"]
    sizes = of.groupBy(*by).agg(F.countDistinct("doc").alias("group_size"))
    at = F.when(F.col("group_type") == "L3", F.col("place")).otherwise(F.col("rank"))
    docs = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "doc"))), lambda x: x["doc"].cast("string"))
    placed = of.join(ranked.select("qid", "doc", "rank"), ["qid", "doc"]).groupBy(*by).agg(F.countDistinct("doc").alias("placed"), F.array_join(docs, ",").alias("docs"))
    return matched.select(*by).distinct().join(sizes, by, "left").join(placed, by, "left").fillna({"group_size": 0, "placed": 0, "docs": ""})


def score_pairs(pairs: DataFrame, make_scorer, most: int = 16, out: str = "ce") -> DataFrame:
    """``pairs(qid, doc, query, text)`` with a score column from a pluggable scorer.

    ``make_scorer()`` runs once per task (models are loaded there) and returns a function from lists of
    queries and texts to scores. Inside an Arrow batch pairs go to it in order of length, ``most`` at a time,
    so that a batch pads to similar lengths. A scorer that is unavailable gives null scores.
    """
    ship(pairs.sparkSession)

    def run(batches):
        scorer = make_scorer()
        for batch in batches:
            q, t = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            scores: list[float | None] = [None] * len(q)
            reasons: list[str | None] = [None if scorer else "no_scorer"] * len(q)
            order = sorted(range(len(q)), key=lambda i: (len(q[i] or "") + len(t[i] or ""), i)) if scorer else []
            for a in range(0, len(order), most):
                at = order[a : a + most]
                try:
                    got = [float(s) for s in scorer([q[i] or "" for i in at], [t[i] or "" for i in at])]
                    why = None if len(got) == len(at) and all(map(np.isfinite, got)) else "bad_scores"
                except Exception:  # a scorer that fails must not fail the search: its pairs say so
                    got, why = [], "scorer_failed"
                for place, i in enumerate(at):
                    scores[i], reasons[i] = (got[place], None) if why is None else (None, why)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(reasons, pa.string())], ["qid", "doc", out, "reason"])

    source = pairs.select(F.col("qid").cast("bigint").alias("qid"), F.col("doc").cast("bigint").alias("doc"), "query", "text")
    return source.mapInArrow(run, f"qid bigint, doc bigint, {out} double, reason string")


def vector_base64(vectors: DataFrame) -> DataFrame:
    """(doc, dim, data): vectors as base64 of their little-endian 32-bit floats."""
    ship(vectors.sparkSession)

    def run(batches):
        import base64

        for batch in batches:
            rows = [np.asarray(v, "<f4") for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in rows], pa.int32()), pa.array([base64.b64encode(v.tobytes()).decode() for v in rows])], ["doc", "dim", "data"])

    return vectors.select(F.col("doc").cast("bigint").alias("doc"), "embedding").where("embedding is not null").mapInArrow(run, "doc bigint, dim int, data string")


def pick_one(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """One row, drawn by a seeded hash of its id: the same seed gives the same row whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(1)
