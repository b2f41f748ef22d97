"""Queries over the lexical, vector and tag routes and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import entities as E
from inkwell.operators import index as I
from inkwell.operators import pipeline as L
from inkwell.operators import retrieval as R
from inkwell.plans import frames as P
from inkwell.plans.frames import K, chunks, fixed_sql, query_vectors, questions, vectors, with_
from inkwell.runtime import cut, table


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    terms = R.postings(chunks(spark, d)).groupBy("doc", "len").agg(F.count(F.lit(1)).alias("distinct_terms"), F.max("tf").alias("max_tf"))
    return terms.select("doc", F.col("len").alias("tokens"), "distinct_terms", "max_tf")


def term_df(spark: SparkSession, d: str) -> DataFrame:
    return R.term_df(chunks(spark, d))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(chunks(spark, d)).select("n", X.fixed(F.col("avg_len"), 6).alias("avg_len"))


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The stored index made anew, with what aliases add: per document its length, terms and counts."""
    c = chunks(spark, d)
    return I.build(c, scanned=E.scan_texts(c.where("role = 'body'").select("doc", "text"), cut(E.lexicon(P.valid_aliases(spark, d))), whole=True)).totals()


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return I.normed(P.index(spark, d), questions(spark, d))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = I.scores(P.index(spark, d), questions(spark, d), best=K).select("qid", "doc", X.fixed(F.col("bm25"), 6).alias("score"))
    return R.top_k(scored, K, F.desc("score"), F.col("doc"))


def bm25_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).select("qid", "doc", X.fixed(F.col("bm25_norm"), 6).alias("bm25_norm"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_top(query_vectors(spark, d), vectors(spark, d), K).select("qid", "doc", X.fixed(F.col("cosine"), 6).alias("cosine"), "rank")


def cosine_fallback_gate(spark: SparkSession, d: str) -> DataFrame:
    """Nearest other rows; a query whose best other row is under the gate has none."""
    scores = R.cosine_scores(query_vectors(spark, d), vectors(spark, d), R.FALLBACK_TOP + 1).where("qid <> doc")
    best = R.top_k(scores, R.FALLBACK_TOP, X.fixed(F.col("cosine"), 6).desc(), F.col("doc"))
    return R.gated_fallback(best).select("qid", "doc", X.fixed(F.col("cosine"), 6).alias("cosine"), "rank")


def cosine_expression(spark: SparkSession, d: str) -> DataFrame:
    """The column form of the cosine, each row against the next id."""
    v = vectors(spark, d)
    nxt = v.select((F.col("doc") - 1).alias("doc"), F.col("embedding").alias("other"))
    return v.join(nxt, "doc").select("doc", X.fixed(X.cosine("embedding", "other"), 6).alias("cosine"))


def tag_scan(spark: SparkSession, d: str) -> DataFrame:
    return R.tag_rows(table(spark, d, "chunk_tags"), chunks(spark, d)).withColumn("content", X.strip_tag_type("tag", R.OWN_PREFIXES))


def tag_route(spark: SparkSession, d: str) -> DataFrame:
    return R.tag_hits(P.asked(spark, d), P.corpus(spark, d).tag_terms)


def recall(spark: SparkSession, d: str) -> L.Recall:
    """The three routes of the question set and their pool; words count with what aliases add."""
    qs = cut(P.asked(spark, d))
    return L.recall(P.corpus(spark, d), qs, query_vectors(spark, d).join(qs.select("qid"), "qid", "left_semi"), R.FALLBACK_TOP)


def pool(spark: SparkSession, d: str) -> DataFrame:
    return recall(spark, d).pool


def best(spark: SparkSession, d: str, keep: int, every: int = 100) -> DataFrame:
    """The first ``keep`` rows of each pool."""
    qs = cut(P.asked(spark, d, every))
    return L.best_of_pool(P.corpus(spark, d), qs, query_vectors(spark, d, every).join(qs.select("qid"), "qid", "left_semi"), keep, R.FALLBACK_TOP)


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The first of every question of the pool."""
    ranked = best(spark, d, K, 1)
    return ranked.select("qid", "doc", "score", "rank", "tag_hit", "vector_hit")


def retrieval_funnel(spark: SparkSession, d: str) -> DataFrame:
    return R.funnel(pool(spark, d))


def gap_to_next(spark: SparkSession, d: str) -> DataFrame:
    return R.gap_to_next(best(spark, d, K + 1), K)


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Explain rows of the first 20 candidates: the score can be computed again from the other columns."""
    top = R.top_k(pool(spark, d), 20, F.desc("score"), F.col("doc"))
    return top.select("qid", "doc", "rank", X.fixed(F.col("bm25"), 3).alias("bm25"), X.fixed(F.col("bm25_norm"), 6).alias("bm25_norm"), X.fixed(F.col("cosine"), 6).alias("cosine"), "tag_hit", "score", L.source_list().alias("sources"))


RANKED = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM pool"

QUERIES = {
    f.__name__: f
    for f in (
        token_stats, term_df, corpus_stats, bm25_topk, bm25_minmax, cosine_topk, cosine_fallback_gate, cosine_expression,
        tag_scan, tag_route, index_build, hybrid_fusion, retrieval_funnel, gap_to_next, diagnostics,
    )
}
SQL = {
    "token_stats": with_(P.CTE_DOCS, P.CTE_POST) + "SELECT doc, any_value(dl) AS tokens, count(*) AS distinct_terms, max(tf) AS max_tf FROM post GROUP BY doc",
    "term_df": with_(P.CTE_DOCS, P.CTE_POST) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term",
    "corpus_stats": with_(P.CTE_DOCS, P.CTE_STATS) + f"SELECT n, {fixed_sql('avg_len', 6)} AS avg_len FROM stats",
    "bm25_topk": with_(*P.LEXICAL)
    + f"SELECT * FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM (SELECT qid, doc, {fixed_sql('bm25', 6)} AS score FROM lex)) WHERE rank <= {K}",
    "bm25_minmax": with_(*P.LEXICAL) + f"SELECT qid, doc, {fixed_sql('bm25_norm', 6)} AS bm25_norm FROM lexn",
    "cosine_topk": with_(P.CTE_COS)
    + f"SELECT * FROM (SELECT qid, doc, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, doc) AS rank FROM (SELECT qid, doc, {fixed_sql('cosine', 6)} AS cosine FROM cosines)) WHERE rank <= {K}",
    "cosine_fallback_gate": with_(P.CTE_COS)
    + f"""SELECT qid, doc, {fixed_sql('cosine', 6)} AS cosine, rank FROM (SELECT *, max(cosine) OVER (PARTITION BY qid) AS best,
  row_number() OVER (PARTITION BY qid ORDER BY {fixed_sql('cosine', 6)} DESC, doc) AS rank FROM cosines WHERE qid <> doc) WHERE rank <= 20 AND best >= 0.3""",
    "cosine_expression": f"SELECT a.vec_id AS doc, {fixed_sql(P.COSINE.format('a.embedding', 'b.embedding'), 6)} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "tag_scan": with_(P.CTE_TAGGED) + f"SELECT doc, chunk_id, tag, {P.strip_sql('tag')} AS content FROM tagged",
    "tag_route": with_(P.A.SCAN, P.CTE_ASKED, P.CTE_QT, P.CTE_TAGGED, P.CTE_TAGSCAN, P.CTE_TAGHIT) + "SELECT qid, doc FROM taghit",
    "index_build": with_(*P.EXPANDED)
    + """SELECT p.doc, any_value(p.dl) AS tokens, count(o.term) AS written_terms, count(*) AS terms, CAST(sum(coalesce(o.tf, 0)) AS BIGINT) AS written, CAST(sum(p.tf) - sum(coalesce(o.tf, 0)) AS BIGINT) AS added
  FROM post p LEFT JOIN post0 o ON o.doc = p.doc AND o.term = p.term GROUP BY p.doc""",
    "hybrid_fusion": with_(*P.HYBRID).replace("question_id % 100 = 0 AND ", "").replace(" WHERE vec_id % 100 = 0", "") + f"SELECT qid, doc, score, rank, tag_hit, vector_hit FROM ({RANKED}) WHERE rank <= {K}",
    "retrieval_funnel": with_(*P.HYBRID) + "SELECT qid, count(bm25) AS lexical, CAST(sum(vector_hit) AS BIGINT) AS vector, CAST(sum(tag_hit) AS BIGINT) AS tag, count(*) AS merged FROM pool GROUP BY qid",
    "gap_to_next": with_(*P.HYBRID)
    + f"""SELECT qid, last_score, next_score, {fixed_sql('greatest(0.0, last_score - next_score)', 6)} AS gap FROM (
  SELECT qid, max(CASE WHEN rank = {K} THEN score END) AS last_score, max(CASE WHEN rank = {K + 1} THEN score END) AS next_score FROM ({RANKED}) WHERE rank IN ({K}, {K + 1}) GROUP BY qid)""",
    "diagnostics": with_(*P.HYBRID)
    + f"""SELECT qid, doc, rank, {fixed_sql('bm25', 3)} AS bm25, {fixed_sql('bm25_norm', 6)} AS bm25_norm, {fixed_sql('cosine', 6)} AS cosine, tag_hit, score,
  concat_ws(',', CASE WHEN bm25 IS NOT NULL THEN 'lexical' END, CASE WHEN vector_hit = 1 THEN 'vector' END, CASE WHEN tag_hit = 1 THEN 'label' END) AS sources FROM ({RANKED}) WHERE rank <= 20""",
}
