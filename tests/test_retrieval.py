import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell import api
from inkwell.operators import retrieval as R

CHUNKS = "doc bigint, chunk_id string, role string, text string"
ROWS = [(1, "s:0001:p0001:c01", "body", "关羽斩将"), (2, "s:0001:p0002:c01", "body", "刘备与关羽饮酒关羽大笑"), (3, "s:0001:p0003:c01", "lead", "关羽诗曰"), (4, "s:0001:p0004:c01", "body", "曹操引兵"), (5, None, "body", None)]


def toks(t):
    c = [x for x in (t or "") if not x.isspace()]
    return c + [a + b for a, b in zip(c, c[1:])]


def brute(query, distinct=False):
    q = toks(query)
    q = set(q) if distinct else q
    body = {d: toks(t) for d, _, r, t in ROWS if r == "body"}
    lens = {d: len(toks(t)) for d, _, _, t in ROWS}
    n, avg = len(ROWS), sum(lens.values()) / len(ROWS)
    df = Counter(t for ts in body.values() for t in set(ts))
    out = {}
    for t in q:
        for d, ts in body.items():
            if tf := ts.count(t):
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                out[d] = out.get(d, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens[d] / avg))
    return out


@pytest.fixture()
def chunks(spark):
    return spark.createDataFrame(ROWS, CHUNKS)


@pytest.mark.parametrize("distinct", [False, True])
def test_bm25_counts_repeated_query_tokens_unless_distinct(spark, chunks, distinct):
    q = spark.createDataFrame([(7, "关羽关羽饮酒")], "qid bigint, text string")
    got = {r.doc: r.bm25 for r in R.bm25(q, chunks, distinct).collect()}
    want = brute("关羽关羽饮酒", distinct)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)


def test_lead_chunks_are_never_found_but_count_for_lengths(spark, chunks):
    q = spark.createDataFrame([(7, "诗曰")], "qid bigint, text string")
    assert R.bm25(q, chunks).count() == 0
    assert R.corpus_stats(chunks).first().n == 5


def test_min_max_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 3.0)], "qid bigint, doc bigint, s double")
    assert {(r.qid, r.doc): r.n for r in R.min_max(df, "s", "n").collect()} == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 0.0, (2, 2): 1.0}


def test_vector_top_is_exact_with_ties(spark):
    rnd = np.random.RandomState(0)
    m = rnd.randint(-2, 3, (300, 4)).astype(float)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(900, None), (901, [1.0])], "doc bigint, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in (3, 5)], "qid bigint, embedding array<double>")
    got = {(r.qid, r["rank"]): r.doc for r in R.vector_top(q, v, 9).collect()}
    for qi in (3, 5):
        norm = np.linalg.norm(m, axis=1)
        if not norm[qi]:
            continue
        s = {i: math.floor(m[i] @ m[qi] / norm[i] / norm[qi] * 1e6 + 0.5) for i in range(300) if norm[i]}
        order = sorted(s, key=lambda i: (-s[i], i))[:9]
        assert [got[qi, k + 1] for k in range(9)] == order


def test_fallback_gate(spark):
    best = spark.createDataFrame([(1, 1, 0.2, 1), (2, 1, 0.5, 1), (2, 2, 0.1, 2)], "qid bigint, doc bigint, cosine double, rank int")
    assert {r.qid for r in R.gated_fallback(best).collect()} == {2} and R.gated_fallback(best).count() == 2


def test_cap_only_where_a_group_matched(spark):
    pool = spark.range(130).select(F.lit(1).alias("qid"), F.col("id").alias("doc"), (F.col("id") / 1000).alias("score"))
    pool = pool.unionByName(pool.withColumn("qid", F.lit(2)))
    matched = spark.createDataFrame([(1,)], "qid bigint")
    got = {r.qid: (r.n, r.lo) for r in R.cap_pool(pool, matched).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("lo")).collect()}
    assert got == {1: (120, 0.01), 2: (130, 0.0)}


def test_pins_come_first_and_add_nothing(spark):
    pool = spark.createDataFrame([(1, 5, 0.9), (1, 7, 0.1), (1, 3, 0.2)], "qid bigint, doc bigint, score double")
    pins = spark.createDataFrame([(1, 7), (1, 3), (1, 99)], "qid bigint, doc bigint")
    rows = R.pinned_order(pool, pins).orderBy("rank").collect()
    assert [(r.doc, r.pinned, r["rank"]) for r in rows] == [(3, 1, 1), (7, 1, 2), (5, 0, 3)]


def test_why_a_query_keeps_its_order(spark):
    ranked = spark.createDataFrame([(q, i, 1 if q == 2 else 0, i, float(i), "scorer_failed" if (q, i) == (3, 2) else None) for q in (1, 2, 3) for i in (1, 2, 3)], "qid bigint, doc bigint, pinned int, rank int, ce double, reason string")
    got = {}
    for r in R.rerank_window(ranked, "ce", 3).orderBy("qid", "final_rank").collect():
        got.setdefault((r.qid, r.degraded), []).append(r.doc)
    assert got == {(1, None): [3, 2, 1], (2, "no_candidates"): [1, 2, 3], (3, "scorer_failed"): [1, 2, 3]}


def test_reasons_of_a_scorer(spark):
    pairs = spark.createDataFrame([(1, 1, "q", "x")], "qid bigint, doc bigint, query string, text string")
    reason = lambda make: R.score_pairs(pairs, make).first().reason

    def failing():
        def score(q, t):
            raise RuntimeError("no")

        return score

    assert reason(lambda: None) == "no_scorer" and reason(failing) == "scorer_failed" and reason(lambda: lambda q, t: []) == "bad_scores" and reason(lambda: lambda q, t: [float("nan")]) == "bad_scores"
    assert reason(lambda: lambda q, t: [1]) is None


def test_index_equals_a_fresh_search_and_can_be_stored(spark, chunks, tmp_path):
    from inkwell.operators import index as I

    extra = spark.createDataFrame([(1, "刘", 2), (4, "关羽", 1), (3, "诗", 5)], "doc bigint, term string, tf bigint")
    made = I.build(chunks, extra)
    made.save(str(tmp_path / "index"))
    stored = I.load(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([(7, "关羽关羽饮酒"), (8, "刘备"), (9, None)], "qid bigint, text string")
    rows = lambda df: {(r.qid, r.doc): round(r.bm25, 9) for r in df.collect()}
    for distinct in (False, True):
        for with_added in (False, True):
            want = rows(R.bm25(q, chunks, distinct, extra if with_added else None))
            assert rows(I.scores(made, q, distinct, with_added)) == rows(I.scores(stored, q, distinct, with_added)) == want and want


def test_queries_in_blocks_give_the_same(spark, chunks, monkeypatch):
    from inkwell.operators import index as I

    made = I.build(chunks)
    q = spark.createDataFrame([(i, "关羽饮酒引兵"[i % 5 :]) for i in range(12)], "qid bigint, text string")
    want = {(r.qid, r.doc): r.bm25 for r in I.scores(made, q).collect()}
    monkeypatch.setattr(I, "BROADCAST_BYTES", 1000)
    assert {(r.qid, r.doc): pytest.approx(r.bm25) for r in I.scores(made, q).collect()} == want


def test_vectors_of_several_lengths_meet_their_own(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "doc bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0]), (3, []), (4, None)], "qid bigint, embedding array<double>")
    assert {(r.qid, r.doc): round(r.cosine, 6) for r in R.cosine_scores(q, v, 5).collect()} == {(1, 2): 1.0, (2, 1): 0.707107}
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4)], "qid bigint, doc bigint")
    assert {(r.qid, r.doc): round(r.cosine, 6) for r in R.with_cosine(pairs, q, v).where("cosine is not null").collect()} == {(1, 2): 1.0, (2, 1): 0.707107}


def test_rerank_window_keeps_pins_ahead_and_the_rest_behind(spark):
    ranked = spark.createDataFrame([(1, i, 1 if i == 1 else 0, i, float(i)) for i in range(1, 7)], "qid bigint, doc bigint, pinned int, rank int, ce double")
    assert [r.doc for r in R.rerank_window(ranked, "ce", 4).orderBy("final_rank").collect()] == [1, 4, 3, 2, 5, 6]
    assert {r.degraded for r in R.rerank_window(ranked, None).collect()} == {"no_scorer"}


def test_score_can_be_computed_from_its_parts(spark):
    pool = spark.createDataFrame([(0.5, 0.2, 1), (None, None, 0)], "bm25_norm double, cosine double, tag_hit int")
    assert [r.score for r in R.with_score(pool).collect()] == [pytest.approx(0.3 * 0.5 + 0.6 * 0.6 + 0.1), 0.0]


def test_search_without_hits_and_with_a_large_limit(spark, chunks):
    q = spark.createDataFrame([(1, "关羽"), (2, "zzz")], "qid bigint, text string")
    got = {r.qid: r.payload for r in api.search_json(q, chunks, limit=99).collect()}
    assert got[2] == "[]" and '"chunk_id":"s:0001:p0001:c01"' in got[1]
    with pytest.raises(ValueError):
        api.search(q, chunks, limit=0)


def test_chapter(spark, chunks):
    c = chunks.withColumn("source", F.lit("s")).withColumn("chapter", (F.col("doc") % 3).cast("int")).withColumn("parent_id", F.col("chunk_id")).withColumn("seq_in_parent", F.lit(1))
    rows = api.chapter(c, 1).collect()
    assert [r.doc for r in rows if r.doc in (1, 4)] == [1, 4] and rows[0].prev == 0 and rows[0].next == 2
    with pytest.raises(ValueError):
        api.chapter(c, 50)


def test_postings_plan_prunes_columns_and_filters_role(spark, tmp_path):
    spark.createDataFrame(ROWS, CHUNKS).write.parquet(str(tmp_path / "c"))
    plan = R.postings(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().toString()
    assert "EqualTo(role,body)" in plan and "chunk_id" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1]


def test_score_pairs_batches_by_length_and_survives_a_missing_scorer(spark):
    pairs = spark.createDataFrame([(1, i, "q", "x" * n) for i, n in enumerate([9, 1, 5, 30, 2])] + [(1, 9, "q", None)], "qid bigint, doc bigint, query string, text string").coalesce(1)

    def make():
        def score(qs, ts):
            lengths = [len(t) for t in ts]
            assert lengths == sorted(lengths) and len(ts) <= 2
            return lengths

        return score

    assert {r.doc: r.ce for r in R.score_pairs(pairs, make, most=2).collect()} == {0: 9, 1: 1, 2: 5, 3: 30, 4: 2, 9: 0}
    assert {r.ce for r in R.score_pairs(pairs, lambda: None).collect()} == {None}


def test_vector_base64(spark):
    import base64
    import struct

    v = spark.createDataFrame([(1, [1.0, -2.5]), (2, None)], "doc bigint, embedding array<double>")
    (r,) = R.vector_base64(v).collect()
    assert r.dim == 2 and struct.unpack("<2f", base64.b64decode(r.data)) == (1.0, -2.5)


def test_pick_one_is_seeded(spark):
    rows = spark.range(100)
    picks = {R.pick_one(rows.repartition(n), "id", 3).first().id for n in (1, 3, 7)}
    assert len(picks) == 1 and len({R.pick_one(rows, "id", s).first().id for s in range(8)}) > 1


def test_search_uses_the_vector_route_alone_behind_the_gate(spark, chunks):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.7, 0.7])], "doc bigint, embedding array<double>")
    q = spark.createDataFrame([(1, "zzz"), (2, "yyy")], "qid bigint, text string")
    qv = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, -1.0])], "qid bigint, embedding array<double>")
    got = [(r.qid, r.doc) for r in api.search(q, chunks, vectors=vectors, query_vectors=qv, limit=2).orderBy("qid", "rank").collect()]
    assert got == [(1, 1), (1, 4)]


def test_containment_joins_hash(spark):
    from inkwell.operators.matching import substring_join

    left = spark.createDataFrame([("abc",)], "t string")
    plan = substring_join(left, "t", spark.createDataFrame([("b",)], "k string"), "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("qid"), F.col("id").alias("doc"), (F.col("id") % 17).cast("double").alias("score"))
    assert "WindowGroupLimit" in R.top_k(df, 5, F.desc("score"), F.col("doc"))._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_containment_joins_of_many_keys_equal_those_of_few(spark, monkeypatch, most):
    from inkwell.operators import matching as M

    monkeypatch.setattr(M, "BROADCAST_BYTES", most)
    left = spark.createDataFrame([(1, "甲乙丙"), (1, "甲乙丙"), (2, "乙"), (3, None), (4, "")], "i int, t string")
    keys = spark.createDataFrame([("甲乙",), ("乙",), ("乙丙",), ("",), (None,), ("丁",)], "k string")
    assert sorted((r.i, r.k) for r in M.substring_join(left, "t", keys, "k").collect()) == sorted([(1, "甲乙"), (1, "乙"), (1, "乙丙")] * 2 + [(2, "乙")])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_reranking_leaves_nothing_out(spark):
    import __spark_entry__ as e
    from inkwell.plans import search

    d = "/root/testdata/sf0.001"
    q = e.queries()
    rows = q["rerank_window"](spark, d).collect()
    pool = {(r.qid, r.doc) for r in search.pool(spark, d).select("qid", "doc").collect()}
    assert {(r.qid, r.doc) for r in rows} == pool and len(rows) == len(pool) and any(r["rank"] > 60 for r in rows)
    assert all(r["rank"] == r.final_rank for r in rows if r["rank"] > 50)
