"""The search from end to end, on a small corpus with results worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkwell import api
from inkwell.operators import entities as E
from inkwell.operators import groups as G
from inkwell.operators import pipeline as L

T = datetime(2024, 1, 1)
GRP = "eventid string, eventname string, aliases array<string>, chunkids array<string>, group_type string, examplequestion string, recorded_at timestamp_ntz, arrived_at timestamp_ntz"
ENT = "entity_id string, entity_type string, canonical string, aliases array<string>, rewritekeys array<string>, fragmentonly array<string>, organguard string, note string"


def cid(i):
    return f"s:0001:p{i:04d}:c01"


TEXTS = {
    1: "甲军夜渡大河", 2: "乙军坚守孤城", 3: "孟德领兵南下", 4: "大雪封山道路断绝", 5: "烈火连营七百里", 6: "水淹七军之后", 7: "老将黄某阵前身亡", 8: "黄某留书嘱咐后人", 9: "黄某初到军中", 10: "曹操论英雄",
}


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([(i, cid(i), "body", t, "s") for i, t in TEXTS.items()] + [(20, cid(20), "lead", "火攻之策如下：", "s")], "doc bigint, chunk_id string, role string, text string, source string")
    tags = spark.createDataFrame([(cid(7), "人物之死-黄某之死"), (cid(8), "黄某遗书"), (cid(9), "登场-黄某"), (cid(4), "战役-孟德雪战"), ("gone", "战役-无")], "chunk_id string, tags string")
    events = [("E1", "火攻", [], [cid(5), cid(20), "gone"], "L1"), ("E2", "水攻之战", [], [cid(6)], "L2"), ("E3", "某人身后之事", [], [cid(2), cid(1)], "L3")]
    allusions = [("A1", "煮酒论英雄", [], [cid(10)], "典故")]
    make = lambda rows, types: G.valid_groups(spark.createDataFrame([(*r, None, T, T) for r in rows], GRP), types)
    entities = E.valid_entities(spark.createDataFrame([("P1", "person", "曹操", ["孟德"], ["孟德"], [], None, None)], ENT))
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(1, 10)] + [(10, None)], "doc bigint, embedding array<double>")
    return L.prepare(chunks, tags, entities, make(events, ("L1", "L2", "L3")), make(allusions, ("典故",)), vectors)


def ask(spark, corpus, text, **options):
    q = spark.createDataFrame([(1, text)], "qid bigint, text string")
    return L.search(corpus, q, **{"limit": 20, **options}).orderBy("rank").collect()


def test_aliases_in_texts_and_tags_are_found_by_their_form(spark, corpus):
    got = {r.doc: r for r in ask(spark, corpus, "曹操")}
    assert set(got) == {3, 4, 10}  # the text with the alias, the tag with the alias, the text with the name
    assert got[4].tag_hit == 1 and got[4].bm25 is None and got[4].sources == "label" and got[3].sources == "lexical"
    assert got[10].rank == 1  # the name itself is longer in its text's counts


def test_members_join_and_say_where_they_come_from(spark, corpus):
    got = {r.doc: r for r in ask(spark, corpus, "火攻是怎么回事")}
    assert got[5].sources == "lexical,event" and 20 not in got  # 火 is in the text; leads never join
    got = {r.doc: r for r in ask(spark, corpus, "煮酒论英雄")}
    assert got[10].sources == "lexical,allusion" and got[10].rank == 1


def test_the_driving_group_is_an_event_and_changes_only_the_lexical_part(spark, corpus):
    q = spark.createDataFrame([(1, "煮酒论英雄与火攻")], "qid bigint, text string")
    m = G.bridges(q, corpus.keys)
    assert G.enhanced_queries(q, m).first().text == "煮酒论英雄与火攻火攻火攻"
    rows = {r.doc: r for r in ask(spark, corpus, "煮酒论英雄与火攻")}
    lexical = {d: r.bm25_norm for d, r in rows.items() if r.bm25_norm is not None}
    assert max(lexical.values()) == 1.0 and min(lexical.values()) == 0.0 and all(r.score == pytest.approx(0.3 * (r.bm25_norm or 0) + 0.1 * r.tag_hit, abs=1e-6) for r in rows.values())


def test_l3_anchors_are_pinned_and_added_with_plain_scores(spark, corpus):
    rows = ask(spark, corpus, "某人身后之事")
    assert [(r.doc, r.pinned) for r in rows[:2]] == [(1, 1), (2, 1)] and not any(r.pinned for r in rows[2:])
    assert rows[0].score == 0.0 and rows[0].sources == ""  # nothing but the group knows it
    # what came after: later first, also for anchors
    assert [r.doc for r in ask(spark, corpus, "某人身后之事，死后怎样")[:2]] == [2, 1]


def test_intents_pin(spark, corpus):
    want = {"黄某怎么死的": [7], "黄某的遗言": [8], "黄某死时几岁": [7, 8], "黄某第一次登场": [9], "黄某死了吗": [7]}
    q = spark.createDataFrame(list(enumerate(want)), "qid bigint, text string")
    rows = L.search(corpus, q, limit=20).orderBy("qid", "rank").collect()
    for i, first in enumerate(want.values()):
        own = [r for r in rows if r.qid == i]
        assert [r.doc for r in own if r.pinned] == first == [r.doc for r in own[: len(first)]]


def test_the_window_of_a_scorer(spark, corpus):
    plain = ask(spark, corpus, "黄某怎么死的")
    assert {r.degraded for r in plain} == {"no_scorer"}
    by_length = ask(spark, corpus, "黄某怎么死的", make_scorer=lambda: lambda q, t: [-len(x) for x in t])
    assert by_length[0].doc == 7 and [len(TEXTS[r.doc]) for r in by_length[1:]] == sorted(len(TEXTS[r.doc]) for r in plain[1:]) and {r.degraded for r in by_length} == {None}

    def failing():
        def score(q, t):
            raise RuntimeError("no weights")

        return score

    failed = ask(spark, corpus, "黄某怎么死的", make_scorer=failing)
    assert [r.doc for r in failed] == [r.doc for r in plain] and {r.degraded for r in failed} == {"scorer_failed"}


def test_queries_without_words_take_vectors_behind_the_gate(spark, corpus):
    near = spark.createDataFrame([(1, [1.0, 0.5])], "qid bigint, embedding array<double>")
    far = spark.createDataFrame([(1, [-1.0, -0.5])], "qid bigint, embedding array<double>")
    got = ask(spark, corpus, "zzz", query_vectors=near, limit=3)
    assert [r.doc for r in got] == [5, 6, 4] and {r.sources for r in got} == {"vector"}
    assert ask(spark, corpus, "zzz", query_vectors=far) == []
    # with words the vectors only rank: every row of the pool has its own cosine
    rows = ask(spark, corpus, "军", query_vectors=far)
    assert {r.doc for r in rows} == set(range(1, 10)) and all(r.cosine < 0 for r in rows)


def test_only_members_of_the_vector_candidates_name_that_route(spark, corpus):
    q = spark.createDataFrame([(1, "军")], "qid bigint, text string")
    v = spark.createDataFrame([(1, [1.0, 0.1])], "qid bigint, embedding array<double>")
    found = L.recall(corpus, q, v)
    rows = found.pool.withColumn("sources", L.source_list()).collect()
    best = {r.doc for r in found.best.collect()}
    assert all(("vector" in r.sources) == (r.doc in best) for r in rows)


def test_nothing_asked_and_nothing_there(spark, corpus):
    none = spark.createDataFrame([], "qid bigint, text string")
    assert L.search(corpus, none).count() == 0
    assert ask(spark, corpus, None) == [] == ask(spark, corpus, "")
    bare = L.prepare(spark.createDataFrame([], "doc bigint, chunk_id string, role string, text string"))
    assert ask(spark, bare, "军") == []


def test_the_cap_leaves_anchors_in(spark):
    chunks = spark.createDataFrame([(i, cid(i), "body", "军" * (1 + i % 7) + "火", "s") for i in range(1, 201)], "doc bigint, chunk_id string, role string, text string, source string")
    rows = [("E1", "火攻", [], [cid(1)], "L1"), ("E3", "身后", [], [cid(200), cid(150)], "L3")]
    events = G.valid_groups(spark.createDataFrame([(*r, None, T, T) for r in rows], GRP), ("L1", "L3"))
    corpus = L.prepare(chunks, events=events)
    q = spark.createDataFrame([(1, "军中火攻与身后"), (2, "军中火")], "qid bigint, text string")
    found = L.recall(corpus, q)
    matched = G.bridges(q, corpus.keys)
    pool = L.assembled(corpus, found, matched)
    size = {r.qid: r.n for r in pool.groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert 120 <= size[1] <= 122 and size[2] == 200  # the cap holds where a group matched; cut anchors come back
    assert [r.doc for r in L.search(corpus, q.where("qid = 1"), limit=2).orderBy("rank").collect()] == [150, 200]


def test_the_call_surface(spark, corpus):
    q = spark.createDataFrame([(1, "曹操"), (2, "zzz")], "qid bigint, text string")
    got = {r.qid: r.payload for r in api.search_json(q, corpus, limit=99).collect()}
    assert got[2] == "[]" and cid(10) in got[1]
    with pytest.raises(ValueError):
        api.search(q, corpus.chunks, source="elsewhere")
    only = corpus.chunks.withColumn("source", F.when(F.col("doc") == 3, "t").otherwise("s"))
    assert [r.doc for r in api.search(q.where("qid = 1"), only, source="t").collect()] == []
    assert {r.doc for r in api.search(q.where("qid = 1"), only, source="s").collect()} == {10}


def test_written_tables_go_with_their_scope(spark):
    import os

    from inkwell import runtime

    with runtime.scope():
        df = runtime.cut(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_query_embed(spark):
    import json

    q = spark.createDataFrame([(1, "孟德"), (2, " "), (3, "x" * 301), (4, None), (5, "坏")], "qid bigint, text string")
    entities = E.valid_entities(spark.createDataFrame([("P1", "person", "曹操", ["孟德"], ["孟德"], [], None, None)], ENT))

    def make():
        def encode(texts):
            if texts[0] == "坏":
                raise RuntimeError("no")
            return [[float(texts[0] == "曹操"), 2.0]]

        return encode

    got = {r.qid: json.loads(r.payload) for r in api.query_embed(q, make, entities, "v1").collect()}
    assert got[1] == {"dim": 2, "encoding": "base64-float32-le", "data": "AACAPwAAAEA=", "normVersion": "v1"}
    assert all(got[i] == {"isError": True} for i in (2, 3, 4, 5)) and {r.payload for r in api.query_embed(q, lambda: None).collect()} == {'{"isError":true}'}


def test_texts_of_tools(spark):
    chunks = spark.createDataFrame([(1, "s", 2, "题", "s:0002:p0001", 1, "a", "文"), (2, "s", 1, "前", "s:0001:p0001", 1, "b", "文")], "doc bigint, source string, chapter int, title string, parent_id string, seq_in_parent int, chunk_id string, text string")
    assert '"title":"题","prev":1,"chunks":[{"chunk_id":"a"' in api.chapter_json(chunks, 2).first().payload
    bank = spark.createDataFrame([(1, "问一", "答一"), (2, "问二", "答二")], "id bigint, question string, answer string")
    found = spark.createDataFrame([(7, 2, 1), (7, 1, 2)], "qid bigint, id bigint, rank int")
    assert api.bank_answers(found, bank).first().payload == "1. 问二 → 答二\n2. 问一 → 答一"
    rows = spark.createDataFrame([(1, 0, "E", "A", "S", "T", "H"), (1, 1, "F", "A", "S", "T", "H")], "id int, place int, event string, areaDesc string, severity string, status string, headline string")
    assert api.alerts_text(rows).first().payload.split("\n---\n")[1].startswith("event: F")
    rows = spark.createDataFrame([(1, 0, "Tonight", "0°F", "5 mph N", "Clear")], "id int, place int, name string, temperature string, wind string, forecast string")
    assert api.forecast_text(rows).first().payload == "Tonight:\ntemperature: 0°F\nwind: 5 mph N\nforecast: Clear"
