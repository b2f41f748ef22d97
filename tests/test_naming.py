from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkwell.operators import entities as E
from inkwell.operators import groups as G

ENT = "entity_id string, entity_type string, canonical string, aliases array<string>, rewritekeys array<string>, fragmentonly array<string>, organguard string, note string"


def ent(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:8] if len(r) < 8 else r for r in rows], ENT)


def test_entity_rules(spark):
    rows = [
        ("P1", "person", "关羽", ["云长", "关公", "羽"], ["云长", "关公", "羽", "没有"], ["关公"]),
        ("P2", "person", "张飞", ["翼德", None, ""], ["翼德"], None),
        ("P2", "person", "重复", ["翼德乙"], ["翼德乙"], None),  # id taken
        (None, "person", "无号", ["丙丁"], ["丙丁"], None),  # no id
        ("L1", "place", "长坂坡", ["长坂", "长坂坡"], ["长坂", "长坂坡"], None),
        ("L2", "place", "博望坡", ["博望"], ["博望"], None),
        ("L3", "place", "奇门遁甲", ["遁甲"], ["遁甲"], None),
        ("L4", "place", "遁甲天书", ["天书"], ["天书"], None),
        ("L5", "place", "空", [], ["x"], None),
        ("L6", "place", "某一", ["同键"], ["同键"], None),
        ("L7", "place", "某二", ["同键"], ["同键"], None),
        ("L8", "place", None, ["a"], None, None),
        ("L9", "place", "守卫", ["汀上"], ["汀上"], None, '{"bad":[["汀上",6]]}', None),
    ]
    v = E.valid_entities(ent(spark, rows))
    assert {r.canonical for r in v.collect()} == {"关羽", "张飞", "长坂坡", "博望坡", "奇门遁甲", "遁甲天书", "某一", "某二", "守卫"}
    keys = {r.key: r.canonical for r in E.rewrite_keys(v).collect()}
    assert keys == {"云长": "关羽", "翼德": "张飞", "长坂": "长坂坡", "博望": "博望坡", "天书": "遁甲天书"}
    assert {(r.key, r.canonical) for r in E.fragment_keys(v).collect()} == {("关公", "关羽")}
    assert {r.key for r in E.key_multiplicity(v).collect()} == {"同键"}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_guarded_rewriting(spark, most):
    v = E.valid_entities(ent(spark, [("L1", "place", "长坂坡", ["长坂"], ["长坂"], None), ("L2", "place", "博望坡", ["博望"], ["博望"], None), ("P1", "person", "曹操", ["孟德", "曹公", "公"], ["孟德"], ["曹公"])]))
    texts = spark.createDataFrame([(1, "博望之战，长坂坡前，长坂桥"), (2, "孟德与曹公曹公"), (3, "无"), (4, None), (5, "")], "doc bigint, text string")
    got = {r.doc: r for r in E.scan_texts(texts, E.lexicon(v), most).collect()}
    assert got[1].normalized == "博望坡之战，长坂坡前，长坂坡桥"
    assert got[2].normalized == "曹操与曹公曹公"
    assert {(e["word"], e["times"]) for e in got[2].expansions} == {("孟德", 1), ("曹公", 2)}
    assert not {3, 4, 5} & {d for d in got if got[d].expansions}


def test_double_write_adds_each_token_of_the_form_once_per_key_use(spark):
    e = spark.createDataFrame([(1, "孟德", "曹操", 1), (1, "曹公", "曹操", 2)], "doc bigint, key string, canonical string, times int")
    assert {(r.term, r.tf) for r in E.double_write(e).collect()} == {("曹", 3), ("操", 3), ("曹操", 3)}


GRP = "eventid string, eventname string, aliases array<string>, chunkids array<string>, group_type string, examplequestion string, recorded_at timestamp_ntz, arrived_at timestamp_ntz"
T = datetime(2024, 1, 1)


def grp(spark, rows):
    return spark.createDataFrame([(*r, None, T, T) for r in rows], GRP)


def cks(spark, ids):
    return spark.createDataFrame([(i, c, "body" if not c.endswith("L") else "lead") for i, c in enumerate(ids)], "doc bigint, chunk_id string, role string")


def test_group_rules(spark):
    g = grp(spark, [("E1", "火烧", ["烧", "火烧连营", "火烧连营"], ["a"], "L1"), ("E1", "后来", ["x"], ["b"], "L1"), ("E2", None, ["二二"], ["a"], "L1"), ("E3", "三", ["火烧连营", "三三", None], ["a"], "L2"), ("E4", "四", None, None, "X"), (None, "五", [], [], "L1")])
    v = G.valid_groups(g, ("L1", "L2", "L3"))
    assert {(r.eventid, r.eventname) for r in v.collect()} <= {("E1", "火烧"), ("E1", "后来"), ("E3", "三")} and v.count() == 2
    al = {(r.eventid, r.alias) for r in G.valid_aliases(v.where("eventname <> '后来'")).collect()}
    assert ("E3", "三三") in al and ("E3", "火烧连营") not in al or ("E1", "火烧连营") not in al


@pytest.mark.parametrize(("missing", "total", "degraded"), [(1, 2, True), (1, 21, False), (0, 0, False)])
def test_drift(spark, missing, total, degraded):
    ids = [f"c{i}" for i in range(total)]
    g = grp(spark, [("E1", "名", [], ids, "L1")])
    r = G.drift(G.valid_groups(g, ("L1",)), cks(spark, ids[missing:])).first()
    assert (r.total_refs, r.missing_refs, r.degraded) == (total, missing, degraded)


def test_members_in_inner_order_without_leads(spark):
    g = grp(spark, [("E1", "名", [], ["s:0002:p0001:c01", "bad", "s:0001:p0009:c02", "s:0001:p0009:c01", "gone", None, "xL"], "L1")])
    m = G.members(G.valid_groups(g, ("L1",)), cks(spark, ["s:0001:p0009:c01", "s:0001:p0009:c02", "s:0002:p0001:c01", "bad", "xL"]))
    assert [r.chunk_id for r in m.orderBy("place").collect()] == ["s:0001:p0009:c01", "s:0001:p0009:c02", "s:0002:p0001:c01", "bad"]


def test_bridges_prefer_the_longest_key(spark):
    g = grp(spark, [("E1", "赤壁之战", ["赤壁"], [], "L1"), ("E2", "火攻", ["战前火攻"], [], "L2")])
    v = G.valid_groups(g, ("L1", "L2"))
    q = spark.createDataFrame([(1, "赤壁之战前火攻"), (2, "无")], "qid bigint, text string")
    keys = G.bridge_keys(v, G.valid_aliases(v)).withColumn("kind", F.lit("event"))
    got = [(r.eventid, r.matched, r.driver) for r in G.bridges(q, keys).orderBy("driver").collect()]
    assert got == [("E1", "赤壁之战", 1), ("E2", "战前火攻", 2)]


def test_events_drive_before_allusions_and_l3_never(spark):
    """The driving group is the first event of L1 or L2, however long the names of allusions and L3 events are."""
    rows = [("event", "E9", "短名", "L2", "短名"), ("event", "E3", "很长很长的名字", "L3", "很长很长的名字"), ("allusion", "A1", "较长的典故", "典故", "较长的典故"), ("event", "E1", "他名", "L1", "他名"), ("allusion", "E9", "同号", "典故", "同号")]
    keys = spark.createDataFrame(rows, "kind string, eventid string, eventname string, group_type string, key string")
    q = spark.createDataFrame([(1, "很长很长的名字、较长的典故、短名"), (2, "很长很长的名字与较长的典故"), (3, "只有很长很长的名字"), (4, "短名他名同号")], "qid bigint, text string")
    m = G.bridges(q, keys)
    got = {(r.qid, r.kind, r.eventid): (r.driver, r.poolable) for r in m.collect()}
    assert got == {
        (1, "event", "E9"): (1, True), (1, "allusion", "A1"): (2, True), (1, "event", "E3"): (None, False), (2, "allusion", "A1"): (1, True), (2, "event", "E3"): (None, False), (3, "event", "E3"): (None, False),
        (4, "event", "E1"): (1, True), (4, "event", "E9"): (2, True), (4, "allusion", "E9"): (3, True),
    }
    assert {r.qid: r.text for r in G.enhanced_queries(q, m).collect()} == {1: "很长很长的名字、较长的典故、短名短名短名", 2: "很长很长的名字与较长的典故较长的典故较长的典故", 4: "短名他名同号他名他名"}


def test_drift_is_acted_on(spark):
    ids = [f"c{i}" for i in range(21)]
    g = lambda *rows: G.valid_groups(grp(spark, list(rows)), ("L1",))
    left = lambda v, there: {r.eventid: r.chunkids for r in G.without_drift(v, cks(spark, there)).collect()}
    # one of two gone: the whole table is left out
    assert left(g(("E1", "名", [], ["c0"], "L1"), ("E2", "名二", [], ["gone"], "L1")), ["c0"]) == {}
    # one of 21 gone: the reference goes, and the group that had nothing else
    assert left(g(("E1", "名", [], ids[:20], "L1"), ("E2", "名二", [], ["gone"], "L1"), ("E3", "空", [], [], "L1"), ("E4", "无", [], None, "L1")), ids) == {"E1": ids[:20]}
    # members keep their order and repeats
    assert left(g(("E1", "名", [], ["c2", "c1", "c2", None], "L1")), ids) == {"E1": ["c2", "c1", "c2"]}


def test_merge(spark):
    rows = [
        ("P2", "person", "关羽", ["云长", "关公"], ["云长"], None),
        ("P1", "person", "关羽", ["关公", None, "美髯"], ["关公", "没有", "关羽"], ["美髯"]),
        ("P3", "person", "赵云", ["子龙", "同"], ["子龙", "同"], None),
        ("P4", "person", "马超", ["子龙", "孟起"], ["子龙", "孟起"], None),
        ("O1", "office", "太守", ["府君"], ["府君"], None),
        ("X", "person", None, ["a"], ["a"], None),
    ]
    banned = spark.createDataFrame([("关公",), ("关公",)], "key string")
    out = {r.canonical: r for r in E.merged(ent(spark, rows), banned, ("office",)).collect()}
    assert (out["关羽"].entity_id, out["关羽"].aliases, out["关羽"].keys, out["关羽"].fragments) == ("P1", ["云长", "关公", "美髯"], ["云长"], ["关公", "美髯"])
    assert out["赵云"].keys == [] and out["马超"].keys == ["孟起"]
    assert (out["太守"].keys, out["太守"].fragments) == ([], ["府君"])
    assert E.merge_problems(E.merged(ent(spark, rows), banned, ("office",))).count() == 0


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, t string")
    same = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "i int, t string").repartition(3)
    other = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    assert E.content_digest(a).first() == E.content_digest(same).first() != E.content_digest(other).first()
