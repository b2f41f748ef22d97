import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkwell.operators import bank as B
from inkwell.operators import evaluate as V
from inkwell.operators import quality as Q
from inkwell.operators.intents import BIRTH, intent_of, intent_pins, people_of_tags
from inkwell.operators.retrieval import pinned_order


def test_nearest_rank_with_a_hot_group_and_ties(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice("ab"), float(rnd.choice([1, 1, 2, 3, 1000]) * rnd.randrange(1, 30)) if rnd.random() < 0.95 else None) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    got = {r.k: r for r in Q.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, ["k"]).collect()}
    for k in ("hot", "a", "b", "one"):
        vs = sorted(v for g, v in rows if g == k and v is not None)
        for name, p in (("p0", 0), ("p50", 0.5), ("p95", 0.95), ("p100", 1)):
            assert got[k][name] == vs[max(math.ceil(p * len(vs)), 1) - 1], (k, name)
    assert "none" not in got


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, kind string, value double")


def random_events(n=800):
    rnd = random.Random(9)
    t = datetime(2024, 1, 1)
    return [(i, 1 if rnd.random() < 0.5 else rnd.randrange(6), t + timedelta(minutes=rnd.randrange(3000), seconds=rnd.choice([0, 0, 30])), rnd.choice(["open", "see", "see", "buy"]), float(i)) for i in range(n)]


def test_sessions_equal_the_sequential_rule(spark):
    rows = random_events()
    got = {r.event_id: r.opened_at for r in Q.sessions_with_ttl(events(spark, rows), "user_id", "ts", "event_id", F.col("kind") == "open").where("active").collect()}
    want, state = {}, {}
    for i, u, ts, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "open":
            state[u] = ts
        if u in state and ts - state[u] <= timedelta(minutes=30):
            want[i] = state[u]
    assert got == want


def test_session_end_is_included_and_not_extended(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t, "open", 0.0), (2, 1, t + timedelta(minutes=20), "see", 0.0), (3, 1, t + timedelta(minutes=30), "see", 0.0), (4, 1, t + timedelta(minutes=30, microseconds=1), "see", 0.0)]
    got = {r.event_id for r in Q.sessions_with_ttl(events(spark, rows), "user_id", "ts", "event_id", F.col("kind") == "open").where("active").collect()}
    assert got == {1, 2, 3}


def test_fill_forward_equals_the_sequential_rule(spark):
    rows = random_events()
    got = {r.event_id: r.last for r in Q.fill_forward(events(spark, rows), "user_id", "ts", "event_id", F.when(F.col("kind") == "buy", F.col("value")), "last").collect()}
    state, want = {}, {}
    for i, u, _, kind, v in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "buy":
            state[u] = v
        want[i] = state.get(u)
    assert got == want


def test_first_wins(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id bigint, t string")
    assert {(r.kept_id, r.copies) for r in Q.first_wins(df, F.col("t"), "id").collect()} == {(1, 2), (2, 1)}


def test_anchors(spark):
    e = "第75回目：“甲乙丙”；第3回：“长句一二三四，短句（注）……后半句子五六七”"
    r = spark.createDataFrame([(e,)], "t string").select(V.text_anchors("t").alias("a"), V.title_anchors("t").alias("h"), V.chapter_refs("t").alias("c")).first()
    assert r.c == [75, 3] and r.h == ["75|甲乙丙"]
    assert set(r.a) == {"甲乙丙", "长句一二三四短句", "长句一二三四", "后半句子五六七"}


def test_anchors_of_all_documents(spark, tmp_path):
    from inkwell.plans.measures import QUERIES

    rows = [(0, "“甲乙丙”"), (1, "“丁戊，己庚辛壬”"), (99, "没有"), (100, None), (101, "“甲乙丙”说“甲乙丙”"), (250, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunk_rows(spark, tmp_path, ["一二三四五六七八九十甲乙丙丁"])
    got = sorted(tuple(r) for r in QUERIES["anchor_extract"](spark, str(tmp_path)).collect())
    assert got == sorted([(0, "甲乙丙"), (1, "丁戊己庚辛壬"), (1, "己庚辛壬"), (101, "甲乙丙"), (-7, "一二三四五六七八九十甲乙")])


def chunk_rows(spark, tmp_path, texts):
    rows = [(7 + i, "c", None, None, "sanguo-yanyi", 1, None, "prose", "body", t, None) for i, t in enumerate(texts)]
    names = "row_id bigint, chunk_id string, parent_id string, seq_in_parent int, source string, chapter int, title string, chunk_type string, chunk_role string, text string, group_id string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/sanguo_yanyi.parquet")


ENTRIES = [(1, 1, 29, "某回", "众人说毒已入骨"), (1, 2, 75, "关云长刮骨疗毒，吕子明白衣渡江", "毒，已入骨！"), (1, 3, 75, None, None), (2, 1, 84, "陆逊营烧七百里，孔明巧布八阵图", "无关"), (2, 2, 84, "陆逊营烧七百里，孔明巧布八阵图", "有锚文字在此")]


@pytest.mark.parametrize(
    ("qid", "evidence", "rank", "tier"),
    [
        (1, "第75回：“毒已入骨”", 2, "text"),  # the chapter it refers to, though another holds the words before
        (1, "“毒已入骨”", 1, "text"),
        (1, "第75回目：“关云长刮骨疗毒”", 2, "title"),
        (1, "“吕子明白衣渡江”", 2, "title"),  # no title anchor: a phrase may stand in a title
        (1, "“毒已”“白衣”", 1, "text"),
        (1, "第30回：“毒已入骨”", 0, None),
        (2, "第84回目：“陆逊营烧七百里，孔明巧布八阵图”第84回：“有锚文字”", 2, "text"),  # a text goes before a title that ranks higher
        (2, "第85回目：“陆逊营烧七百里”", 0, None),
        (2, "", 0, None), (2, None, 0, None),
    ],
)
def test_evidence_tiers(spark, qid, evidence, rank, tier):
    items = V.evidence_items(spark.createDataFrame([(qid, evidence)], "qid bigint, evidence string"))
    entries = spark.createDataFrame(ENTRIES, "qid bigint, rank int, chapter int, title string, text string")
    (r,) = V.match_evidence(items, entries).collect()
    assert (r["rank"], r.tier) == (rank, tier)


def test_locatable_and_anchor_counters(spark):
    chunks = spark.createDataFrame([(1, 75, "关云长刮骨疗毒", "毒，已入骨"), (2, 84, None, None)], "doc bigint, chapter int, title string, text string")
    ev = [(1, "“毒已入骨”"), (2, "第75回目：“刮骨疗毒”"), (3, "第84回目：“刮骨疗毒”"), (4, "“云长刮骨”"), (5, "没有引文"), (6, None), (7, "“不在书中”")]
    items = V.evidence_items(spark.createDataFrame(ev, "qid bigint, evidence string"))
    # the third names a chapter with another title, but its words stand as a quoted phrase in a title
    assert {r.qid for r in V.locatable(items, chunks).collect()} == {1, 2, 3, 4}
    results = spark.createDataFrame([(1, "甲", 1, 1, False), (2, "甲", 7, 6, False), (3, "乙", 0, 2, False), (4, "乙", 12, 0, False), (5, "乙", 0, 0, True)], "qid bigint, category string, rank int, chapter_rank int, no_anchor boolean")
    got = {r.category: tuple(r)[1:] for r in V.anchor_counters(results).collect()}
    assert got == {None: (4, 1, 1, 1, 2, 3, 2, 1), "甲": (2, 1, 1, 1, 0, 2, 1, 0), "乙": (2, 0, 0, 0, 2, 1, 1, 1)}


def test_group_counters(spark):
    results = spark.createDataFrame([(1, "甲", 9, 1, 1, 1, True, False), (2, "甲", 1, 0, 0, 0, False, True), (3, "乙", 20, 0, 0, 0, False, False)], "qid bigint, category string, seg_count bigint, first_rank int, hits5 bigint, hits10 bigint, event_bridge boolean, allusion_bridge boolean")
    got = {(r.category, r.bucket): (r.total, r.event_bridge, r.allusion_bridge, r.no_bridge, r.dropped, r.miss_no_bridge) for r in V.group_counters(results).collect()}
    assert got[None, None] == (3, 1, 1, 1, 1, 1) and got["甲", None] == (2, 1, 1, 0, 1, 0) and got[None, "large"] == (1, 0, 0, 1, 0, 1)


def test_rerank_failures(spark):
    mk = lambda rows: spark.createDataFrame(rows, "qid bigint, doc bigint, rank int")
    before, after = mk([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)]), mk([(1, 11, 1), (1, 10, 3), (1, 13, 2), (2, 20, 1)])
    evidence = spark.createDataFrame([(1, 10), (1, 12), (2, 20)], "qid bigint, doc bigint")
    got = {tuple(r) for r in V.rerank_failures(before, after, evidence).collect()}
    assert got == {(1, "evidence_demoted", 10), (1, "wrong_top1", 11), (1, "evidence_dropped", 12), (1, "non_evidence_promoted", 13)}


def test_first_anchor(spark):
    items = spark.createDataFrame([("i", "毒已入骨"), ("j", "没有")], "item string, anchor string")
    entries = spark.createDataFrame([(2, "其毒已入骨矣"), (5, "毒已入骨")], "rank int, form string")
    assert [(r.item, r["rank"]) for r in V.first_anchor(items, entries).collect()] == [("i", 2)]


def test_coverage_and_grouping_sets(spark):
    items = spark.createDataFrame([(1, "甲", 9), (2, "甲", 1), (3, "乙", 20)], "qid bigint, category string, seg_count bigint")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 7), (2, 20, 6), (3, 30, 11)], "qid bigint, doc bigint, rank int")
    rel = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 31)], "qid bigint, doc bigint")
    res = V.hit_results(ranked, rel, items)
    assert {(r.qid, r.status, r.hits5, r.hits10) for r in res.collect()} == {(1, "hit5", 1, 2), (2, "hit10", 0, 1), (3, "miss", 0, 0)}
    s = {(r.category, r.bucket): r for r in V.summarize(res).collect()}
    assert (s[None, None].total, s[None, None].hit10, s[None, None].cover5) == (3, 2, pytest.approx(1 / 11, abs=1e-6))
    assert s["甲", None].hit10_rate == 1.0 and s[None, "single"].hit5 == 0 and len(s) == 6


def test_compare_runs(spark):
    mk = lambda rows: spark.createDataFrame(rows, "qid bigint, status string, first_rank int")
    got = {(r.qid, r.change) for r in V.compare_runs(mk([(1, "hit5", 2), (2, "miss", 0), (3, "hit10", 7), (4, "hit5", 1)]), mk([(1, "hit10", 8), (2, "hit50", 20), (3, "hit10", 9)])).collect()}
    assert got == {(1, "improved"), (2, "regressed")}


QUESTIONS = [
    ("他是被谁杀死的", "death_agent"), ("死在谁手里", "death_agent"), ("死在哪里", "death_place"), ("丧命何处", "death_place"), ("他何时战死", "death_time"), ("死时几岁", "death_age"), ("享年多少", "death_age"),
    ("他死了吗？", "death_confirm"), ("怎么死的", "death_manner"), ("关羽之死", "death_manner"), ("临终说了什么", "death_last_words"), ("死后谁继任", "death_aftermath"), ("他的结局", "death_aftermath"), ("他吃了什么", None), (None, None),
]


@pytest.mark.parametrize(("text", "kind"), QUESTIONS)
def test_intents(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(intent_of("t")).first()[0] == kind


def test_birth(spark):
    assert spark.createDataFrame([("刘备第一次出场",)], "t string").select(F.col("t").rlike(BIRTH)).first()[0]


def bank(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string")


def test_dice_and_route(spark):
    b = bank(spark, [(1, "诸葛亮的字是什么？"), (2, "刘备的字是什么"), (3, "！"), (4, None), (5, "完全不同")])
    q = bank(spark, [(9, "诸葛亮字什么"), (8, "？"), (7, "刘备的字是什么")])
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in B.dice_top(q, b).collect()}
    assert got[9, 1][0] == 1 and got[7, 1] == (2, 1.0) and not any(k[0] == 8 for k in got)
    known = {r.qid: r.known for r in B.route(q, b).collect()}
    assert known == {9: True, 8: False, 7: True}


def test_route_known_meets_every_other_row(spark, tmp_path):
    from inkwell.plans.measures import QUERIES

    rows = [(100, "诸葛亮的字是什么？"), (200, "诸葛亮的字是什么"), (300, "刘备生于何年何月"), (301, "完全不同的一句话"), (400, "赤壁之战谁放的火"), (7, "赤壁之战谁放的火"), (500, None)]
    spark.createDataFrame(rows, "question_id bigint, question string").write.parquet(f"{tmp_path}/event_question_pool.parquet")
    got = {r.qid: (r.known, r.vector_similarity) for r in QUERIES["route_known"](spark, str(tmp_path)).collect()}
    assert {k for k, (known, _) in got.items() if known} == {100, 200, 400} and set(got) == {100, 200, 300, 400}
    assert got[100][1] == got[200][1] == got[400][1] == 1.0 and got[300][1] < 0.9


def test_edit_neighbours_equal_brute_force(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(8, 26))) for _ in range(40)]
    rows = [(i, w) for i, w in enumerate(words)] + [(100 + i, w[:3] + "x" + w[4:]) for i, w in enumerate(words)]

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    df = bank(spark, rows)
    got = {(r.qid, r.id) for r in B.close_in_edits(df, df).collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if 1 - lev(a, b) / max(len(a), len(b)) >= 0.9}


def test_numeral_runs_are_whole(spark, tmp_path):
    from inkwell.plans.measures import QUERIES

    chunk_rows(spark, tmp_path, ["三人行，一百二十三里；一百〇五", "三、十", "一二三四五六七，一百二十三四五六", None, "〇"])
    got = {tuple(r) for r in QUERIES["cn_numerals"](spark, str(tmp_path)).collect()}
    assert got == {("三", 2, 3), ("一百二十三", 1, 123), ("一百〇五", 1, 105), ("十", 1, 10), ("〇", 1, 0)}


def test_people_of_tags(spark):
    tags = [(1, "人物之死-关羽之死"), (2, "人物之生-刘备登场"), (3, "登场-张飞"), (4, "遗言-周瑜"), (5, "关羽临终遗言"), (6, "战役-关羽"), (7, "登场-"), (8, None)]
    got = {tuple(r) for r in people_of_tags(spark.createDataFrame(tags, "doc bigint, tag string")).collect()}
    assert got == {("death", "关羽", 1), ("birth", "刘备", 2), ("birth", "张飞", 3), ("speech", "周瑜", 4), ("speech", "关羽", 5)}


def test_judging(spark):
    options = {"A": "赤壁", "B": "官渡", "C": "夷陵", "D": "ＡＢＣ"}
    rows = [("Ａ", "A", False), ("b", "B", True), (" 官渡！", "B", True), ("abc", "D", False), ("e", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, m, options, " 官渡 ") for i, (m, _, _) in enumerate(rows)], "i int, message string, options map<string,string>, answer string")
    assert {r.i: (r.chosen, r.correct) for r in B.judged(df).collect()} == {i: (k, c) for i, (_, k, c) in enumerate(rows)}


def test_quiz_replies(spark):
    from inkwell.operators.quiz import numbered, replies

    t = datetime(2024, 1, 1)
    bank = spark.createDataFrame([(5, "哪一战？", {"A": "赤壁", "B": "官渡", "C": "夷陵", "D": "街亭"}, "官渡")], "id bigint, question string, options map<string,string>, answer string")
    said = [(1, "s", 0, "B"), (2, "s", 1, "随机一题"), (3, "s", 2, "答案"), (4, "s", 3, "Ｂ"), (5, "s", 4, "赤壁"), (6, "s", 5, None), (7, "s", 40, "B"), (8, "z", 3, "B"), (9, "s", 41, "来一题！"), (10, "s", 71, "官渡")]
    log = spark.createDataFrame([(i, k, t + timedelta(minutes=m), x) for i, k, m, x in said], "event_id bigint, session_key string, ts timestamp_ntz, message string")
    got = {r.event_id: (r.kind, r.reply) for r in replies(log, bank).collect()}
    assert [got[i][0] for i in range(1, 11)] == ["no_session", "question", "answer", "correct", "wrong", "wrong", "no_session", "no_session", "question", "correct"]
    assert got[3][1] == "正确答案：官渡（B）" and got[5][1] == "答错了，正确答案：官渡（B）" and got[2][1].startswith("题目：哪一战？\nA. 赤壁")
    assert {r.kind for r in replies(log, bank.limit(0)).collect()} == {"empty_bank", "no_session"}
    assert sorted(r.place for r in numbered(spark.range(500).select("id")).collect()) == list(range(500))


PEOPLE = [("death", "关羽", 10), ("death", "关羽", 12), ("speech", "关羽", 11), ("death", "张飞", 20), ("birth", "刘备", 30)]


@pytest.mark.parametrize(
    ("text", "pins", "direction"),
    [
        ("关羽怎么死的", {10, 12}, 1), ("关羽死后怎样", {10, 12}, -1), ("关羽临终遗言", {11}, 0), ("张飞临终遗言", {20}, 0), ("关羽死时几岁", {10, 11, 12}, 1),
        ("刘备第一次出场", {30}, 1), ("关羽吃饭", set(), None), ("曹操怎么死的", set(), None), ("云长怎么死的", {10, 12}, 1),
    ],
)
def test_intent_pins(spark, text, pins, direction):
    q = spark.createDataFrame([(1, text)], "qid bigint, text string")
    people = spark.createDataFrame(PEOPLE, "kind string, person string, doc bigint")
    expanded = spark.createDataFrame([(1, "关羽")] if "云长" in text else [], "qid bigint, person string")
    rows = intent_pins(q, people, expanded).collect()
    assert {r.doc for r in rows} == pins and {r.direction for r in rows} <= {direction}


def test_pins_in_the_direction_of_the_intent(spark):
    pool = spark.createDataFrame([(1, 5, 0.9), (1, 7, 0.1), (1, 3, 0.2), (2, 3, 0.1), (2, 7, 0.5), (2, 5, 0.9)], "qid bigint, doc bigint, score double")
    pins = spark.createDataFrame([(1, 7, -1), (1, 3, -1), (1, 99, -1), (2, 3, 0), (2, 7, 0)], "qid bigint, doc bigint, direction int")
    got = [(r.qid, r.doc) for r in pinned_order(pool, pins).orderBy("qid", "rank").collect()]
    assert got == [(1, 7), (1, 3), (1, 5), (2, 7), (2, 3), (2, 5)]
    assert [(r.qid, r.doc) for r in pinned_order(pool, pins, keep=2).orderBy("qid", "rank").collect()] == [(1, 7), (1, 3), (2, 7), (2, 3)]


def test_chapter_rank(spark):
    items = spark.createDataFrame([(1, [3, 4]), (2, [9]), (3, [])], "qid bigint, chapters array<int>")
    ranked = spark.createDataFrame([(1, 7, 1), (1, 4, 2), (1, 3, 3), (2, 1, 1)], "qid bigint, chapter int, rank int")
    assert {(r.qid, r.chapter_rank) for r in V.chapter_rank(items, ranked).collect()} == {(1, 2), (2, 0), (3, 0)}


def test_sets_of_runs(spark):
    runs = spark.createDataFrame([("group-x-2024",), ("group-2024",), ("other",)], "run_id string")
    reg = spark.createDataFrame([("g", "group-"), ("gx", "group-x-")], "set_id string, prefix string")
    assert {tuple(r) for r in V.sets_of_runs(runs, reg, "d").collect()} == {("group-x-2024", "gx"), ("group-2024", "g"), ("other", "d")}


def test_runs_are_single_flight_and_can_be_stopped(spark):
    import time

    from inkwell.api import Runs

    runs = Runs(spark)
    assert runs.state == "idle" and not runs.abort()
    slow = lambda: spark.range(0, 10**12, numPartitions=8).selectExpr("max(hash(id, id))").collect()
    assert runs.start("r1", slow) and not runs.start("r2", slow)
    time.sleep(1.5)
    assert runs.abort() and runs.wait(60) == "aborted"
    assert runs.start("r3", lambda: spark.range(5).count()) and runs.wait(60) == "done"
    assert runs.start("r4", lambda: 1 / 0) and runs.wait(60) == "failed" and "zero" in runs.error
