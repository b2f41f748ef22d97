import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import corpus as C


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc bigint, text string")


def test_lines_and_chapters(spark):
    t = "正文 第一回 初见\n　　甲。\n更新时间 2020\n\n乙。\n第二十回　再见\n丙。"
    lines = C.body_lines(texts(spark, t, None, ""))
    got = [(r.chapter, r.title, r.line_no, r.line) for r in C.chapters(lines).orderBy("chapter", "line_no").collect()]
    assert [(g[0], g[2], g[3]) for g in got] == [(1, 1, "甲。"), (1, 2, "乙。"), (20, 1, "丙。")]
    assert got[0][1] == "初见"


def test_lead_and_verse(spark):
    t = "有诗赞曰：\n一二三四，五六七八，一二三四，五六七八。\n一二三，四五六，七八，九十。\n后来无事，各自归家去了。\n“诗”者：\n散文。"
    rows = C.line_kinds(C.body_lines(texts(spark, t))).orderBy("line_no").collect()
    assert [r.verse for r in rows] == [True, True, True, False, False, False]
    assert [r.role for r in rows] == ["lead", "body", "body", "body", "lead", "body"]


def brute_cascade(base, follow):
    out = []
    for b, f in zip(base, follow):
        out.append(b or (f and bool(out) and out[-1]))
    return out


def test_cascade_equals_the_sequential_rule(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.random() < 0.15, rnd.random() < 0.6) for k in range(20) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, b boolean, f boolean")
    got = {(r.k, r.i): r.verse for r in C.cascade(df, "k", "i", F.col("b"), F.col("f")).collect()}
    for k in range(20):
        own = [r for r in rows if r[0] == k]
        assert [got[k, i] for i in range(40)] == brute_cascade([r[2] for r in own], [r[3] for r in own])


def test_packing_keeps_the_text_and_the_limits():
    rnd = random.Random(5)
    for _ in range(200):
        parts = []
        for _ in range(rnd.randrange(1, 60)):
            s = "字" * rnd.randrange(1, 60) + rnd.choice("。！？；，")
            parts.append(f"“{s}”" if rnd.random() < 0.2 else s)
        t = "".join(parts)
        blocks = C.pack_blocks(t)
        assert "".join(blocks) == t and all(blocks)
        _, legal = C.sentence_cuts(t)
        at = 0
        for b in blocks[:-1]:
            at += len(b)
            assert at in legal
        for b in blocks:  # over the cap only where no legal cut could have helped
            if len(b) > C.CAP:
                assert len(C.sentence_cuts(b)[1]) <= 2


def test_packing_edges():
    assert C.pack_blocks("短") == ["短"] and C.pack_blocks("") == [""]
    assert C.pack_blocks("字" * 700) == ["字" * 700]
    quoted = "“" + "字" * 400 + "。" + "字" * 400 + "。”"
    assert C.pack_blocks(quoted) == [quoted]
    t = "字" * 349 + "。" + "字" * 299 + "。" + "尾" * 10 + "。"
    assert [len(b) for b in C.pack_blocks(t)] == [350, 311]


def test_packed_frame(spark):
    rows = C.packed(texts(spark, "字" * 400 + "。" + "字" * 400 + "。", None, "")).collect()
    assert [(r.doc, r.seq, r.char_count) for r in rows] == [(0, 1, 401), (0, 2, 401), (2, 1, 0)]


def test_ranges_and_neighbours(spark):
    rows = spark.createDataFrame([(1, 1), (1, 5), (2, 3)], "chapter int, segment_no int")
    ranges = spark.createDataFrame([("g", 1, 4, 6), ("e", 1, 9, 3)], "group_id string, chapter int, seg_start int, seg_end int")
    assert [(r.segment_no, r.group_id) for r in C.in_ranges(rows, ranges).collect()] == [(5, "g")]
    present = spark.createDataFrame([("s", 1), ("s", 2), ("s", 119)], "source string, chapter int")
    assert {(r.chapter, r.prev, r.next) for r in C.adjacent_chapters(present).collect()} == {(1, None, 2), (2, 1, None), (119, None, None)}


def test_every_chunk_has_its_context_group(spark, tmp_path):
    from inkwell.plans.measures import QUERIES

    ids = [(1, f"s:0001:p{i:04d}:c01") for i in range(1, 1201)] + [(2, "s:0002:p0012:c01"), (2, "s:0002:p0012:c02"), (3, "s:0003:p0000:c01"), (3, "bad"), (3, None), (None, "s:0004:p0001:c01")]
    rows = [(i, c, None, None, "s", ch, None, "prose", "body", "x", None) for i, (ch, c) in enumerate(ids)]
    names = "row_id bigint, chunk_id string, parent_id string, seq_in_parent int, source string, chapter int, title string, chunk_type string, chunk_role string, text string, group_id string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/sanguo_yanyi.parquet")
    got = sorted((r.doc, r.group_id) for r in QUERIES["interval_group_join"](spark, str(tmp_path)).collect())
    want = [(i, f"g0001-{i // 10 * 10 + 1:03d}") for i in range(1200)] + [(1200, "g0002-011"), (1201, "g0002-011")] + [(i, None) for i in range(1202, 1206)]
    assert got == want


def test_ids(spark):
    df = spark.createDataFrame([(7, 12, 3)], "chapter int, segment_no int, seq int")
    r = C.chunk_ids("s", df).first()
    assert (r.parent_id, r.chunk_id) == ("s:0007:p0012", "s:0007:p0012:c03")


@pytest.mark.parametrize(("line", "lead"), [("诗曰：", True), ("他说。诗曰：", False), ("一二三四五六七八九十一二三：", False)])
def test_lead(spark, line, lead):
    assert spark.createDataFrame([(line,)], "t string").select(C.is_lead("t")).first()[0] is lead


@pytest.mark.parametrize(
    ("line", "announces"),
    [
        ("有诗云：", True), ("“昔日有诗云：", False), ("昔日“闲话”有诗云：", True), ("“他说‘有诗’”罢了：", False), ("”有诗云：", True), ("“甲‘乙”有诗：", False), ("“甲’有诗：", True), ("祭“丁”文：", False), ("祭”文：", False), ("无：", False),
    ],
)
def test_only_words_outside_quotations_announce_verse(spark, line, announces):
    df = spark.createDataFrame([(line,)], "t string")
    assert df.select(C.announces_verse("t")).first()[0] == announces
