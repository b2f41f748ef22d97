import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as X


def one(spark, expr, *values, schema="t string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_tokens_are_characters_then_pairs(spark):
    assert one(spark, X.tokens("t"), "曹 操　兵", "a𠮷b", "", None, "一") == [["曹", "操", "兵", "曹操", "操兵"], ["a", "𠮷", "b", "a𠮷", "𠮷b"], [], [], ["一"]]


def test_token_count_equals_tokens(spark):
    values = ["曹 操", "", None, "a", "a﻿b c", "𠮷𠂉x"]
    assert one(spark, X.token_count("t"), *values) == [len(x) for x in one(spark, X.tokens("t"), *values)]


def test_bigram_set(spark):
    assert one(spark, X.bigram_set("t"), "abab", "a", "", None) == [["ab", "ba"], ["a"], [], []]


def test_bank_form(spark):
    assert one(spark, X.bank_form("t"), "Ａ．ＢＣ！", "《谁》是　Ａ？") == ["abc", "谁是a"]


def test_fnv(spark):
    def brute(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    words = ["曹操", "a", "", "größe", "𠮷"]
    assert one(spark, X.fnv1a32("t"), *words) == [brute(w) for w in words]
    assert brute("曹操") == 4294390097


@pytest.mark.parametrize(("text", "value"), [("一百二十", 120), ("十", 10), ("二十三", 23), ("一百零五", 105), ("百", 0), ("九", 9), ("两百", 200), ("千", None)])
def test_chinese_numerals(spark, text, value):
    assert one(spark, X.cn2int("t"), text) == [value]


def test_lexical_similarity(spark):
    got = one(spark, X.lexical_similarity(X.route_signature(X.bank_form("a")), X.route_signature(X.bank_form("b"))), ("谁的马", "谁马"), ("abc", "abd"), ("", "x"), ("的", "了"), schema="a string, b string")
    assert got == [1.0, pytest.approx(2 / 3), 0.0, 0.0]


def test_cosine(spark):
    got = one(spark, X.cosine("a", "b"), ([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), schema="a array<float>, b array<float>")
    assert got == [pytest.approx(2**-0.5), 0.0]


def test_tags(spark):
    assert one(spark, X.tag_list("t"), "a-b| |c ||", None, "") == [["a-b", "c"], [], []]
    tags = ["人物之生-刘备登场", "人物之死-关羽之死", "武将单挑-张-马", "战役-赤壁", "其他"]
    assert one(spark, X.strip_tag_type("t"), *tags) == ["刘备", "关羽", "张-马", "赤壁", "其他"]


def test_inner_order(spark):
    o = X.inner_order("t")
    got = one(spark, F.struct(o["chapter_no"], o["segment_no"], o["sequence_no"]), "s:0073:p0001:c02", "bad")
    assert [tuple(g) for g in got] == [(73, 1, 2), (2147483647,) * 3]


def test_quote_depth(spark):
    got = one(spark, X.quote_depth("t"), "“a‘b’”", "”a", "“")
    assert [tuple(g) for g in got] == [(0, 0), (-1, -1), (0, 1)]


def test_fixed_rounds_halves_up(spark):
    assert one(spark, X.fixed(F.col("t").cast("double"), 2), "0.125", "-0.125", "1.0") == [0.13, -0.12, 1.0]


def test_size_bucket(spark):
    assert one(spark, X.size_bucket("t"), 1, 2, 10, 11, schema="t int") == ["single", "several", "several", "large"]


def test_substring_join_equals_brute_force(spark):
    from inkwell.operators.matching import substring_join

    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc𠮷") for _ in range(rnd.randrange(0, 12))) for _ in range(60)] + [None]
    keys = ["".join(rnd.choice("abc𠮷") for _ in range(rnd.randrange(0, 4))) for _ in range(25)] + [None]
    left = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    right = spark.createDataFrame(list(enumerate(keys)), "j int, k string")
    got = sorted((r.i, r.j) for r in substring_join(left, "t", right, "k").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, k in enumerate(keys) if t and k and k in t)
