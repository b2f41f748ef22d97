import random
import unicodedata as ud

import pytest

from inkwell.llm import lookalike as L

SAME = [
    ("Ｐｌａｔｅ　Ａ", "Plate A"), ("Lǔ", "Lǔ"), ("か​゙", "が"), ("ガラス", "ガラス"), ("ｶﾞﾗｽ", "ガラス"), ("Sheеt", "Sheet"), ("о́", "ó"), ("ａ̄", "ā"),
    ("老", "老"), ("⼀", "一"), ("⻅", "见"), ("a b", "a b"), ("a\tb", "a b"), ("a\r\nb", "a\nb"), ("折﻿损", "折损"), ("co­py", "copy"), ("ハ", "八"), ("XA‑6", "XA-6"),
    ("ํา", "ำ"), ("क़", "क़"), ("（。！", "(｡!"), ("ệ", "ệ"), ("ヘ", "へ"), ("ｅ́", "é"),
]
DIFFERENT = [
    ("A", "a"), ("é", "e"), ("人", "入"), ("见", "見"), ("日", "目"), ("1", "l"), ("0", "O"), ("a b", "ab"), ("a  b", "a b"), ("3", "③"), ("己", "已"), ("、", "，"), ("“", "\""), ("…", "..."), ("m²", "m2"),
    ("ガ", "カ"), ("に", "こ"), ("क्‌ष", "क्ष"), ("a\nb", "a b"), ("が", "か"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert L.canonical(a) == L.canonical(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(a, b):
    assert L.canonical(a) != L.canonical(b)


def test_mapping_is_settled():
    m = L.build_mapping()
    assert not [k for k, v in m.items() if v in m]
    assert len(L.RADICALS) == 0x2EF4 - 0x2E80


def test_conflicts_are_refused(monkeypatch):
    monkeypatch.setattr(L, "HYPHENS", {"‐": "-", "ο": "0"})
    monkeypatch.setattr(L, "SEQUENCES", {"เเ": "แ", "Ａ": "B"})
    with pytest.raises(L.Conflict):
        L.build_mapping()


def test_idempotent_and_faithful_to_canonical_equivalence():
    rnd = random.Random(1)
    pool = [chr(o) for o in [*range(0x20, 0x250), *range(0x300, 0x345), *range(0x370, 0x460), *range(0x900, 0x980), *range(0xE00, 0xE5C), *range(0x3040, 0x3100), *range(0x4E00, 0x4E60), *range(0xF900, 0xF940), *range(0xFF00, 0xFFA0), 0x200B, 0x200D, 0xFEFF] if ud.category(chr(o)) != "Cn"]
    for _ in range(3000):
        t = "".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14)))
        c = L.canonical(t)
        assert L.canonical(c) == c, ascii(t)
    for _ in range(1500):
        t = "".join(rnd.choice("aeioucnéüǚ日が क़") for _ in range(8))
        assert L.canonical(ud.normalize("NFD", t)) == L.canonical(ud.normalize("NFC", t))


def test_one_pass_equals_the_transducer_cluster_by_cluster():
    t = L.transducer()
    text = "Ｌｕǒ‍，ガ㋐ ｶﾞ がเเ " * 30
    assert t.apply(text) == t.apply("Ｌｕǒ‍，ガ㋐ ｶﾞ がเเ ") * 30


def test_ideographs_beyond_the_basic_plane_need_no_mark_beside_them():
    m = L.build_mapping()
    far = [c for c in m if len(c) == 1 and c >= "\U00010000"]
    assert {chr(0x2F800), chr(0x2FA1D)} <= set(far)
    for c in far:
        assert L.canonical(f"天{c}地") == f"天{m[c]}地" == L.canonical(f"天{ud.normalize('NFC', c)}地"), ascii(c)
        assert L.canonical(f"天{c}地é") == f"天{m[c]}地é"


def test_null_and_empty():
    assert L.canonical(None) is None and L.canonical("") == ""


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, text string, look string, raw string, table_name string")
    from pyspark.sql import functions as F

    return {tuple(r) for r in L.lookalike_pairs(L.look_keys(df, "id", "text").withColumn("table_name", F.lit("t"))).collect()}


def test_pairs(spark):
    rows = [(5, "Ａ b", "x", "y", "z"), (2, "A b", "", "", ""), (3, "A b", "", "", ""), (4, "A b", "", "", ""), (9, "a b", "", "", ""), (6, None, "", "", ""), (7, "", "", "", ""), (8, None, "", "", "")]
    assert pairs(spark, rows) == {("t", 2, 3), ("t", 2, 4), ("t", 2, 5), ("t", 3, 5), ("t", 4, 5)}


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(3)
    forms = ["一​二", "一二", "⼀二", "一 二", "一　二", "二一"]
    rows = [(i, "一二" if rnd.random() < 0.3 else rnd.choice(forms) * rnd.randrange(1, 3), "", "", "") for i in range(120)]
    want = {("t", a, b) for a, x, *_ in rows for b, y, *_ in rows if a < b and x != y and L.canonical(x) == L.canonical(y)}
    assert pairs(spark, rows) == want


def test_empty_table_and_long_text(spark):
    assert pairs(spark, []) == set()
    long = "长文Ａ" * 200_000
    assert pairs(spark, [(1, long, "", "", ""), (2, long.replace("Ａ", "A"), "", "", "")]) == {("t", 1, 2)}


def test_canonical_texts(spark):
    df = spark.createDataFrame([(1, "Ａ", "c"), (2, None, "c"), (3, "", "c"), (1, "Ａ", "c")], "row_id bigint, text string, canonical string")
    assert sorted((r.row_id, r.canonical, r.changed) for r in L.canonical_texts(df, "row_id", "text").collect() if r.canonical is not None) == [(1, "A", True), (1, "A", True), (3, "", False)]


@pytest.mark.parametrize("pair", ["ѵv", "νv", "ԛq", "ɡg", "ᎪA", "һh", "ӏl", "օo", "ҮY", "ꓐB", "ՏS", "ոn", "ρp", "ԝw"])
def test_letters_that_render_alike_fold(pair):
    assert L.canonical(pair[0]) == L.canonical(pair[1]) == pair[1] and L.canonical(f"x{pair[0]}\u0301") == L.canonical(f"x{pair[1]}\u0301")


def test_selectors_and_fillers():
    assert L.canonical("龍\ufe0f中\u115f文\u1160") == "龍中文" and L.canonical("a\u3164b\uffa0c") == "a b c"


def test_classes_follow_from_the_pairs(spark):
    rows = [("t", i, f"look{i % 4}".encode(), f"raw{i % 4}{i % 3 if i % 4 else 0}".encode()) for i in range(60)] + [("u", 1, b"look1", b"raw10")]
    keys = spark.createDataFrame(rows, "table_name string, id bigint, look binary, raw binary")
    pairs = [tuple(r) for r in L.lookalike_pairs(keys).collect()]
    links = {}
    for t, a, b in pairs:
        for x in (a, b):
            links[t, x] = links.get((t, x), 0) + 1
    got = {(r.table_name, r.id): (r.class_id, r.links) for r in L.lookalike_classes(keys).collect()}
    assert {k: n for k, (_, n) in got.items()} == links and all(c == k[1] % 4 for k, (c, _) in got.items())
