import random

import numpy as np
import pytest

from inkwell.llm import pieces as P
from inkwell.llm.sentences import Periods, unit_ends

ROW = "row_id bigint, parent_id string, seq_in_parent int, text string, char_count int, piece_no int"


def split(spark, rows, **kw):
    return P.split_oversized(spark.createDataFrame(rows, ROW), Periods(), **kw).orderBy("row_id", "piece_no").collect()


def check(text, out, limit, overlap):
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(out, out[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b, _ in out)


def random_text(rnd):
    return "".join(rnd.choice(["字" * rnd.randrange(1, 90) + rnd.choice("。，！ "), "word " * rnd.randrange(1, 20), "一" * rnd.randrange(1, 900)]) for _ in range(rnd.randrange(1, 14)))


@pytest.mark.parametrize("overlap", [0, 1, 60, 200])
def test_pieces_cover_the_text_within_the_limit(overlap):
    rnd = random.Random(overlap)
    for _ in range(150):
        t = random_text(rnd)
        b, _ = P.text_boundaries(t, Periods())
        check(t, P.cut_points(t, b, limit=600, overlap=overlap), 600, overlap)


def test_cuts_stand_at_the_last_sentence_end_that_fits():
    rnd = random.Random(7)
    for _ in range(100):
        t = random_text(rnd)
        ends = unit_ends(t)
        reached = 0
        for a, b, kind in P.cut_points(t, P.text_boundaries(t, Periods())[0], limit=600, overlap=60):
            fit = [e for e in ends if reached < e <= a + 600]
            if kind != "end":
                assert (kind == "sentence") == bool(fit) and (not fit or b == max(fit))
            reached = b


def test_sizes_other_than_one():
    t = "a。" * 50
    b, _ = P.text_boundaries(t, Periods())
    out = P.cut_points(t, b, sizes=np.full(len(t), 3), limit=30, overlap=6)
    assert all((y - x) * 3 <= 30 for x, y, _ in out) and out[-1][1] == len(t)


def test_marks_stay_with_their_letter():
    t = "é" * 500
    for _, b, _ in P.cut_points(t, [np.empty(0, np.int64)] * 3, limit=601 - 2, overlap=0)[:-1]:
        assert b % 2 == 0


def test_rows(spark):
    long = "字" * 599 + "。" + "字" * 300 + "。"
    rows = [(1, "p", 1, long, 5, 0), (2, "p", 2, "字" * 600, 9999, 0), (3, None, None, "字" * 601, None, 0), (4, "p", 3, None, 1, 0), (5, "p", 4, "", 0, 0), (1, "p", 1, long, 5, 0)]
    out = split(spark, rows, overlap=50)
    assert [(r.row_id, r.piece_no, r.cut_kind, r.unit_over) for r in out] == [(1, 1, "sentence", False)] * 2 + [(1, 2, "end", False)] * 2 + [(3, 1, "hard", True), (3, 2, "end", True)]
    assert out[0].text == long[:600] and (out[4].parent_id, out[4].seq_in_parent) == (None, None) and out[0].piece_count == 2
    kinds = {(r.row_id, r.kind) for r in P.oversized_kinds(P.split_oversized(spark.createDataFrame(rows, ROW), Periods())).collect()}
    assert kinds == {(1, "between"), (3, "inside")}


def test_a_unit_of_exactly_the_limit_is_not_over(spark):
    out = split(spark, [(1, "p", 1, "字" * 599 + "。 尾", 0, 0), (2, "p", 1, " " * 50 + "字" * 600, 0, 0)])
    assert {(r.row_id, r.unit_over) for r in out} == {(1, False), (2, False)}


def test_empty_and_bad_overlap(spark):
    assert split(spark, []) == []
    with pytest.raises(ValueError):
        split(spark, [], overlap=300)


def test_very_long_text(spark):
    out = split(spark, [(1, "p", 1, "很长的一句话，没有尽头。" * 30_000, 0, 0)], with_text=False)
    assert out[-1].end_pos == 360_000 and max(r.end_pos - r.start_pos for r in out) <= 600


def test_token_sizes_and_pieces(spark):
    from inkwell.llm import tokens as K

    path = K.tokenizer_path()
    encoder = K.Encoder(K.read_ranks(path))
    for t in ("Sun Quan's 孙权，走！\U0001f409\U0002070e x", "", "a", "鑫" * 5):
        sizes = P.token_sizes(t, encoder)
        assert len(sizes) == len(t) and sizes.sum() == len(encoder.encode(t))
    text = "孙权领兵渡江，众人皆惊。He left at dawn! " * 60
    out = split(spark, [(1, "p", 1, text, 0, 0), (2, "p", 1, "short", 0, 0), (3, "p", 1, None, 0, 0)], limit=100, overlap=10, tokenizer=path)
    sizes = P.token_sizes(text, encoder)
    assert {r.row_id for r in out} == {1} and out[0].piece_count == len(out) > 5
    for a, b in zip(out, out[1:]):
        assert a.start_pos < b.start_pos <= a.end_pos and sizes[b.start_pos : a.end_pos].sum() <= 10
    assert all(sizes[r.start_pos : r.end_pos].sum() <= 100 and text[r.start_pos : r.end_pos] == r.text for r in out)
    assert out[0].start_pos == 0 and out[-1].end_pos == len(text)
