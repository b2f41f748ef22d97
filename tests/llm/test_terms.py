import random
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import terms as T

ROW = "row_id bigint, chunk_id string, text string, term string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.0) for r in rows], ROW)


def names(spark, *words, **kw):
    return T.Names(spark.createDataFrame([(w,) for w in words], "canonical string"), "canonical", **kw)


def brute_converge(tf, q, share=T.SHARE):
    """Expectation-maximisation as written, for very many rounds."""
    p = np.asarray(tf, float) / sum(tf)
    for _ in range(100_000):
        part = share * p / (share * p + (1 - share) * np.asarray(q))
        e = tf * part
        p = e / e.sum()
    return p, part


def test_records_converge_alone_and_together():
    rnd = np.random.RandomState(1)
    sizes = [1, 5, 40, 3, 200]
    row = np.repeat(np.arange(5), sizes).astype(np.int32)
    tf, q = rnd.randint(1, 9, row.size), rnd.rand(row.size) * 0.01 + 1e-9
    p, part = T.converge(row, tf, q)
    for r in range(5):
        own = row == r
        bp, bpart = brute_converge(tf[own], q[own])
        # terms on the border fall to zero as slowly as one over the rounds
        assert np.abs(p[own] - bp).max() < 1e-4 and np.abs(part[own] - bpart)[(p[own] > 1e-3) | (bp < 1e-9)].max() < 1e-2 and p[own].sum() == pytest.approx(1)
        # both steps leave the result where it is
        e = tf[own] * T.SHARE * p[own] / (T.SHARE * p[own] + (1 - T.SHARE) * q[own])
        assert np.allclose(e / e.sum(), p[own], atol=1e-12) and (T.converge(row[own], tf[own], q[own])[0] == p[own]).all()


def test_common_terms_lose_their_mass(spark):
    rows = [(i, f"c{i}", "天下大事天下大事" + ("麒麟" if i == 3 else "")) for i in range(40)]
    got = {(r.row_id, r.term): r for r in T.characteristic_terms(frame(spark, rows), names(spark, "麒麟", "天下")).collect()}
    assert got[3, "麒麟"].score > 0.1 and got[3, "麒麟"].own_part > 0.9
    best = min((r for (i, _), r in got.items() if i == 3), key=lambda r: r.rank)
    assert "麟" in best.term or "麒" in best.term


@pytest.mark.parametrize("broadcast_bytes", [T.BROADCAST_BYTES, 0])
def test_common_terms_come_out_and_rank_low(spark, broadcast_bytes):
    rows = [(i, f"c{i}", "天下大事天下大事" + ("麒麟" if i == 3 else "")) for i in range(40)]
    got = T.characteristic_terms(frame(spark, rows), names(spark, "麒麟", "天下"), broadcast_bytes=broadcast_bytes).collect()
    for i in range(40):
        own = {(r.term, r.is_name): r for r in got if r.row_id == i}
        pairs = {"天下", "下大", "大事", "事天"} | ({"事麒", "麒麟"} if i == 3 else set())
        assert set(own) == {(p, False) for p in pairs} | {("天下", True)} | ({("麒麟", True)} if i == 3 else set())
        assert sorted(r.rank for r in own.values()) == list(range(1, len(own) + 1))
        assert sum(r.score for r in own.values()) == pytest.approx(1)
    third = {(r.term, r.is_name): r for r in got if r.row_id == 3}
    assert third["天下", True].own_part < 0.5 and third["天下", True].rank > third["麒麟", True].rank


def test_term_keys_tokens():
    texts = ["Tom's 中国人 ab", "", "人", "中国"]
    row, key, start, end = T.term_keys(texts)
    whole = "".join(texts)
    assert Counter((int(r), whole[a:b]) for r, a, b in zip(row, start, end)) == Counter({(0, "Tom"): 1, (0, "s"): 1, (0, "中国"): 1, (0, "国人"): 1, (0, "ab"): 1, (3, "中国"): 1})
    same = {}
    for k, a, b in zip(key, start, end):
        assert same.setdefault(int(k), whole[a:b].lower()) == whole[a:b].lower()


def brute_found(rows, names):
    at = {}
    for _, c, t in rows:
        for n in names:
            if c is not None and t and n in t:
                at.setdefault(n, set()).add(c)
    return {(c, n) for n, cs in at.items() if 2 <= len(cs) <= 5 for c in cs}


def few(rows, seed=4):
    rnd = random.Random(seed)
    words = ["甲乙", "乙丙", "甲乙丙", "丁", "戊己庚", "never", "", None, "甲乙"]
    out = [(i, rnd.choice([None, "hot", f"c{i % 37}"]), rnd.choice([None, "", "".join(rnd.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(rnd.randrange(1, 30)))])) for i in range(rows)]
    return [*out, (900, "x", "辰巳"), (901, "y", "子辰巳"), (902, "y", "辰巳辰巳")], [*words, "辰巳"]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_names_of_few_equal_brute_force(spark, options):
    rows, words = few(300)
    ents = spark.createDataFrame([(n, "x") for n in words], "canonical string, chunk_id string")
    got = [tuple(r) for r in T.names_of_few(frame(spark, rows), ents, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_found(rows, [n for n in words if n]) and ("y", "辰巳") in got


def test_a_name_in_a_third_of_all_rows_but_one_chunk_pair_is_found(spark):
    rows = [(i, "hot" if i % 3 else "cold", "长坂桥头") if i < 200 else (i, f"c{i}", f"天下大事{chr(0x4E00 + i)}{chr(0x5E00 + i)}") for i in range(600)]
    ents = spark.createDataFrame([("长坂",), ("天下",)], "canonical string")
    assert {tuple(r) for r in T.names_of_few(frame(spark, rows), ents).collect()} == {("hot", "长坂"), ("cold", "长坂")}


key = lambda r: (r.row_id, r.chunk_id, r.term, r.is_name, r.tf, r["rank"], round(r.score, 12), round(r.own_part, 12))


@pytest.mark.parametrize("with_rank", [True, False])
def test_one_model_whatever_the_sizes(spark, with_rank):
    """Scores and ranks: one dictionary block or several, a background that is broadcast or joined, one block of records or many."""
    rnd = random.Random(6)
    rows = [(i % 50, f"c{i}" if i % 7 else None, "".join(rnd.choice("甲乙丙丁 ab") for _ in range(40)) if i % 11 else None) for i in range(120)]
    words = ["甲乙", "丁", "丙丁", "乙丙丁", "ab", "absent"]
    one, several = names(spark, *words), names(spark, *words, block_bytes=80)
    assert one.blocks == 1 and several.blocks > 1
    df = frame(spark, rows).repartition(5)
    plain = sorted(map(str, map(key, T.characteristic_terms(df, one, with_rank=with_rank).collect())))
    assert plain and len(plain) > 1000
    for dictionary, options in ((one, {"broadcast_bytes": 0}), (several, {}), (several, {"broadcast_bytes": 0})):
        assert sorted(map(str, map(key, T.characteristic_terms(df, dictionary, with_rank=with_rank, **options).collect()))) == plain


def test_records_in_many_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, f"c{i}", "天下大事" * (i % 5) + "麒麟" * (i % 2)) for i in range(60)]
    dictionary = names(spark, "麒麟", "天下")
    want = sorted(map(key, T.characteristic_terms(frame(spark, rows), dictionary).collect()))
    import inkwell.llm.blocks as B

    monkeypatch.setattr(T, "in_blocks", lambda df, c: B.in_blocks(df, c, 7))
    assert sorted(map(key, T.characteristic_terms(frame(spark, rows), dictionary, broadcast_bytes=0).collect())) == want


def test_ranks_are_complete_and_follow_the_scores(spark):
    rows = [(i, f"c{i}", "天下大事天下大事" + chr(0x4E00 + i) * 2 + "abc def abc") for i in range(30)]
    by_row = {}
    for r in T.characteristic_terms(frame(spark, rows), names(spark, "天下")).collect():
        by_row.setdefault(r.row_id, []).append(r)
    for rs in by_row.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1)) and all(a.score >= b.score - 1e-12 for a, b in zip(rs, rs[1:]))


def test_edges(spark):
    none = frame(spark, [(1, "c", None), (2, "c", "")])
    assert T.characteristic_terms(none, names(spark, "甲"), broadcast_bytes=0).count() == 0 and T.names_of_few(none, none.select("text"), "text").count() == 0
    assert T.characteristic_terms(frame(spark, []), names(spark, "甲")).count() == 0
    assert T.characteristic_terms(frame(spark, [(1, "c", None), (2, "c", ""), (3, "c", "。。")]), names(spark)).count() == 0
    long = T.characteristic_terms(frame(spark, [(1, "c", "很长的文字" * 60_000), (2, "d", "别的")]), names(spark, "别的")).collect()
    assert any(r.row_id == 2 and r.term == "别的" for r in long)
    twice = T.characteristic_terms(frame(spark, [(1, "c", "甲乙"), (1, "c", "甲乙"), (2, "d", "丙丁")]), names(spark, "甲乙"), only_names=True)
    assert [r.row_id for r in twice.collect()] == [1, 1]
