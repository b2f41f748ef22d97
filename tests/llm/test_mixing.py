import random

import pytest

from inkwell.llm import mixing as M


def test_water_filling_clamps_and_shares_out():
    sizes = {"a": 100, "b": 10, "c": 1000}
    out = M.water_fill([("a", 1.0, None), ("b", 1.0, 2), ("c", 2.0, 1)], sizes, budget=400)
    assert out["b"]["tokens"] == 20 and out["b"]["capped"]
    assert out["a"]["tokens"] == pytest.approx(380 / 3) and out["c"]["tokens"] == pytest.approx(760 / 3)


def test_water_filling_invariants():
    rnd = random.Random(3)
    for _ in range(500):
        names = [f"s{i}" for i in range(rnd.randrange(1, 7))]
        sizes = {s: rnd.choice([0, rnd.randrange(1, 1000)]) for s in names}
        targets = [(s, rnd.choice([None, -1.0, 0.0, rnd.random() * 5, float("nan")]), rnd.choice([None, 0, 1, 3])) for s in names]
        budget = rnd.choice([None, 10.0, 5000.0])
        out = M.water_fill(targets, sizes, budget)
        total = sum(sizes.values()) if budget is None else budget
        assert sum(o["tokens"] for o in out.values()) <= total + 1e-6
        free = []
        for s, w, cap in targets:
            o = out[s]["tokens"]
            assert o >= 0 and (cap is None or o <= sizes[s] * cap + 1e-9)
            if w is not None and w > 0 and sizes[s] and (cap is None or o < sizes[s] * cap - 1e-9):
                free.append(o / w)
        assert not free or max(free) - min(free) < 1e-6  # what no cap binds is proportional
        if free:
            assert sum(o["tokens"] for o in out.values()) == pytest.approx(total)


def test_exact_total():
    assert M.exact_total([("a", 1.0, 1), ("b", 3.0, 2), ("none", 9.0, 1)], {"a": 100, "b": 60}) == pytest.approx(160)
    assert M.exact_total([], {}) == 0.0


DOCS = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "mix_name string, source string, target_weight double, max_repeats int, n_tokens int"


def docs(spark, n=3000):
    rnd = random.Random(5)
    return spark.createDataFrame([(i, "hot" if i % 3 else rnd.choice(["a", "b"]), rnd.choice([0, 1, 5, 40])) for i in range(n)], DOCS)


def test_drawn_shares_follow_the_plan(spark):
    sized = docs(spark).cache()
    targets = spark.createDataFrame([("m", "hot", 1.0, None, 0), ("m", " A ", 1.0, 3, 0), ("m", "b", 1.0, None, 0), ("m", "nowhere", 1.0, None, 0), ("one", "b", 2.0, 1, 0), (None, "a", 1.0, 2, 0), ("m", None, 1.0, 1, 0)], TARGETS)
    plan = M.plan_mixes(sized, targets)
    drawn = M.draw(sized, plan)
    rows = {(r.mix_name, r.source): r for r in M.reached_shares(drawn, plan).collect()}
    assert rows["m", "nowhere"].drawn_tokens == 0 and (None, "a") in rows
    for r in rows.values():
        assert abs(r.drawn_tokens - r.epochs * r.available_tokens) <= 40 and (r.max_repeats is None or r.most_repeats <= r.max_repeats)
    each = drawn.groupBy("mix_name", "source", "doc_id").count()
    assert each.where("count > 1").count() == 0 and drawn.where("n_tokens = 0").count() == 0
    again = {tuple(r) for r in M.draw(sized.repartition(5), plan).collect()}
    assert again == {tuple(r) for r in drawn.collect()}  # the same whatever the partitioning
    other = {tuple(r) for r in M.draw(sized, plan, seed=2).collect()}
    assert other != again
    whole = {r.repeats for r in drawn.where("mix_name = 'm' and source = 'a'").collect()}
    assert max(whole) - min(whole) <= 1


def test_exact_shares(spark):
    sized = docs(spark)
    targets = spark.createDataFrame([("m", "hot", 1.0, 1, 0), ("m", "a", 3.0, 2, 0)], TARGETS)
    plan = M.plan_mixes(sized, targets, "exact")
    rows = {r.source: r for r in M.reached_shares(M.draw(sized, plan), plan).collect()}
    assert rows["a"].reached_share == pytest.approx(0.75, abs=0.01)


def test_empty_tables(spark):
    sized, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS)
    plan = M.plan_mixes(sized, none)
    assert plan.count() == 0 and M.draw(sized, plan).count() == 0
    plan = M.plan_mixes(sized, spark.createDataFrame([("m", "a", 1.0, 1, 0)], TARGETS))
    assert M.reached_shares(M.draw(sized, plan), plan).first().reached_share == 0.0


def test_sized_documents(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Hello", " RETELLING ", 3), (2, None, None, 3)], "doc_id bigint, text string, source string, n_tokens int")
    assert {tuple(r) for r in M.sized_documents(df).collect()} == {(1, "retelling", 1), (2, None, 0)}
