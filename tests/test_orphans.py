import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkwell.operators.orphans import BlockedBloom, orphan_references, orphan_report

REFS = "ref_table string, ref_key string, parent_key string, at timestamp_ntz, kind string, rank int"
PARENTS = "key string, since timestamp_ntz, until timestamp_ntz, parent_key string, at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def expected(refs, parents):
    out = set()
    for table, key, parent, at, *_ in refs:
        if parent is None:
            continue
        rows = [(s, u) for k, s, u, *_ in parents if k == parent]
        if at is not None and any(s is not None and s <= at and (u is None or u > at) for s, u in rows):
            continue
        kind = "missing" if not rows else "late" if at is not None and all(s is not None and s > at for s, _ in rows) else "removed"
        out.add((table, key, parent, at.strftime("%Y-%m") if at else None, kind))
    return out


def run(spark, refs, parents, **kw):
    r = spark.createDataFrame([(*x, "clash", 1) for x in refs], REFS)
    p = spark.createDataFrame([(*x, "clash", T0) for x in parents], PARENTS)
    rows = [tuple(x) for x in orphan_references(r, p, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(4)
    keys = [f"k{i}" for i in range(60)]
    parents = []
    for _ in range(900):
        k = "k0" if rnd.random() < 0.4 else rnd.choice(keys[:40])
        s = day(rnd.randrange(60)) + timedelta(hours=rnd.randrange(24))
        parents.append((k, s, None if rnd.random() < 0.3 else s + timedelta(hours=rnd.randrange(-5, 90))))
    refs = [(rnd.choice("ab"), str(rnd.randrange(50)), "k0" if rnd.random() < 0.3 else rnd.choice(keys), day(rnd.randrange(-3, 70)) + timedelta(hours=rnd.randrange(24))) for _ in range(700)]
    assert run(spark, refs, parents) == expected(refs, parents)


def test_defined_cases(spark):
    parents = [("a", day(1), day(5)), ("a", day(1), day(5)), ("b", None, None), ("c", day(3), day(3)), ("", day(0), None), (None, day(0), None), ("d", day(2), day(4))]
    refs = [
        ("t", "1", "a", day(1)), ("t", "2", "a", day(5)), ("t", "3", "a", day(0)), ("t", "4", "b", day(9)), ("t", "5", "c", day(3)),
        ("t", "6", "", day(1)), ("t", "7", None, day(1)), ("t", None, "zz", day(1)), ("t", "8", "a", None), ("t", "9", "zz", None), ("t", "2", "a", day(5)), ("t", "10", "d", day(4)),
    ]
    got = run(spark, refs, parents)
    assert got == expected(refs, parents)
    assert ("t", "1", "a", "2024-01", "missing") not in got
    assert ("t", "2", "a", "2024-01", "removed") in got and ("t", "3", "a", "2023-12", "late") not in got


def test_late_and_removed(spark):
    got = run(spark, [("t", "1", "a", day(0)), ("t", "2", "a", day(9))], [("a", day(1), day(5))])
    assert {x[4] for x in got} == {"late", "removed"}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("t", "1", "a", day(0))], []) == {("t", "1", "a", "2024-01", "missing")}


def test_full_filter_stays_exact(spark):
    """With one block for far too many keys everything passes the filter; the exact check decides."""
    parents = [(f"k{i}", day(1), None) for i in range(20_000)]
    refs = [("t", str(i), f"k{i}", day(2)) for i in range(50)] + [("t", str(i), f"x{i}", day(2)) for i in range(50)]
    assert run(spark, refs, parents, max_bits=32_768) == expected(refs, [p for p in parents[:60]])


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "k string")
    bloom = BlockedBloom(keys, "k")
    assert bloom.mark(keys, "k").where("not may_exist").count() == 0
    other = spark.createDataFrame([(f"other{i}",) for i in range(5000)], "k string")
    assert bloom.mark(other, "k").where("may_exist").count() < 250


def test_report(spark):
    rows = spark.createDataFrame([("t", "1", "a", "2024-01", "late"), ("t", "2", "a", "2024-01", "late")], "ref_table string, ref_key string, parent_key string, ref_month string, kind string")
    (r,) = orphan_report(rows).collect()
    assert (r.orphans, r.orphan_keys) == (2, 1)


@pytest.mark.parametrize("bits", [1, 64])
def test_filter_size_is_bounded(spark, bits):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(5000)], "k string")
    assert BlockedBloom(keys, "k", bits_per_key=bits, max_bits=65_536).blocks <= 2


def test_keys_of_equal_hash_have_equal_bits(spark):
    from inkwell.operators.orphans import _bits, _hash

    rows = spark.range(2000).select(F.col("id").cast("string").alias("k")).select("k", F.array(*_bits(_hash(F.col("k")), 5)).alias("b")).collect()
    assert all(0 <= x < 32_768 for r in rows for x in r.b) and sum(len(set(r.b)) == 5 for r in rows) > 1990 and len({tuple(r.b) for r in rows}) > 1990
