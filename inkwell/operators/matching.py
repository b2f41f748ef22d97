"""Joins on containment, rewritten so that they hash instead of comparing every pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.runtime import BROADCAST_BYTES, cut


def substring_join(left: DataFrame, text: str, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` and ``right`` where ``left.text`` contains ``right.key``, each pair once.

    Equi-join on the first two characters of the key (one for single characters), which every text that
    contains the key has among its own pairs, then the exact test. Null and empty keys match nothing. The
    pairs of a text are distinct before the join, so a pair of rows meets at most once. Keys within
    ``BROADCAST_BYTES`` are broadcast and the texts stay where they are; more keys meet only the rows' numbers and
    pairs, and texts are fetched for the rows that met one.
    """
    grams = F.array_distinct(F.concat(X.singles(text), X.pairs(text)))
    right = right.where(F.length(key) > 0)
    keys = right.withColumn("__gram", F.substring(F.col(key), 1, 2))
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in right.columns])
    size = right.agg(F.sum(width + 96)).first()[0] or 0
    left = left.where(F.length(text) > 0)
    if size <= BROADCAST_BYTES:
        met = left.withColumn("__gram", F.explode(grams)).join(F.broadcast(keys), "__gram")
    else:
        left = cut(left.withColumn("__row", F.monotonically_increasing_id()))
        met = left.select("__row", F.explode(grams).alias("__gram")).join(keys, "__gram").join(left, "__row").drop("__row")
    return met.where(F.col(text).contains(F.col(key))).drop("__gram")
