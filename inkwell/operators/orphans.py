"""References to records that do not exist, found with a blocked Bloom filter and an exact check.

The filter holds the parent keys in blocks of 32,768 bits. Its size follows the number of keys up to a
hard bound (``max_bits``), so broadcasting it is always safe; past the bound only the share of references
that need the exact check rises. A reference the filter rejects is proven an orphan without touching the
parents; one it passes is verified by an exact join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.runtime import cut

BLOCK_BITS = 32_768  # of bitmap_construct_agg


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit(0))


def _bits(h: Column, hashes: int) -> list[Column]:
    """The bits of a key by double hashing of its one hash: keys of equal hash have equal bits, so folding them loses none."""
    first, step = F.pmod(h, F.lit(BLOCK_BITS)), F.pmod(F.shiftright(h, 20), F.lit(BLOCK_BITS)).bitwiseOR(F.lit(1))
    return [F.pmod(first + i * step, F.lit(BLOCK_BITS)) for i in range(hashes)]


class BlockedBloom:
    """A Bloom filter as a DataFrame (block, bitmap), at most ``max_bits / 8`` bytes in all."""

    def __init__(self, parents: DataFrame, key: str, bits_per_key: int = 12, hashes: int = 5, max_bits: int = 1 << 29):
        self.hashes = hashes
        wanted = max(1, -(-parents.count() * bits_per_key // BLOCK_BITS))
        self.blocks = min(wanted, max_bits // BLOCK_BITS)
        hashed = (
            parents.where(F.col(key).isNotNull())
            .select(_block(F.col(key), self.blocks).alias("block"), _hash(F.col(key)).alias("h"))
            # equal keys leave a task once; the bitmaps are built after the shuffle, so no task sends
            # a bitmap of every block
            .distinct()
        )
        self.frame = (
            hashed.repartition("block").select("block", F.explode(F.array(*_bits(F.col("h"), hashes))).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        )

    def mark(self, refs: DataFrame, key: str, out: str = "may_exist") -> DataFrame:
        """Add ``out``: false proves that no parent has the key; a null key gives false."""
        known = F.broadcast(self.frame.withColumnRenamed("block", "__block"))

        def set_at(bit: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (bit % 8).cast("int")) == 1

        inside = reduce(lambda a, b: a & b, [set_at(b) for b in _bits(_hash(F.col(key)), self.hashes)])
        return (
            refs.withColumn("__block", _block(F.col(key), self.blocks))
            .join(known, "__block", "left")
            .withColumn(out, F.coalesce(inside, F.lit(False)))
            .drop("__block", "bitmap")
        )


def orphan_references(refs: DataFrame, parents: DataFrame, bits_per_key: int = 12, max_bits: int = 1 << 29) -> DataFrame:
    """Orphans among ``refs(ref_table, ref_key, parent_key, at)`` against ``parents(key, since, until)``.

    A reference is an orphan when at its time ``at`` no parent row with exactly its key was present
    (``since <= at`` and ``until`` null or later). Returns distinct
    (ref_table, ref_key, parent_key, ref_month, kind) with kind ``missing`` (no row ever has the key),
    ``late`` (every row has ``since`` > ``at``) or ``removed``.

    Defined cases: null parent keys are no references; a null ``ref_key`` is kept; a null ``at`` matches no
    presence, so it is ``missing`` or ``removed`` with a null month; a null ``since`` never makes a row
    present; rows with ``until <= since`` were never present; an empty string is an ordinary key; repeated
    references and parents count once; empty inputs give an empty or all-``missing`` result.
    No parent key's versions are gathered into one task: presence is a prefix sum over days, then within
    a day, so one key holding a large share of the rows splits by time.
    """
    parents = parents.select(F.col("key").alias("parent_key"), "since", "until")
    refs = refs.select("ref_table", "ref_key", "parent_key", "at").where(F.col("parent_key").isNotNull()).distinct()
    bloom = BlockedBloom(parents.select("parent_key"), "parent_key", bits_per_key=bits_per_key, max_bits=max_bits)
    # written once: the marked references feed every branch below
    marked = cut(bloom.mark(refs, "parent_key"))
    proven = marked.where(~F.col("may_exist")).select("ref_table", "ref_key", "parent_key", "at", F.lit("missing").alias("kind"))
    passed = marked.where("may_exist").drop("may_exist")

    asked = passed.select("parent_key", "at").distinct()
    wanted = cut(parents.join(asked.select("parent_key").distinct(), "parent_key", "left_semi"))
    ever = wanted.groupBy("parent_key").agg(F.min("since").alias("first_since"), F.max(F.col("since").isNull()).alias("undated"))
    there = wanted.where("since is not null and (until is null or until > since)")
    steps = (
        there.select("parent_key", F.explode(F.array(F.struct(F.col("since").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("until").alias("ts"), F.lit(-1).alias("d")))).alias("s"))
        .select("parent_key", "s.ts", "s.d")
        .where("ts is not null")
        .groupBy("parent_key", "ts")
        .agg(F.sum("d").alias("d"))
        .withColumn("day", F.to_date("ts"))
    )
    by_day = steps.groupBy("parent_key", "day").agg(F.sum("d").alias("day_d")).unionByName(
        asked.where("at is not null").select("parent_key", F.to_date("at").alias("day"), F.lit(0).cast("bigint").alias("day_d")).distinct()
    ).groupBy("parent_key", "day").agg(F.sum("day_d").alias("day_d"))
    before = by_day.withColumn(
        "carried", F.coalesce(F.sum("day_d").over(Window.partitionBy("parent_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("day_d")
    merged = steps.select("parent_key", "day", "ts", "d", F.lit(False).alias("asked")).unionByName(
        asked.where("at is not null").select("parent_key", F.to_date("at").alias("day"), F.col("at").alias("ts"), F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("asked"))
    )
    within = (
        merged.withColumn("live", F.sum("d").over(Window.partitionBy("parent_key", "day").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("asked")
        .select("parent_key", "day", F.col("ts").alias("at"), "live")
    )
    present = within.join(before, ["parent_key", "day"]).where("live + carried > 0").select("parent_key", "at")

    kind = (
        F.when(F.col("first_since").isNull() & F.col("undated").isNull(), "missing")
        .when((F.col("first_since") > F.col("at")) & ~F.col("undated"), "late")
        .otherwise("removed")
    )
    verified = (
        passed.join(present, ["parent_key", "at"], "left_anti")
        .join(ever, "parent_key", "left")
        .select("ref_table", "ref_key", "parent_key", "at", kind.alias("kind"))
    )
    return (
        proven.unionByName(verified)
        .select("ref_table", "ref_key", "parent_key", F.date_format("at", "yyyy-MM").alias("ref_month"), "kind")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, month and kind."""
    return orphans.groupBy("ref_table", "ref_month", "kind").agg(
        F.count(F.lit(1)).alias("orphans"), F.countDistinct("parent_key").alias("orphan_keys")
    )
