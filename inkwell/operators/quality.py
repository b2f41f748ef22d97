"""Aggregates and checks that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as X

BUCKETS = 2048


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Exact nearest-rank percentiles: the value at position ceil(share * n) of each group, as columns.

    Values are counted per distinct value first. The position is then looked for in ``BUCKETS`` equal ranges
    between the group's extremes, and only the range that holds it is ordered, so no task sees a whole group.
    Null values don't count; groups without values give nulls; a share of 0 gives the smallest value.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counted.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    width = (F.col("hi") - F.col("lo")) / BUCKETS
    placed = counted.join(ends, by).withColumn("b", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BUCKETS - 1))).otherwise(F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).alias("at")) for name, p in shares.items()]))
    totals = placed.groupBy(*by, "b").agg(F.sum("c").alias("bc"), F.first("n").alias("n"))
    running = F.sum("bc").over(Window.partitionBy(*by).orderBy("b"))
    holding = totals.withColumn("upto", running).select(*by, "b", "bc", "upto", wanted.alias("w")).where("upto - bc < w.at and w.at <= upto").select(*by, "b", F.col("w.name").alias("name"), (F.col("w.at") - F.col("upto") + F.col("bc")).alias("at"))
    inner = Window.partitionBy(*by, "b", "name").orderBy("v")
    found = placed.select(*by, "b", "v", "c").join(holding, [*by, "b"]).withColumn("upto", F.sum("c").over(inner)).where("upto >= at and upto - c < at")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])


def fill_forward(df: DataFrame, key: str, at: str, tie: str, value: Column, out: str) -> DataFrame:
    """The last non-null ``value`` up to and with each row, per key in order of (``at``, ``tie``).

    Days are filled apart and joined with what the days before carry over, so a key's rows are never ordered
    in one task, only its days.
    """
    rows = df.withColumn("__v", value).withColumn("__day", F.to_date(at))
    within = F.last("__v", ignorenulls=True).over(Window.partitionBy(key, "__day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    daily = rows.groupBy(key, "__day").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(at, tie))).alias("__last"))
    carried = daily.withColumn("__carried", F.last("__last", ignorenulls=True).over(Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    return rows.withColumn("__w", within).join(carried, [key, "__day"], "left").withColumn(out, F.coalesce("__w", "__carried")).drop("__v", "__w", "__carried", "__day")


def first_wins(df: DataFrame, content: Column, id_col: str) -> DataFrame:
    """(content_key, first id, copies): the first row of each content, in an aggregate."""
    return df.groupBy(content.alias("content_key")).agg(F.min(id_col).alias("kept_id"), F.count(F.lit(1)).alias("copies"))


def sessions_with_ttl(events: DataFrame, key: str, at: str, tie: str, opens: Column, minutes: int = 30) -> DataFrame:
    """Rows with ``opened_at`` and ``active``: the session a row falls into, with a fixed time to live.

    A session lasts ``minutes`` from its opening (the exact end included), reads don't extend it, a later
    opening replaces it. The opening a row can belong to lies in the row's own span of ``minutes`` or the one
    before, so the last opening of each span is all that is joined; a busy key splits by span.
    """
    span = minutes * 60
    epoch = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.withColumn("__s", F.floor(epoch / (span * 1_000_000)).cast("bigint")).withColumn("__open", F.when(opens, F.col(at)))
    within = F.last("__open", ignorenulls=True).over(Window.partitionBy(key, "__s").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = rows.where("__open is not null").groupBy(key, (F.col("__s") + 1).alias("__s")).agg(F.max("__open").alias("__before"))
    joined = rows.withColumn("__w", within).join(before, [key, "__s"], "left").withColumn("__o", F.coalesce("__w", "__before"))
    age = epoch - F.unix_micros(F.col("__o").cast("timestamp"))
    active = F.coalesce(age <= span * 1_000_000, F.lit(False))
    return joined.withColumn("active", active).withColumn("opened_at", F.when(active, F.col("__o"))).drop("__s", "__open", "__w", "__before", "__o")


def corpus_checks(chunks: DataFrame, cap: int = 600) -> DataFrame:
    """(check, failures): invariants of stored chunks, in one pass and one row per check."""
    depth = X.quote_depth(F.coalesce("text", F.lit("")))
    well_formed = F.col("chunk_id").rlike(X.CHUNK_ID)
    checks = {
        "chunk_id_present": F.col("chunk_id").isNull(),
        "chunk_id_well_formed": F.col("chunk_id").isNotNull() & ~well_formed,
        "chunk_id_of_parent": well_formed & (F.substring_index("chunk_id", ":c", 1) != F.col("parent_id")),
        "chapter_of_id": well_formed & (F.regexp_extract("chunk_id", X.CHUNK_ID, 1).cast("int") != F.col("chapter")),
        "sequence_of_id": well_formed & (F.regexp_extract("chunk_id", X.CHUNK_ID, 3).cast("int") != F.col("seq_in_parent")),
        "text_present": F.coalesce(F.col("text"), F.lit("")) == "",
        "char_count_right": F.col("text").isNotNull() & ~F.col("char_count").eqNullSafe(F.length("text")),
        "within_cap": (F.col("chunk_type") != "verse") & (F.length("text") > cap),
        "quotes_balanced": (depth["lowest"] < 0) | (depth["final"] != 0),
        "known_type": ~F.col("chunk_type").isin("prose", "verse") | ~F.col("chunk_role").isin("body", "lead"),
    }
    wide = chunks.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in checks)
    return wide.selectExpr(f"stack({len(checks)}, {pairs}) as (check, failures)")
