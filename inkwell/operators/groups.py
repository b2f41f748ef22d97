"""Named groups of chunks: validation, drift against the corpus, members, and name bridges from queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as X
from inkwell.operators.matching import substring_join

DRIFT = 0.05  # a larger share of missing members degrades the whole table


def valid_groups(groups: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """First row of each id (by record time, arrival, members) that has a name and a known type."""
    order = [F.col("recorded_at").asc_nulls_first(), F.col("arrived_at").asc_nulls_first(), F.coalesce(F.concat_ws(",", "chunkids"), F.lit(""))]
    first = groups.where("eventid <> ''").withColumn("__n", F.row_number().over(Window.partitionBy("eventid").orderBy(*order))).where("__n = 1")
    return first.where("eventname <> ''").where(F.col("group_type").isin(*types)).select("eventid", "eventname", "aliases", "chunkids", "group_type")


def valid_aliases(valid: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(eventid, alias): aliases of two or more characters; the first row (by id) keeps one that several have,
    and ``taken(key)`` words of the alias table go."""
    each = valid.select("eventid", F.explode("aliases").alias("alias")).where("length(alias) >= 2").groupBy("alias").agg(F.min("eventid").alias("eventid"))
    return (each.join(taken.select(F.col("key").alias("alias")), "alias", "left_anti") if taken is not None else each).select("eventid", "alias")


def bridge_keys(valid: DataFrame, aliases: DataFrame) -> DataFrame:
    """(eventid, group_type, key): names (whatever else uses them) and aliases."""
    names = valid.select("eventid", F.col("eventname").alias("key"))
    keys = names.unionByName(aliases.select("eventid", F.col("alias").alias("key"))).distinct()
    return keys.join(valid.select("eventid", "eventname", "group_type"), "eventid")


def references(valid: DataFrame) -> DataFrame:
    """(eventid, chunk_id): one row per non-null member, repeats included."""
    return valid.select("eventid", F.explode("chunkids").alias("chunk_id")).where("chunk_id is not null")


def missing_references(valid: DataFrame, chunks: DataFrame) -> DataFrame:
    return references(valid).join(chunks.where("chunk_id is not null").select("chunk_id").distinct(), "chunk_id", "left_anti").select("eventid", "chunk_id").distinct()


def drift(valid: DataFrame, chunks: DataFrame, most: float = DRIFT) -> DataFrame:
    """One row: references (repeats included), distinct missing ones, their ratio, and whether it degrades."""
    refs = references(valid)
    gone = refs.select("chunk_id").distinct().join(chunks.where("chunk_id is not null").select("chunk_id").distinct(), "chunk_id", "left_anti")
    counted = refs.agg(F.count(F.lit(1)).alias("total_refs")).crossJoin(F.broadcast(gone.agg(F.count(F.lit(1)).alias("missing_refs"))))  # one row each
    ratio = F.when(F.col("total_refs") > 0, F.col("missing_refs") / F.col("total_refs")).otherwise(F.lit(0.0))
    return counted.withColumn("ratio", X.fixed(ratio, 6)).withColumn("degraded", ratio > most)


def members(valid: DataFrame, chunks: DataFrame) -> DataFrame:
    """(eventid, doc, chunk_id, place): existing body members in their inner order."""
    body = chunks.where("role = 'body' and chunk_id is not null").select("doc", "chunk_id")
    found = references(valid).distinct().join(body, "chunk_id")
    o = X.inner_order("chunk_id")
    order = Window.partitionBy("eventid").orderBy(o["chapter_no"], o["segment_no"], o["sequence_no"], "chunk_id", "doc")
    return found.select("eventid", "doc", "chunk_id", F.row_number().over(order).alias("place"))


def without_drift(valid: DataFrame, chunks: DataFrame, most: float = DRIFT) -> DataFrame:
    """The groups searches may use: none if more than ``most`` of the references are gone; else references that
    are gone leave their groups, and groups left without any go, as do those that never had one."""
    degraded = drift(valid, chunks, most).select("degraded")  # one row
    known = chunks.where("chunk_id is not null").select("chunk_id").distinct()
    refs = valid.select("eventid", F.posexplode("chunkids").alias("at", "chunk_id")).join(known, "chunk_id")
    kept = refs.groupBy("eventid").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))).alias("__r"))  # one group's members
    ids = F.transform("__r", lambda r: r["chunk_id"])
    return valid.drop("chunkids").join(kept, "eventid").crossJoin(F.broadcast(degraded)).where("not degraded").select("eventid", "eventname", "aliases", ids.alias("chunkids"), "group_type")


def bridges(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, kind, eventid, eventname, group_type, matched, poolable, driver): groups named in a query.

    ``keys(kind, eventid, eventname, group_type, key)``. The longest key of a group that the query contains is its
    match (ties by key). Groups other than events of type L3 are ``poolable``; among a query's poolable groups
    ``driver`` counts events before allusions, then longer matches first, then by id. It is null for the others.
    """
    hits = substring_join(queries.select("qid", "text"), "text", keys, "key").drop("text")
    longest = Window.partitionBy("qid", "kind", "eventid").orderBy(F.length("key").desc(), "key")
    one = hits.withColumn("__n", F.row_number().over(longest)).where("__n = 1").withColumn("poolable", (F.col("kind") != "event") | (F.col("group_type") != "L3"))
    order = Window.partitionBy("qid", "poolable").orderBy((F.col("kind") != "event"), F.length("key").desc(), "eventid")
    return one.select("qid", "kind", "eventid", "eventname", "group_type", F.col("key").alias("matched"), "poolable", F.when(F.col("poolable"), F.row_number().over(order)).alias("driver"))


def enhanced_queries(queries: DataFrame, matched: DataFrame) -> DataFrame:
    """(qid, text): the query, its driving group's name and the matched key."""
    first = matched.where("driver = 1").select("qid", "eventname", "matched")
    return queries.join(first, "qid").select("qid", F.concat("text", "eventname", "matched").alias("text"))
