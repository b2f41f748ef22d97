"""Problem 1: references of the group and tag tables against the stored chunk versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.orphans import orphan_references, orphan_report
from inkwell.runtime import table


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [
        table(spark, sf_dir, t).select(F.lit(t).alias("ref_table"), F.col("eventid").alias("ref_key"), F.explode("chunkids").alias("parent_key"), F.col("recorded_at").alias("at"))
        for t in ("allusions", "event_groups")
    ]
    tags = table(spark, sf_dir, "chunk_tags").select(
        F.lit("chunk_tags").alias("ref_table"), F.col("tag_id").alias("ref_key"), F.col("chunk_id").alias("parent_key"), F.col("recorded_at").alias("at")
    )
    return groups[0].unionByName(groups[1]).unionByName(tags)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "sanguo_yanyi").where("chunk_id is not null").select(F.col("chunk_id").alias("key"), F.col("loaded_at").alias("since"), F.col("removed_at").alias("until"))
    return orphan_references(_references(spark, sf_dir), parents).withColumnRenamed("parent_key", "chunk_id")


def p1_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p1_found(spark, sf_dir).withColumnRenamed("chunk_id", "parent_key"))


FOUND_SQL = """
WITH refs AS (
  SELECT 'allusions' AS ref_table, eventid AS ref_key, unnest(chunkids) AS chunk_id, recorded_at AS seen FROM allusions
  UNION ALL SELECT 'event_groups', eventid, unnest(chunkids), recorded_at FROM event_groups
  UNION ALL SELECT 'chunk_tags', tag_id, chunk_id, recorded_at FROM chunk_tags),
r AS (SELECT DISTINCT * FROM refs WHERE chunk_id IS NOT NULL),
j AS (
  SELECT r.ref_table, r.ref_key, r.chunk_id, r.seen, count(s.row_id) AS n,
    count(CASE WHEN s.loaded_at <= r.seen AND (s.removed_at IS NULL OR s.removed_at > r.seen) THEN 1 END) AS live,
    count(CASE WHEN s.loaded_at > r.seen THEN 1 END) AS after
  FROM r LEFT JOIN sanguo_yanyi s ON s.chunk_id = r.chunk_id GROUP BY ALL)
SELECT DISTINCT ref_table, ref_key, chunk_id, strftime(seen, '%Y-%m') AS ref_month,
  CASE WHEN n = 0 THEN 'missing' WHEN after = n THEN 'late' ELSE 'removed' END AS kind
FROM j WHERE live = 0"""

QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report}
SQL = {
    "p1_found": FOUND_SQL,
    "p1_orphan_report": f"SELECT ref_table, ref_month, kind, count(*) AS orphans, count(DISTINCT chunk_id) AS orphan_keys FROM ({FOUND_SQL}) GROUP BY ref_table, ref_month, kind",
}
