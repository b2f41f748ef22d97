"""Sinks: chapter files, tables, vectors, run snapshots and their summaries."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.sources.readers import MAGIC

NO_HIT = "[]"


PART = 64  # segments of a chapter that one object holds


def chapter_files(chunks: DataFrame, folder: str) -> None:
    """JSON objects in a folder per chapter, each with the chunks of ``PART`` segments in the order of parent and
    sequence: a chapter of any size is never one group. ``part`` numbers a chapter's objects."""
    body = F.struct("chunk_id", "parent_id", "seq_in_parent", F.col("chunk_type").alias("type"), "role", "text", "char_count", "group_id")
    segment = F.regexp_extract(F.coalesce("parent_id", F.lit("")), r":p(\d+)$", 1)
    numbered = chunks.withColumn("part", F.when(segment != "", F.floor(segment.cast("int") / PART)).otherwise(F.lit(-1)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("parent_id", "seq_in_parent", body.alias("body")))), lambda x: x["body"])
    docs = numbered.groupBy("source", "chapter", "title", "part").agg(ordered.alias("chunks"))
    docs.withColumn("chapter_no", F.format_string("%03d", "chapter")).write.mode("overwrite").partitionBy("chapter_no").json(folder)


def segment_dump(chunks: DataFrame, folder: str) -> None:
    """The text of every segment, a line each in a folder per chapter, and ``INDEX``: segments with their sizes.

    ``chunks(parent_id, seq_in_parent, doc, chapter, text)``; a segment's pieces are joined in order, line ends become blanks.
    """
    pieces = F.array_sort(F.collect_list(F.struct("seq_in_parent", "doc", "text")))  # one paragraph
    text = F.regexp_replace(F.array_join(F.transform(pieces, lambda p: p["text"]), ""), "[\r\n]+", " ")
    rows = chunks.where("parent_id is not null and text is not null").groupBy("chapter", "parent_id").agg(text.alias("t"))
    rows.select("chapter", F.concat("parent_id", F.lit("\t"), "t").alias("value")).sortWithinPartitions("chapter", "value").write.mode("overwrite").partitionBy("chapter").text(f"{folder}/segments")
    rows.select("parent_id", "chapter", F.length("t").alias("chars")).write.mode("overwrite").json(f"{folder}/INDEX")


def chunk_rows(chunks: DataFrame, folder: str) -> None:
    """Chunks as parquet partitioned by chapter, so that a chapter's lookup reads its own files only."""
    chunks.write.mode("overwrite").partitionBy("chapter").parquet(folder)


def json_table(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def run_snapshot(results: DataFrame, run_id: str, folder: str) -> None:
    """Results of one run under ``run_id=..``; writing a run again replaces it and no other."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(folder)


def merged_report(new: DataFrame, folder: str, key: str) -> None:
    """A report merged with what ``folder`` holds: rows of ``new`` replace those with the same key."""
    spark = new.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        from inkwell.runtime import cut

        old = cut(spark.read.schema(new.schema).json(folder))  # read before it is overwritten
        new = new.unionByName(old.join(new.select(key), key, "left_anti"))
    new.write.mode("overwrite").json(folder)


def summary_markdown(summary: DataFrame, title: str) -> str:
    """A Markdown table of a small summary (one row per group)."""
    names = summary.columns
    rows = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in summary.collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"# {title}", "", line(names), line(["---"] * len(names)), *(line(r) for r in rows)]) + "\n"


def vector_bytes(vectors: list[list[float]], scheme: int = 1) -> bytes:
    """A small vector file's bytes; the engine's own store is parquet."""
    m = np.asarray(vectors, "<f4")
    return MAGIC + struct.pack("<3I", m.shape[1], m.shape[0], scheme) + m.tobytes()


def result_json(ranked: DataFrame, queries: DataFrame, *fields: Column | str, most: int = 20, no_hit: str = NO_HIT) -> DataFrame:
    """(qid, payload): each query's first results as a JSON array; the fixed text where there are none."""
    kept = ranked.where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("body")))).alias("rows"))
    payload = F.to_json(F.transform("rows", lambda r: r["body"]))
    return queries.select("qid").join(kept, "qid", "left").select("qid", F.coalesce(F.when(F.size("rows") > 0, payload), F.lit(no_hit)).alias("payload"))


def within_budget(candidates: DataFrame, rest: DataFrame | None = None, body: str = "body", budget: int = 65_536) -> DataFrame:
    """(qid, candidates, next, intents, dropped): explanations within ``budget`` bytes per query, in steps.

    ``candidates(qid, rank, body)``, ``rest(qid, next, intents)``; all bodies are JSON texts. Candidates leave from the end
    until what is left fits beside the others; if those alone don't fit, ``next`` goes, then ``intents``. A query keeps
    its row in any case, and ``dropped`` says what went (``candidates``, ``next``, ``intents``).
    """
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    heads = candidates.select("qid").distinct() if rest is None else rest.select("qid", "next", "intents")
    heads = heads if rest is not None else heads.withColumns({"next": F.lit(None).cast("string"), "intents": F.lit(None).cast("string")})
    keep_next, keep_intents = size("next") + size("intents") <= budget, size("intents") <= budget
    lost = F.array_compact(F.array(F.when(~keep_next & F.col("next").isNotNull(), "next"), F.when(~keep_intents & F.col("intents").isNotNull(), "intents")))
    kept = heads.select("qid", F.when(keep_next, F.col("next")).alias("next"), F.when(keep_intents, F.col("intents")).alias("intents"), lost.alias("lost"))
    used = F.sum(F.octet_length(body)).over(Window.partitionBy("qid").orderBy("rank"))  # the candidates of one query
    placed = candidates.withColumn("used", used).join(kept, "qid").withColumn("fits", F.col("used") + size("next") + size("intents") <= budget)
    rows = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", F.col(body).alias("body")))))
    listed = placed.groupBy("qid").agg(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["body"]), ","), F.lit("]")).alias("candidates"), F.bool_or(~F.col("fits")).alias("cut"))
    dropped = F.array_join(F.concat(F.when(F.coalesce("cut", F.lit(False)), F.array(F.lit("candidates"))).otherwise(F.array().cast("array<string>")), "lost"), ",")
    return kept.join(listed, "qid", "left").select("qid", F.coalesce("candidates", F.lit("[]")).alias("candidates"), "next", "intents", dropped.alias("dropped"))


def anchor_summary(counters: DataFrame, misses: DataFrame, title: str, most: int = 20) -> str:
    """A Markdown report of ``evaluate.anchor_counters`` and the first ``most`` missed items(qid, category, rank)."""
    listed = misses.orderBy("category", "qid").limit(most).collect()
    lines = [f"- {r.category} #{r.qid}: {r['rank'] or '-'}" for r in listed]
    return summary_markdown(counters, title) + "\n## misses\n\n" + "\n".join(lines or ["none"]) + "\n"


def group_summary(counters: DataFrame, changes: DataFrame, misses: DataFrame, title: str, most: int = 30) -> str:
    """A Markdown report of ``evaluate.group_counters``, the changes against an earlier run, and the first misses."""
    moved = changes.orderBy("change", "qid").limit(most).collect()
    lines = [f"- {r.change}: #{r.qid} {r.from_status} ({r.from_rank}) to {r.to_status} ({r.to_rank})" for r in moved]
    return anchor_summary(counters, misses, title, most) + "\n## against the run before\n\n" + "\n".join(lines or ["none"]) + "\n"


def entity_file(rows: DataFrame, folder: str, norm_version: str, banned: list[str]) -> None:
    """A merged alias table as one JSON object with its meta and policy; ``generatedAt`` is the digest of the rows.

    The table is configuration that readers load whole; one task writes it.
    """
    from inkwell.operators.entities import content_digest

    digest = content_digest(rows).first().digest
    meta = F.struct(F.lit(1).alias("schemaVersion"), F.lit(norm_version).alias("normVersion"), F.lit(digest).alias("generatedAt"))
    policy = F.struct(F.array(*map(F.lit, banned)).cast("array<string>").alias("bannedRewriteKeys"))
    row = F.struct(F.col("entity_type").alias("type"), F.col("entity_id").alias("id"), "canonical", "aliases", F.col("keys").alias("rewriteKeys"), F.col("fragments").alias("fragmentOnly"))
    listed = rows.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    listed.select(meta.alias("meta"), "rows", policy.alias("policy")).coalesce(1).write.mode("overwrite").json(folder)
