"""Readers of the corpus, its side tables and evaluation files."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.runtime import ship

CHAPTER = (
    "source string, chapter int, title string, chunks array<struct<chunk_id:string,parent_id:string,seq_in_parent:int,type:string,role:string,text:string,char_count:int,group_id:string>>"
)
ENTITY = "meta struct<schemaVersion:int,normVersion:string,generatedAt:string>, rows array<struct<type:string,id:string,canonical:string,aliases:array<string>,rewriteKeys:array<string>,fragmentOnly:array<string>,organGuard:string,note:string>>, policy struct<bannedRewriteKeys:array<string>,ambiguityGuard:array<struct<term:string,bad:array<array<string>>>>>"
GROUP = "meta struct<schemaVersion:int,normVersion:string,generatedAt:string,corpusChunkCount:int>, rows array<struct<eventId:string,eventName:string,aliases:array<string>,chunkIds:array<string>,type:string,exampleQuestion:string>>"
QUESTION = "question string, options map<string,string>, answer string"
OPTIONS = ("A", "B", "C", "D")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of chapter files ``NNN.json`` with chapter and title; ``doc`` follows file and place.

    Files that aren't valid JSON of this form fail the read; a type or role outside its domain fails the
    query. The ordinal is computed per file, then shifted by the files before it, so no task orders all rows.
    """
    files = spark.read.schema(CHAPTER).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "[0-9][0-9][0-9].json").json(folder)
    named = files.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{3})", 1))
    rows = named.select("file", "source", "chapter", "title", F.posexplode("chunks").alias("place", "c"))
    sizes = named.select("file", F.size("chunks").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # one row per file, at most a thousand names NNN
    checked = F.when(F.col("c.type").isin("prose", "verse") & F.col("c.role").isin("body", "lead"), F.col("c.type")).otherwise(F.raise_error(F.concat(F.lit("type or role outside its domain: "), F.col("c.chunk_id"))))
    return rows.join(before, "file").select(
        (F.col("before") + F.col("place")).cast("bigint").alias("doc"), "source", "chapter", "title", "c.chunk_id", "c.parent_id", "c.seq_in_parent",
        checked.alias("chunk_type"), F.col("c.role").alias("role"), "c.text", "c.char_count", "c.group_id",
    )


def tags(spark: SparkSession, *files: str) -> DataFrame:
    """(chunk_id, tags) of JSON objects; a key in several files has its tags joined in the order given."""
    parts = [
        spark.read.text(f, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("chunk_id", "tags"), F.lit(i).alias("ord")) for i, f in enumerate(files)
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "tags")))  # at most one row per file
    return every.where("tags is not null").groupBy("chunk_id").agg(F.array_join(F.transform(ordered, lambda x: x["tags"]), "|").alias("tags"))


def entity_table(spark: SparkSession, file: str) -> tuple[DataFrame, bool]:
    """(rows in the engine's columns, degraded): another version, no rows or no policy degrade to no rows."""
    raw = spark.read.schema(ENTITY).option("multiLine", True).option("mode", "PERMISSIVE").json(file)
    ok = bool(raw.where("meta.schemaVersion = 1 and size(rows) > 0 and policy is not null").limit(1).count())
    rows = raw.where(F.lit(ok)).select(F.posexplode("rows").alias("place", "r")).select(
        "place", F.col("r.id").alias("entity_id"), F.col("r.type").alias("entity_type"), "r.canonical", "r.aliases",
        F.col("r.rewriteKeys").alias("rewritekeys"), F.col("r.fragmentOnly").alias("fragmentonly"), F.col("r.organGuard").alias("organguard"), "r.note",
    )
    return rows, not ok


def group_table(spark: SparkSession, file: str) -> tuple[DataFrame, bool]:
    """(groups in the engine's columns, degraded): missing meta fields or rows degrade to no rows."""
    raw = spark.read.schema(GROUP).option("multiLine", True).option("mode", "PERMISSIVE").json(file)
    ok = bool(raw.where("meta.normVersion <> '' and meta.corpusChunkCount is not null and rows is not null").limit(1).count())
    never = F.lit(None).cast("timestamp_ntz")
    rows = raw.where(F.lit(ok)).select(F.posexplode("rows").alias("place", "r")).select(
        F.col("r.eventId").alias("eventid"), F.col("r.eventName").alias("eventname"), "r.aliases", F.col("r.chunkIds").alias("chunkids"), F.col("r.type").alias("group_type"),
        F.col("r.exampleQuestion").alias("examplequestion"), F.timestamp_seconds("place").cast("timestamp_ntz").alias("recorded_at"),  # file order
        never.alias("arrived_at"),
    )
    return rows, not ok


def valid_questions(rows: DataFrame) -> DataFrame:
    """Rows with a question, all four options, and an answer among them."""
    o = F.col("options")
    present = F.forall(F.array(*[F.lit(k) for k in OPTIONS]), lambda k: F.coalesce(F.trim(o[k]), F.lit("")) != "")
    return rows.where((F.coalesce(F.trim("question"), F.lit("")) != "") & o.isNotNull() & present & F.array_contains(F.map_values("options"), F.trim("answer")))


def question_bank(spark: SparkSession, file: str) -> DataFrame:
    return valid_questions(spark.read.schema(QUESTION).option("multiLine", True).option("mode", "PERMISSIVE").json(file))


def questions(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.schema("question string, source string").option("multiLine", True).json(file)


def markdown_items(spark: SparkSession, file: str, categories: dict[str, str] | None = None) -> DataFrame:
    """(category, num, question, answer, evidence) of a Markdown evaluation file.

    Rows are table lines whose first cell is a number; evidence is the cell before the last border. The
    category is the nearest ``##`` heading above; with ``categories`` (heading text to id) others are null.
    """
    lines = spark.read.text(file, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1 << 20)))
    filled = lines.withColumn("heading", F.last(heading, ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # one file
    cells = F.transform(F.split("line", "\\|"), lambda c: F.trim(c))
    rows = filled.where(F.col("line").startswith("|")).select("heading", cells.alias("c")).where("size(c) >= 5").where(F.col("c")[1].rlike("^\\d+$"))
    category = F.element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("heading")) if categories else F.col("heading")
    return rows.select(category.alias("category"), F.col("c")[1].cast("int").alias("num"), F.col("c")[2].alias("question"), F.col("c")[3].alias("answer"), F.element_at("c", -2).alias("evidence"))


def markdown_rows(spark: SparkSession, file: str) -> DataFrame:
    """(line_no, cells) of all table lines of a Markdown file, separator lines left out; for catalogues."""
    lines = spark.read.text(file, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("line like '|%'")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), "\\|"), lambda c: F.trim(c))
    return lines.where(~F.col("line").rlike(r"^[|\s:-]+$")).select("line_no", cells.alias("cells"))


def group_evaluation(spark: SparkSession, file: str) -> DataFrame:
    """(id, category, question, chunk_ids, seg_count, cross_chapter); a missing field fails the query."""
    schema = "meta map<string,string>, rows array<struct<id:string,category:string,question:string,chunkIds:array<string>,segCount:int,crossChapter:boolean>>"
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(file).select(F.explode("rows").alias("r")).select("r.*")
    need = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"evaluation row without {c}")))
    return r.select(need("id").alias("id"), need("category").alias("category"), need("question").alias("question"), need("chunkIds").alias("chunk_ids"), need("segCount").alias("seg_count"), need("crossChapter").alias("cross_chapter"))


def novel_lines(spark: SparkSession, file: str) -> DataFrame:
    """(doc, text) of a plain text file, for ``operators.corpus``."""
    return spark.read.text(file, wholetext=True).select(F.lit(0).cast("bigint").alias("doc"), F.col("value").alias("text"))


def context_ranges(spark: SparkSession, file: str) -> DataFrame:
    """(group_id, chapter, seg_start, seg_end); a range that ends before it starts fails the query."""
    rows = spark.read.schema("groups array<struct<groupId:string,chapter:int,segStart:int,segEnd:int>>").option("multiLine", True).option("mode", "FAILFAST").json(file).select(F.explode("groups").alias("g")).select("g.*")
    start = F.when(F.col("segStart") <= F.col("segEnd"), F.col("segStart")).otherwise(F.raise_error(F.concat(F.lit("empty range: "), F.col("groupId"))))
    return rows.select(F.col("groupId").alias("group_id"), "chapter", start.alias("seg_start"), F.col("segEnd").alias("seg_end"))


# The first bytes of a vector file.
MAGIC = b"SNGV"


def vector_file(spark: SparkSession, file: str, expected: int | None = None) -> DataFrame:
    """(doc, embedding) of a vector file: magic, dimension, count and scheme (little-endian), then floats.

    Wrong magic, a truncated body or another count than ``expected`` give no rows.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                if len(content) < 16 or content[:4] != MAGIC:
                    continue
                dim, count, _ = struct.unpack("<3I", content[4:16])
                if not dim or len(content) - 16 != 4 * dim * count or expected not in (None, count):
                    continue
                values = pa.array(np.frombuffer(content, "<f4", offset=16))
                step = max(1, (1 << 20) // dim)
                for a in range(0, count, step):
                    b = min(count, a + step)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * dim + 1, dim, dtype=np.int32)), values[a * dim : b * dim])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], ["doc", "embedding"])

    return spark.read.format("binaryFile").load(file).select("content").mapInArrow(run, "doc bigint, embedding array<float>")


def run_snapshot(spark: SparkSession, folder: str, run_id: str, schema: str) -> DataFrame:
    """The results of one run; an id of another form, or none of that name, fails."""
    if not re.fullmatch(RUN_ID, run_id):
        raise ValueError(f"no run id: {run_id!r}")
    return spark.read.schema(schema).json(f"{folder}/run_id={run_id}")


RUN_ID = r"^[a-z0-9-]+-\d{4}-\d{2}-\d{2}-\d{4}(\d{2})?$"


def run_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, path) of snapshot folders, newest first; names that aren't run ids are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path")
    run = F.regexp_extract("path", r"run_id=([^/]+)/", 1)
    return files.select(run.alias("run_id")).where(F.col("run_id").rlike(RUN_ID)).distinct().orderBy(F.desc(F.substring_index("run_id", "-", -4)), F.desc("run_id"))


# --- JSON payloads of web services ----------------------------------------------------------------

ALERTS = "features array<struct<properties:struct<event:string,areaDesc:string,severity:string,status:string,headline:string>>>"
FORECAST = "properties struct<periods:array<struct<name:string,temperature:int,temperatureUnit:string,windSpeed:string,windDirection:string,shortForecast:string>>>"


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def alert_rows(payloads: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` alerts of each payload(id, body) with defaults; unreadable bodies give none."""
    p = payloads.select("id", F.from_json("body", ALERTS).alias("p")).select("id", F.posexplode("p.features").alias("place", "f")).where(F.col("place") < most)
    names = ("event", "areaDesc", "severity", "status", "headline")
    return p.select("id", "place", *[_or_unknown(F.col(f"f.properties.{n}")).alias(n) for n in names])


def forecast_rows(payloads: DataFrame) -> DataFrame:
    """Forecast periods; a temperature of 0 is a temperature, only null is unknown."""
    p = payloads.select("id", F.from_json("body", FORECAST).alias("p")).select("id", F.posexplode("p.properties.periods").alias("place", "f"))
    unit = F.coalesce(F.nullif(F.col("f.temperatureUnit"), F.lit("")), F.lit("F"))
    degrees = F.coalesce(F.col("f.temperature").cast("string"), F.lit("Unknown"))
    return p.select("id", "place", _or_unknown(F.col("f.name")).alias("name"), F.concat(degrees, F.lit("°"), unit).alias("temperature"), F.concat_ws(" ", _or_unknown(F.col("f.windSpeed")), F.coalesce("f.windDirection", F.lit(""))).alias("wind"), _or_unknown(F.col("f.shortForecast")).alias("forecast"))


def point_path(latitude: Column, longitude: Column) -> Column:
    return F.concat_ws(",", F.format_string("%.4f", latitude), F.format_string("%.4f", longitude))


