"""Building chunks from source text: headings, lines, verse, blocks, context groups."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as X
from inkwell.runtime import ship, spread

# Block sizes and the marks that end a sentence or close it.
TARGET, CAP, TINY, LEAD = 350, 600, 60, 12
STOPS = "。！？；"
HEADING = "^\\s*(?:正文\\s*)?第([一二三四五六七八九十百零〇两]+)回\\s*(.*)$"
TRIM = " \u3000\t\r\n"
NOISE = "更新时间"
# Words that announce verse.
VERSE_WORDS = ("诗", "歌", "词", "赋", "吟", "赞", "谣", "偈", "古风", "一绝", "联", "祭文", "单道", "正是", "为证", "一首", "八句", "十六字", "口占")


def body_lines(texts: DataFrame) -> DataFrame:
    """(doc, line_no, line): trimmed lines of ``texts(doc, text)`` without blank and noise lines, numbered."""
    parts = F.filter(F.transform(F.split("text", "\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(TRIM))), lambda x: (x != "") & ~x.contains(NOISE))
    return spread(texts.where("text is not null").select("doc", "text")).select("doc", F.posexplode(parts).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def chapters(lines: DataFrame) -> DataFrame:
    """(doc, chapter, title, line_no, line): lines under their heading, numbered anew; heading lines go.

    ``lines(doc, line_no, line)`` of one source per doc: the running count of headings is the chapter's place.
    """
    order = Window.partitionBy("doc").orderBy("line_no")
    marked = lines.withColumn("is_heading", F.col("line").rlike(HEADING)).withColumn("at", F.sum(F.col("is_heading").cast("int")).over(order))
    heads = marked.where("is_heading").select("doc", "at", X.cn2int(F.regexp_extract("line", HEADING, 1)).alias("chapter"), F.trim(F.regexp_extract("line", HEADING, 2)).alias("title"))
    inner = Window.partitionBy("doc", "at").orderBy("line_no")
    body = marked.where("not is_heading and at > 0").withColumn("line_no", F.row_number().over(inner))
    return body.join(heads, ["doc", "at"]).select("doc", "chapter", "title", "line_no", "line")


def is_lead(line: Column | str) -> Column:
    c = X.col(line)
    return c.endswith("：") & (F.length(c) <= LEAD) & ~c.rlike(f"[{STOPS}]")


def outside_quotes(c: Column) -> Column:
    """The text that no curly quotation holds, with the marks; a quotation that never closes holds the rest, a mark
    that closes nothing is passed over. Marks stay, so that words on both sides of one never join."""
    runs = F.regexp_extract_all(c, F.lit("[“‘]|[”’]|[^“‘”’]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, run: Column) -> Column:
        opens, closes = run.isin("“", "‘"), run.isin("”", "’")
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(opens | closes | (s["depth"] == 0), F.concat(s["out"], run)).otherwise(s["out"]).alias("out"))

    return F.aggregate(runs, start, step, lambda s: s["out"])


def announces_verse(line: Column | str) -> Column:
    words, c = "|".join(VERSE_WORDS), X.col(line)
    return c.rlike(words) & outside_quotes(c).rlike(words)


def looks_like_verse(line: Column | str, long: tuple[int, int] = (2, 9), short: tuple[int, int] = (4, 5)) -> Column:
    """No quotes, and either ``long``[0] semicolons with clauses of at most ``long``[1] characters or at least
    ``short``[0] clauses of at most ``short``[1]."""
    c = X.col(line)
    a, b = X.clause_lengths(c), X.clause_lengths(c, "[，。；！？：、]")
    paired = (F.length(c) - F.length(F.replace(c, F.lit("；"), F.lit(""))) >= long[0]) & (F.size(a) > 0) & (F.array_max(a) <= long[1])
    brief = (F.size(b) >= short[0]) & (F.array_max(b) <= short[1])
    return ~c.rlike("[“‘”’]") & (F.coalesce(paired, F.lit(False)) | F.coalesce(brief, F.lit(False)))


def cascade(lines: DataFrame, key: str, order: str, base: Column, follows: Column, out: str = "verse") -> DataFrame:
    """A line is marked when ``base`` holds, or when it ``follows`` and the line before is marked (itself perhaps
    by following): islands start at every line that is neither, and are marked from their first base on."""
    by = Window.partitionBy(key).orderBy(order)
    rows = lines.withColumn("__b", F.coalesce(base, F.lit(False))).withColumn("__f", F.coalesce(follows, F.lit(False)))
    island = F.sum((~F.col("__b") & ~F.col("__f")).cast("int")).over(by)
    inner = Window.partitionBy(key, "__i").orderBy(order)
    seen = F.max(F.col("__b").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    breaks = ~F.col("__b") & ~F.col("__f")
    return rows.withColumn("__i", island).withColumn(out, F.when(breaks, F.lit(False)).otherwise(seen == 1)).drop("__b", "__f", "__i")


def line_kinds(lines: DataFrame) -> DataFrame:
    """``verse`` and ``role`` of numbered lines: announced verse, lines after an announcement, and followers."""
    before = F.lag("line").over(Window.partitionBy("doc").orderBy("line_no"))
    rows = lines.withColumn("__before", before)
    # the last two sentences of the line before
    tail = F.regexp_extract("__before", f"([^{STOPS}]*[{STOPS}]?[^{STOPS}]*)$", 1)
    alone = F.col("line").endswith("：") & ~F.col("line").rlike(f"[{STOPS}]") & announces_verse("line")
    after = F.col("__before").endswith("：") & announces_verse(tail)
    return cascade(rows, "doc", "line_no", alone | after, looks_like_verse("line")).withColumn("role", F.when(is_lead("line"), "lead").otherwise("body")).drop("__before")


_SENTENCE = re.compile(f"[{STOPS}][”’』」》】]*|[“‘]|[”’]")


def sentence_cuts(text: str) -> tuple[list[int], list[int]]:
    """(ends of all sentences, those outside quotations); the rest after the last mark ends at the text's end."""
    ends, legal, depth = [], [], 0
    for m in _SENTENCE.finditer(text):
        run = m.group()
        if run in "“‘":
            depth += 1
            continue
        depth = max(0, depth - sum(c in "”’" for c in run))
        if run[0] in STOPS:
            ends.append(m.end())
            if depth == 0:
                legal.append(m.end())
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends, legal


def pack_blocks(text: str, target: int = TARGET, cap: int = CAP, tiny: int = TINY) -> list[str]:
    """Blocks of whole sentences: closed at the first legal cut from ``target`` on, and before ``cap`` is passed
    at the last legal one; a quotation without a legal cut stays whole. A last block under ``tiny`` joins the
    one before where both fit. The blocks concatenate to the text."""
    if len(text) <= cap:
        return [text]
    ends, legal = sentence_cuts(text)
    legal_set = set(legal)
    cuts, start, before, k = [], 0, 0, 0
    open_: list[int] = []  # legal cuts since start
    for end in ends:
        while end - start > cap and open_:
            start = open_[-1]
            cuts.append(start)
            open_.clear()
        if end in legal_set:
            open_.append(end)
            if end - start >= target:
                cuts.append(end)
                start = end
                open_.clear()
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    blocks = [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    if len(blocks) > 1 and len(blocks[-1]) < tiny and len(blocks[-2]) + len(blocks[-1]) <= cap:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    return blocks


def packed(texts: DataFrame) -> DataFrame:
    """(doc, seq, text, char_count): blocks of ``texts(doc, text)``; null texts give none, empty ones one."""
    ship(texts.sparkSession)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, b in enumerate(pack_blocks(t), 1):
                    for o, v in zip(out, (d, i, b, len(b)), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["doc", "seq", "text", "char_count"])

    return spread(texts.where("text is not null").select(F.col("doc").cast("bigint").alias("doc"), "text")).mapInArrow(run, "doc bigint, seq int, text string, char_count int")


def chunk_ids(source: str, blocks: DataFrame) -> DataFrame:
    """``parent_id`` and ``chunk_id`` of blocks with chapter, segment_no and seq."""
    parent = F.format_string(source + ":%04d:p%04d", "chapter", "segment_no")
    return blocks.withColumn("parent_id", parent).withColumn("chunk_id", F.format_string("%s:c%02d", "parent_id", "seq"))


def adjoining_ranges(rows: DataFrame, size: int = 10) -> DataFrame:
    """(group_id, chapter, seg_start, seg_end): ranges of ``size`` segments side by side, from 1 up to the largest
    segment that ``rows(chapter, segment_no)`` have in the chapter; a chapter without a segment has none."""
    last = rows.where("chapter is not null and segment_no >= 1").groupBy("chapter").agg(F.max("segment_no").alias("last"))
    starts = last.select("chapter", F.explode(F.sequence(F.lit(1), "last", F.lit(size))).alias("seg_start"))
    return starts.select(F.format_string("g%04d-%03d", "chapter", "seg_start").alias("group_id"), "chapter", "seg_start", (F.col("seg_start") + size - 1).alias("seg_end"))


def in_ranges(rows: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the group whose range of segments holds them: ranges are unrolled, so the join is on equality.

    ``rows(chapter, segment_no, ..)``, ``ranges(group_id, chapter, seg_start, seg_end)``. With ``how`` "left" rows
    outside all ranges stay, with a null group_id.
    """
    unrolled = ranges.where("seg_start <= seg_end").select("group_id", "chapter", F.explode(F.sequence("seg_start", "seg_end")).alias("segment_no"))
    return rows.join(unrolled, ["chapter", "segment_no"], how)


def adjacent_chapters(present: DataFrame) -> DataFrame:
    """(source, chapter, prev, next) of ``present(source, chapter)``: neighbours by number; a gap gives null."""
    own = present.select("source", "chapter").distinct()
    p = own.select("source", (F.col("chapter") + 1).alias("chapter"), F.col("chapter").alias("prev"))
    n = own.select("source", (F.col("chapter") - 1).alias("chapter"), F.col("chapter").alias("next"))
    return own.join(p, ["source", "chapter"], "left").join(n, ["source", "chapter"], "left")


def parents_joined(chunks: DataFrame) -> DataFrame:
    """(parent_id, pieces, chars, digest): a parent's pieces in order (sequence, then row) as one text.

    ``chunks(parent_id, seq, doc, text)``; the group is one paragraph.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "doc", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    rows = chunks.where("parent_id is not null and text is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.length("text")).alias("chars"), joined.alias("__t"))
    return rows.select("parent_id", "pieces", "chars", F.md5("__t").alias("digest"))
