"""Queries over evaluation, the question bank, corpus building, and data quality."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import bank as B
from inkwell.operators import corpus as C
from inkwell.operators import evaluate as V
from inkwell.operators import quality as Q
from inkwell.operators import retrieval as R
from inkwell.operators.intents import BIRTH, DEATH_GATE, INTENTS, intent_of
from inkwell.plans import frames as P
from inkwell.plans import naming, search
from inkwell.plans.frames import chunks, fixed_sql, query_vectors, questions, vectors, with_
from inkwell.runtime import cut, table

DEPTH = 50

# --- evaluation: vectors of the query set against all rows, relevant rows carry the same label -----------


def _ranking(spark: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    q, v = query_vectors(spark, d), vectors(spark, d)
    if dims:
        q, v = (f.withColumn("embedding", F.slice("embedding", 1, dims)) for f in (q, v))
    scores = R.cosine_scores(q, v, DEPTH + 1).where("qid <> doc")
    return R.top_k(scores, DEPTH, X.fixed(F.col("cosine"), 6).desc(), F.col("doc")).select("qid", "doc", "rank")


def _relevant(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    asked = e.where("doc % 100 = 0").select(F.col("doc").alias("qid"), "label")
    relevant = asked.join(e, "label").where("qid <> doc").select("qid", "doc")
    sizes = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("seg_count"))
    items = asked.join(sizes, "qid", "left").select("qid", F.concat(F.lit("label-"), F.col("label")).alias("category"), F.coalesce("seg_count", F.lit(0)).alias("seg_count"))
    return relevant, items


def _results(spark: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    relevant, items = _relevant(spark, d)
    return V.hit_results(_ranking(spark, d, dims), relevant, items)


def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


def cover_at_5(spark: SparkSession, d: str) -> DataFrame:
    return V.summarize(_results(spark, d))


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """All dimensions against the first two."""
    return V.compare_runs(_results(spark, d), _results(spark, d, 2))


def top10_overlap(spark: SparkSession, d: str) -> DataFrame:
    return V.overlap(_ranking(spark, d), _ranking(spark, d, 16), 10)


def rank_changes(spark: SparkSession, d: str) -> DataFrame:
    return V.rank_changes(_ranking(spark, d), _ranking(spark, d, 16), _relevant(spark, d)[0], 10)


def group_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the ranking with what bridges the questions of the same ids have."""
    hit = P.corpus(spark, d).keys
    matched = naming.G.bridges(questions(spark, d), hit).groupBy("qid").agg(F.max(F.col("kind") == "event").alias("event_bridge"), F.max(F.col("kind") == "allusion").alias("allusion_bridge"))
    no = F.lit(False)
    return V.group_counters(_results(spark, d).join(matched, "qid", "left").withColumns({"event_bridge": F.coalesce("event_bridge", no), "allusion_bridge": F.coalesce("allusion_bridge", no)}))


def rerank_failures(spark: SparkSession, d: str) -> DataFrame:
    return V.rerank_failures(_ranking(spark, d), _ranking(spark, d, 16), _relevant(spark, d)[0])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document, and one more item per chapter (negative) whose evidence quotes a stored text."""
    c = chunks(spark, d).where("source = 'sanguo-yanyi' and length(text) >= 12 and chapter is not null")
    first = c.groupBy("chapter").agg(F.min("doc").alias("doc"), F.min_by("text", "doc").alias("text"))
    quoting = first.select((-F.col("doc")).alias("item"), F.concat(F.lit("第"), F.col("chapter").cast("string"), F.lit("回：“"), F.substring("text", 1, 12), F.lit("”")).alias("text"))
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item"), "text").unionByName(quoting)


def anchor_extract(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of every document."""
    return _texts(spark, d).select("item", F.explode(V.text_anchors("text")).alias("anchor"))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return cut(chunks(spark, d).where("text is not null").select(F.col("doc").alias("rank"), X.evidence_form("text").alias("form")), codec="zstd")


def anchor_match(spark: SparkSession, d: str) -> DataFrame:
    return V.first_anchor(cut(anchor_extract(spark, d)), _forms(spark, d))


def no_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Evidence without any anchor in the corpus, which evaluation leaves out of its total."""
    return _texts(spark, d).select("item").join(anchor_match(spark, d).select("item"), "item", "left_anti")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items for the query set: the chunk of the same id is the evidence; every third item cites its
    chapter's title only, one in three a chapter it isn't in."""
    c = chunks(spark, d).select(F.col("doc").alias("qid"), "chapter", "title", "text")
    q = questions(spark, d).select("qid", F.pmod(F.floor(F.col("qid") / 100), F.lit(3)).alias("kind"))
    number = F.when(F.col("kind") == 2, F.col("chapter") + 1).otherwise(F.col("chapter")).cast("string")
    quoted = F.when(F.col("kind") == 1, F.concat(F.lit("第"), number, F.lit("回目：“"), "title", F.lit("”"))).otherwise(F.concat(F.lit("第"), number, F.lit("回：“"), F.substring("text", 1, 12), F.lit("”")))
    return q.join(c, "qid").select("qid", F.concat(F.lit("kind-"), F.col("kind").cast("string")).alias("category"), F.coalesce(quoted, F.lit("")).alias("evidence"))


def evidence_results(spark: SparkSession, d: str) -> DataFrame:
    """Rank and tier of the evidence in the first 50 of the search, rank of its chapter, and whether it can be found at all."""
    items = cut(V.evidence_items(evidence(spark, d)))
    c = chunks(spark, d)
    ranked = search.best(spark, d, DEPTH).where("qid > 0").select("qid", "doc", "rank")
    entries = cut(ranked.join(c.select("doc", "chapter", "title", "text"), "doc"))
    found = V.match_evidence(items, entries)
    chapters = V.chapter_rank(items.select("qid", F.col("chapter_refs").alias("chapters")), entries.select("qid", "chapter", "rank"))
    there = V.locatable(items, c).withColumn("no_anchor", F.lit(False))
    out = items.select("qid", "category").join(found, "qid").join(chapters, "qid").join(there, "qid", "left")
    return out.select("qid", "category", F.col("rank").cast("bigint").alias("rank"), "tier", F.col("chapter_rank").cast("bigint").alias("chapter_rank"), F.coalesce("no_anchor", F.lit(True)).alias("no_anchor"))


def anchor_counters(spark: SparkSession, d: str) -> DataFrame:
    return V.anchor_counters(evidence_results(spark, d))


# --- question bank ----------------------------------------------------------------------------------


def _bank(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bank = table(spark, d, "event_question_pool").where("question is not null").select(F.col("question_id").alias("id"), F.col("question").alias("text"))
    return bank.where("id % 100 = 0"), bank


def dice_topk(spark: SparkSession, d: str) -> DataFrame:
    return B.dice_top(*_bank(spark, d))


def hash_vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest bank rows by hashed vectors."""
    q, b = _bank(spark, d)
    return B.hashed_top(q, b).select("qid", "id", X.fixed(F.col("similarity"), 6).alias("similarity"), "rank")


def route_known(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the query set against all others of the bank."""
    return B.route(*_bank(spark, d), own=True)


def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.fnv1a32("p_name").alias("hash"))


def lexical_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.bank_form("p_name").alias("form")).select("k", X.route_signature("form").alias("s"))
    nxt = p.select((F.col("k") - 1).alias("k"), F.col("s").alias("other"))
    return p.join(nxt, "k").select("k", X.fixed(X.lexical_similarity("s", "other"), 6).alias("similarity"))


def bank_form(spark: SparkSession, d: str) -> DataFrame:
    return _bank(spark, d)[1].select("id", X.bank_form("text").alias("form"))


#: one question of every kind, beside those of the tables
ASKED = (
    "他是被谁杀死的", "丧命何处", "他何时战死", "享年多少", "他死了吗？", "死因为何", "临终说了什么", "死后谁继任", "第一次登场是哪一回",
)


def intent_class(spark: SparkSession, d: str) -> DataFrame:
    """Death intent and birth intent of every question of the pool, of the cases, and of one question of every kind."""
    more = spark.createDataFrame([(-101 - i, t) for i, t in enumerate(ASKED)], "qid bigint, text string")
    qs = questions(spark, d, 1).unionByName(P.cases(spark, d)).unionByName(more)
    return qs.select("qid", intent_of("text").alias("death"), F.col("text").rlike(BIRTH).alias("birth")).where("death is not null or birth")


# --- corpus building --------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return C.body_lines(chunks(spark, d).select("doc", "text"))


def body_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc", "line_no", F.length("line").alias("chars"), C.is_lead("line").alias("lead"))


def verse_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Lines of short clauses after the first line of a text count as its continuation."""
    short = C.looks_like_verse("line", short=(2, 8))
    return C.cascade(_lines(spark, d), "doc", "line_no", (F.col("line_no") == 1) & short, short).select("doc", "line_no", "verse")


def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    return C.line_kinds(_lines(spark, d)).select("doc", "line_no", "verse", "role")


def block_packing(spark: SparkSession, d: str) -> DataFrame:
    return C.packed(chunks(spark, d).select("doc", "text"))


def packed_concat(spark: SparkSession, d: str) -> DataFrame:
    """Blocks joined again: the digest of every text's blocks is the text's own."""
    blocks = C.packed(chunks(spark, d).select("doc", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return blocks.groupBy("doc").agg(F.md5(joined).alias("digest"), F.sum("char_count").alias("chars"))


def parent_concat_check(spark: SparkSession, d: str) -> DataFrame:
    return C.parents_joined(chunks(spark, d).select("parent_id", F.col("seq_in_parent").alias("seq"), "doc", "text"))


def interval_group_join(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its context group of ten segments: the ranges adjoin and reach each chapter's last segment.

    Chunks without a segment number (null or malformed ids) or chapter are kept with a null group.
    """
    segment = F.when(F.col("chunk_id").rlike(X.CHUNK_ID), F.regexp_extract("chunk_id", X.CHUNK_ID, 2).cast("int"))
    rows = chunks(spark, d).select("doc", "chapter", segment.alias("segment_no"))
    return C.in_ranges(rows, C.adjoining_ranges(rows), "left").select("doc", "group_id")


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, chunks, chars) of every context group."""
    sized = interval_group_join(spark, d).where("group_id is not null").join(chunks(spark, d).select("doc", F.length("text").alias("n")), "doc")
    return sized.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chars"))


def adjacent_chapters(spark: SparkSession, d: str) -> DataFrame:
    return C.adjacent_chapters(chunks(spark, d))


def chapter_payload(spark: SparkSession, d: str) -> DataFrame:
    """Per edition and chapter: chunks, characters, title and neighbours."""
    c = chunks(spark, d)
    sums = c.groupBy("source", "chapter").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.max("title").alias("title"))
    return sums.join(C.adjacent_chapters(c), ["source", "chapter"])


def inner_order(spark: SparkSession, d: str) -> DataFrame:
    o = X.inner_order("chunk_id")
    return chunks(spark, d).select("doc", o["chapter_no"].alias("chapter_no"), o["segment_no"].alias("segment_no"), o["sequence_no"].alias("sequence_no"))


def cn_numerals(spark: SparkSession, d: str) -> DataFrame:
    """All numerals in the texts with their values and how often they occur: whole runs, of which STANDARD tells the numerals."""
    found = chunks(spark, d).where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("[零〇一二两三四五六七八九十百]+"), F.lit(0))).alias("numeral"))
    counted = found.groupBy("numeral").agg(F.count(F.lit(1)).alias("times"))
    return counted.where(F.translate("numeral", "〇", "零").rlike(STANDARD)).select("numeral", "times", X.cn2int("numeral").alias("value"))


STANDARD = "^([一二两三四五六七八九]百)?零?([一二两三四五六七八九]?十)?[一二两三四五六七八九]?$"


def clause_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = X.clause_lengths("text")
    return chunks(spark, d).where("text <> ''").select("doc", F.size(n).alias("clauses"), F.coalesce(F.array_max(n), F.lit(0)).alias("longest"))


UNBALANCED = ((-1, "“甲"), (-2, "乙”“"), (-3, "“丙‘丁’"), (-4, "“戊‘己’”"))


def quote_balance(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose quotes don't balance, among the stored ones and four more."""
    depth = X.quote_depth("text")
    more = spark.createDataFrame(list(UNBALANCED), "doc bigint, text string")
    return chunks(spark, d).where("text is not null").select("doc", "text").unionByName(more).select("doc", depth["lowest"].alias("lowest"), depth["final"].alias("final")).where("lowest < 0 or final <> 0")


def corpus_invariants(spark: SparkSession, d: str) -> DataFrame:
    return Q.corpus_checks(table(spark, d, "sanguo_yanyi"))


# --- quality and sessions ---------------------------------------------------------------------------


def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    ranks = Q.nearest_rank(li, "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, ["l_returnflag"])
    stats = li.groupBy("l_returnflag").agg(F.count("l_extendedprice").alias("n"), X.fixed(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return stats.join(ranks, "l_returnflag")


def ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.sum("l_extendedprice") / F.sum("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(X.fixed(ratio, 4).alias("price_per_unit"))


def fill_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase value each user had made up to every event."""
    e = table(spark, d, "events")
    filled = Q.fill_forward(e, "user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase")
    return filled.select("event_id", "user_id", "last_purchase")


def session_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Events inside a session that a signup opened at most 30 minutes before."""
    s = Q.sessions_with_ttl(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "signup")
    return s.where("active").select("event_id", "user_id", "opened_at")


def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_wins(table(spark, d, "documents").where("text is not null"), F.md5("text"), "doc_id")


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digest of a reference table: rows as text in key order, the first eight hex digits."""
    line = F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    rows = F.array_sort(F.collect_list(line))  # 25 rows
    return table(spark, d, "nation").agg(F.substring(F.sha2(F.array_join(rows, "\n"), 256), 1, 8).alias("digest"), F.count(F.lit(1)).alias("rows"))


def json_features(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("with_k"), F.sum("p.k").alias("sum_k"), F.max("p.k").alias("max_k"))


def coverage_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name a group, by source and overall."""
    qs = table(spark, d, "event_question_pool").where("question is not null").select(F.col("question_id").alias("qid"), F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"))
    hit = naming.bridge_match(spark, d).select("qid", F.lit(1).alias("hit")).distinct()
    return qs.join(hit, "qid", "left").rollup("source").agg(F.count(F.lit(1)).alias("questions"), F.count("hit").alias("covered"), X.fixed(F.count("hit") / F.count(F.lit(1)), 6).alias("coverage"))


def time_keys(spark: SparkSession, d: str) -> DataFrame:
    """Run ids and size buckets."""
    e = table(spark, d, "events")
    return e.select("event_id", X.run_id("run", "ts").alias("run_id"), X.run_id("run", "ts", seconds=True).alias("run_id_seconds"), X.size_bucket((F.col("event_id") % 15) + 1).alias("bucket"))


QUERIES = {
    f.__name__: f
    for f in (
        hit_at_k, cover_at_5, group_counters, compare_runs, top10_overlap, rank_changes, rerank_failures, anchor_extract, anchor_match, no_anchor, evidence_results, anchor_counters, dice_topk, hash_vector_cosine, route_known, fnv_hash,
        lexical_similarity, bank_form, intent_class, body_lines, verse_cascade, line_kinds, block_packing, packed_concat, parent_concat_check, interval_group_join, group_sizes,
        adjacent_chapters, chapter_payload, inner_order, cn_numerals, clause_metrics, quote_balance, corpus_invariants, percentile_nearest, ratio_of_sums, fill_forward,
        session_ttl, dedupe_first_wins, content_hash, json_features, coverage_by_source, time_keys,
    )
}

# --- SQL ------------------------------------------------------------------------------------------


def _rank_sql(name: str, dims: int | None = None) -> str:
    cut_ = f"[:{dims}]" if dims else ""
    cos = P.COSINE.format(f"a.embedding{cut_}", f"b.embedding{cut_}")
    return f"""{name} AS (SELECT qid, doc, rank FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY c DESC, doc) AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS doc, {fixed_sql(cos, 6)} AS c FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= {DEPTH})"""


REL = """rel AS (SELECT a.vec_id AS qid, b.vec_id AS doc FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
items AS (SELECT e.vec_id AS qid, 'label-' || e.label AS category, (SELECT count(*) FROM rel WHERE rel.qid = e.vec_id) AS seg_count FROM embeddings e WHERE e.vec_id % 100 = 0)"""


def _results_sql(name: str, ranking: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN first_rank BETWEEN 1 AND 5 THEN 'hit5' WHEN first_rank BETWEEN 6 AND 10 THEN 'hit10' WHEN first_rank > 10 THEN 'hit50' ELSE 'miss' END AS status FROM (
  SELECT i.qid, i.category, i.seg_count, coalesce(min(r.rank), 0) AS first_rank, count(CASE WHEN r.rank <= 5 THEN 1 END) AS hits5, count(CASE WHEN r.rank <= 10 THEN 1 END) AS hits10
  FROM items i LEFT JOIN (SELECT {ranking}.* FROM {ranking} SEMI JOIN rel USING (qid, doc)) r ON r.qid = i.qid GROUP BY ALL))"""


BUCKET = "CASE WHEN {0} = 1 THEN 'single' WHEN {0} <= 10 THEN 'several' ELSE 'large' END"
_CLS = {"hit5": 3, "hit10": 2, "hit50": 1, "miss": 0}
_ST = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CLS.items()) + " END"
_FORM = lambda c: f"regexp_replace(regexp_replace({c}, '{X.EVIDENCE_MARKS}', '', 'g'), '{X.BLANKS}', '', 'g')".replace("()'\"", "()''\"")
def anchors_sql(source: str, end: str = "") -> str:
    """CTE anchors (item, anchor) of ``source``, a query of item and text."""
    return f"""ev{end} AS ({source}),
quoted{end} AS (SELECT item, unnest(regexp_extract_all(text, '{V.QUOTED}', 1)) AS q FROM ev{end}),
seg{end} AS (SELECT item, trim(regexp_replace(s, '{V.ASIDE}', '', 'g')) AS s FROM (SELECT item, unnest(regexp_split_to_array(q, '{V.ELLIPSIS}')) AS s FROM quoted{end})),
anchors{end} AS (SELECT DISTINCT item, {_FORM('a')} AS anchor FROM (SELECT item, s AS a FROM seg{end} WHERE length(s) >= 2
  UNION ALL SELECT item, trim(p) FROM (SELECT item, unnest(regexp_split_to_array(s, '{V.PHRASE_END}')) AS p FROM seg{end}) WHERE length(trim(p)) >= 4) WHERE {_FORM('a')} <> '')"""


ANCHORS = anchors_sql("""SELECT doc_id AS item, text FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT -min(row_id), '第' || chapter || '回：“' || substring(arg_min(text, row_id), 1, 12) || '”' FROM sanguo_yanyi WHERE source = 'sanguo-yanyi' AND length(text) >= 12 AND chapter IS NOT NULL GROUP BY chapter""")
_EVIDENCE = f"""evi AS (SELECT qid, 'kind-' || kind AS category, coalesce(CASE WHEN kind = 1 THEN '第' || c || '回目：“' || title || '”' ELSE '第' || c || '回：“' || substring(text, 1, 12) || '”' END, '') AS evidence FROM (
  SELECT q.qid, (q.qid // 100) % 3 AS kind, CASE WHEN (q.qid // 100) % 3 = 2 THEN s.chapter + 1 ELSE s.chapter END AS c, s.title, s.text FROM q JOIN sanguo_yanyi s ON s.row_id = q.qid WHERE q.qid > 0)),
{anchors_sql("SELECT qid AS item, evidence AS text FROM evi", "_e")},
crefs AS (SELECT DISTINCT qid, CAST(unnest(regexp_extract_all(evidence, '{V.CHAPTER_REF}', 1)) AS INT) AS chapter FROM evi),
tit AS (SELECT DISTINCT qid, CAST(regexp_extract(evidence, '{V.TITLE_REF}', 1) AS INT) AS chapter, {_FORM('trim(t)')} AS title FROM (SELECT qid, evidence, unnest(regexp_extract_all(evidence, '{V.TITLE_REF}', 2)) AS t FROM evi)),
ent AS (SELECT r.qid, r.rank, s.chapter, {_FORM('s.text')} AS form, {_FORM('s.title')} AS tform FROM (SELECT * FROM ({search.RANKED}) WHERE rank <= {DEPTH} AND qid > 0) r JOIN sanguo_yanyi s ON s.row_id = r.doc),
m1 AS (SELECT e.qid, min(e.rank) AS rank FROM ent e JOIN anchors_e a ON a.item = e.qid AND contains(e.form, a.anchor) WHERE e.qid NOT IN (SELECT qid FROM crefs) OR EXISTS (SELECT 1 FROM crefs c WHERE c.qid = e.qid AND c.chapter = e.chapter) GROUP BY e.qid),
m2 AS (SELECT qid, min(rank) AS rank FROM (SELECT e.qid, e.rank FROM ent e JOIN tit t ON t.qid = e.qid AND t.chapter = e.chapter AND contains(e.tform, t.title)
  UNION ALL SELECT e.qid, e.rank FROM ent e JOIN anchors_e a ON a.item = e.qid AND length(a.anchor) >= 4 AND contains(e.tform, a.anchor) WHERE e.qid NOT IN (SELECT qid FROM tit)) GROUP BY qid),
cr AS (SELECT e.qid, min(e.rank) AS rank FROM ent e JOIN crefs c USING (qid, chapter) GROUP BY e.qid),
loc AS (SELECT item AS qid FROM anchors_e a WHERE EXISTS (SELECT 1 FROM sanguo_yanyi s WHERE contains({_FORM('s.text')}, a.anchor)) OR length(anchor) >= 4 AND EXISTS (SELECT 1 FROM sanguo_yanyi s WHERE contains({_FORM('s.title')}, a.anchor))
  UNION SELECT qid FROM tit t WHERE EXISTS (SELECT 1 FROM sanguo_yanyi s WHERE s.chapter = t.chapter AND contains({_FORM('s.title')}, t.title))),
er AS (SELECT evi.qid, evi.category, coalesce(m1.rank, m2.rank, 0) AS rank, CASE WHEN m1.rank IS NOT NULL THEN 'text' WHEN m2.rank IS NOT NULL THEN 'title' END AS tier, coalesce(cr.rank, 0) AS chapter_rank, evi.qid NOT IN (SELECT qid FROM loc) AS no_anchor
  FROM evi LEFT JOIN m1 USING (qid) LEFT JOIN m2 USING (qid) LEFT JOIN cr USING (qid))"""
MATCHED = f"matched AS (SELECT a.item, min(s.row_id) AS rank FROM anchors a JOIN (SELECT row_id, {_FORM('text')} AS form FROM sanguo_yanyi) s ON contains(s.form, a.anchor) GROUP BY a.item)"

#: code points whose compatibility form is one other code point
_WIDE = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if len(f := unicodedata.normalize("NFKC", c)) == 1 and f != c)
_NARROW = "".join(unicodedata.normalize("NFKC", c) for c in _WIDE)


def bank_form_sql(c: str) -> str:
    quoted = _NARROW.replace("'", "''")
    return f"regexp_replace(regexp_replace(lower(nfc_normalize(translate({c}, '{_WIDE}', '{quoted}'))), '{X.BLANKS}', '', 'g'), '\\p{{P}}', '', 'g')"


BANK = f"bank AS (SELECT question_id AS id, {bank_form_sql('question')} AS form FROM event_question_pool WHERE question IS NOT NULL)"
GRAMS = """grams AS (SELECT id, form, list_distinct(CASE WHEN length(form) = 1 THEN [form] ELSE list_transform(range(1, length(form)), lambda i: substring(form, CAST(i AS INT), 2)) END) AS g FROM bank WHERE form <> ''),
gx AS (SELECT id, len(g) AS size, unnest(g) AS gram FROM grams)"""


def fnv_sql(c: str) -> str:
    return f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(hex(encode({c}))), 2), lambda i: CAST('0x' || substring(hex(encode({c})), CAST(i AS INT), 2) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


HASHED = f"""tk AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest({P.tokens_sql('form')}) AS token FROM bank) GROUP BY ALL),
hs AS (SELECT token, {fnv_sql('token')} AS h FROM (SELECT DISTINCT token FROM tk)),
wt AS (SELECT id, (h & 2147483647) % 256 AS bucket, sum(CASE WHEN h >= 2147483648 THEN -n ELSE n END) AS w FROM tk JOIN hs USING (token) GROUP BY ALL HAVING w <> 0),
hv AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM wt)"""


def _case(c: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{k}'" for k, p in pairs) + " END"


def lines_sql(source: str, doc: str) -> str:
    return f"""lines AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i) AS line_no, line FROM (SELECT doc, i, trim(x, ' ' || chr(12288) || chr(9) || chr(13) || chr(10)) AS line FROM (
  SELECT doc, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT {doc} AS doc, regexp_split_to_array(text, '\r\n|\n|\r') AS a FROM {source} WHERE text IS NOT NULL))) WHERE line <> '' AND NOT contains(line, '{C.NOISE}'))"""


LINES = lines_sql("sanguo_yanyi", "row_id")
LEAD = f"(line LIKE '%：' AND length(line) <= {C.LEAD} AND NOT regexp_matches(line, '[{C.STOPS}]'))"


def verse_sql(c: str, long=(2, 9), short=(4, 5)) -> str:
    lens = lambda m: f"list_transform(list_filter(regexp_split_to_array({c}, '{m}'), lambda x: x <> ''), lambda x: length(x))"
    a, b = lens("[，。；！？：]"), lens("[，。；！？：、]")
    return f"""(NOT regexp_matches({c}, '[“‘”’]') AND ((length({c}) - length(replace({c}, '；', '')) >= {long[0]} AND coalesce(list_max({a}) <= {long[1]}, false)) OR (len({b}) >= {short[0]} AND coalesce(list_max({b}) <= {short[1]}, false))))"""


def cascade_sql(base: str, follows: str, extra: str = "") -> str:
    return f"""flagged AS (SELECT *, coalesce({base}, false) AS b, coalesce({follows}, false) AS f FROM lines0),
isl AS (SELECT *, sum(CASE WHEN NOT b AND NOT f THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS isle FROM flagged),
casc AS (SELECT *, CASE WHEN NOT b AND NOT f THEN false ELSE max(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc, isle ORDER BY line_no) = 1 END AS verse FROM isl)"""


#: text outside quotations: runs between marks, with a depth that closing marks don't take below zero
_OUTSIDE = """runs AS (SELECT doc, line_no, what, i, run, run IN ('“', '‘', '”', '’') AS mark, sum(CASE WHEN run IN ('“', '‘') THEN 1 WHEN run IN ('”', '’') THEN -1 ELSE 0 END) OVER w AS s
  FROM (SELECT doc, line_no, what, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM (SELECT doc, line_no, what, regexp_extract_all(t, '[“‘]|[”’]|[^“‘”’]+') AS r FROM (SELECT doc, line_no, 'line' AS what, line AS t FROM lines1 UNION ALL SELECT doc, line_no, 'tail', {} FROM lines1)))
  WINDOW w AS (PARTITION BY doc, line_no, what ORDER BY i)),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc, line_no, what ORDER BY i)) AS depth FROM runs),
outs AS (SELECT doc, line_no, what, string_agg(CASE WHEN mark OR depth = 0 THEN run ELSE '' END, '' ORDER BY i) AS t FROM deep GROUP BY doc, line_no, what),
lines0 AS (SELECT l.*, coalesce(regexp_matches(a.t, '{}'), false) AS announces, coalesce(regexp_matches(b.t, '{}'), false) AS tail_announces FROM lines1 l
  LEFT JOIN outs a ON a.doc = l.doc AND a.line_no = l.line_no AND a.what = 'line' LEFT JOIN outs b ON b.doc = l.doc AND b.line_no = l.line_no AND b.what = 'tail')"""
_TAIL = f"regexp_extract(before, '([^{C.STOPS}]*[{C.STOPS}]?[^{C.STOPS}]*)$', 1)"
_ID = lambda i: f"regexp_extract(chunk_id, '^[^:]+:(\\d{{4}}):p(\\d{{4}}):c(\\d{{2}})$', {i})"
_WELL = "regexp_matches(chunk_id, '^[^:]+:(\\d{4}):p(\\d{4}):c(\\d{2})$')"
DEPTHS_OF = """dep AS (SELECT row_id AS doc, list_transform(regexp_extract_all(text, '[“‘”’]'), lambda c: CASE WHEN c IN ('“', '‘') THEN 1 ELSE -1 END) AS m FROM {} WHERE text IS NOT NULL),
dq AS (SELECT doc, least(0, min(run)) AS lowest, max_by(run, i) AS final FROM (SELECT doc, i, sum(v) OVER (PARTITION BY doc ORDER BY i) AS run FROM (SELECT doc, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM dep)) GROUP BY doc)"""
DEPTHS = DEPTHS_OF.format("sanguo_yanyi")
_CHECKS = {
    "chunk_id_present": "chunk_id IS NULL",
    "chunk_id_well_formed": f"chunk_id IS NOT NULL AND NOT {_WELL}",
    "chunk_id_of_parent": f"{_WELL} AND string_split(chunk_id, ':c')[1] <> parent_id",
    "chapter_of_id": f"{_WELL} AND try_cast({_ID(1)} AS INT) <> chapter",
    "sequence_of_id": f"{_WELL} AND try_cast({_ID(3)} AS INT) <> seq_in_parent",
    "text_present": "coalesce(text, '') = ''",
    "char_count_right": "text IS NOT NULL AND char_count IS DISTINCT FROM length(text)",
    "within_cap": "chunk_type <> 'verse' AND length(text) > 600",
    "quotes_balanced": "row_id IN (SELECT doc FROM dq WHERE lowest < 0 OR final <> 0)",
    "known_type": "chunk_type NOT IN ('prose', 'verse') OR chunk_role NOT IN ('body', 'lead')",
}
_ADJ = """own AS (SELECT DISTINCT source, chapter FROM sanguo_yanyi),
adj AS (SELECT o.source, o.chapter, p.chapter AS prev, n.chapter AS next FROM own o LEFT JOIN own p ON p.source = o.source AND p.chapter = o.chapter - 1 LEFT JOIN own n ON n.source = o.source AND n.chapter = o.chapter + 1)"""
#: adjoining ranges of ten segments, up to each chapter's last
_GROUPED = f"""seg AS (SELECT row_id AS doc, chapter, CASE WHEN {_WELL} THEN try_cast({_ID(2)} AS INT) END AS segment_no FROM sanguo_yanyi),
top AS (SELECT chapter, max(segment_no) AS last FROM seg WHERE segment_no >= 1 AND chapter IS NOT NULL GROUP BY chapter),
rng AS (SELECT chapter, unnest(range(1, last + 1, 10)) AS a FROM top),
grp AS (SELECT doc, printf('g%04d-%03d', r.chapter, r.a) AS group_id FROM seg LEFT JOIN rng r ON r.chapter = seg.chapter AND segment_no BETWEEN r.a AND r.a + 9)"""
_NUM = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.NUMERALS.items()) + " ELSE 0 END"

SQL = {
    "hit_at_k": with_(_rank_sql("rk"), REL, _results_sql("res", "rk")) + "SELECT qid, category, seg_count, first_rank, hits5, hits10, status FROM res",
    "cover_at_5": with_(_rank_sql("rk"), REL, _results_sql("res", "rk"))
    + f"""SELECT category, bucket, count(*) AS total, count(CASE WHEN first_rank BETWEEN 1 AND 5 THEN 1 END) AS hit5, count(CASE WHEN first_rank BETWEEN 1 AND 10 THEN 1 END) AS hit10,
  count(CASE WHEN first_rank >= 1 THEN 1 END) AS hit50, count(CASE WHEN first_rank = 0 THEN 1 END) AS miss,
  {fixed_sql('count(CASE WHEN first_rank BETWEEN 1 AND 10 THEN 1 END) / count(*)', 6)} AS hit10_rate,
  {fixed_sql('CASE WHEN sum(least(5, seg_count)) > 0 THEN sum(hits5) / sum(least(5, seg_count)) ELSE 0.0 END', 6)} AS cover5
FROM (SELECT *, {BUCKET.format('seg_count')} AS bucket FROM res) GROUP BY GROUPING SETS ((), (category), (bucket))""",
    "group_counters": with_(_rank_sql("rk"), REL, _results_sql("res", "rk"), naming.VALID, naming.KEYS, naming.GROUPS, naming.BRIDGE_KEYS, P.CTE_Q, naming._bridge_sql("q"))
    + f"""SELECT category, bucket, count(*) AS total, count(CASE WHEN first_rank BETWEEN 1 AND 5 THEN 1 END) AS hit5, count(CASE WHEN first_rank BETWEEN 1 AND 10 THEN 1 END) AS hit10,
  count(CASE WHEN first_rank >= 1 THEN 1 END) AS hit50, count(CASE WHEN first_rank = 0 THEN 1 END) AS miss,
  {fixed_sql('count(CASE WHEN first_rank BETWEEN 1 AND 10 THEN 1 END) / count(*)', 6)} AS hit10_rate,
  {fixed_sql('CASE WHEN sum(least(5, seg_count)) > 0 THEN sum(hits5) / sum(least(5, seg_count)) ELSE 0.0 END', 6)} AS cover5,
  count(CASE WHEN e THEN 1 END) AS event_bridge, count(CASE WHEN a THEN 1 END) AS allusion_bridge, count(CASE WHEN NOT (e OR a) THEN 1 END) AS no_bridge,
  count(CASE WHEN first_rank = 0 AND (e OR a) THEN 1 END) AS dropped, count(CASE WHEN first_rank = 0 AND NOT (e OR a) THEN 1 END) AS miss_no_bridge
FROM (SELECT *, {BUCKET.format('seg_count')} AS bucket, EXISTS (SELECT 1 FROM br WHERE br.qid = res.qid AND src = 'e') AS e, EXISTS (SELECT 1 FROM br WHERE br.qid = res.qid AND src = 'a') AS a FROM res) GROUP BY GROUPING SETS ((), (category), (bucket))""",
    "rerank_failures": with_(_rank_sql("rk"), _rank_sql("rk2", 16), REL,
        "b AS (SELECT * FROM rk WHERE rank <= 10)", "a AS (SELECT * FROM rk2 WHERE rank <= 10)",
        "j AS (SELECT coalesce(b.qid, a.qid) AS qid, coalesce(b.doc, a.doc) AS doc, b.rank AS was, a.rank AS now FROM b FULL JOIN a ON a.qid = b.qid AND a.doc = b.doc)",
        "je AS (SELECT j.*, EXISTS (SELECT 1 FROM rel WHERE rel.qid = j.qid AND rel.doc = j.doc) AS e FROM j)")
    + """SELECT qid, kind, doc FROM (SELECT qid, doc, CASE WHEN e AND now IS NULL THEN 'evidence_dropped' WHEN e AND now > was THEN 'evidence_demoted' WHEN NOT e AND was IS NULL THEN 'non_evidence_promoted' END AS kind FROM je) WHERE kind IS NOT NULL
UNION ALL SELECT qid, 'wrong_top1', doc FROM je WHERE now = 1 AND qid IN (SELECT qid FROM je WHERE e AND was = 1 AND (now IS NULL OR now <> 1))""",
    "compare_runs": with_(_rank_sql("rk"), _rank_sql("rk2", 2), REL, _results_sql("res", "rk"), _results_sql("res2", "rk2"))
    + f"""SELECT * FROM (SELECT a.qid, a.status AS to_status, a.first_rank AS to_rank, b.status AS from_status, b.first_rank AS from_rank,
  CASE WHEN {_ST.format('a.status')} < {_ST.format('b.status')} THEN 'regressed' WHEN {_ST.format('a.status')} > {_ST.format('b.status')} THEN 'improved' END AS change
  FROM res a JOIN res2 b USING (qid)) WHERE change IS NOT NULL""",
    "top10_overlap": with_(_rank_sql("rk"), _rank_sql("rk2", 16))
    + "SELECT a.qid, count(b.doc) AS shared, count(b.doc) = count(*) AS same_set FROM rk a LEFT JOIN (SELECT * FROM rk2 WHERE rank <= 10) b ON a.qid = b.qid AND a.doc = b.doc WHERE a.rank <= 10 GROUP BY a.qid",
    "rank_changes": with_(_rank_sql("rk"), _rank_sql("rk2", 16), REL)
    + """SELECT a.qid, a.doc, CASE WHEN b.rank IS NULL THEN 'dropped' WHEN b.rank > a.rank THEN 'demoted' WHEN b.rank < a.rank THEN 'raised' ELSE 'kept' END AS change
  FROM (SELECT * FROM rk SEMI JOIN rel USING (qid, doc) WHERE rank <= 10) a LEFT JOIN (SELECT * FROM rk2 WHERE rank <= 10) b ON a.qid = b.qid AND a.doc = b.doc""",
    "anchor_extract": with_(ANCHORS) + "SELECT item, anchor FROM anchors",
    "anchor_match": with_(ANCHORS, MATCHED) + "SELECT item, rank FROM matched",
    "no_anchor": with_(ANCHORS, MATCHED) + "SELECT item FROM ev WHERE item NOT IN (SELECT item FROM matched)",
    "evidence_results": with_(*P.HYBRID, _EVIDENCE) + "SELECT qid, category, rank, tier, chapter_rank, no_anchor FROM er",
    "anchor_counters": with_(*P.HYBRID, _EVIDENCE)
    + """SELECT category, count(CASE WHEN NOT no_anchor THEN 1 END) AS total, count(CASE WHEN NOT no_anchor AND rank BETWEEN 1 AND 3 THEN 1 END) AS top3, count(CASE WHEN NOT no_anchor AND rank BETWEEN 1 AND 5 THEN 1 END) AS top5,
  count(CASE WHEN NOT no_anchor AND rank BETWEEN 6 AND 10 THEN 1 END) AS tail, count(CASE WHEN NOT no_anchor AND (rank = 0 OR rank > 10) THEN 1 END) AS miss, count(CASE WHEN NOT no_anchor AND rank >= 1 THEN 1 END) AS in_pool,
  count(CASE WHEN NOT no_anchor AND chapter_rank BETWEEN 1 AND 5 THEN 1 END) AS chapter_top5, count(CASE WHEN no_anchor THEN 1 END) AS no_anchor FROM er GROUP BY GROUPING SETS ((), (category))""",
    "dice_topk": with_(BANK, GRAMS)
    + f"""SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT q.id AS qid, b.id, {fixed_sql('2 * count(*) / (any_value(q.size) + any_value(b.size))', 6)} AS score FROM gx q JOIN gx b USING (gram) WHERE q.id % 100 = 0 GROUP BY q.id, b.id)) WHERE rank <= 8""",
    "hash_vector_cosine": with_(BANK, HASHED)
    + f"""SELECT qid, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (
  SELECT a.id AS qid, b.id, coalesce(any_value(s.similarity), 0.0) AS similarity FROM (SELECT DISTINCT id FROM hv WHERE id % 100 = 0) a CROSS JOIN (SELECT DISTINCT id FROM hv) b
  LEFT JOIN (SELECT q.id AS qid, h.id, {fixed_sql('sum(q.weight * h.weight)', 6)} AS similarity FROM hv q JOIN hv h USING (bucket) WHERE q.id % 100 = 0 GROUP BY q.id, h.id) s ON s.qid = a.id AND s.id = b.id GROUP BY a.id, b.id)) WHERE rank <= 8""",
    "fnv_hash": f"SELECT p_partkey, {fnv_sql('p_name')} AS hash FROM part",
    "lexical_similarity": f"""SELECT a.p_partkey AS k, {fixed_sql("CASE WHEN length(x) = 0 OR length(y) = 0 THEN 0.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END", 6)} AS similarity
  FROM (SELECT a.p_partkey, {bank_form_sql('a.p_name')} AS x, {bank_form_sql('b.p_name')} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) a""",
    "bank_form": with_(BANK) + "SELECT id, form FROM bank",
    "intent_class": with_(P.CTE_ASKED.replace("question_id % 100 = 0 AND ", ""))
    + f"""SELECT qid, death, birth FROM (SELECT qid, CASE WHEN regexp_matches(text, '{DEATH_GATE}') THEN {_case('text', INTENTS)} END AS death, regexp_matches(text, '{BIRTH}') AS birth
  FROM (SELECT qid, text FROM q UNION ALL VALUES {', '.join(f"({-101 - i}, '{t}')" for i, t in enumerate(ASKED))})) WHERE death IS NOT NULL OR birth""",
    "body_lines": with_(LINES) + f"SELECT doc, line_no, length(line) AS chars, {LEAD} AS lead FROM lines",
    "verse_cascade": with_(LINES, "lines0 AS (SELECT * FROM lines)", cascade_sql(f"line_no = 1 AND {verse_sql('line', short=(2, 8))}", verse_sql("line", short=(2, 8)))) + "SELECT doc, line_no, verse FROM casc",
    "line_kinds": with_(LINES, "lines1 AS (SELECT *, lag(line) OVER (PARTITION BY doc ORDER BY line_no) AS before FROM lines)", _OUTSIDE.format(_TAIL, "|".join(C.VERSE_WORDS), "|".join(C.VERSE_WORDS)),
        cascade_sql(f"(line LIKE '%：' AND NOT regexp_matches(line, '[{C.STOPS}]') AND announces) OR (before LIKE '%：' AND tail_announces)", verse_sql("line")))
    + f"SELECT doc, line_no, verse, CASE WHEN {LEAD} THEN 'lead' ELSE 'body' END AS role FROM casc",
    "packed_concat": "SELECT row_id AS doc, md5(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM sanguo_yanyi WHERE text IS NOT NULL",
    "parent_concat_check": """SELECT parent_id, count(*) AS pieces, CAST(sum(length(text)) AS BIGINT) AS chars, md5(string_agg(text, '' ORDER BY seq_in_parent NULLS FIRST, row_id)) AS digest
  FROM sanguo_yanyi WHERE parent_id IS NOT NULL AND text IS NOT NULL GROUP BY parent_id""",
    "interval_group_join": with_(_GROUPED) + "SELECT doc, group_id FROM grp",
    "group_sizes": with_(_GROUPED) + "SELECT grp.group_id, count(*) AS members, CAST(coalesce(sum(length(s.text)), 0) AS BIGINT) AS total_chars FROM grp JOIN sanguo_yanyi s ON s.row_id = doc WHERE grp.group_id IS NOT NULL GROUP BY grp.group_id",
    "adjacent_chapters": with_(_ADJ) + "SELECT source, chapter, prev, next FROM adj",
    "chapter_payload": with_(_ADJ)
    + "SELECT a.source, a.chapter, count(*) AS chunks, CAST(coalesce(sum(length(s.text)), 0) AS BIGINT) AS chars, max(s.title) AS title, a.prev, a.next FROM adj a JOIN sanguo_yanyi s ON s.source = a.source AND s.chapter = a.chapter GROUP BY a.source, a.chapter, a.prev, a.next",
    "inner_order": "SELECT row_id AS doc, " + ", ".join(f"coalesce(try_cast({_ID(i)} AS INT), 2147483647) AS {n}" for i, n in ((1, "chapter_no"), (2, "segment_no"), (3, "sequence_no"))) + " FROM sanguo_yanyi",
    "cn_numerals": f"""WITH f AS (SELECT numeral, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, '[零〇一二两三四五六七八九十百]+')) AS numeral FROM sanguo_yanyi) GROUP BY numeral)
SELECT numeral, times, CAST({_NUM.format("regexp_extract(numeral, '^(.)百', 1)")} * 100 + CASE WHEN contains(numeral, '十') THEN CASE WHEN regexp_matches(numeral, '(^|百|零)十') THEN 1 ELSE {_NUM.format("regexp_extract(numeral, '(.)十', 1)")} END * 10 ELSE 0 END
  + {_NUM.format("regexp_extract(numeral, '([^十百])$', 1)")} AS INT) AS value FROM f WHERE regexp_matches(replace(numeral, '〇', '零'), '{STANDARD}')""",
    "clause_metrics": "SELECT doc, len(n) AS clauses, coalesce(list_max(n), 0) AS longest FROM (SELECT row_id AS doc, list_transform(list_filter(regexp_split_to_array(text, '[，。；！？：]'), lambda x: x <> ''), lambda x: length(x)) AS n FROM sanguo_yanyi WHERE text <> '')",
    "quote_balance": with_(DEPTHS_OF.format("(SELECT row_id, text FROM sanguo_yanyi UNION ALL VALUES " + ", ".join(f"({i}, '{t}')" for i, t in UNBALANCED) + ")")) + "SELECT doc, CAST(lowest AS INT) AS lowest, CAST(final AS INT) AS final FROM dq WHERE lowest < 0 OR final <> 0",
    "corpus_invariants": with_(DEPTHS) + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(CASE WHEN {c} THEN 1 END) AS failures FROM sanguo_yanyi" for n, c in _CHECKS.items()),
    "percentile_nearest": f"""SELECT l_returnflag, count(l_extendedprice) AS n, {fixed_sql('avg(l_extendedprice)', 4)} AS mean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
  quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag""",
    "ratio_of_sums": f"SELECT l_linestatus, {fixed_sql('sum(l_extendedprice) / sum(l_quantity)', 4)} AS price_per_unit FROM lineitem GROUP BY l_linestatus",
    "fill_forward": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events",
    "session_ttl": """SELECT event_id, user_id, opened_at FROM (SELECT event_id, user_id, ts, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened_at FROM events)
  WHERE ts - opened_at <= INTERVAL 30 MINUTE""",
    "dedupe_first_wins": "SELECT md5(text) AS content_key, min(doc_id) AS kept_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)",
    "content_hash": "SELECT substring(sha256(string_agg(l, chr(10) ORDER BY l)), 1, 8) AS digest, count(*) AS rows FROM (SELECT concat_ws('|', n_nationkey, n_name, n_regionkey) AS l FROM nation)",
    "json_features": "SELECT event_type, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type",
    "coverage_by_source": f"""WITH hit AS (SELECT DISTINCT qid FROM ({naming.SQL['bridge_match']})),
qs AS (SELECT question_id AS qid, coalesce(lower(trim(source)), 'unknown') AS source FROM event_question_pool WHERE question IS NOT NULL)
SELECT source, count(*) AS questions, count(hit.qid) AS covered, {fixed_sql('count(hit.qid) / count(*)', 6)} AS coverage FROM qs LEFT JOIN hit USING (qid) GROUP BY ROLLUP (source)""",
    "time_keys": f"SELECT event_id, strftime(ts, 'run-%Y-%m-%d-%H%M') AS run_id, strftime(ts, 'run-%Y-%m-%d-%H%M%S') AS run_id_seconds, {BUCKET.format('(event_id % 15 + 1)')} AS bucket FROM events",
}
