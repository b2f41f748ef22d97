"""Queries over the alias table, the groups, bridges and ordered pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import entities as E
from inkwell.operators import groups as G
from inkwell.operators import index as I
from inkwell.operators import pipeline as L
from inkwell.operators import pools as O
from inkwell.operators import retrieval as R
from inkwell.operators.intents import BIRTH, DEATH_GATE, INTENTS, LAST_WORDS
from inkwell.plans import frames as P
from inkwell.plans import search
from inkwell.plans.alias_sql import KEYS, SCAN, SCAN_FRAGMENTS, VALID, scan_sql, valid_sql
from inkwell.plans.frames import ALLUSION_TYPES, EVENT_TYPES, K, allusions, chunks, events, fixed_sql, questions, with_
from inkwell.runtime import cut, table

_valid = P.valid_aliases


def entity_valid(spark: SparkSession, d: str) -> DataFrame:
    v = _valid(spark, d, wide=False)
    return v.select("entity_id", "entity_type", "canonical", F.size("aliases").alias("aliases"), F.size("keys").alias("keys"), F.size("fragments").alias("fragments"))


def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    v = _valid(spark, d)
    return E.rewrite_keys(v).withColumn("kind", F.lit("rewrite")).unionByName(E.fragment_keys(v).withColumn("kind", F.lit("fragment")))


#: two more rows that claim one key: (entity_id, entity_type, canonical, aliases)
CLAIMS = (("X1", "check", "甲甲甲", ["乙乙", "丙丙"]), ("X2", "check", "丁丁丁", ["乙乙"]))


def key_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """Keys of several rows, of the stored table and two more rows."""
    e = table(spark, d, "entity_table")
    more = spark.createDataFrame([(i, t, c, a, [], [], None, None) for i, t, c, a in CLAIMS], "entity_id string, entity_type string, canonical string, aliases array<string>, rewritekeys array<string>, fragmentonly array<string>, organguard string, note string")
    return E.key_multiplicity(E.valid_entities(e.select(*more.columns).unionByName(more), wide=True))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return E.scan_texts(chunks(spark, d).select("doc", "text"), E.lexicon(_valid(spark, d)))


def alias_expand(spark: SparkSession, d: str) -> DataFrame:
    return E.expansions(_scan(spark, d))


def alias_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Rewritten chunk texts, with the fragments taken as keys too, so that guards have work to do."""
    lex = E.lexicon(_valid(spark, d)).withColumn("key_of", F.coalesce("key_of", "fragment_of"))
    return E.scan_texts(chunks(spark, d).select("doc", "text"), lex).where("size(rewrites) > 0").select("doc", "normalized")


def double_write_tf(spark: SparkSession, d: str) -> DataFrame:
    """Term counts of the chunks' canonical forms: written, added and total."""
    added = E.double_write(alias_expand(spark, d)).withColumnRenamed("tf", "added")
    base = R.postings(chunks(spark, d), added.select("term").distinct()).select("doc", "term", F.col("tf").alias("written"))
    body = chunks(spark, d).where("role = 'body'").select("doc")
    return added.join(body, "doc", "left_semi").join(base, ["doc", "term"], "left").select("doc", "term", F.coalesce("written", F.lit(0)).alias("written"), "added", (F.coalesce("written", F.lit(0)) + F.col("added")).alias("tf"))


def bm25_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Lexical top-k with the expansions' terms added to the counts, lengths unchanged."""
    scored = I.scores(P.index(spark, d), questions(spark, d), with_added=True, best=K).select("qid", "doc", X.fixed(F.col("bm25"), 6).alias("score"))
    return R.top_k(scored, K, F.desc("score"), F.col("doc"))


def group_valid(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).unionByName(allusions(spark, d)).select("eventid", "eventname", "group_type", F.size("chunkids").alias("refs"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    taken = E.rewrite_keys(_valid(spark, d))
    e, a = events(spark, d), allusions(spark, d)
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    return kind(G.bridge_keys(e, G.valid_aliases(e, taken)), "event").unionByName(kind(G.bridge_keys(a, G.valid_aliases(a, taken)), "allusion"))


def group_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("kind", "eventid", "key")


def group_members(spark: SparkSession, d: str) -> DataFrame:
    return G.members(events(spark, d), chunks(spark, d))


def missing_refs(spark: SparkSession, d: str) -> DataFrame:
    return G.missing_references(events(spark, d), chunks(spark, d))


def drift_check(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return G.drift(events(spark, d), c).withColumn("table_name", F.lit("event_groups")).unionByName(G.drift(allusions(spark, d), c).withColumn("table_name", F.lit("allusions")))


def drift_applied(spark: SparkSession, d: str) -> DataFrame:
    """(kind, eventid, refs): groups and their references after what is gone has left.

    These tables hold more missing references than the usual 5 %, past which a whole table would be left out; the
    bound is raised to a half here.
    """
    c = chunks(spark, d)
    left = lambda g, kind: G.without_drift(g, c, 0.5).select(F.lit(kind).alias("kind"), "eventid", F.size("chunkids").alias("refs"))
    return left(events(spark, d), "event").unionByName(left(allusions(spark, d), "allusion"))


def bridge_match(spark: SparkSession, d: str) -> DataFrame:
    """Every question of the pool against every group name and alias."""
    qs = questions(spark, d, 1).unionByName(P.cases(spark, d))
    return G.bridges(qs, _keys(spark, d))


def _stages(spark: SparkSession, d: str) -> tuple[L.Corpus, L.Recall, DataFrame]:
    corpus, found = P.corpus(spark, d), search.recall(spark, d)
    found.pool = cut(found.pool)  # read twice where members join it
    return corpus, found, cut(G.bridges(found.queries, corpus.keys))


def pools(spark: SparkSession, d: str, enhanced: bool = False) -> tuple[L.Corpus, O.Pools, DataFrame]:
    """The corpus, the pools of the question set with members of matched groups, and the matches."""
    corpus, qs = P.corpus(spark, d), cut(P.asked(spark, d))
    matched = cut(G.bridges(qs, corpus.keys))
    more = {"enhanced": G.enhanced_queries(qs, matched)} if enhanced else {}
    return corpus, L.pools(corpus, qs, P.query_vectors(spark, d).join(qs.select("qid"), "qid", "left_semi"), R.FALLBACK_TOP, matched, **more), matched


def _capped(made: O.Pools, matched: DataFrame) -> DataFrame:
    driven = L.driven(matched)
    return R.cap_pool(made.rows(None, driven, columns=("qid", "doc", "score")), driven)


def pool_union_cap(spark: SparkSession, d: str) -> DataFrame:
    """Pools with the members of matched groups, capped where a group matched."""
    _, made, matched = pools(spark, d)
    return _capped(made, matched)


def enhanced_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Pools of queries that name a group, scored with the enhanced query and capped; those of the others as they are."""
    _, made, matched = pools(spark, d, True)
    return _capped(made, matched)


def person_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """(kind, person, doc) from the tags that name a person's death, first appearance or last words."""
    return P.corpus(spark, d).people


def pins(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc, direction): what the intents of every question of the pool pin, and anchors of L3 groups."""
    corpus, qs = P.corpus(spark, d), cut(P.asked(spark, d, 1))
    return L.pins(corpus, qs, cut(G.bridges(qs, corpus.keys)))


def pinned_order(spark: SparkSession, d: str) -> DataFrame:
    """The plain pools with their pins first."""
    corpus, found, matched = _stages(spark, d)
    return R.pinned_order(found.pool, L.pins(corpus, found.queries, matched), keep=K).select("qid", "doc", "score", "pinned", "rank")


def rerank_window(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic scorer (the text's length) inside the window of 50 of the whole ranking."""
    corpus, qs = P.corpus(spark, d), cut(P.asked(spark, d))
    pinned = cut(L.pins(corpus, qs, cut(G.bridges(qs, corpus.keys))))
    made = O.Pools(corpus, qs, P.query_vectors(spark, d).join(qs.select("qid"), "qid", "left_semi"), R.FALLBACK_TOP, pins=pinned)
    first = R.pinned_order(made.rows(R.RERANK_WINDOW, columns=("qid", "doc", "score")), pinned, keep=R.RERANK_WINDOW)
    sized = first.join(chunks(spark, d).select("doc", F.length("text").alias("ce")), "doc")
    return made.ranked(cut(R.rerank_window(sized, "ce")))


def search_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole search without a pair scorer: the first 20."""
    qs = cut(P.asked(spark, d))
    out = L.search(P.corpus(spark, d), qs, P.query_vectors(spark, d).join(qs.select("qid"), "qid", "left_semi"), 20)
    return out.select("qid", "doc", "score", "rank", "pinned", "tag_hit", "sources", "degraded")


def _shared_characters():
    """A scorer without weights: the share of the characters of the two texts that they have in common."""
    return lambda qs, ts: [round(len(set(q) & set(t)) / max(1, len(set(q) | set(t))), 6) for q, t in zip(qs, ts, strict=True)]


def search_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The whole search with a pair scorer over the window of 50: the first 20."""
    qs = cut(P.asked(spark, d))
    out = L.search(P.corpus(spark, d), qs, P.query_vectors(spark, d).join(qs.select("qid"), "qid", "left_semi"), 20, _shared_characters)
    return out.select("qid", "doc", "rank", "pinned", "degraded")


QUERIES = {
    f.__name__: f
    for f in (
        entity_valid, entity_keys, key_multiplicity, alias_expand, alias_normalize, double_write_tf, bm25_expanded, group_valid, group_aliases, group_members,
        missing_refs, drift_check, drift_applied, bridge_match, pool_union_cap, enhanced_rescore, person_dictionary, pins, pinned_order, rerank_window, search_full, search_reranked,
    )
}

# --- SQL ------------------------------------------------------------------------------------------

def _groups_sql(name: str, source: str, types: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{t}'" for t in types)
    return f"""{name} AS (SELECT eventid, eventname, aliases, chunkids, group_type FROM (SELECT *, row_number() OVER (PARTITION BY eventid
  ORDER BY recorded_at NULLS FIRST, arrived_at NULLS FIRST, coalesce(array_to_string(chunkids, ','), '')) AS n FROM {source} WHERE eventid <> '') WHERE n = 1 AND eventname <> '' AND group_type IN ({listed}))"""


GROUPS = f"""{_groups_sql('ev', 'event_groups', EVENT_TYPES)},
{_groups_sql('al', 'allusions', ALLUSION_TYPES)},
gr AS (SELECT *, 'e' AS src FROM ev UNION ALL SELECT *, 'a' FROM al)"""
BRIDGE_KEYS = """galias AS (SELECT src, alias, min(eventid) AS eventid FROM (SELECT src, eventid, unnest(aliases) AS alias FROM gr) WHERE length(alias) >= 2 GROUP BY src, alias),
bkeys AS (SELECT DISTINCT src, eventid, eventname AS key FROM gr UNION SELECT src, eventid, alias FROM galias WHERE alias NOT IN (SELECT key FROM rkeys))"""


def _bridge_sql(q: str) -> str:
    return f"""br0 AS (SELECT q.qid, g.src, g.eventid, g.eventname, g.group_type, b.key AS matched, row_number() OVER (PARTITION BY q.qid, g.src, b.eventid ORDER BY length(b.key) DESC, b.key) AS n
  FROM {q} q JOIN bkeys b ON contains(q.text, b.key) JOIN gr g ON g.eventid = b.eventid AND g.src = b.src),
br1 AS (SELECT qid, src, CASE src WHEN 'e' THEN 'event' ELSE 'allusion' END AS kind, eventid, eventname, group_type, matched, src = 'a' OR group_type <> 'L3' AS poolable FROM br0 WHERE n = 1),
br AS (SELECT *, CASE WHEN poolable THEN row_number() OVER (PARTITION BY qid, poolable ORDER BY CASE src WHEN 'e' THEN 0 ELSE 1 END, length(matched) DESC, eventid) END AS driver FROM br1)"""


_PART = "coalesce(try_cast(regexp_extract(chunk_id, '^[^:]+:(\\d{{4}}):p(\\d{{4}}):c(\\d{{2}})$', {}) AS INT), 2147483647)"
_MEMBERS = """mem AS (SELECT DISTINCT g.src, g.eventid, s.row_id AS doc, s.chunk_id FROM (SELECT src, eventid, unnest(chunkids) AS chunk_id FROM gr) g JOIN sanguo_yanyi s USING (chunk_id) WHERE s.chunk_role = 'body')"""
_MATCHED = "matched AS (SELECT * FROM br WHERE poolable)"


def _added(what: str, name: str, base: str, groups: str) -> str:
    """``base`` with the members of ``groups`` it doesn't have, by their plain parts."""
    return f"""{name} AS (SELECT qid, doc, bm25, tag_hit, vector_hit, cosine, score FROM {base} UNION ALL
  SELECT qid, doc, bm25, tag_hit, 0, cosine, {P.score_sql()} AS score FROM (SELECT n.qid, n.doc, l.bm25, l.bm25_norm, c.cosine, CASE WHEN t.doc IS NULL THEN 0 ELSE 1 END AS tag_hit
    FROM (SELECT DISTINCT m.qid, mem.doc FROM {groups} m JOIN mem USING (src, eventid)) n ANTI JOIN {base} p ON p.qid = n.qid AND p.doc = n.doc
    LEFT JOIN lexn l ON l.qid = n.qid AND l.doc = n.doc LEFT JOIN cosines c ON c.qid = n.qid AND c.doc = n.doc LEFT JOIN taghit t ON t.qid = n.qid AND t.doc = n.doc))"""


_GPOOL = _added("groups", "gpool", "pool", "matched")
_CAPPED = "SELECT qid, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM {0}) WHERE r <= 120 OR qid NOT IN (SELECT qid FROM matched)"
_GHEAD = (*P.HYBRID, GROUPS, BRIDGE_KEYS, _bridge_sql("q"), _MATCHED, _MEMBERS, _GPOOL)
_RESCORED = (
    "eq AS (SELECT q.qid, q.text || b.eventname || b.matched AS text FROM q JOIN br b ON b.qid = q.qid AND b.driver = 1)",
    f"eqt AS (SELECT DISTINCT qid, unnest({P.tokens_sql('text')}) AS term FROM eq)",
    f"elex AS (SELECT qid, doc, sum({P.BM25.replace('times * ', '')}) AS bm25 FROM eqt JOIN post USING (term) JOIN df USING (term) CROSS JOIN stats SEMI JOIN gpool USING (qid, doc) GROUP BY qid, doc)",
    f"elexn AS (SELECT qid, doc, bm25, {P.NORM} AS bm25_norm FROM elex JOIN (SELECT qid, min(bm25) AS lo, max(bm25) AS hi FROM elex GROUP BY qid) USING (qid))",
    f"rpool AS (SELECT g.qid, g.doc, l.bm25, g.tag_hit, g.vector_hit, g.cosine, {P.score_sql('l.bm25_norm')} AS score FROM gpool g SEMI JOIN eq USING (qid) LEFT JOIN elexn l ON l.qid = g.qid AND l.doc = g.doc)",
    """cpool AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM rpool) WHERE r <= 120
  UNION ALL SELECT qid, doc, bm25, tag_hit, vector_hit, cosine, score FROM gpool WHERE qid NOT IN (SELECT qid FROM eq))""",
    "l3 AS (SELECT * FROM br WHERE kind = 'event' AND group_type = 'L3')",
    _added("anchors", "apool", "cpool", "l3"),
)
_KIND = "CASE WHEN starts_with(tag, '登场-') THEN 'birth' WHEN starts_with(tag, '遗言-') THEN 'speech' WHEN starts_with(tag, '人物之死-') THEN 'death' WHEN starts_with(tag, '人物之生-') THEN 'birth' END"
_PERSON = "CASE WHEN starts_with(tag, '人物之死-') THEN regexp_replace(substring(tag, 6), '之死$', '') WHEN starts_with(tag, '人物之生-') THEN regexp_replace(substring(tag, 6), '登场$', '') ELSE substring(tag, 4) END"
#: tags in their rewritten form, and the persons they name; a tag about last words is of every dead person in it
PEOPLE = f"""retag AS (SELECT t.doc, coalesce(n.normalized, t.tag) AS tag FROM tagged t LEFT JOIN (
  SELECT p.doc AS tag, string_agg(coalesce(h.canonical, p.piece), '' ORDER BY p.i) AS normalized FROM placed_t p LEFT JOIN hits_t h ON h.doc = p.doc AND h.i = p.i GROUP BY p.doc) n ON n.tag = t.tag),
named AS (SELECT DISTINCT kind, person, doc FROM (SELECT {_KIND} AS kind, {_PERSON} AS person, doc FROM retag) WHERE kind IS NOT NULL AND person <> ''),
people AS (SELECT * FROM named UNION SELECT 'speech', d.person, r.doc FROM retag r JOIN (SELECT DISTINCT person FROM named WHERE kind = 'death') d ON contains(r.tag, d.person)
  WHERE r.doc IN (SELECT doc FROM retag WHERE regexp_matches(tag, '{LAST_WORDS}')))"""
_CASES = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in INTENTS) + " END"
_DIRECTION = "CASE intent WHEN 'death_aftermath' THEN -1 WHEN 'death_last_words' THEN 0 ELSE 1 END"
PINS = f"""{scan_sql("SELECT qid AS doc, text FROM q", "_q")},
qi AS (SELECT qid, text, CASE WHEN regexp_matches(text, '{DEATH_GATE}') THEN {_CASES} END AS intent, regexp_matches(text, '{BIRTH}') AS birth FROM q),
qp AS (SELECT DISTINCT qi.*, p.person FROM qi JOIN (SELECT DISTINCT person FROM people) p ON contains(qi.text, p.person) OR EXISTS (SELECT 1 FROM expanded_q x WHERE x.doc = qi.qid AND x.canonical = p.person) WHERE intent IS NOT NULL OR birth),
pins AS (SELECT DISTINCT qid, doc, {_DIRECTION} AS direction FROM qp JOIN people USING (person)
  WHERE birth AND kind = 'birth' OR intent = 'death_age' AND kind IN ('death', 'speech') OR intent = 'death_last_words' AND kind = (CASE WHEN person IN (SELECT person FROM people WHERE kind = 'speech') THEN 'speech' ELSE 'death' END)
    OR intent NOT IN ('death_age', 'death_last_words') AND kind = 'death'
  UNION SELECT l.qid, mem.doc, {_DIRECTION} FROM br l JOIN mem USING (src, eventid) JOIN qi ON qi.qid = l.qid WHERE l.kind = 'event' AND l.group_type = 'L3')"""


def _ordered(name: str, pool: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, CASE WHEN direction <> 0 THEN doc * direction END NULLS LAST, score DESC, doc) AS rank
  FROM (SELECT p.*, x.direction, CASE WHEN x.doc IS NULL THEN 0 ELSE 1 END AS pinned FROM {pool} p LEFT JOIN (SELECT qid, doc, min(direction) AS direction FROM pins GROUP BY qid, doc) x ON x.qid = p.qid AND x.doc = p.doc))"""


_PINNED = (GROUPS, BRIDGE_KEYS, _bridge_sql("q"), _MEMBERS, PEOPLE, PINS, _ordered("pinned", "pool"))
_FULL = (*_GHEAD, *_RESCORED, PEOPLE, PINS, _ordered("ranked", "apool"))
_SOURCES = """concat_ws(',', CASE WHEN bm25 IS NOT NULL THEN 'lexical' END, CASE WHEN vector_hit = 1 THEN 'vector' END, CASE WHEN tag_hit = 1 THEN 'label' END,
  CASE WHEN EXISTS (SELECT 1 FROM matched m JOIN mem USING (src, eventid) WHERE m.qid = r.qid AND mem.doc = r.doc AND m.src = 'e') THEN 'event' END,
  CASE WHEN EXISTS (SELECT 1 FROM matched m JOIN mem USING (src, eventid) WHERE m.qid = r.qid AND mem.doc = r.doc AND m.src = 'a') THEN 'allusion' END)"""
_REFS = """refs AS (SELECT src, eventid, unnest(chunkids) AS chunk_id FROM gr),
known AS (SELECT DISTINCT chunk_id FROM sanguo_yanyi WHERE chunk_id IS NOT NULL),
gone AS (SELECT src, count(DISTINCT CASE WHEN chunk_id NOT IN (SELECT chunk_id FROM known) THEN chunk_id END) / count(*) AS ratio FROM refs WHERE chunk_id IS NOT NULL GROUP BY src)"""

SQL = {
    "entity_valid": with_(valid_sql(False)) + "SELECT entity_id, entity_type, canonical, len(aliases) AS aliases, len(keys) AS keys, len(fragments) AS fragments FROM valid",
    "entity_keys": with_(VALID, KEYS) + "SELECT key, canonical, 'rewrite' AS kind FROM rkeys UNION ALL SELECT key, canonical, 'fragment' FROM fkeys",
    "key_multiplicity": with_(VALID.replace("FROM entity_table WHERE", "FROM (SELECT entity_id, entity_type, canonical, aliases, rewritekeys, fragmentonly, organguard, note FROM entity_table UNION ALL VALUES " + ", ".join(f"('{i}', '{t}', '{c}', CAST({a!r} AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), NULL, NULL)" for i, t, c, a in CLAIMS) + ") WHERE")) + "SELECT key, count(DISTINCT canonical) AS rows FROM (SELECT unnest(keys) AS key, canonical FROM valid) GROUP BY key HAVING count(DISTINCT canonical) > 1",
    "alias_expand": with_(SCAN) + "SELECT doc, key, canonical, times FROM expanded",
    "alias_normalize": with_(SCAN_FRAGMENTS)
    + "SELECT p.doc, string_agg(coalesce(h.canonical, p.piece), '' ORDER BY p.i) AS normalized FROM placed p LEFT JOIN hits h ON h.doc = p.doc AND h.i = p.i WHERE p.doc IN (SELECT doc FROM hits) GROUP BY p.doc",
    "double_write_tf": with_(SCAN, P.CTE_EXTRA, P.CTE_DOCS, P.CTE_POST)
    + "SELECT e.doc, e.term, coalesce(p.tf, 0) AS written, CAST(e.added AS BIGINT) AS added, CAST(coalesce(p.tf, 0) + e.added AS BIGINT) AS tf FROM extra e JOIN docs d ON d.doc = e.doc AND d.role = 'body' LEFT JOIN post p ON p.doc = e.doc AND p.term = e.term",
    "bm25_expanded": with_(*P.EXPANDED, P.CTE_Q, P.CTE_QT, P.CTE_DF, P.CTE_LEX)
    + f"SELECT * FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM (SELECT qid, doc, {fixed_sql('bm25', 6)} AS score FROM lex)) WHERE rank <= {K}",
    "group_valid": with_(GROUPS) + "SELECT eventid, eventname, group_type, len(chunkids) AS refs FROM gr",
    "group_aliases": with_(VALID, KEYS, GROUPS, BRIDGE_KEYS) + "SELECT CASE src WHEN 'e' THEN 'event' ELSE 'allusion' END AS kind, eventid, key FROM bkeys",
    "group_members": with_(GROUPS, _MEMBERS)
    + f"SELECT eventid, doc, chunk_id, row_number() OVER (PARTITION BY eventid ORDER BY {_PART.format(1)}, {_PART.format(2)}, {_PART.format(3)}, chunk_id, doc) AS place FROM mem WHERE src = 'e'",
    "missing_refs": with_(GROUPS)
    + "SELECT DISTINCT eventid, chunk_id FROM (SELECT eventid, unnest(chunkids) AS chunk_id FROM ev) r WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sanguo_yanyi s WHERE s.chunk_id = r.chunk_id)",
    "drift_check": with_(GROUPS)
    + f"""SELECT total_refs, missing_refs, {fixed_sql('CASE WHEN total_refs > 0 THEN missing_refs / total_refs ELSE 0 END', 6)} AS ratio, CASE WHEN total_refs > 0 THEN missing_refs / total_refs ELSE 0 END > 0.05 AS degraded, table_name
FROM (SELECT CASE src WHEN 'e' THEN 'event_groups' ELSE 'allusions' END AS table_name, count(*) AS total_refs,
  count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM sanguo_yanyi s WHERE s.chunk_id = r.chunk_id) THEN chunk_id END) AS missing_refs
  FROM (SELECT src, unnest(chunkids) AS chunk_id FROM gr) r WHERE chunk_id IS NOT NULL GROUP BY src)""",
    "drift_applied": with_(GROUPS, _REFS)
    + """SELECT CASE src WHEN 'e' THEN 'event' ELSE 'allusion' END AS kind, eventid, CAST(count(*) AS BIGINT) AS refs FROM refs JOIN gone USING (src) WHERE ratio <= 0.5 AND chunk_id IN (SELECT chunk_id FROM known) GROUP BY src, eventid""",
    "bridge_match": with_(VALID, KEYS, GROUPS, BRIDGE_KEYS, P.CTE_ASKED.replace("question_id % 100 = 0 AND ", ""), _bridge_sql("q"))
    + "SELECT qid, kind, eventid, eventname, group_type, matched, poolable, driver FROM br",
    "pool_union_cap": with_(*_GHEAD) + _CAPPED.format("gpool"),
    "enhanced_rescore": with_(*_GHEAD, *_RESCORED[:6]) + "SELECT qid, doc, score FROM cpool",
    "person_dictionary": with_(SCAN, P.CTE_TAGGED, P.CTE_TAGSCAN, PEOPLE) + "SELECT kind, person, doc FROM people",
    "pins": with_(SCAN, P.CTE_ASKED.replace("question_id % 100 = 0 AND ", ""), P.CTE_TAGGED, P.CTE_TAGSCAN, GROUPS, BRIDGE_KEYS, _bridge_sql("q"), _MEMBERS, PEOPLE, PINS) + "SELECT qid, doc, direction FROM pins",
    "pinned_order": with_(*P.HYBRID, *_PINNED) + f"SELECT qid, doc, score, pinned, rank FROM pinned WHERE rank <= {K}",
    "rerank_window": with_(*P.HYBRID, *_PINNED)
    + """SELECT qid, doc, rank, row_number() OVER (PARTITION BY qid ORDER BY zone, CASE WHEN zone = 1 THEN ce END DESC NULLS LAST, rank) AS final_rank FROM (
  SELECT p.qid, p.doc, p.rank, length(s.text) AS ce, CASE WHEN p.rank > 50 THEN 2 WHEN p.pinned = 1 THEN 0 ELSE 1 END AS zone FROM pinned p JOIN sanguo_yanyi s ON s.row_id = p.doc)""",
    "search_full": with_(*_FULL) + f"SELECT qid, doc, score, rank, pinned, tag_hit, {_SOURCES} AS sources, 'no_scorer' AS degraded FROM ranked r WHERE rank <= 20",
    "search_reranked": with_(*_FULL,
        "win AS (SELECT r.*, q.text AS qtext, s.text AS dtext, min(pinned) OVER (PARTITION BY r.qid) AS all_pinned FROM (SELECT * FROM ranked WHERE rank <= 50) r JOIN q USING (qid) JOIN sanguo_yanyi s ON s.row_id = r.doc)",
        "ch AS (SELECT *, list_distinct(regexp_extract_all(coalesce(qtext, ''), '(?s).')) AS a, list_distinct(regexp_extract_all(coalesce(dtext, ''), '(?s).')) AS b FROM win)",
        "ce AS (SELECT *, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS ce FROM ch)")
    + """SELECT * FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, CASE WHEN pinned = 0 THEN ce END DESC NULLS LAST, rank) AS rank, pinned, CASE WHEN all_pinned = 1 THEN 'no_candidates' END AS degraded FROM ce) WHERE rank <= 20""",
}
