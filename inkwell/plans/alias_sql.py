"""SQL of the alias table: validation, keys, and the guarded scan of texts."""

from __future__ import annotations

_CLEAN = "list_filter(coalesce({}, []), lambda x: x IS NOT NULL AND x <> '')"
_ORD = "entity_id NULLS FIRST, coalesce(note, ''), coalesce(array_to_string(aliases, ','), ''), coalesce(array_to_string(rewritekeys, ','), ''), coalesce(array_to_string(fragmentonly, ','), '')"
def valid_sql(wide: bool) -> str:
    return f"""v1 AS (SELECT *, row_number() OVER (PARTITION BY entity_type, canonical ORDER BY {_ORD}) AS n FROM entity_table WHERE entity_type <> '' AND canonical <> ''),
v2 AS (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY {_ORD}, canonical) AS n FROM v1 WHERE n = 1 AND (entity_type <> 'person' OR coalesce(entity_id, '') <> '')),
v3 AS (SELECT entity_id, entity_type, canonical, organguard, {_CLEAN.format('aliases')} AS al, {_CLEAN.format('rewritekeys')} AS rk, {_CLEAN.format('fragmentonly')} AS fr FROM v2 WHERE entity_type <> 'person' OR n = 1),
valid AS (SELECT entity_id, entity_type, canonical, organguard, list_distinct(al) AS aliases,
  list_distinct(list_filter({'list_concat(rk, al)' if wide else 'rk'}, lambda k: list_contains(al, k) AND NOT list_contains(fr, k) AND length(k) > 1)) AS keys,
  list_distinct(list_filter(fr, lambda k: {'true' if wide else 'list_contains(al, k)'} AND k <> canonical)) AS fragments FROM v3 WHERE len(al) > 0)"""


VALID = valid_sql(True)
KEYS = """guards AS (SELECT DISTINCT unnest(CAST(json_extract_string(organguard, '$.bad[*][0]') AS VARCHAR[])) AS key FROM valid WHERE organguard IS NOT NULL),
k1 AS (SELECT DISTINCT unnest(keys) AS key, canonical FROM valid),
k2 AS (SELECT * FROM k1 WHERE key NOT IN (SELECT canonical FROM valid) AND key NOT IN (SELECT key FROM guards WHERE key IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM valid o WHERE o.canonical <> k1.canonical AND length(o.canonical) > length(k1.key) AND contains(o.canonical, k1.key))),
rkeys AS (SELECT key, min(canonical) AS canonical FROM k2 GROUP BY key HAVING count(*) = 1),
fkeys AS (SELECT key, canonical FROM (SELECT key, canonical, row_number() OVER (PARTITION BY key ORDER BY entity_id NULLS FIRST, canonical) AS n FROM (SELECT unnest(fragments) AS key, canonical, entity_id FROM valid)) WHERE n = 1)"""
WORDS = """words AS (SELECT DISTINCT unnest(list_concat([canonical], aliases, keys)) AS word FROM valid),
pat AS (SELECT '(?s)(' || coalesce(string_agg(regexp_escape(key), '|' ORDER BY length(key) DESC, key) || '|', '') || '.)' AS p FROM rkeys)"""


def scan_sql(source: str, end: str = "") -> str:
    """CTEs placed, hits and expanded (with ``end`` behind their names) over ``source``, a query of doc and text."""
    return f"""segs{end} AS (SELECT doc, text, regexp_extract_all(text, (SELECT p FROM pat)) AS g FROM ({source}) WHERE text <> ''),
pieces{end} AS (SELECT doc, text, unnest(g) AS piece, generate_subscripts(g, 1) AS i FROM segs{end}),
placed{end} AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM pieces{end}),
hits{end} AS (SELECT p.doc, p.i, p.piece AS key, r.canonical FROM placed{end} p JOIN rkeys r ON r.key = p.piece
  WHERE NOT EXISTS (SELECT 1 FROM words w, range(1, length(w.word) - length(p.piece) + 2) o(j) WHERE length(w.word) > length(p.piece) AND contains(w.word, p.piece)
    AND substring(w.word, CAST(o.j AS INT), length(p.piece)) = p.piece AND p.at - o.j + 1 >= 0 AND substring(p.text, CAST(p.at - o.j + 2 AS INT), length(w.word)) = w.word)),
expanded{end} AS (SELECT doc, key, canonical, CAST(sum(times) AS INT) AS times FROM (
  SELECT doc, key, canonical, count(*) AS times FROM hits{end} GROUP BY ALL
  UNION ALL SELECT s.doc, f.key, f.canonical, (length(s.text) - length(replace(s.text, f.key, ''))) // length(f.key) FROM ({source}) s JOIN fkeys f ON contains(s.text, f.key)) GROUP BY ALL)"""


CHUNK_TEXTS = "SELECT row_id AS doc, text FROM sanguo_yanyi"
_SCAN = f"""{VALID},
{KEYS},
{WORDS},
{scan_sql(CHUNK_TEXTS)}"""
SCAN = _SCAN
SCAN_FRAGMENTS = _SCAN.replace("rkeys AS (SELECT key", "rkeys0 AS (SELECT key", 1).replace("\nwords AS", "\nrkeys AS (SELECT * FROM rkeys0 UNION SELECT key, canonical FROM fkeys WHERE key NOT IN (SELECT key FROM rkeys0)),\nwords AS", 1)
