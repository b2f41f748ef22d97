"""Alias tables: validation, key sets, and guarded longest-match rewriting and expansion of texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as X
from inkwell.operators.matching import substring_join
from inkwell.runtime import BROADCAST_BYTES, cut, ship, spread


def _texts(c: str) -> Column:
    return F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _order() -> list[Column]:
    """A total order that stands for file order: repeated rows differ in some of these."""
    joined = lambda c: F.coalesce(F.concat_ws(",", c), F.lit(""))
    return [F.col("entity_id").asc_nulls_first(), F.coalesce("note", F.lit("")), joined("aliases"), joined("rewritekeys"), joined("fragmentonly")]


def valid_entities(entities: DataFrame, person_type: str = "person", wide: bool = False) -> DataFrame:
    """Rows that pass validation, with cleaned ``aliases``, ``keys`` and ``fragments``.

    In file order: rows without type or canonical form go; the first row of a (type, canonical) stays;
    persons need an id, the first row of an id stays; rows without aliases go. Keys must be aliases of two
    or more characters, no fragment of the row and no word a guard names; fragments must be aliases and
    differ from the canonical form. With ``wide`` every alias is offered as a key and fragments need not be
    aliases, for tables that fill the key columns loosely.
    """
    kept = entities.where("entity_type <> '' and canonical <> ''")
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("entity_type", "canonical").orderBy(*_order()))).where("__n = 1")
    kept = kept.where((F.col("entity_type") != person_type) | (F.coalesce("entity_id", F.lit("")) != ""))
    person = Window.partitionBy("entity_type", "entity_id").orderBy(*_order(), F.col("canonical"))
    kept = kept.withColumn("__n", F.row_number().over(person)).where((F.col("entity_type") != person_type) | (F.col("__n") == 1)).drop("__n")
    clean = kept.select("entity_id", "entity_type", "canonical", "organguard", "note", *(_texts(c).alias(c) for c in ("aliases", "rewritekeys", "fragmentonly"))).where("size(aliases) > 0")
    return clean.select(
        "entity_id", "entity_type", "canonical", "organguard", F.array_distinct("aliases").alias("aliases"),
        F.array_distinct(F.filter(F.concat("rewritekeys", "aliases") if wide else F.col("rewritekeys"), lambda k: F.array_contains(F.col("aliases"), k) & ~F.array_contains(F.col("fragmentonly"), k) & (F.length(k) > 1))).alias("keys"),
        F.array_distinct(F.filter("fragmentonly", lambda k: (F.lit(wide) | F.array_contains(F.col("aliases"), k)) & (k != F.col("canonical")))).alias("fragments"),
    )


def guard_words(entities: DataFrame) -> DataFrame:
    """(key): words that the rows' guards forbid as keys."""
    bad = F.from_json("organguard", "bad array<array<string>>").getField("bad")
    return entities.where("organguard is not null").select(F.explode(bad).alias("b")).select(F.col("b")[0].alias("key")).where("key is not null").distinct()


def rewrite_keys(valid: DataFrame) -> DataFrame:
    """(key, canonical): a key is dropped when it is any row's canonical form, part of another row's longer
    canonical form, guarded, or claimed by more than one row."""
    canon = valid.select(F.col("canonical").alias("other")).distinct()
    keys = valid.select(F.explode("keys").alias("key"), "canonical")
    keys = keys.join(canon.withColumnRenamed("other", "key"), "key", "left_anti").join(guard_words(valid), "key", "left_anti")
    inside = substring_join(canon, "other", keys.withColumnRenamed("canonical", "own"), "key").where("other <> own and length(other) > length(key)").select("key", F.col("own").alias("canonical"))
    keys = keys.join(inside.distinct(), ["key", "canonical"], "left_anti")
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("canonical").alias("canonical")).where("n = 1").select("key", "canonical")


def fragment_keys(valid: DataFrame) -> DataFrame:
    """(key, canonical): fragments expand wherever they stand; the first row (by id, then form) owns one."""
    each = valid.select(F.explode("fragments").alias("key"), "canonical", "entity_id")
    first = Window.partitionBy("key").orderBy(F.col("entity_id").asc_nulls_first(), "canonical")
    return each.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("key", "canonical")


def known_words(valid: DataFrame) -> DataFrame:
    return valid.select(F.explode(F.concat(F.array("canonical"), "aliases", "keys")).alias("word")).distinct()


def key_multiplicity(valid: DataFrame) -> DataFrame:
    """(key, rows): keys of more than one row, which are dropped everywhere."""
    return valid.select(F.explode("keys").alias("key"), "canonical").groupBy("key").agg(F.countDistinct("canonical").alias("rows")).where("rows > 1")


def lexicon(valid: DataFrame) -> DataFrame:
    """(word, is_key, is_fragment, canonical): everything a text is searched for."""
    keys = rewrite_keys(valid).select(F.col("key").alias("word"), F.col("canonical").alias("key_of"), F.lit(None).cast("string").alias("fragment_of"))
    parts = fragment_keys(valid).select(F.col("key").alias("word"), F.lit(None).cast("string").alias("key_of"), F.col("canonical").alias("fragment_of"))
    words = known_words(valid).select("word", F.lit(None).cast("string").alias("key_of"), F.lit(None).cast("string").alias("fragment_of"))
    return keys.unionByName(parts).unionByName(words).groupBy("word").agg(F.max("key_of").alias("key_of"), F.max("fragment_of").alias("fragment_of"))


HITS = "array<struct<at:int,word:string,key_of:string,fragment_of:string>>"


def resolve(hits: list[tuple[int, str, str | None, str | None]]) -> tuple[list[tuple[int, str, str]], dict[tuple[str, str], int]]:
    """Replacements and expansion counts of one text from all occurrences of lexicon words in it.

    Keys match leftmost, then longest, without overlap. A match inside a longer known word standing there is
    guarded: it is passed over whole, shorter keys in it are not tried. Fragments count their
    non-overlapping occurrences from the left.
    """
    hits = sorted(hits, key=lambda h: (h[0], -len(h[1])))
    replaced: list[tuple[int, str, str]] = []
    counts: dict[tuple[str, str], int] = {}
    free = 0
    fragment_free: dict[str, int] = {}
    longest = max((len(h[1]) for h in hits), default=0)
    at_start: dict[int, list[int]] = {}
    for s, w, _, _ in hits:
        at_start.setdefault(s, []).append(len(w))
    for s, w, key_of, fragment_of in hits:
        if fragment_of is not None and s >= fragment_free.get(w, 0):
            fragment_free[w] = s + len(w)
            counts[w, fragment_of] = counts.get((w, fragment_of), 0) + 1
        if key_of is None or s < free:
            continue
        free = s + len(w)
        if any(n > len(w) and b + n >= free for b in range(max(0, s - longest), s + 1) for n in at_start.get(b, ())):
            continue
        replaced.append((s, w, key_of))
        counts[w, key_of] = counts.get((w, key_of), 0) + 1
    return replaced, counts


SCANNED = "doc bigint, normalized string, rewrites array<struct<word:string,canonical:string>>, expansions array<struct<word:string,canonical:string,times:int>>"


KEPT = "doc bigint, text string, expansions array<struct<word:string,canonical:string,times:int>>"


def scan_texts(texts: DataFrame, lex: DataFrame, most_bytes: int = BROADCAST_BYTES, whole: bool = False) -> DataFrame:
    """(doc, normalized, rewrites, expansions) of ``texts(doc, text)`` that contain a lexicon word; with ``whole``
    (doc, text, expansions) of every text that isn't empty.

    A lexicon within ``most_bytes`` is broadcast as one automaton; a larger one is joined to the texts on the
    first two characters of its words, and a text's occurrences are resolved together afterwards.
    """
    spark = texts.sparkSession
    ship(spark)
    size = lex.select(F.sum(F.octet_length("word") + 128)).first()[0] or 0

    pair = [pa.field("word", pa.string()), pa.field("canonical", pa.string())]
    types = [pa.int64(), pa.string(), pa.list_(pa.struct(pair)), pa.list_(pa.struct([*pair, pa.field("times", pa.int32())]))]

    def finish(doc: list, text: list, hits: list) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for d, t, h in zip(doc, text, hits, strict=True):
            replaced, counts = resolve(h)
            parts, at = [], 0
            for s, w, to in replaced:
                parts += [t[at:s], to]
                at = s + len(w)
            for o, v in zip(out, (d, "".join(parts) + t[at:], [{"word": w, "canonical": c} for _, w, c in replaced], [{"word": w, "canonical": c, "times": n} for (w, c), n in sorted(counts.items())]), strict=True):
                o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["doc", "normalized", "rewrites", "expansions"])

    source = spread(texts.select(F.col("doc").cast("bigint").alias("doc"), "text").where("text <> ''"))
    if size <= most_bytes:
        words = spark.sparkContext.broadcast([(r.word, r.key_of, r.fragment_of) for r in lex.collect()])

        def by_automaton(batches):
            machine = ahocorasick.Automaton()
            for w, k, f in words.value:
                machine.add_word(w, (w, k, f))
            if words.value:
                machine.make_automaton()
            elif not whole:
                return
            for batch in batches:
                doc, text, hits = [], [], []
                if whole:
                    counts = [resolve([(e - len(w) + 1, w, k, f) for e, (w, k, f) in machine.iter(t)])[1] if words.value else {} for t in batch.column(1).to_pylist()]
                    found = [[{"word": w, "canonical": c, "times": n} for (w, c), n in sorted(x.items())] for x in counts]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, types[3])], ["doc", "text", "expansions"])
                    continue
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if h := [(e - len(w) + 1, w, k, f) for e, (w, k, f) in machine.iter(t)]:
                        doc.append(d), text.append(t), hits.append(h)
                yield finish(doc, text, hits)

        return source.mapInArrow(by_automaton, KEPT if whole else SCANNED)
    # only row numbers, places and pairs meet the lexicon; the texts are fetched for the rows that met a word
    source = cut(source.withColumn("__row", F.monotonically_increasing_id()))
    places = source.select("__row", F.posexplode(X.pairs("text")).alias("at", "gram")).unionByName(source.select("__row", F.posexplode(X.singles("text")).alias("at", "gram")))
    found = (
        places.join(lex.withColumn("gram", F.substring("word", 1, 2)), "gram")
        .join(source, "__row")
        .where(F.substring(F.col("text"), F.col("at") + 1, F.length("word")) == F.col("word"))
        .groupBy("__row", "doc", "text")
        .agg(F.collect_list(F.struct("at", "word", "key_of", "fragment_of")).alias("hits"))
        .drop("__row")
    )

    def by_join(batches):
        for batch in batches:
            hits = [[(h["at"], h["word"], h["key_of"], h["fragment_of"]) for h in hs] for hs in batch.column(2).to_pylist()]
            yield finish(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hits)

    met = found.mapInArrow(by_join, SCANNED)
    return source.select("doc", "text").join(met.select("doc", "expansions"), "doc", "left").select("doc", "text", F.coalesce("expansions", F.array().cast(KEPT.rsplit(" ", 1)[1])).alias("expansions")) if whole else met


def expansions(scanned: DataFrame) -> DataFrame:
    """(doc, key, canonical, times) of a scan."""
    return scanned.select("doc", F.explode("expansions").alias("e")).select("doc", F.col("e.word").alias("key"), "e.canonical", "e.times")


def double_write(expanded: DataFrame) -> DataFrame:
    """(doc, term, tf): every distinct token of an expansion's canonical form counts as often as the key."""
    each = expanded.select("doc", "times", F.explode(F.array_distinct(X.tokens("canonical"))).alias("term"))
    return each.groupBy("doc", "term").agg(F.sum("times").alias("tf"))


def merged(entities: DataFrame, banned: DataFrame, no_keys_types: tuple[str, ...] = ()) -> DataFrame:
    """One row per (type, canonical) of a draft with repeated rows.

    Aliases, keys and fragments are united in sorted order; the smallest id stays. Keys must be aliases, not the
    canonical form, and of two or more characters; ``banned(key)`` words and all aliases of the types in
    ``no_keys_types`` become fragments instead; a key of several rows is dropped from all and becomes none.
    """
    each = entities.where("entity_type <> '' and canonical <> ''").select("entity_id", "entity_type", "canonical", *(_texts(c).alias(c) for c in ("aliases", "rewritekeys", "fragmentonly")))
    united = each.groupBy("entity_type", "canonical").agg(F.min("entity_id").alias("entity_id"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("aliases", "rewritekeys", "fragmentonly")))
    own = lambda k: F.array_contains(F.col("aliases"), k) & (k != F.col("canonical"))
    loose = F.col("entity_type").isin(*no_keys_types) if no_keys_types else F.lit(False)
    named = united.select("entity_id", "entity_type", "canonical", "aliases", F.filter("rewritekeys", own).alias("wanted"), F.filter(F.when(loose, F.array_union("fragmentonly", "aliases")).otherwise(F.col("fragmentonly")), own).alias("parts"), loose.alias("loose"))
    keys = named.select("entity_type", "canonical", "loose", F.explode("wanted").alias("key")).where("length(key) > 1")
    marked = keys.join(banned.select("key", F.lit(True).alias("__b")).distinct(), "key", "left").withColumn("__b", F.coalesce("__b", F.lit(False)) | F.col("loose"))
    claims = marked.where("not __b").groupBy("key").agg(F.countDistinct("entity_type", "canonical").alias("claims"))
    decided = marked.join(claims, "key", "left").groupBy("entity_type", "canonical").agg(
        F.array_sort(F.collect_set(F.when(~F.col("__b") & (F.col("claims") == 1), F.col("key")))).alias("keys"), F.collect_set(F.when(F.col("__b"), F.col("key"))).alias("moved")
    )
    none = F.array().cast("array<string>")
    joined = named.join(decided, ["entity_type", "canonical"], "left").withColumn("keys", F.coalesce("keys", none)).withColumn("moved", F.coalesce("moved", none))
    return joined.select("entity_id", "entity_type", "canonical", "aliases", "keys", F.array_sort(F.array_except(F.array_union("parts", "moved"), "keys")).alias("fragments"))


def merge_problems(rows: DataFrame) -> DataFrame:
    """(problem, key): what a merged table must not have; empty when it is sound."""
    key = rows.select("entity_type", "canonical", F.explode("keys").alias("key"))
    part = rows.select("canonical", F.explode("fragments").alias("key"))
    forms = rows.select(F.col("canonical").alias("key")).distinct()
    said = lambda df, what: df.select(F.lit(what).alias("problem"), "key")
    return (
        said(key.groupBy("key").count().where("count > 1"), "key of several rows")
        .unionByName(said(rows.groupBy("entity_type", F.col("canonical").alias("key")).count().where("count > 1"), "form twice in a type"))
        .unionByName(said(key.join(forms, "key", "left_semi"), "form among keys"))
        .unionByName(said(part.join(key.select("canonical", "key"), ["canonical", "key"], "left_semi"), "key and fragment"))
    )


def content_digest(rows: DataFrame) -> DataFrame:
    """One row: the first eight hex digits of a digest over all rows, independent of their order.

    Row digests are summed, so no task or driver holds the table; a repeated row counts.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.substring(F.sha2(F.concat_ws(":", F.sum(part).cast("string"), F.count(F.lit(1)).cast("string")), 256), 1, 8).alias("digest"), F.count(F.lit(1)).alias("rows"))
