"""Queries of the text problems, by name, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import lookalike, mixing, pieces, reading, sentences, terms, tokens
from inkwell.runtime import cut, table


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        lookalike.look_keys(table(spark, sf_dir, t), i, c).withColumn("table_name", F.lit(t))
        for t, i, c in (("sanguo_yanyi", "row_id", "text"), ("event_question_pool", "question_id", "question"))
    ]
    return cut(found[0].unionByName(found[1]))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(_spellings(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a look with several spellings with its class and number of links."""
    return lookalike.lookalike_classes(_spellings(spark, sf_dir))


def p2_canonical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, sf_dir, "sanguo_yanyi"), "row_id", "text")


def p2_canonical_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, sf_dir, "event_question_pool"), "question_id", "question")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "sanguo_yanyi")
    return sentences.sentence_ends(chunks, "row_id", "text", sentences.learn_periods(chunks, "text", "source"), "source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.names_of_few(table(spark, sf_dir, "sanguo_yanyi"), table(spark, sf_dir, "entity_table"))


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's own terms, ranked, with the dictionary's names among them."""
    return terms.characteristic_terms(table(spark, sf_dir, "sanguo_yanyi"), terms.Names(table(spark, sf_dir, "entity_table"), "canonical"))


def p4_terms_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins in blocks, as it runs where the background is too large for a broadcast."""
    return terms.characteristic_terms(table(spark, sf_dir, "sanguo_yanyi"), terms.Names(table(spark, sf_dir, "entity_table"), "canonical"), broadcast_bytes=0)


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    chunks = table(spark, sf_dir, "sanguo_yanyi")
    return pieces.split_oversized(chunks, sentences.learn_periods(chunks, "text", "source"), with_text=with_text, lang_col="source")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_kinds(_pieces(spark, sf_dir, with_text=False))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, with_text=True)


def p5_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of more than 512 tokens as pieces of at most 512 with an overlap of up to 64."""
    chunks = table(spark, sf_dir, "sanguo_yanyi")
    learned = sentences.learn_periods(chunks, "text", "source")
    return pieces.split_oversized(chunks, learned, 512, 64, lang_col="source", tokenizer=tokens.tokenizer_path())


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded ids of every document; null and empty texts come back empty."""
    return tokens.decoded(p6_ids(spark, sf_dir), "doc_id")


def _mix(spark: SparkSession, sf_dir: str, budget: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    plan = mixing.plan_mixes(sized, table(spark, sf_dir, "mix_targets"), budget)
    return mixing.draw(sized, plan), plan


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(*_mix(spark, sf_dir))


def p7_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached at the largest total at which no cap binds."""
    return mixing.reached_shares(*_mix(spark, sf_dir, "exact"))


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents").where("source is null or lower(trim(source)) <> 'tool_trace'")
    return reading.reading_levels(documents, table(spark, sf_dir, "reading_labels"), "lang"), documents


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)[0].select("doc_id", "reading_level")


def p8_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(round, moved, settled): how far the words' difficulties still moved in each round of the propagation."""
    documents = table(spark, sf_dir, "documents").where("source is null or lower(trim(source)) <> 'tool_trace'")
    done = reading.word_difficulty(reading.document_graph(documents, reading.opinions(table(spark, sf_dir, "reading_labels"))))
    rows = [(i, m, done.settled and i == len(done.moves)) for i, m in enumerate(done.moves, 1)]
    return spark.createDataFrame(rows, "round int, moved double, settled boolean")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.level_profile(*_levels(spark, sf_dir))


QUERIES = {
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p2_canonical_chunks": p2_canonical_chunks,
    "p2_canonical_questions": p2_canonical_questions,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p4_terms_joined": p4_terms_joined,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_token_pieces": p5_token_pieces,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_exact_shares": p7_exact_shares,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
    "p8_rounds": p8_rounds,
}
SQL = {
    "p4_found": """
WITH e AS (SELECT DISTINCT canonical FROM entity_table WHERE canonical <> ''),
h AS (SELECT DISTINCT s.chunk_id, e.canonical FROM sanguo_yanyi s JOIN e ON contains(s.text, e.canonical) WHERE s.chunk_id IS NOT NULL),
c AS (SELECT canonical FROM h GROUP BY canonical HAVING count(*) BETWEEN 2 AND 5)
SELECT chunk_id, canonical FROM h SEMI JOIN c USING (canonical)""",
    # decoding gives back every text
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
