"""Question bank matching: set similarity, hashed vectors, edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators.retrieval import cosine_scores, top_k

DIM, ROUTE, MOST = 256, 0.9, 8


def bigrams(bank: DataFrame) -> DataFrame:
    """(id, size, gram) of ``bank(id, text)`` in comparison form; texts without characters have none."""
    formed = bank.select("id", X.bank_form("text").alias("form")).where("form <> ''")
    sized = formed.select("id", F.size(X.bigram_set("form")).alias("size"), "form")
    return sized.select("id", "size", F.explode(X.bigram_set("form")).alias("gram"))


def dice_top(queries: DataFrame, bank: DataFrame, k: int = MOST) -> DataFrame:
    """(qid, id, score, rank): the ``k`` bank rows with the largest Dice coefficient, through shared pairs."""
    q, b = bigrams(queries).select(F.col("id").alias("qid"), F.col("size").alias("qsize"), "gram"), bigrams(bank)
    shared = q.join(b, "gram").groupBy("qid", "qsize", "id", "size").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.select("qid", "id", X.fixed(X.dice(F.col("shared"), F.col("qsize"), F.col("size")), 6).alias("score"))
    return top_k(scored, k, F.desc("score"), F.col("id"))


def hashed_vectors(bank: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, embedding): signed token buckets scaled to length 1; texts without tokens have none."""
    formed = bank.select("id", X.bank_form("text").alias("form"))
    each = formed.select("id", F.explode(X.tokens("form")).alias("token"))
    distinct = each.select("token").distinct().withColumn("h", X.fnv1a32("token"))  # one hash per token, not per use
    weights = (
        each.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n")).join(distinct, "token")
        .groupBy("id", (F.col("h").bitwiseAND(F.lit(0x7FFFFFFF)) % dim).alias("bucket"))
        .agg(F.sum(F.when(F.col("h") >= 0x80000000, -F.col("n")).otherwise(F.col("n"))).alias("w"))
        .where("w <> 0")
    )
    dense = weights.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))  # at most ``dim`` entries
    return dense.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0)) / F.col("norm")).alias("embedding"))


def hashed_top(queries: DataFrame, bank: DataFrame, k: int = MOST) -> DataFrame:
    """(qid, id, similarity, rank): the ``k`` most similar bank rows by hashed vectors, multiplied in blocks."""
    q = hashed_vectors(queries).select(F.col("id").alias("qid"), "embedding")
    scored = cosine_scores(q, hashed_vectors(bank).select(F.col("id").alias("doc"), "embedding"), k)
    ranked = top_k(scored, k, X.fixed(F.col("cosine"), 6).desc(), F.col("doc"))
    return ranked.select("qid", F.col("doc").alias("id"), F.col("cosine").alias("similarity"), "rank")


def close_in_edits(queries: DataFrame, bank: DataFrame, least: float = ROUTE) -> DataFrame:
    """(qid, id, similarity) with a lexical similarity of at least ``least``.

    The similarity bounds the lengths and the number of edits ``e``. A bank signature is cut into ``e + 1`` pieces, of
    which one at least stands unchanged in any signature within ``e`` edits, moved by at most ``e`` places; so
    signatures meet by length, piece and its text, and only those that met are compared.
    """
    signed = lambda df, i: df.select(F.col("id").alias(i), X.bank_form("text").alias("f")).select(i, X.route_signature("f").alias("s")).where("s <> ''").withColumn("n", F.length("s"))
    lo, hi = lambda n: F.ceil(n * least - 1e-9).cast("int"), lambda n: F.floor(n / least + 1e-9).cast("int")
    edits = lambda n: F.floor(hi(n) * (1 - least) + 1e-9).cast("int")  # noqa: E731  the most for a bank signature of length n
    begin = lambda n, e, i: F.floor(n * i / (e + 1)).cast("int")
    b = signed(bank, "id").withColumn("e", edits(F.col("n")))
    b = b.select("id", "s", F.col("n").alias("len"), "e", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("piece"))
    b = b.withColumn("at", begin(F.col("len"), F.col("e"), F.col("piece"))).withColumn("size", begin(F.col("len"), F.col("e"), F.col("piece") + 1) - F.col("at"))
    b = b.select("id", "s", "len", "piece", F.substring("s", F.col("at") + 1, F.col("size")).alias("part"))
    q = signed(queries, "qid").withColumnRenamed("s", "qs")
    q = q.select("qid", "qs", "n", F.explode(F.sequence(lo(F.col("n")), F.greatest(lo(F.col("n")), hi(F.col("n"))))).alias("len")).withColumn("e", edits(F.col("len")))
    q = q.select("qid", "qs", "n", "len", "e", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("piece"))
    q = q.withColumn("at", begin(F.col("len"), F.col("e"), F.col("piece"))).withColumn("size", begin(F.col("len"), F.col("e"), F.col("piece") + 1) - F.col("at"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("e")), F.greatest(F.greatest(F.lit(0), F.col("at") - F.col("e")), F.least(F.col("at") + F.col("e"), F.col("n") - F.col("size"))))
    q = q.select("qid", "qs", "len", "piece", F.explode(F.array_distinct(F.transform(starts, lambda a: F.substring(F.col("qs"), a + 1, F.col("size"))))).alias("part"))
    met = q.join(b, ["len", "piece", "part"]).select("qid", "id", "qs", "s").distinct()
    sim = 1 - F.levenshtein("qs", "s") / F.greatest(F.length("qs"), F.length("s"))
    return met.select("qid", "id", sim.alias("similarity")).where(F.col("similarity") >= least)


def route(queries: DataFrame, bank: DataFrame, least: float = ROUTE, own: bool = False) -> DataFrame:
    """(qid, vector_similarity, known): whether a bank row is near enough by vector or by edits.

    With ``own`` the queries are rows of the bank, and a query doesn't meet the row with its own id.
    """
    others = (lambda df: df.where("qid <> id")) if own else lambda df: df
    best = others(hashed_top(queries, bank, 2)).groupBy("qid").agg(F.max("similarity").alias("best"))
    near = others(close_in_edits(queries, bank, least)).select("qid", F.lit(True).alias("near")).distinct()
    joined = queries.select(F.col("id").alias("qid")).join(best, "qid", "left").join(near, "qid", "left")
    vector = F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)))
    return joined.select("qid", X.fixed(vector, 6).alias("vector_similarity"), (F.coalesce("near", F.lit(False)) | (vector >= least - 1e-9)).alias("known"))


def judged(answers: DataFrame) -> DataFrame:
    """``answers(message, options, answer, ..)`` with ``chosen`` and ``correct``.

    A message chooses by an option's letter, whatever its width and case, else by an option's text in bank form; one
    that is neither chooses nothing (null). ``options`` maps the letters A to D to texts, ``answer`` is a text.
    """
    letters = ("A", "B", "C", "D")
    formed = answers.withColumns({"__message": X.bank_form("message"), "__right": X.bank_form("answer"), **{f"__{k}": X.bank_form(F.col("options")[k]) for k in letters}})
    of = lambda c: F.coalesce(*[F.when(F.col(f"__{k}") == F.col(c), k) for k in letters])
    letter = F.coalesce(*[F.when(F.col("__message") == k.lower(), k) for k in letters])
    chosen = F.coalesce(letter, of("__message"))
    out = formed.withColumn("chosen", chosen).withColumn("right_one", of("__right")).withColumn("correct", F.col("chosen") == F.col("right_one"))
    return out.drop("__message", "__right", *(f"__{k}" for k in letters))
