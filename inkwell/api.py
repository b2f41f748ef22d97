"""The call surface: one function per tool, over batches of queries."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import bank as B
from inkwell.operators import corpus as C
from inkwell.operators import entities as E
from inkwell.operators import pipeline as L
from inkwell.operators.retrieval import RERANK_WINDOW, pick_one, vector_base64
from inkwell.runtime import cut
from inkwell.sources import writers

DEFAULT_LIMIT, MOST_LIMIT = 5, 20
LONGEST_QUERY = 300
NO_SESSION, EMPTY_BANK = "no_session", "empty_bank"


def search(
    queries: DataFrame, corpus: L.Corpus | DataFrame, tags: DataFrame | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
    limit: int = DEFAULT_LIMIT, make_scorer: Callable | None = None, window: int = RERANK_WINDOW, source: str | None = None,
) -> DataFrame:
    """The first ``limit`` results of every query of ``queries(qid, text)``: see ``pipeline.search``.

    ``corpus``: what ``pipeline.prepare`` made, which serves any number of calls; or chunks(doc, role, chunk_id, text),
    from which it is made here with ``tags(chunk_id, tags)`` and ``vectors(doc, embedding)``. A limit over 20 is taken
    as 20. ``source`` keeps results to one edition and must be one that the chunks have. ``query_vectors(qid, embedding)``
    and ``make_scorer`` (a pair scorer) are optional; routes without data are off. What a call writes on the way
    is removed when ``runtime.scope`` around it ends, or the session.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    chunks = corpus if isinstance(corpus, DataFrame) else corpus.chunks
    if source is not None and not chunks.where(F.col("source") == source).limit(1).count():
        raise ValueError(f"no source {source!r}")
    if isinstance(corpus, DataFrame):
        corpus = L.prepare(chunks if source is None else chunks.where(F.col("source") == source), tags, vectors=vectors)
    elif source is not None:
        raise ValueError("prepare a corpus of the source")
    return L.search(corpus, queries, query_vectors, min(limit, MOST_LIMIT), make_scorer, window)


def search_json(queries: DataFrame, corpus: L.Corpus | DataFrame, **options) -> DataFrame:
    """(qid, payload): results as JSON arrays, or the fixed text for no hits."""
    found = search(queries, corpus, **options)
    chunks = corpus if isinstance(corpus, DataFrame) else corpus.chunks
    return writers.result_json(found.join(chunks.select("doc", "chunk_id", "text"), "doc"), queries, "chunk_id", "text", "score")


def query_embed(queries: DataFrame, make_encoder: Callable, entities: DataFrame | None = None, norm_version: str = "") -> DataFrame:
    """(qid, payload): every query's vector as JSON (dim, encoding, data, normVersion), or the uniform error.

    ``make_encoder()`` runs once per task and returns a function from a list of texts to a list of vectors, or is None.
    Aliases are rewritten before encoding (``entities``: ``valid_entities``). Blank queries, queries of more than 300 code
    points and queries the encoder fails on get the error, and only those.
    """
    import pyarrow as pa

    from inkwell.runtime import ship

    ship(queries.sparkSession)
    rows = queries.select("qid", "text", F.coalesce((F.length(X.without_blanks("text")) > 0) & (F.length("text") <= LONGEST_QUERY), F.lit(False)).alias("ok"))
    asked = rows.where("ok").select(F.col("qid").cast("bigint").alias("doc"), "text")
    if entities is not None:
        asked = cut(asked)
        forms = E.scan_texts(asked, E.lexicon(entities)).select("doc", "normalized")
        asked = asked.join(forms, "doc", "left").select("doc", F.coalesce("normalized", "text").alias("text"))

    def run(batches):
        encoder = make_encoder()
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for t in texts:
                try:
                    out.append([float(x) for x in encoder([t])[0]] if encoder else None)
                except Exception:  # one query's failure is its own error
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["doc", "embedding"])

    coded = vector_base64(asked.mapInArrow(run, "doc bigint, embedding array<double>").where("size(embedding) > 0"))
    payload = F.to_json(F.struct("dim", F.lit("base64-float32-le").alias("encoding"), "data", F.lit(norm_version).alias("normVersion")))
    made = coded.select(F.col("doc").alias("qid"), payload.alias("payload"))
    return rows.select("qid").join(made, "qid", "left").withColumn("payload", F.coalesce("payload", F.to_json(F.struct(F.lit(True).alias("isError")))))


def bank_answers(found: DataFrame, bank: DataFrame) -> DataFrame:
    """(qid, payload): ``bank_query`` results as numbered "question → answer" lines; ``bank(id, question, answer)``."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "question", F.lit(" → "), "answer")
    rows = found.join(bank, "id").select("qid", "rank", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])  # at most eight
    return rows.groupBy("qid").agg(F.array_join(lines, "\n").alias("payload"))


def random_question(bank: DataFrame, seed: int) -> DataFrame:
    return pick_one(bank, "id", seed)


def alerts_text(rows: DataFrame) -> DataFrame:
    """(id, payload): ``readers.alert_rows`` as text, one block an alert."""
    names = ("event", "areaDesc", "severity", "status", "headline")
    block = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.col(n)) for n in names])
    return _blocks(rows.select("id", "place", block.alias("block")))


def forecast_text(rows: DataFrame) -> DataFrame:
    """(id, payload): ``readers.forecast_rows`` as text, one block a period."""
    block = F.concat_ws("\n", F.concat("name", F.lit(":")), *[F.concat(F.lit(f"{n}: "), F.col(n)) for n in ("temperature", "wind", "forecast")])
    return _blocks(rows.select("id", "place", block.alias("block")))


def _blocks(rows: DataFrame) -> DataFrame:
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"])  # one payload's rows
    return rows.groupBy("id").agg(F.array_join(each, "\n---\n").alias("payload"))


def chapter_json(chunks: DataFrame, number: int) -> DataFrame:
    """(source, payload): a chapter as one JSON object with title, neighbours and its chunks in order."""
    rows = chapter(chunks, number)
    body = F.struct("chunk_id", "parent_id", "seq_in_parent", "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("parent_id", "seq_in_parent", "doc", body.alias("b")))), lambda x: x["b"])  # one chapter
    packed = rows.groupBy("source", "chapter", "prev", "next").agg(F.max("title").alias("title"), ordered.alias("chunks"))
    return packed.select("source", F.to_json(F.struct("chapter", "title", "prev", "next", "chunks")).alias("payload"))


def chapter(chunks: DataFrame, number: int) -> DataFrame:
    """The chunks of one chapter in order, with title and neighbours; an unknown chapter raises."""
    own = chunks.where(F.col("chapter") == number)
    if not own.limit(1).count():
        raise ValueError(f"no chapter {number}")
    neighbours = C.adjacent_chapters(chunks.where(F.col("chapter").between(number - 1, number + 1))).where(F.col("chapter") == number)
    return own.join(neighbours, ["source", "chapter"]).orderBy("source", "parent_id", "seq_in_parent", "doc")


def bank_query(queries: DataFrame, bank: DataFrame, limit: int = 1) -> DataFrame:
    """(qid, id, score, rank) of the nearest bank rows; at most eight."""
    return B.dice_top(queries, bank, max(1, min(limit, B.MOST)))


def bank_route(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """(qid, known): whether the bank has nearly this question."""
    return B.route(queries, bank).select("qid", "known")


class Runs:
    """One evaluation run at a time, with its state and a way to stop it.

    States: ``idle``, ``running``, ``done``, ``failed``, ``aborted``. A second start while one runs is refused.
    ``abort`` cancels the run's Spark jobs; what it has written by then stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.state, self.run_id, self.error = spark, "idle", None, None
        self._lock, self._thread = threading.Lock(), None
        self._aborted = threading.Event()

    def start(self, run_id: str, job: Callable[[], object]) -> bool:
        with self._lock:
            if self.state == "running":
                return False
            self.state, self.run_id, self.error = "running", run_id, None
            self._aborted.clear()

        def work() -> None:
            sc = self.spark.sparkContext
            sc.setJobGroup(run_id, f"evaluation {run_id}", interruptOnCancel=True)
            try:
                job()
                state = "aborted" if self._aborted.is_set() else "done"
            except Exception as e:  # the state carries the failure to whoever polls
                self.error = str(e)
                state = "aborted" if self._aborted.is_set() else "failed"
            with self._lock:
                self.state = state

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()
        return True

    def abort(self) -> bool:
        with self._lock:
            if self.state != "running":
                return False
            self._aborted.set()
        self.spark.sparkContext.cancelJobGroup(self.run_id)
        return True

    def wait(self, seconds: float | None = None) -> str:
        if self._thread is not None:
            self._thread.join(seconds)
        return self.state
