"""A quiz over a question bank: messages of sessions, and what each is answered with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as X
from inkwell.operators.bank import judged
from inkwell.operators.quality import sessions_with_ttl
from inkwell.runtime import cut

# Messages that ask for a question, and for the answer.
ASKS, TELLS = ("随机一题", "来一题"), ("答案", "这题选什么")
BUCKETS = 1024


def numbered(bank: DataFrame) -> DataFrame:
    """``bank`` with ``place`` 0, 1, ..: counts of hash buckets first, then places inside them, so no task orders all rows."""
    rows = bank.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over ``BUCKETS`` rows
    counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy("id"))
    return rows.join(counts.select("__b", "__before"), "__b").withColumn("place", F.col("__before") + inner - 1).drop("__b", "__before")


def question_text() -> Column:
    return F.concat(F.lit("题目："), "question", *(F.concat(F.lit(f"\n{k}. "), F.coalesce(F.col("options")[k], F.lit(""))) for k in "ABCD"))


def answer_text() -> Column:
    return F.concat(F.lit("正确答案："), F.trim("answer"), F.lit("（"), "right_one", F.lit("）"))


def replies(messages: DataFrame, bank: DataFrame, minutes: int = 30) -> DataFrame:
    """(event_id, session_key, id, kind, reply) for every message.

    ``messages(event_id, session_key, ts, message)``, ``bank(id, question, options, answer)``. A message that asks for a
    question opens a session of ``minutes`` with one, drawn by a hash of the session and the time, in place of an
    earlier one. Inside, a message asks for the answer or is an answer and is judged. ``kind``: ``question``, ``answer``,
    ``correct``, ``wrong``, ``no_session``, ``empty_bank``. Null messages are answers that choose nothing.
    """
    places = cut(numbered(bank))
    n = places.count()
    formed = cut(messages.select("event_id", "session_key", "ts", "message", F.coalesce(X.bank_form("message"), F.lit("")).alias("form")))
    asks = F.col("form").isin(*ASKS)
    inside = sessions_with_ttl(formed, "session_key", "ts", "event_id", asks & F.lit(n > 0), minutes)
    drawn = inside.withColumn("place", F.when(F.col("active"), F.pmod(F.xxhash64("session_key", "opened_at"), F.lit(max(n, 1)))))
    known = judged(drawn.join(places, "place", "left"))
    kind = (
        F.when(F.col("form").isin(*ASKS), F.when(F.lit(n > 0), "question").otherwise("empty_bank")).when(~F.col("active"), "no_session")
        .when(F.col("form").isin(*TELLS), "answer").when(F.coalesce("correct", F.lit(False)), "correct").otherwise("wrong")
    )
    out = known.withColumn("kind", kind)
    says = F.when(F.col("kind") == "question", question_text()).when(F.col("kind") == "answer", answer_text()).when(F.col("kind") == "correct", F.concat(F.lit("答对了！"), answer_text())).when(F.col("kind") == "wrong", F.concat(F.lit("答错了，"), answer_text())).otherwise(F.col("kind"))
    return out.select("event_id", "session_key", "id", "kind", says.alias("reply"))
