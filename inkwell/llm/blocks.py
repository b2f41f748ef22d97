"""Records in blocks of a bounded size, and keyed models that reach the blocks through joins.

A model of one row per key (a word's probability or difficulty) may be larger than what can be broadcast. Each
block then asks only for the keys its own records have: (block, key) meets the model in a join on the key, and
the answers meet the block's records in a grouping on the block. So a record's keys never travel one by one, and
no task holds more of the model than its block needs.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.llm.batches import map_batches
from inkwell.runtime import cut, ship

BLOCK = 1_000_000  # code points of a block


def in_blocks(df: DataFrame, text_col: str, size: int = BLOCK) -> DataFrame:
    """``df`` with ``block``: runs of rows whose texts have about ``size`` code points together, written once.

    Block numbers are drawn at random per task attempt and fixed by writing; two blocks that draw the same
    number are one larger block, which changes nothing else.
    """
    names = df.columns
    at = names.index(text_col)

    def make():
        state = [secrets.randbits(62), 0]

        def convert(batch: pa.RecordBatch) -> dict:
            blocks = []
            for t in batch.column(at).to_pylist():
                blocks.append(state[0])
                state[1] += len(t or "")
                if state[1] >= size:
                    state[:] = [state[0] + 1, 0]
            return {n: batch.column(i) for i, n in enumerate(names)} | {"block": pa.array(blocks, pa.int64())}

        return convert

    return cut(map_batches(df, T.StructType([*df.schema.fields, T.StructField("block", T.LongType())]), make))


def with_answers(rows: DataFrame, answers: DataFrame, schema: str, convert: Callable[[pa.Table, pa.Table], dict | None]) -> DataFrame:
    """``convert(rows of a block, answers for it)`` for every block of ``rows``; both frames have ``block``.

    Answers of blocks without rows are left out; a block without answers gets an empty table.
    """
    ship(rows.sparkSession)
    run, spark_schema = _to_table(schema, convert)
    # both frames may come from one table: the other name makes another column of it
    other = answers.withColumnRenamed("block", "__block")
    return rows.groupBy("block").cogroup(other.groupBy("__block")).applyInArrow(lambda left, right: run(left, right), spark_schema)


def in_each_block(rows: DataFrame, schema: str, convert: Callable[[pa.Table], dict | None]) -> DataFrame:
    """``convert(rows of a block)`` for every block of ``rows``."""
    ship(rows.sparkSession)
    run, spark_schema = _to_table(schema, convert)
    return rows.groupBy("block").applyInArrow(lambda table: run(table), spark_schema)


def _to_table(schema: str, convert: Callable) -> tuple[Callable, T.StructType]:
    spark_schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(left: pa.Table, *right: pa.Table) -> pa.Table:
        columns = convert(left, *right) if left.num_rows else None
        if columns is None:
            return arrow.empty_table()
        return pa.table([c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) and c.type == f.type else (c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)) for f in arrow], schema=arrow)

    return run, spark_schema


def asked(vocabulary: DataFrame, model: DataFrame) -> DataFrame:
    """The model's rows for every (block, key) of ``vocabulary``; ``model`` has one row per key."""
    return vocabulary.join(model, "key")
