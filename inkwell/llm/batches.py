"""Arrow batch plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.runtime import ship, spread


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]]) -> DataFrame:
    """``mapInArrow`` with a per-task ``make()`` that returns a function from batch to columns.

    Batches stay as Spark cuts them, so memory follows the batch and not the partition.
    """
    ship(df.sparkSession)
    spark_schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in batches:
            if batch.num_rows and (columns := convert(batch)) is not None:
                arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return spread(df).mapInArrow(run, spark_schema)
