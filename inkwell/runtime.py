"""Session helpers: table loading, shared storage, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its estimated size is proven to stay under this many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where nothing is configured (local tests) a fresh folder is made and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="inkwell-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Ends the lineage: a lost executor re-reads files instead of recomputing, and an input used by
    several branches is computed once. Files are removed when the driver ends, or the ``scope`` around.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}"
    writer = df.write.mode("error").options(**({"compression": codec} if codec else {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, column: str, buckets: int, sort: str | None = None) -> DataFrame:
    """``cut`` into ``buckets`` buckets of ``column``, sorted by it or by ``sort``: later groupings and joins on it read
    the table as it lies, without a shuffle of it."""
    spark = df.sparkSession
    name = f"inkwell_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    write_by(df, column, buckets, sort or column, path, name)
    _forget_at_exit(spark, path, name)
    return spark.table(name)


def write_by(df: DataFrame, column: str, buckets: int, sort: str, path: str, name: str) -> None:
    df.repartition(buckets, column).write.mode("overwrite").bucketBy(buckets, column).sortBy(sort).option("path", path).format("parquet").saveAsTable(name)


def read_by(spark: SparkSession, schema: str, column: str, buckets: int, sort: str, path: str) -> DataFrame:
    """The bucketed table that ``write_by`` left in ``path``, as a table of this session."""
    name = f"inkwell_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({column}) SORTED BY ({sort}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def buckets_for(spark: SparkSession, size: int, bucket_bytes: int = 16 << 20, most: int = 100_000) -> int:
    """Buckets for a table of about ``size`` bytes: one for every ``bucket_bytes``, and one a core at least."""
    return max(spark.sparkContext.defaultParallelism, min(most, size // bucket_bytes))


_written: list[list] = []


@contextmanager
def scope():
    """What is cut inside is removed when the block ends, not only with the session: for a server that answers many
    calls. Results must be read or written inside."""
    _written.append([])
    try:
        yield
    finally:
        for remove in _written.pop():
            remove()
            atexit.unregister(remove)


def _forget_at_exit(spark: SparkSession, path: str, name: str | None = None) -> None:
    def remove() -> None:
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is already gone; the folder's own clean-up applies
            pass

    atexit.register(remove)
    if _written:
        _written[-1].append(remove)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when a scan has less than half as many splits as there are cores.

    For work that multiplies its input (tokenising, Python). Large inputs have enough splits and stay as they
    are, and a frame that already has a shuffle behind it is left alone: looking at it here would run it.
    """
    execution = df._jdf.queryExecution()
    if any(word in execution.executedPlan().toString() for word in ("AdaptiveSparkPlan", "Exchange", "Subquery")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * execution.toRdd().getNumPartitions() <= cores else df


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``rows * row_bytes`` is within ``limit``; else leave the join to the planner."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per context, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_inkwell_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="inkwell-py-"), "inkwell.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._inkwell_shipped = True
