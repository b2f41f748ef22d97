"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from inkwell.plans import checks, dangling, measures, naming, search

_MODULES = (dangling, search, naming, measures, checks)
#: counts and positions come out as bigint, as in the SQL counterparts
_LONG = {
    "rank", "final_rank", "place", "priority", "refs", "tokens", "aliases", "keys", "fragments", "first_rank", "to_rank", "from_rank", "line_no", "chars", "clauses", "longest", "driver",
}


def _long(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        small = [c for c, kind in df.dtypes if kind == "int" and c in _LONG]
        return df.withColumns({c: df[c].cast("bigint") for c in small}) if small else df

    return run


QUERIES = {name: _long(f) for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over the question set."""
    return naming.search_full(spark, sf_dir)
