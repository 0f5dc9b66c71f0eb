"""Query registry: name -> (Spark callable, optional DuckDB oracle SQL).

Each query binds one operator of the library to fixture views over the
driver tables, so its work grows with the tables. Spark callables take
``(spark, sf_dir)`` and return a DataFrame; oracle SQL runs in DuckDB on the
same tables (pre-registered as views). Doubles are rounded to 6 digits on
both sides because float sums are order dependent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (top level) to ``digits``. Whole numbers stay as they are (``round`` makes a decimal of each)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name).cast("double")
            cols.append(F.when(F.rint(c) == c, c + F.lit(0.0)).otherwise(F.round(c, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every query module (each registers its queries on import)."""
    from . import (q_bytes, q_catalog, q_dataset, q_evaluate, q_flat, q_layout, q_model, q_sources,  # noqa: F401
                   q_stats, q_vector)
