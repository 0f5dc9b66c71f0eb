"""Rows of array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def explode_array(df: DataFrame, keep: list, arr, value="value", pos: str | None = None) -> DataFrame:
    """Rows of an array (or map) column.

    Uses ``posexplode_outer`` + a filter on the position instead of ``explode``:
    for a plain explode Catalyst infers ``size(arr) > 0`` and pushes it (with the
    whole computation of ``arr``) below an earlier repartition, so an expensive
    per-row expression would run twice, once without parallelism.
    """
    from pyspark.sql import functions as F

    p = pos or "_pos"
    names = [value] if isinstance(value, str) else list(value)
    out = df.select(*keep, F.posexplode_outer(arr).alias(p, *names)).filter(F.col(p).isNotNull())
    return out if pos else out.drop(p)
