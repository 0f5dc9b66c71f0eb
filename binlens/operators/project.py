"""Projection, filtering, coercion and schema normalisation (all narrow: no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_number

# Label names used by the exploratory report.
LABEL_NAMES = {1: "Malware", 0: "Benign"}


def prune_columns(df: DataFrame, wanted: list[str], require_any: bool = False) -> DataFrame:
    """Keep ``wanted`` ∩ present columns in ``wanted`` order.

    Catalyst pushes the projection into the scan (``ReadSchema``).
    """
    present = set(df.columns)
    keep = [c for c in wanted if c in present]
    if require_any and not keep:
        raise ValueError("none of the wanted columns is present")
    return df.select(*keep)


def filter_labelled(df: DataFrame, label: str = "label", allowed=(0, 1)) -> DataFrame:
    """Drop unlabelled rows (label not in ``allowed``); pushed down to the scan."""
    return df.filter(F.col(label).isin(list(allowed)))


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise when a required column is absent (driver-side schema check)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {missing}")
    return df


def binary_label(col: str | Column) -> Column:
    """Label coerced like the evaluator: non-numeric (NaN and infinities too) -> -1, then truncated toward zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_finite(c).try_cast("long"), F.lit(-1).cast("long"))


def _finite(c: Column) -> Column:
    v = to_number(c)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def validate_binary_label(df: DataFrame, col: str = "label") -> DataFrame:
    """One row of violation counts: rows, non-numeric values, values not in {0,1}."""
    lab = binary_label(col)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(_finite(F.col(col)).isNull()).alias("n_non_numeric"),
                  F.count_if(~lab.isin(0, 1)).alias("n_not_binary"))


def assert_binary_label(df: DataFrame, col: str = "label") -> DataFrame:
    """Raise if any label is not 0/1 after coercion; returns ``df`` unchanged."""
    require_columns(df, [col])
    bad = validate_binary_label(df, col).first()["n_not_binary"]
    if bad:
        raise ValueError(f"column {col!r} must contain only binary values 0 or 1 ({bad} violations)")
    return df


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def coerce_numeric(df: DataFrame, cols: list[str], fill=None, dtype: str = "double") -> DataFrame:
    """Cast the given columns to numbers; unparsable -> NULL (or ``fill``)."""
    targets = set(cols)
    return df.select(*[
        (to_number(F.col(c), fill).cast(dtype).alias(c) if c in targets else F.col(c))
        for c in df.columns])


def select_by_prefix(df: DataFrame, prefixes: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns whose name starts with one of ``prefixes`` (plus ``keep``), schema order."""
    return df.select(*[c for c in df.columns if c in keep or c.startswith(tuple(prefixes))])


def map_values(col: str | Column, mapping: dict = LABEL_NAMES) -> Column:
    """Value -> name via a literal map (unknown -> NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, c)


def derive_size_mb(df: DataFrame, size: str = "size", out: str = "size_mb") -> DataFrame:
    """bytes / 1 MiB with a missing size counted as 0."""
    return df.withColumn(out, F.coalesce(F.col(size), F.lit(0)).cast("double") / F.lit(1048576.0))


def filter_cap(df: DataFrame, col: str, cap: float) -> DataFrame:
    return df.filter(F.col(col) <= F.lit(cap))
