"""Schema-aware column helpers: nested access with defaults, coercion, aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Data type at a dotted struct path, or None when any step is absent."""
    dt: T.DataType = schema
    for part in path.split("."):
        if not isinstance(dt, T.StructType) or part not in dt.fieldNames():
            return None
        dt = dt[part].dataType
    return dt


def has_path(schema: T.StructType, path: str) -> bool:
    return field_type(schema, path) is not None


def nested_get(schema: T.StructType, path: str, default=0) -> Column:
    """Walk a struct path; an absent field *or* a NULL value gives ``default``.

    Absence is resolved against the schema at plan time, so the expression
    is a plain ``coalesce`` (or a literal) inside whole-stage codegen.
    """
    if not has_path(schema, path):
        return F.lit(default)
    c = F.col(path)
    return c if default is None else F.coalesce(c, F.lit(default))


def first_present(schema: T.StructType, paths: list[str], default=0,
                  null_aware: bool = True) -> Column:
    """Alias fallback between alternative names.

    ``null_aware=True`` (field-level lookups): the first non-NULL among the
    present names wins. ``null_aware=False`` (column-level lookups): the
    first *present* name wins even when its value is NULL.
    """
    present = [p for p in paths if has_path(schema, p)]
    if not present:
        return F.lit(default)
    if null_aware:
        return F.coalesce(*[F.col(p) for p in present], F.lit(default))
    c = F.col(present[0])
    return F.coalesce(c, F.lit(default)) if default is not None else c


def to_number(c: Column, fill=None) -> Column:
    """Any value -> double; unparsable -> NULL (or ``fill``). Never throws under ANSI."""
    out = c.cast("string").try_cast("double")
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def bool_int(c: Column) -> Column:
    """Truthiness of a number as 0/1 (NULL -> 0)."""
    return F.when(F.coalesce(c.cast("double"), F.lit(0.0)) != 0, 1).otherwise(0)
