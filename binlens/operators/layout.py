"""Polymorphic raw fields -> one typed shape (list / dict / string variants).

Raw JSON fields arrive as text or ``VARIANT``; dispatch is on
``schema_of_variant`` (``try_variant_get(..., 'string')`` also succeeds on
arrays, so a NULL test cannot tell the kinds apart).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EMPTY_S = "array<string>"


def as_variant(col: str | Column) -> Column:
    """JSON text or VARIANT -> VARIANT (invalid JSON -> NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_parse_json(c)


def _kind(v: Column) -> Column:
    return F.upper(F.schema_of_variant(v))


def normalize_warnings(col: str | Column) -> Column:
    """string -> [s]; object -> ["key:value"]; array -> each element as text; else []."""
    c = F.col(col) if isinstance(col, str) else col
    v = as_variant(c)
    k = _kind(v)
    arr = F.transform(F.try_variant_get(v, "$", "array<variant>"),
                      lambda e: F.coalesce(F.try_variant_get(e, "$", "string"), F.lit("None")))
    obj = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")),
                      lambda e: F.concat(e["key"], F.lit(":"),
                                         F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit("None"))))
    return (F.when(c.isNull(), F.array().cast(_EMPTY_S))
             .when(v.isNull(), F.array(c.cast("string")))  # plain text that is not JSON: one warning
             .when(k.startswith("ARRAY"), arr)
             .when(k.startswith("OBJECT"), obj)
             .when(k == "STRING", F.array(F.try_variant_get(v, "$", "string")))
             .otherwise(F.array().cast(_EMPTY_S)))


def normalize_list_or_dict_count(col: str | Column) -> Column:
    """Length of a list or dict (exports), else 0."""
    v = as_variant(col)
    k = _kind(v)
    return (F.when(k.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")))
             .when(k.startswith("OBJECT"), F.size(F.try_variant_get(v, "$", "map<string,variant>")))
             .otherwise(F.lit(0)))


DIR_STRUCT = "struct<name:string,size:bigint,virtual_address:bigint>"


def normalize_directories(col: str | Column) -> Column:
    """List of directory structs, or a dict name -> {size, virtual_address} turned into a list
    (entries in key order). Returns (kind, array) so callers can apply dict-specific rules."""
    v = as_variant(col)
    k = _kind(v)
    lst = F.try_variant_get(v, "$", f"array<{DIR_STRUCT}>")
    dct = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(
        e["key"].alias("name"), F.try_variant_get(e["value"], "$.size", "bigint").alias("size"),
        F.try_variant_get(e["value"], "$.virtual_address", "bigint").alias("virtual_address")))
    kind = F.when(k.startswith("ARRAY"), "list").when(k.startswith("OBJECT"), "dict").otherwise("none")
    arr = F.when(k.startswith("ARRAY"), lst).when(k.startswith("OBJECT"), dct) \
           .otherwise(F.array().cast(f"array<{DIR_STRUCT}>"))
    return F.struct(kind.alias("kind"), arr.alias("dirs"))


def normalize_rich(col: str | Column) -> Column:
    """Flat list of numbers, or a dict holding it under ``values`` (else ``raw``)."""
    v = as_variant(col)
    k = _kind(v)
    lst = F.try_variant_get(v, "$", "array<bigint>")
    vals = F.coalesce(F.try_variant_get(v, "$.values", "array<bigint>"),
                      F.try_variant_get(v, "$.raw", "array<bigint>"))
    return F.when(k.startswith("ARRAY"), lst).when(k.startswith("OBJECT"), vals) \
            .otherwise(F.array().cast("array<bigint>"))


def datadir_features(norm: Column, layout: str = "A") -> list[Column]:
    """Directory features on a normalised (kind, dirs) struct.

    ``layout='A'`` follows the flattener: RESOURCE / SECURITY are read at list
    positions 2 / 4 and a dict gives 0 for both. ``layout='B'`` looks them up by
    name, which is right for extractor output whose first entry holds the
    relocation flags.
    """
    dirs, kind = norm["dirs"], norm["kind"]
    size_of = lambda d: F.coalesce(d["size"], F.lit(0))
    count = F.size(dirs)
    nonempty = F.size(F.filter(dirs, lambda d: size_of(d) > 0))
    if layout == "A":
        res = F.when(kind == "list", F.coalesce(F.get(dirs, 2)["size"], F.lit(0))).otherwise(0)
        cert = F.when(kind == "list", (F.coalesce(F.get(dirs, 4)["size"], F.lit(0)) > 0).cast("int")).otherwise(0)
    else:
        by_name = lambda n: F.get(F.filter(dirs, lambda d: d["name"] == n), 0)
        res = F.coalesce(by_name("RESOURCE")["size"], F.lit(0))
        cert = (F.coalesce(by_name("SECURITY")["size"], F.lit(0)) > 0).cast("int")
    return [count.alias("datadir_count"), nonempty.alias("datadir_nonempty"),
            res.cast("long").alias("dd_resource_size"), cert.alias("dd_cert_present")]


def variant_kind(col: str | Column) -> Column:
    """'list' / 'dict' / 'string' / 'number' / 'null' for a JSON value."""
    v = as_variant(col)
    k = _kind(v)
    return (F.when(v.isNull(), "null").when(k.startswith("ARRAY"), "list").when(k.startswith("OBJECT"), "dict")
             .when(k == "STRING", "string").otherwise("number"))


__all__ = ["as_variant", "normalize_warnings", "normalize_list_or_dict_count", "normalize_directories",
           "normalize_rich", "datadir_features", "variant_kind", "T"]
