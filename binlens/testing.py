"""Oracle comparison helpers (Spark result vs DuckDB SQL on the same parquet)."""

from __future__ import annotations

import math
import os

from .sources.tables import TABLES, table_path


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def normalise_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: repr(r))


def _cat_spark(dt) -> str:
    n = type(dt).__name__
    if n in ("ByteType", "ShortType", "IntegerType", "LongType"):
        return "int"
    if n in ("FloatType", "DoubleType", "DecimalType"):
        return "float"
    if n in ("StringType", "VarcharType", "CharType"):
        return "str"
    return n.replace("Type", "").lower()


def _cat_duck(t) -> str:
    s = str(t).upper()
    if s in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT",
             "UINTEGER", "UBIGINT"):
        return "int"
    if s in ("FLOAT", "DOUBLE") or s.startswith("DECIMAL"):
        return "float"
    if s.startswith("VARCHAR"):
        return "str"
    if s == "BOOLEAN":
        return "boolean"
    if s == "BLOB":
        return "binary"
    return s.lower()


_EXACT = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
          "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT", "BooleanType": "BOOLEAN",
          "BinaryType": "BLOB"}


def _type_mismatch(schema, description):
    """Column types must agree exactly (Spark int <-> INTEGER, long <-> BIGINT, ...);
    columns that are all NULL on one side are not compared."""
    sp = {f.name: _EXACT.get(type(f.dataType).__name__, _cat_spark(f.dataType)) for f in schema.fields}
    du = {d[0]: (str(d[1]) if str(d[1]) in _EXACT.values() else _cat_duck(d[1])) for d in description}
    bad = {k: (sp[k], du.get(k)) for k in sp if k in du and sp[k] != du[k]
           and du[k] != "null" and "null" not in sp[k]}
    return bad


def compare_query(spark, con, sf_dir, fn, sql):
    try:
        df = fn(spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
    except Exception as e:  # noqa: BLE001
        return "ERROR", f"spark: {type(e).__name__}: {str(e)[:300]}"
    if sql is None:
        return "ROWS", f"rows={len(rows)} (no oracle)"
    try:
        res = con.execute(sql)
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
    except Exception as e:  # noqa: BLE001
        return "ERROR", f"duckdb: {type(e).__name__}: {str(e)[:300]}"
    tmis = _type_mismatch(df.schema, res.description)
    if tmis:
        return "MISMATCH", f"types {tmis}"
    c1, r1 = normalise_rows(cols, rows)
    c2, r2 = normalise_rows(ocols, orows)
    if c1 != c2:
        return "MISMATCH", f"columns spark={c1} oracle={c2}"
    if len(r1) != len(r2):
        return "MISMATCH", f"rows spark={len(r1)} oracle={len(r2)}"
    if r1 != r2:
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:3]
        return "MISMATCH", f"rows={len(r1)} first diffs={diff}"
    return "OK", f"rows={len(r1)}"
