"""Fixture views over the driver tables.

Each view is one SQL text with ``{table}`` placeholders. Spark resolves a
placeholder to a parquet relation (``parquet.`path```) so Catalyst prunes and
pushes filters into the scan; the DuckDB oracle resolves it to the
pre-registered view of the same name. Engine-specific fragments (byte
encoding of text) are the only differences.

"File" = an order. Polymorphic and nested raw-record shapes are assembled
from these long views by ``binlens.operators.records``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import TABLES, table_path  # noqa: F401

# Engine-specific fragments.
_FRAG = {
    "spark": {
        "utf8": "encode({x}, 'UTF-8')",
        "nbytes": "length(encode({x}, 'UTF-8'))",
    },
    "duckdb": {
        "utf8": "encode({x})",
        "nbytes": "octet_length(encode({x}))",
    },
}

VIEWS: dict[str, str] = {
    # numeric features + label; keeps one constant column on purpose
    "v_num": """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       CAST(0 AS DOUBLE) AS constant_col,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
FROM {lineitem}""",
    # label in {-1,0,1} and a deterministic, imperfect score in [0,1]
    "v_scored": """
SELECT d.doc_id, COALESCE(l.quality, -1) AS label, l.toxic,
       (CAST(3 * (d.doc_id * 7919 % 1000) AS DOUBLE) / CAST(1000 AS DOUBLE)
        + CAST(COALESCE(l.quality, 0) AS DOUBLE)) / CAST(4 AS DOUBLE) AS score
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # byte content = UTF-8 encoding of the document text
    "v_bytes": """
SELECT doc_id, lang, source, text, {utf8:text} AS content,
       CAST({nbytes:text} AS BIGINT) AS size
FROM {documents}""",
    "v_page_bytes": """
SELECT page_id, url, {utf8:html} AS content, CAST({nbytes:html} AS BIGINT) AS size
FROM {pages}""",
    # long form of section.sections[]
    "v_sections": """
SELECT o.o_orderkey AS file_id, l.l_linenumber AS ord,
       CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN '.text'
            WHEN l.l_returnflag = 'A' THEN '.data'
            WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F' THEN 'UPX0'
            WHEN l.l_returnflag = 'N' THEN '.itext'
            WHEN l.l_linestatus = 'F' THEN ' .RSRC '
            ELSE '.foo' END AS name,
       CAST(CASE WHEN l.l_quantity < 4 THEN 0 ELSE floor(l.l_extendedprice) END AS BIGINT) AS size,
       CAST(floor(l.l_extendedprice / 2) AS BIGINT) AS vsize,
       l.l_quantity * 8 / 50 AS entropy,
       CASE WHEN l.l_discount >= 0.05 THEN 1 ELSE 0 END AS mem_execute,
       CASE WHEN l.l_tax >= 0.04 THEN 1 ELSE 0 END AS mem_write,
       CASE WHEN l.l_quantity >= 5 THEN 1 ELSE 0 END AS mem_read
FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey""",
    # long form of the imports map dll -> functions
    "v_imports": """
SELECT l.l_orderkey AS file_id,
       CASE l.l_suppkey % 7 WHEN 0 THEN 'USER32.dll' WHEN 1 THEN 'KERNEL32.dll'
            WHEN 2 THEN 'VCRUNTIME140.dll' WHEN 3 THEN 'gdi32.dll'
            WHEN 4 THEN 'api-ms-win-crt-heap-l1-1-0.dll' WHEN 5 THEN 'ADVAPI32.dll'
            ELSE 'ws2_32.dll' END AS dll,
       CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE p.p_name END AS func,
       l.l_partkey AS ordinal
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # rich-header style (compid, count) pairs
    "v_pairs": """
SELECT l_orderkey AS file_id, l_linenumber AS ord, l_partkey AS compid,
       CAST(l_quantity AS BIGINT) AS cnt FROM {lineitem}""",
    # data directories: the first 1 + o_custkey % 16 of 16 exist
    "v_dirs": """
SELECT o_orderkey AS file_id, o_custkey % 16 + 1 AS n_dirs, o_orderkey % 5 AS size_key FROM {orders}""",
    # signatures per file
    "v_sigs": """
SELECT l.l_orderkey AS file_id, l.l_linenumber AS ord, l.l_suppkey, l.l_partkey,
       CASE WHEN l.l_discount = 0 THEN 1 ELSE 0 END AS no_program_name,
       CASE WHEN l.l_tax = 0 THEN 1 ELSE 0 END AS no_countersigner,
       CAST(l.l_quantity AS BIGINT) AS n_certs,
       CASE WHEN l.l_partkey % 13 = 0 THEN 1 ELSE 0 END AS self_signed,
       CAST(epoch(l.l_shipdate) AS BIGINT) AS signing_time,
       CAST(epoch(o.o_orderdate) AS BIGINT) AS pe_timestamp
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    # one column holding list / string / dict / null / empty list (JSON text)
    "v_poly": """
SELECT event_id, props,
       CASE event_type WHEN 'click' THEN '["Checksum bad","import x"]' WHEN 'error' THEN '"Overlay found"'
            WHEN 'purchase' THEN '{{"section":"odd"}}' WHEN 'signup' THEN NULL ELSE '[]' END AS warnings_json
FROM {events}""",
    # sample catalogue; family priority en, fr, xx, de, es
    "v_catalog": """
SELECT doc_id, lang AS tag, CASE WHEN source = 'src3' THEN 'xx' ELSE source END AS signature,
       CASE WHEN doc_id % 4 = 0 THEN 'exe' WHEN doc_id % 4 = 1 THEN 'dll'
            WHEN doc_id % 4 = 2 THEN 'zip' ELSE NULL END AS file_type,
       CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS ok
FROM {documents}""",
    # strings, some numeric, some not
    "v_text_num": """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment
                       ELSE CAST(c_custkey AS VARCHAR(20)) END AS raw FROM {customer}""",
    "v_label_text": """
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'NaN' WHEN 2 THEN '-0.5' WHEN 3 THEN '1'
                       WHEN 4 THEN '1.7' WHEN 5 THEN '-1.2' ELSE CAST(c_custkey AS VARCHAR(20)) END AS raw FROM {customer}""",
}

# Spark has unix_timestamp; DuckDB has epoch(). Normalise through a fragment.
_EPOCH = {"spark": "unix_timestamp({x})", "duckdb": "epoch({x})"}


def _render(sql: str, engine: str, table_ref) -> str:
    import re

    frag = _FRAG[engine]

    def sub_frag(m):
        name, arg = m.group(1), m.group(2)
        return frag[name].format(x=arg)

    out = re.sub(r"\{(utf8|nbytes):([a-z_]+)\}", sub_frag, sql)
    out = re.sub(r"epoch\(([a-z_.]+)\)", lambda m: _EPOCH[engine].format(x=m.group(1)), out)
    refs = {t: table_ref(t) for t in TABLES}
    return out.format(**refs)


def view_sql(name: str, engine: str = "duckdb", sf_dir: str | None = None) -> str:
    """SQL text of a fixture view for one engine."""
    if engine == "duckdb":
        return _render(VIEWS[name], engine, lambda t: t)
    return _render(VIEWS[name], engine, lambda t: f"parquet.`{table_path(sf_dir, t)}`")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture view as a Spark DataFrame (planned by Catalyst like any query).

    Table references resolve to session temp views of the (balanced) driver tables.
    """
    from .tables import register_tables
    names = register_tables(spark, sf_dir)
    return spark.sql(_render(VIEWS[name], "spark", lambda t: f"`{names[t]}`"))


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """DuckDB text: ``WITH v_a AS (...), ... <body>``; extra CTEs follow the views."""
    ctes = [f"{n} AS ({view_sql(n, 'duckdb')})" for n in names]
    ctes += [f"{n} AS ({s})" for n, s in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
