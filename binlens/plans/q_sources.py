"""Queries for 2.A sources/sinks (round trips through the shared scratch folder)
and 2.B layout normalisation of polymorphic JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import flat as fl
from ..operators import layout as lay
from ..operators import project as pj
from ..sources import io, table, view, with_views
from .registry import register, round_doubles

_EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_PART_SCHEMA = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@register("scan_jsonl", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id, event_type, round(value, 6) AS value, props FROM events""")
def q_scan_jsonl(spark, sf_dir):
    path = io.scratch_path(spark, "events-jsonl")
    io.sink_jsonl(table(spark, sf_dir, "events").repartition(4), path)
    back = io.scan_jsonl(spark, f"{path}/*.json", _EVENTS_SCHEMA)
    return round_doubles(back.withColumn("ts", F.unix_timestamp("ts")))


@register("scan_jsonl_rejects", """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS rejected FROM events""")
def q_scan_jsonl_rejects(spark, sf_dir):
    """Shards in which every seventeenth line is cut off: good rows and rejects, each line once."""
    path = io.scratch_path(spark, "events-cut")
    lines = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("value"))
    cut = F.when(F.col("event_id") % 17 == 0, F.expr("left(value, length(value) - 3)")).otherwise(F.col("value"))
    lines.select(cut.alias("value")).write.text(path)
    good, bad = io.scan_jsonl_with_rejects(spark, f"{path}/*.txt", _EVENTS_SCHEMA)
    back = bad.select(F.regexp_extract("line", r'"event_id":(\d+)', 1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(1).alias("rejected"))
    return good.select("event_id", "event_type", F.lit(0).alias("rejected")).unionAll(back)


@register("scan_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def q_scan_csv(spark, sf_dir):
    path = io.scratch_path(spark, "part-csv")
    io.sink_csv(table(spark, sf_dir, "part"), path)
    return round_doubles(io.scan_csv(spark, f"{path}/*.csv", _PART_SCHEMA))


@register("sink_csv", with_views(["v_scored"], """
SELECT doc_id, label, toxic, round(score, 6) AS score FROM v_scored WHERE label = 0 AND score >= 0.5"""))
def q_sink_csv(spark, sf_dir):
    fp = ev.false_positive_rows(pj.filter_labelled(view(spark, sf_dir, "v_scored")), 0.5)
    path = io.sink_csv(fp.coalesce(1), io.scratch_path(spark, "false-positives"))
    back = io.scan_csv(spark, path, "doc_id bigint, label int, toxic int, score double")
    return round_doubles(back)


# The oracle reads the same files as the sf0.01 run (the driver's correctness scale).
@register("scan_binary", """
SELECT parse_filename(filename) AS file_name, CAST(size AS BIGINT) AS size, sha256(content) AS sha256
FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
def q_scan_binary(spark, sf_dir):
    b = io.scan_binary(spark, f"{sf_dir}/*.parquet", with_content=False)
    return b.select("file_name", "size", "sha256")


@register("scan_binary_rows", """
SELECT doc_id, CAST(octet_length(encode(COALESCE(text, ''))) + 1 AS BIGINT) AS size, sha256(COALESCE(text, '') || chr(10)) AS sha256 FROM documents""")
def q_scan_binary_rows(spark, sf_dir):
    """Every document as a file of its own, read back whole."""
    files = io.sink_row_files(table(spark, sf_dir, "documents"), io.scratch_path(spark, "document-files"), "doc_id", "text")
    b = io.scan_row_files(spark, files)
    return b.select(F.regexp_extract("path", r"doc_id=(-?\d+)", 1).try_cast("long").alias("doc_id"), "size", "sha256")


_LI_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
             ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
             ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("profile_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS type, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST(count(*) AS BIGINT) AS n_rows FROM lineitem" for i, (c, t) in enumerate(_LI_TYPES)))
def q_profile_columns(spark, sf_dir):
    return io.profile_columns(table(spark, sf_dir, "lineitem"))


_POLY_WARN = """CASE json_type(warnings_json)
    WHEN 'ARRAY' THEN json_extract_string(warnings_json, '$[*]')
    WHEN 'OBJECT' THEN list_transform(json_keys(warnings_json),
                                      lambda k: k || ':' || json_extract_string(warnings_json, '$.' || k))
    WHEN 'VARCHAR' THEN [json_extract_string(warnings_json, '$')]
    ELSE CAST([] AS VARCHAR[]) END"""


@register("normalize_layout", with_views(["v_poly"], f"""
SELECT event_id, array_to_string(w, '|') AS warnings, CAST(len(w) AS BIGINT) AS pe_warn_count,
       {', '.join(f"CAST(len(list_filter(w, lambda x: contains(lower(x), '{k}'))) > 0 AS INTEGER) AS pe_warn_{k}"
                  for k in fl.WARN_KEYWORDS)},
       CASE WHEN warnings_json IS NULL THEN 'null' WHEN json_type(warnings_json) = 'ARRAY' THEN 'list'
            WHEN json_type(warnings_json) = 'OBJECT' THEN 'dict' ELSE 'string' END AS kind
FROM (SELECT event_id, warnings_json, {_POLY_WARN} AS w FROM v_poly) t"""))
def q_normalize_layout(spark, sf_dir):
    p = view(spark, sf_dir, "v_poly").withColumn("w", lay.normalize_warnings("warnings_json"))
    feats = fl.feat_warnings(p.schema, F.col("w"))
    return p.select("event_id", F.array_join("w", "|").alias("warnings"),
                    *[c if i else c.cast("long").alias("pe_warn_count") for i, c in enumerate(feats)],
                    lay.variant_kind("warnings_json").alias("kind"))


@register("normalize_exports_count", with_views(["v_poly"], """
SELECT event_id, CAST(CASE json_type(warnings_json) WHEN 'ARRAY' THEN json_array_length(warnings_json)
                      WHEN 'OBJECT' THEN len(json_keys(warnings_json)) ELSE 0 END AS INTEGER) AS exp_count
FROM v_poly"""))
def q_normalize_exports_count(spark, sf_dir):
    p = view(spark, sf_dir, "v_poly")
    return p.select("event_id", F.coalesce(lay.normalize_list_or_dict_count("warnings_json"), F.lit(0))
                    .cast("int").alias("exp_count"))


# ---- polymorphic directories and rich headers, as JSON text written from orders -------------
DIRS = ["EXPORT", "IMPORT", "RESOURCE", "EXCEPTION", "SECURITY"]


def _dir_size(i: int) -> str:
    return f"((o_orderkey * {i + 1} + o_custkey) % 3) * 100"


def _dirs_json(kind: str) -> str:
    """The directories as a JSON list or dict, as a portable SQL text expression."""
    body = " || ', ' || ".join(
        (f"""'{{"name": "{d}", "size": ' || CAST({_dir_size(i)} AS VARCHAR(20)) || ', "virtual_address": 7}}'""" if kind == "list" else
         f"""'"{d}": {{"size": ' || CAST({_dir_size(i)} AS VARCHAR(20)) || '}}'""") for i, d in enumerate(DIRS))
    return f"'[' || {body} || ']'" if kind == "list" else f"'{{' || {body} || '}}'"


_DIRS_TEXT = f"""CASE o_orderkey % 4 WHEN 0 THEN {_dirs_json('list')} WHEN 1 THEN {_dirs_json('dict')}
  WHEN 2 THEN '17' ELSE NULL END"""
_FULL = " + ".join(f"CASE WHEN {_dir_size(i)} > 0 THEN 1 ELSE 0 END" for i in range(len(DIRS)))


@register("normalize_directories", f"""
SELECT o_orderkey, CASE WHEN k = 0 THEN 'list' WHEN k = 1 THEN 'dict' ELSE 'none' END AS kind,
       CAST(CASE WHEN k < 2 THEN {len(DIRS)} ELSE 0 END AS INTEGER) AS datadir_count, CAST(CASE WHEN k < 2 THEN {_FULL} ELSE 0 END AS INTEGER) AS datadir_nonempty,
       CAST(CASE WHEN k = 0 THEN {_dir_size(2)} ELSE 0 END AS BIGINT) AS dd_resource_size, CAST(CASE WHEN k = 0 AND {_dir_size(4)} > 0 THEN 1 ELSE 0 END AS INTEGER) AS dd_cert_present,
       CAST(CASE WHEN k < 2 THEN {_dir_size(2)} ELSE 0 END AS BIGINT) AS b_resource_size, CAST(CASE WHEN k < 2 AND {_dir_size(4)} > 0 THEN 1 ELSE 0 END AS INTEGER) AS b_cert_present
FROM (SELECT *, o_orderkey % 4 AS k FROM orders) o""")
def q_normalize_directories(spark, sf_dir):
    """Lists, dicts and other values of the directories, by position (layout A) and by name (layout B)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DIRS_TEXT).alias("raw"))
    norm = o.select("o_orderkey", lay.normalize_directories("raw").alias("n"))
    kind = F.coalesce(F.col("n.kind"), F.lit("none"))
    b = {c.replace("dd_", "b_"): c for c in ("dd_resource_size", "dd_cert_present")}
    a_cols = lay.datadir_features(F.col("n"), "A")
    both = norm.select("o_orderkey", "n", kind.alias("kind"), *a_cols)
    b_cols = both.select("*", F.struct(*lay.datadir_features(F.col("n"), "B")).alias("b"))
    return b_cols.select("o_orderkey", "kind", "datadir_count", "datadir_nonempty", "dd_resource_size", "dd_cert_present",
                         *[F.col(f"b.{c}").alias(name) for name, c in b.items()])


_RICH_NUMBERS = "CAST(o_custkey AS VARCHAR(20)) || ', 3, ' || CAST(o_orderkey % 1000 AS VARCHAR(20)) || ', 5'"
_RICH_TEXT = f"""CASE o_orderkey % 5 WHEN 0 THEN '[' || {_RICH_NUMBERS} || ']' WHEN 1 THEN '{{"values": [' || {_RICH_NUMBERS} || ']}}'
  WHEN 2 THEN '{{"raw": [' || {_RICH_NUMBERS} || ']}}' WHEN 3 THEN '"text"' ELSE NULL END"""


@register("normalize_rich", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 < 3 THEN 4 ELSE 0 END AS INTEGER) AS n,
       CAST(CASE WHEN o_orderkey % 5 < 3 THEN o_custkey + 8 + o_orderkey % 1000 ELSE 0 END AS BIGINT) AS total FROM orders""")
def q_normalize_rich(spark, sf_dir):
    """Rich headers as a list, under ``values`` or ``raw``, or something else."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RICH_TEXT).alias("raw"))
    r = o.select("o_orderkey", F.coalesce(lay.normalize_rich("raw"), F.array().cast("array<bigint>")).alias("r"))
    return r.select("o_orderkey", F.size("r").alias("n"), F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
