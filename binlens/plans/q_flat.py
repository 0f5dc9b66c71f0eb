"""Queries for 2.B schema helpers and 2.C flat feature families.

Spark side: nested layout-A records (``binlens.sources.records``) flattened
with in-row higher-order functions. DuckDB side: the same features computed
independently with GROUP BY aggregates over the long fixture views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import first_present, nested_get
from ..functions.hashing import sql_parity_bin
from ..operators import flat as fl
from ..operators import project as pj
from ..operators import records as rec
from ..sources import table, view, with_views
from ..sources.records import (FILE_RULES, GENERAL_RULES, LABEL_RULE, OPTIONAL_RULES, OVERLAY_RULES,
                               raw_records, rules_sql)
from .registry import register, round_doubles

_STD = ", ".join(f"'{n}'" for n in fl.STANDARD_SEC_NAMES)
_GUI = ", ".join(f"'{n}'" for n in fl.GUI_DLLS)
_BIN, _SIGN = sql_parity_bin("compid", 8)

_CTES = [
    ("f", f"""SELECT o_orderkey AS file_id, {LABEL_RULE} AS label, {rules_sql(GENERAL_RULES, 'g_')},
              {rules_sql(FILE_RULES, 'h_')}, {rules_sql(OPTIONAL_RULES, 'o_')}, {rules_sql(OVERLAY_RULES, 'ov_')},
              o_custkey % 16 + 1 AS n_dirs, o_orderkey % 5 AS size_key FROM orders"""),
    ("sa", f"""SELECT file_id, count(*) AS n, avg(entropy) AS em, max(entropy) AS emax, min(entropy) AS emin,
               stddev_pop(entropy) AS esd, avg(size) AS rm, max(size) AS rmax, avg(vsize) AS vm,
               sum(mem_execute) AS ex, sum(mem_write) AS wr, sum(mem_read) AS rd,
               sum(CASE WHEN entropy > 7.0 THEN 1 ELSE 0 END) AS he,
               sum(CASE WHEN lower(trim(name)) IN ({_STD}) THEN 1 ELSE 0 END) AS sn,
               max(CASE WHEN contains(lower(trim(name)), 'upx') THEN 1 ELSE 0 END) AS upx,
               max(CASE WHEN lower(trim(name)) = '.itext' THEN 1 ELSE 0 END) AS inno
               FROM v_sections GROUP BY file_id"""),
    ("ia", f"""SELECT file_id, count(DISTINCT dll) AS dlls, count(*) AS funcs,
               max(CASE WHEN lower(dll) IN ({_GUI}) THEN 1 ELSE 0 END) AS gui,
               max(CASE WHEN starts_with(lower(dll), 'vcruntime') OR starts_with(lower(dll), 'api-ms-win-crt-')
                   THEN 1 ELSE 0 END) AS crt,
               count(DISTINCT func) AS n_exp
               FROM v_imports GROUP BY file_id"""),
    ("ra", "SELECT file_id, count(*) AS n_pairs, " + ", ".join(
        f"sum(CASE WHEN {_BIN} = {k} THEN {_SIGN} * cnt ELSE 0 END) AS rh{k}" for k in range(8))
        + " FROM v_pairs GROUP BY file_id"),
    ("aa", """SELECT file_id, count(*) AS num_certs, max(self_signed) AS self_signed,
              max(no_program_name) AS empty_program_name, max(no_countersigner) AS no_countersigner,
              greatest(max(n_certs), 0) AS chain_max_depth,
              greatest(COALESCE(max(signing_time) FILTER (WHERE no_countersigner = 0), 0), 0) AS latest_signing_time,
              COALESCE(arg_max(CAST(signing_time - pe_timestamp AS DOUBLE),
                               (ord, l_partkey, l_suppkey, signing_time, n_certs))
                       FILTER (WHERE no_countersigner = 0), 0) AS signing_time_diff
              FROM v_sigs GROUP BY file_id"""),
    ("ff", f"""SELECT f.file_id, f.label,
       COALESCE(sa.n, 0) AS sec_count,
       CASE WHEN sa.n > 0 THEN sa.em ELSE 0 END AS sec_entropy_mean,
       CASE WHEN sa.n > 0 THEN sa.emax ELSE 0 END AS sec_entropy_max,
       CASE WHEN sa.n > 0 THEN sa.emin ELSE 0 END AS sec_entropy_min,
       CASE WHEN sa.n > 0 THEN sa.esd ELSE 0 END AS sec_entropy_std,
       CASE WHEN sa.n > 0 THEN sa.rm ELSE 0 END AS sec_rawsize_mean,
       CASE WHEN sa.n > 0 THEN CAST(sa.rmax AS DOUBLE) ELSE 0 END AS sec_rawsize_max,
       CASE WHEN sa.n > 0 THEN sa.vm ELSE 0 END AS sec_virtsize_mean,
       COALESCE(sa.ex, 0) AS sec_exec_count, COALESCE(sa.wr, 0) AS sec_write_count,
       COALESCE(sa.rd, 0) AS sec_read_count,
       CASE WHEN sa.n > 0 THEN sa.ex / sa.n ELSE 0 END AS sec_exec_ratio,
       CASE WHEN sa.n > 0 THEN sa.wr / sa.n ELSE 0 END AS sec_write_ratio,
       CASE WHEN sa.n > 0 THEN sa.he / sa.n ELSE 0 END AS sec_high_entropy_frac,
       CASE WHEN sa.n > 0 THEN sa.sn / sa.n ELSE 0 END AS sec_std_name_frac,
       COALESCE(sa.upx, 0) AS has_upx_sections, COALESCE(sa.inno, 0) AS has_inno_sections,
       {', '.join(f'COALESCE(f.g_{n}, 0) AS gen_{n}' for n in fl.GENERAL_FIELDS)},
       {', '.join(f'COALESCE(f.h_{n}, 0) AS hdr_{n}' for n in fl.HDR_FILE_FIELDS)},
       {', '.join(f'COALESCE(f.o_{n}, 0) AS hdr_{a}' for n, a in zip(fl.HDR_OPT_FIELDS, fl.HDR_OPT_ALIASES))},
       CASE WHEN (f.h_characteristics & 8192) <> 0 THEN 1 ELSE 0 END AS is_dll,
       f.n_dirs AS datadir_count,
       (SELECT count(*) FROM range(f.n_dirs) r(i) WHERE (f.size_key * (i + 1) % 3) * 100 > 0) AS datadir_nonempty,
       CASE WHEN f.n_dirs > 2 THEN CAST((f.size_key * 3 % 3) * 100 AS BIGINT) ELSE 0 END AS dd_resource_size,
       CASE WHEN f.n_dirs > 4 AND (f.size_key * 5 % 3) * 100 > 0 THEN 1 ELSE 0 END AS dd_cert_present,
       CASE WHEN ia.funcs > 0 THEN 1 ELSE 0 END AS imp_available,
       COALESCE(ia.dlls, 0) AS imp_dll_count, COALESCE(ia.funcs, 0) AS imp_func_count,
       COALESCE(ia.gui, 0) AS imp_has_gui_libs, COALESCE(ia.crt, 0) AS imp_has_crt,
       COALESCE(ia.n_exp, 0) AS exp_count, CASE WHEN ia.n_exp > 0 THEN 1 ELSE 0 END AS exp_available,
       COALESCE(ra.n_pairs, 0) AS rich_num_pairs,
       {', '.join(f'COALESCE(ra.rh{k}, 0.0) AS rich_hash_{k}' for k in range(8))},
       COALESCE(aa.num_certs, 0) AS auth_num_certs, COALESCE(aa.self_signed, 0) AS auth_self_signed,
       0 AS auth_parse_error, COALESCE(aa.chain_max_depth, 0) AS auth_chain_depth,
       abs(COALESCE(aa.signing_time_diff, 0.0)) AS auth_sign_time_delta_abs,
       COALESCE(aa.no_countersigner, 0) AS auth_no_countersigner,
       COALESCE(len(string_split(d.text, '. ')), 0) AS pe_warn_count,
       {', '.join(f"CASE WHEN contains(lower(COALESCE(d.text, '')), '{k}') THEN 1 ELSE 0 END AS pe_warn_{k}"
                  for k in fl.WARN_KEYWORDS)},
       f.ov_size AS overlay_size, f.ov_size_ratio AS overlay_size_ratio, f.ov_entropy AS overlay_entropy,
       CASE WHEN f.ov_size <> 0 THEN 1 ELSE 0 END AS overlay_present
FROM f LEFT JOIN sa ON sa.file_id = f.file_id LEFT JOIN ia ON ia.file_id = f.file_id
LEFT JOIN ra ON ra.file_id = f.file_id LEFT JOIN aa ON aa.file_id = f.file_id
LEFT JOIN documents d ON d.doc_id = f.file_id"""),
]
_VIEWS = ["v_sections", "v_imports", "v_pairs", "v_sigs"]


def _round_sql(cols: list[str]) -> str:
    out = []
    for c in cols:
        out.append(f"round(CAST({c} AS DOUBLE), 6) AS {c}" if _is_float(c) else f"CAST({c} AS BIGINT) AS {c}")
    return ", ".join(out)


_FLOAT_COLS = {"sec_entropy_mean", "sec_entropy_max", "sec_entropy_min", "sec_entropy_std", "sec_rawsize_mean",
               "sec_rawsize_max", "sec_virtsize_mean", "sec_exec_ratio", "sec_write_ratio",
               "sec_high_entropy_frac", "sec_std_name_frac", "auth_sign_time_delta_abs", "overlay_size_ratio",
               "overlay_entropy"} | {f"rich_hash_{k}" for k in range(8)}


def _is_float(c: str) -> bool:
    return c in _FLOAT_COLS


def _twin(cols: list[str]) -> str:
    return with_views(_VIEWS, f"SELECT CAST(file_id AS BIGINT) AS file_id, {_round_sql(cols)} FROM ff", _CTES)


def _spark_family(spark, sf_dir, cols: list[str]):
    recs = raw_records(spark, sf_dir)
    flat = fl.flatten_record(recs, keep=["file_id"], label=None)
    return _typed(flat.select("file_id", *cols))


def _typed(df):
    return round_doubles(df.select(*[
        F.col(c).cast("double").alias(c) if _is_float(c) else
        (F.col(c).cast("long").alias(c) if c != "file_id" else F.col(c)) for c in df.columns]))


FAMILIES = {
    "feat_general": [f"gen_{n}" for n in fl.GENERAL_FIELDS],
    "feat_header": [f"hdr_{n}" for n in fl.HDR_FILE_FIELDS] + [f"hdr_{a}" for a in fl.HDR_OPT_ALIASES],
    "feat_bitflag": ["is_dll"],
    "feat_section_stats": ["sec_count", "sec_entropy_mean", "sec_entropy_max", "sec_entropy_min",
                           "sec_entropy_std", "sec_rawsize_mean", "sec_rawsize_max", "sec_virtsize_mean"],
    "feat_section_flags": ["sec_exec_count", "sec_write_count", "sec_read_count", "sec_exec_ratio",
                           "sec_write_ratio"],
    "feat_section_names": ["has_upx_sections", "has_inno_sections", "sec_std_name_frac", "sec_high_entropy_frac"],
    "feat_datadirs": ["datadir_count", "datadir_nonempty", "dd_resource_size", "dd_cert_present"],
    "feat_imports": ["imp_available", "imp_dll_count", "imp_func_count", "imp_has_gui_libs", "imp_has_crt"],
    "feat_exports": ["exp_count", "exp_available"],
    "feat_rich_pairs": ["rich_num_pairs"] + [f"rich_hash_{k}" for k in range(8)],
    "feat_authenticode": ["auth_num_certs", "auth_self_signed", "auth_parse_error", "auth_chain_depth",
                          "auth_sign_time_delta_abs", "auth_no_countersigner"],
    "feat_warnings": ["pe_warn_count"] + [f"pe_warn_{k}" for k in fl.WARN_KEYWORDS],
    "feat_overlay": ["overlay_size", "overlay_size_ratio", "overlay_entropy", "overlay_present"],
}


def _make(name, cols):
    @register(name, _twin(cols))
    def q(spark, sf_dir):
        return _spark_family(spark, sf_dir, cols)
    q.__name__ = f"q_{name}"
    return q


for _n, _c in FAMILIES.items():
    _make(_n, _c)


@register("flatten_record", with_views(_VIEWS, f"""
SELECT CAST(file_id AS BIGINT) AS file_id, {_round_sql(fl.FEATURE_COLS)}, CAST(label AS BIGINT) AS label
FROM ff""", _CTES))
def q_flatten_record(spark, sf_dir):
    recs = raw_records(spark, sf_dir)
    flat = fl.flatten_record(pj.filter_labelled(recs), keep=["file_id"])
    return _typed(flat)


@register("signature_rollup", with_views(_VIEWS, """
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(num_certs AS BIGINT) AS num_certs,
       CAST(self_signed AS BIGINT) AS self_signed, CAST(empty_program_name AS BIGINT) AS empty_program_name,
       CAST(no_countersigner AS BIGINT) AS no_countersigner, CAST(0 AS BIGINT) AS parse_error,
       CAST(chain_max_depth AS BIGINT) AS chain_max_depth,
       round(CAST(latest_signing_time AS DOUBLE), 6) AS latest_signing_time,
       round(signing_time_diff, 6) AS signing_time_diff FROM aa""", _CTES))
def q_signature_rollup(spark, sf_dir):
    r = rec.signature_rollup(view(spark, sf_dir, "v_sigs"), order=["ord", "l_partkey", "l_suppkey"])
    return round_doubles(r.select("file_id", *[F.col(c).cast("long").alias(c) for c in
                                               ("num_certs", "self_signed", "empty_program_name",
                                                "no_countersigner", "parse_error", "chain_max_depth")],
                                  "latest_signing_time", "signing_time_diff"))


# ---- 2.B schema helpers over the raw records ---------------------------------

@register("nested_get", with_views([], """
SELECT o_orderkey AS file_id, CAST(floor(o_totalprice) AS BIGINT) AS size,
       CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS has_tls,
       0 AS absent_field, CAST(o_orderkey % 16384 AS BIGINT) AS characteristics
FROM orders"""))
def q_nested_get(spark, sf_dir):
    r = raw_records(spark, sf_dir)
    s = r.schema
    return r.select("file_id", nested_get(s, "general.size").alias("size"),
                    nested_get(s, "general.has_tls").alias("has_tls"),
                    nested_get(s, "general.no_such_field").alias("absent_field"),
                    nested_get(s, "header.file.characteristics").alias("characteristics"))


@register("first_present", with_views([], """
SELECT o_orderkey AS file_id, CAST(o_custkey % 100 AS BIGINT) AS symbols,
       CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 50 WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS tls_or_imports
FROM orders"""))
def q_first_present(spark, sf_dir):
    r = raw_records(spark, sf_dir)
    s = r.schema
    return r.select("file_id",
                    first_present(s, ["general.nosuch", "general.symbols"]).alias("symbols"),
                    first_present(s, ["general.has_tls", "general.imports"]).cast("long").alias("tls_or_imports"))


@register("prune_columns", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
def q_prune_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return pj.prune_columns(o, ["o_orderkey", "missing_col", "o_totalprice", "o_custkey"], require_any=True)


@register("require_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def q_require_columns(spark, sf_dir):
    """Columns that must be there are; one that is not stops the job."""
    o = table(spark, sf_dir, "orders")
    try:
        pj.require_columns(o, ["o_orderkey", "no_such_column"])
    except ValueError:
        pj.require_columns(o, ["o_orderkey", "o_totalprice"])
        return o.select("o_orderkey", "o_totalprice")
    raise AssertionError("a missing column went unnoticed")


@register("drop_columns", with_views(["v_num"], """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, constant_col FROM v_num"""))
def q_drop_columns(spark, sf_dir):
    return pj.drop_columns(view(spark, sf_dir, "v_num"), ["label"])


@register("select_by_prefix", "SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus FROM lineitem")
def q_select_by_prefix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return pj.select_by_prefix(li, ("l_order", "l_line", "l_quan"))


@register("coerce_numeric", with_views(["v_text_num"], """
SELECT c_custkey, TRY_CAST(raw AS DOUBLE) AS raw, COALESCE(TRY_CAST(raw AS DOUBLE), 0) AS raw_filled
FROM v_text_num"""))
def q_coerce_numeric(spark, sf_dir):
    v = view(spark, sf_dir, "v_text_num").withColumn("raw_filled", F.col("raw"))
    v = pj.coerce_numeric(v, ["raw"])
    return pj.coerce_numeric(v, ["raw_filled"], fill=0)


@register("coerce_numeric_text", """
SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS prio, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio_num
FROM orders""")
def q_coerce_numeric_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("prio"),
                                              F.substring("o_orderpriority", 1, 1).alias("prio_num"))
    return pj.coerce_numeric(o, ["prio", "prio_num"])


@register("derive_size_mb", with_views(["v_bytes"], """
SELECT doc_id, round(size / 1048576.0, 6) AS size_mb FROM v_bytes"""))
def q_derive_size_mb(spark, sf_dir):
    b = view(spark, sf_dir, "v_bytes").select("doc_id", "size")
    return round_doubles(pj.derive_size_mb(b).select("doc_id", "size_mb"))


@register("filter_cap", with_views(["v_bytes"], "SELECT doc_id, size FROM v_bytes WHERE size <= 2048"))
def q_filter_cap(spark, sf_dir):
    return pj.filter_cap(view(spark, sf_dir, "v_bytes").select("doc_id", "size"), "size", 2048)
