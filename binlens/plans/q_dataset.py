"""Queries for 2.F dataset assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as ds
from ..operators import project as pj
from ..sources import table, view, with_views
from ..operators.partitioning import explode_array
from .registry import register, round_doubles

_MD5 = "md5('42' || ':' || CAST({k} AS VARCHAR))"


def _u(tag: str, key: str) -> str:
    return (f"CAST(('0x' || substr(md5('42' || ':' || '{tag}' || ':' || CAST({key} AS VARCHAR)), 1, 8))"
            f" AS BIGINT) / 4294967296.0")


@register("union_shards", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_tax FROM lineitem WHERE l_returnflag = 'A'
UNION ALL
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, NULL FROM lineitem WHERE l_returnflag = 'N'
UNION ALL
SELECT l_orderkey, l_linenumber, l_returnflag, NULL, l_tax FROM lineitem WHERE l_returnflag = 'R'""")
def q_union_shards(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    base = ["l_orderkey", "l_linenumber", "l_returnflag"]
    shards = [li.filter(F.col("l_returnflag") == "A").select(*base, "l_quantity", "l_tax"),
              li.filter(F.col("l_returnflag") == "N").select(*base, "l_quantity"),
              li.filter(F.col("l_returnflag") == "R").select(*base, "l_tax")]
    return ds.union_shards(shards)


@register("label_and_union", """
SELECT doc_id, lang, 0 AS label FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, lang, 1 AS label FROM documents WHERE lang <> 'en'""")
def q_label_and_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ds.label_and_union(d.filter(F.col("lang") == "en"), d.filter(F.col("lang") != "en"))


@register("attach_features", """
SELECT d.doc_id, d.n_chars, COALESCE(l.quality, 0) AS quality, COALESCE(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_attach_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ds.attach_features(d, table(spark, sf_dir, "labels"), "doc_id")


@register("seeded_shuffle", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {_MD5.format(k='doc_id')}, doc_id) AS BIGINT) AS ordinal
FROM documents""")
def q_seeded_shuffle(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return ds.seeded_shuffle(d, "doc_id").select("doc_id", "ordinal")


_DROP_BASE = """
SELECT doc_id, 1 AS imp_available, n_chars % 17 AS imp_dll_count, n_chars % 101 AS imp_func_count,
       CAST(doc_id % 2 AS INTEGER) AS imp_has_gui_libs, CAST(doc_id % 3 AS INTEGER) AS imp_has_crt,
       CASE WHEN n_chars % 7 = 0 THEN 0 ELSE 1 END AS exp_available, n_chars % 7 AS exp_count,
       n_chars FROM {documents}"""


def _drop_base(spark, sf_dir):
    return spark.sql(_DROP_BASE.format(documents=f"parquet.`{sf_dir}/documents.parquet`"))


@register("group_dropout", f"""
WITH b AS ({_DROP_BASE.format(documents='documents')})
SELECT doc_id,
       CASE WHEN {_u('imp', 'doc_id')} < 0.3 THEN 0 ELSE imp_available END AS imp_available,
       CASE WHEN {_u('imp', 'doc_id')} < 0.3 THEN 0 ELSE imp_dll_count END AS imp_dll_count,
       CASE WHEN {_u('imp', 'doc_id')} < 0.3 THEN 0 ELSE imp_func_count END AS imp_func_count,
       CASE WHEN {_u('imp', 'doc_id')} < 0.3 THEN 0 ELSE imp_has_gui_libs END AS imp_has_gui_libs,
       CASE WHEN {_u('imp', 'doc_id')} < 0.3 THEN 0 ELSE imp_has_crt END AS imp_has_crt,
       CASE WHEN {_u('exp', 'doc_id')} < 0.3 THEN 0 ELSE exp_available END AS exp_available,
       CASE WHEN {_u('exp', 'doc_id')} < 0.3 THEN 0 ELSE exp_count END AS exp_count,
       n_chars
FROM b""")
def q_group_dropout(spark, sf_dir):
    return ds.group_dropout(_drop_base(spark, sf_dir), "doc_id")


_SPLIT_RANK = f"""
SELECT doc_id, label,
       row_number() OVER (PARTITION BY label ORDER BY {_MD5.format(k='doc_id')}, doc_id) AS r,
       count(*) OVER (PARTITION BY label) AS n
FROM v_scored WHERE label IN (0, 1)"""


@register("stratified_split", with_views(["v_scored"], """
SELECT doc_id, label, CASE WHEN r <= ceil(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM rk""",
                                         [("rk", _SPLIT_RANK)]))
def q_stratified_split(spark, sf_dir):
    s = pj.filter_labelled(view(spark, sf_dir, "v_scored")).select("doc_id", "label")
    return ds.stratified_split(s, "doc_id", frac=0.15)


@register("stratified_split_threshold", with_views(["v_scored"], f"""
SELECT doc_id, label, CASE WHEN {_u('split', 'doc_id')} < 0.15 THEN 'val' ELSE 'train' END AS split FROM v_scored WHERE label IN (0, 1)"""))
def q_stratified_split_threshold(spark, sf_dir):
    """The split by hash threshold: in the row, without a shuffle."""
    s = pj.filter_labelled(view(spark, sf_dir, "v_scored")).select("doc_id", "label")
    return ds.stratified_split(s, "doc_id", frac=0.15, approx=True)


@register("nested_split", with_views(["v_scored"], """
SELECT doc_id, label,
       CASE WHEN r <= ceil(n * 0.2) THEN 'vault'
            WHEN r <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.2) THEN 'val'
            ELSE 'train' END AS split FROM rk""", [("rk", _SPLIT_RANK)]))
def q_nested_split(spark, sf_dir):
    s = pj.filter_labelled(view(spark, sf_dir, "v_scored")).select("doc_id", "label")
    return ds.nested_split(s, "doc_id")


_WEIGHT_BASE = """
SELECT s.doc_id, s.label,
       CASE WHEN s.doc_id % 5 = 0 THEN 1 ELSE 0 END AS has_inno_sections,
       CASE WHEN s.doc_id % 3 = 0 THEN 1 ELSE 0 END AS imp_has_gui_libs,
       COALESCE(s.toxic, 0) AS dd_cert_present,
       CASE WHEN s.doc_id % 2 = 0 THEN 1 ELSE 0 END AS gen_has_signature
FROM v_scored s WHERE s.label IN (0, 1)"""


@register("sample_weights", with_views(["v_scored"], """
SELECT doc_id, label, has_inno_sections, imp_has_gui_libs, dd_cert_present, gen_has_signature,
       round(CASE WHEN label = 0 THEN 1.4 * power(2.25, has_inno_sections + imp_has_gui_libs
                                                  + CASE WHEN dd_cert_present > 0 THEN 1 ELSE 0 END
                                                  + gen_has_signature)
                  ELSE 1.0 END, 6) AS weight
FROM b""", [("b", _WEIGHT_BASE)]))
def q_sample_weights(spark, sf_dir):
    s = pj.filter_labelled(view(spark, sf_dir, "v_scored"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    b = s.select("doc_id", "label",
                 flag(F.col("doc_id") % 5 == 0).alias("has_inno_sections"),
                 flag(F.col("doc_id") % 3 == 0).alias("imp_has_gui_libs"),
                 F.coalesce(F.col("toxic"), F.lit(0)).alias("dd_cert_present"),
                 flag(F.col("doc_id") % 2 == 0).alias("gen_has_signature"))
    return round_doubles(ds.sample_weights(b))


@register("assemble_matrix", with_views(["v_num"], """
SELECT l_orderkey, l_linenumber, label, slot, value FROM (
  SELECT l_orderkey, l_linenumber, label, 0 AS slot, CAST(l_quantity AS DOUBLE) AS value FROM v_num
  UNION ALL SELECT l_orderkey, l_linenumber, label, 1, l_extendedprice FROM v_num
  UNION ALL SELECT l_orderkey, l_linenumber, label, 2, l_discount FROM v_num
  UNION ALL SELECT l_orderkey, l_linenumber, label, 3, l_tax FROM v_num
  UNION ALL SELECT l_orderkey, l_linenumber, label, 4, constant_col FROM v_num) t"""))
def q_assemble_matrix(spark, sf_dir):
    m = ds.assemble_matrix(view(spark, sf_dir, "v_num"),
                           ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant_col", "absent"],
                           keep=["l_orderkey", "l_linenumber"])
    return round_doubles(explode_array(m, ["l_orderkey", "l_linenumber", "label"], "features", "value",
                                       pos="slot"))


@register("vault_write", with_views(["v_scored"], """
SELECT doc_id, label FROM rk WHERE r <= ceil(n * 0.2)""", [("rk", _SPLIT_RANK)]))
def q_vault_write(spark, sf_dir):
    """Vault rows of the nested split written as headered CSV and read back."""
    from ..sources import io
    s = pj.filter_labelled(view(spark, sf_dir, "v_scored")).select("doc_id", "label")
    vault = ds.nested_split(s, "doc_id").filter(F.col("split") == "vault").drop("split")
    path = io.sink_csv(vault, io.scratch_path(spark, "vault"))
    return io.scan_csv(spark, path, "doc_id bigint, label int")
