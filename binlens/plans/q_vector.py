"""Queries for 2.E vectorisers over layout-B records.

Spark side: entries of all groups summed in their row by the vector kernel; long form (file_id, slot,
value), zeros dropped. DuckDB side: the same slots computed from the long fixture views with GROUP BY.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.hashing import _let, blake2b_bins, hash_bin, hash_sign, signed_parity_bin, sql_hash_bin, sql_hash_sign, \
    sql_murmur3, sql_murmur3_bin, sql_murmur3_sign, sql_parity_bin
from ..operators import records as rec
from ..operators import vector as vec
from ..sources import io, table, view, with_views
from ..sources.records import (B_COFF_RULES, B_DLL_BITS, B_ENTRY_POINT, B_FILE_SIZE, B_IMAGE_BITS, B_MACHINE,
                               LABEL_RULE, b_dos_rules, b_optional_rules, b_subsystem_sql, raw_records_b, rules_sql)
from .q_bytes import _BL, _EH, _HIST, _ST, _STRING_ITEMS, _STRS
from .q_flat import _CTES as _FLAT_CTES
from ..operators.partitioning import explode_array
from .registry import register, round_doubles

_AA = next(s for n, s in _FLAT_CTES if n == "aa")


def _lst(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_FB = ("fb", f"""SELECT o_orderkey AS file_id, {LABEL_RULE} AS label, {B_FILE_SIZE} AS fsize,
       (o_custkey % 80) / 10.0 AS gentropy, o_orderkey % 256 AS sb2, o_custkey % 256 AS sb3,
       {rules_sql(B_COFF_RULES, 'c_')}, {B_MACHINE} AS machine, {B_IMAGE_BITS} AS ibits,
       {rules_sql(b_optional_rules(), 'p_')}, {b_subsystem_sql()} AS subsystem, {B_DLL_BITS} AS dbits,
       {rules_sql(b_dos_rules(), 'd_')},
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 ELSE 0 END AS ov_size,
       CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000) / ({B_FILE_SIZE}) ELSE 0.0 END AS ov_ratio,
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 1000 > 0 THEN (o_custkey % 80) / 10.0 ELSE 0.0 END AS ov_entropy,
       o_custkey % 16 + 1 AS n_dirs, o_orderkey % 5 AS size_key, o_custkey % 2 AS has_relocs,
       o_orderkey % 2 AS has_dyn, {B_ENTRY_POINT} AS ep FROM orders""")

_SB = ("sb", """SELECT s.file_id, s.ord, lower(s.name) AS name, s.size, s.vsize, s.entropy, s.ord * 4096 AS va,
       s.mem_execute, s.mem_write, s.mem_read, s.size / fb.fsize AS size_ratio,
       s.size / greatest(s.vsize, 1) AS vsize_ratio, fb.ep
       FROM v_sections s JOIN fb ON fb.file_id = s.file_id""")

_TOK = ("tok", """SELECT file_id, dll, CASE WHEN func IS NOT NULL AND length(func) > 0 THEN substr(func, 1, 10000)
       ELSE dll || ':ordinal' || CAST(ordinal AS VARCHAR) END AS token,
       CASE WHEN func IS NOT NULL AND length(func) > 0 THEN substr(func, 1, 10000)
            WHEN ordinal IS NOT NULL THEN 'ordinal' || CAST(ordinal AS VARCHAR) END AS etoken
       FROM v_imports""")


def _hb(tok: str, n: int) -> str:
    return sql_hash_bin(tok, n)


def _hs(tok: str) -> str:
    return sql_hash_sign(tok)


_IMAGE_HOT = ", ".join(f"CAST((ibits >> {i}) & 1 AS DOUBLE)" for i in range(16))
_DLL_HOT = ", ".join(f"CAST((dbits >> {i}) & 1 AS DOUBLE)" for i in range(11))
_HEADER_VALS = ", ".join(
    [f"CAST(c_{f} AS DOUBLE)" for f in vec.COFF_FIELDS]
    + [f"CAST(COALESCE(list_position({_lst(vec.MACHINE_TYPES)}, machine) - 1, 0) AS DOUBLE)",
       f"CAST(COALESCE(list_position({_lst(vec.SUBSYSTEM_TYPES)}, subsystem) - 1, 0) AS DOUBLE)"]
    + [f"CAST(p_{f} AS DOUBLE)" for f in vec.OPTIONAL_VECTOR_FIELDS]
    + [_IMAGE_HOT, _DLL_HOT] + [f"CAST(d_{m} AS DOUBLE)" for m in vec.DOS_MEMBERS])

_SEC_GEN = """SELECT fb.file_id,
       COALESCE(count(sb.ord), 0) AS n, COALESCE(sum(CASE WHEN sb.size = 0 THEN 1 ELSE 0 END), 0) AS nz,
       COALESCE(sum(CASE WHEN sb.name = '' THEN 1 ELSE 0 END), 0) AS ne,
       COALESCE(sum(CASE WHEN sb.mem_read = 1 AND sb.mem_execute = 1 THEN 1 ELSE 0 END), 0) AS nrx,
       COALESCE(sum(sb.mem_write), 0) AS nw,
       greatest(COALESCE(max(sb.entropy), 0), fb.ov_entropy, 0) AS emax,
       least(COALESCE(min(sb.entropy), 0), fb.ov_entropy, 0) AS emin,
       greatest(COALESCE(max(sb.size_ratio), 0), fb.ov_ratio, 0) AS smax,
       least(COALESCE(min(sb.size_ratio), 0), fb.ov_ratio, 0) AS smin,
       greatest(COALESCE(max(sb.vsize_ratio), 0), 0) AS vmax, least(COALESCE(min(sb.vsize_ratio), 0), 0) AS vmin,
       COALESCE(arg_max(sb.name, (sb.ord, sb.name, sb.size, sb.vsize, sb.entropy))
                FILTER (WHERE sb.va <= sb.ep AND sb.ep < sb.va + sb.vsize),
                arg_min(sb.name, (sb.ord, sb.name, sb.size, sb.vsize, sb.entropy))
                FILTER (WHERE sb.mem_execute = 1 AND sb.name <> ''), '') AS entry,
       fb.ov_size, fb.ov_ratio, fb.ov_entropy
       FROM fb LEFT JOIN sb ON sb.file_id = fb.file_id
       GROUP BY fb.file_id, fb.ov_size, fb.ov_ratio, fb.ov_entropy"""


def _hb_exact(tok: str, n: int) -> str:
    return _let(sql_murmur3(tok), "hz", sql_murmur3_bin("hz", n))


def _hs_exact(tok: str) -> str:
    return _let(sql_murmur3(tok), "hz", sql_murmur3_sign("hz"))


def _items_sql(offsets: dict[str, int], _hb=_hb, _hs=_hs) -> str:
    """Union of (file_id, slot, value) items of the requested groups, before aggregation."""
    parts = []
    if "general" in offsets:
        o = offsets["general"]
        parts.append(f"""SELECT file_id, {o} + unnest(range(7)) AS slot,
            unnest([CAST(fsize AS DOUBLE), gentropy, 1.0, 77.0, 90.0, CAST(sb2 AS DOUBLE), CAST(sb3 AS DOUBLE)]) AS value
            FROM fb""")
    if "header" in offsets:
        o = offsets["header"]
        parts.append(f"SELECT file_id, {o} + unnest(range(74)) AS slot, unnest([{_HEADER_VALS}]) AS value FROM fb")
    if "section" in offsets:
        o = offsets["section"]
        parts.append(f"""SELECT file_id, {o} + unnest(range(11)) AS slot,
            unnest([CAST(n AS DOUBLE), nz, ne, nrx, nw, emax, emin, smax, smin, vmax, vmin]) AS value FROM sg""")
        for k, w in ((11, "size"), (61, "vsize"), (111, "entropy")):
            parts.append(f"SELECT file_id, {o + k} + {_hb('name', 50)} AS slot, {_hs('name')} * {w} AS value FROM sb")
        chars = ("(SELECT file_id, name || ':' || p AS t FROM (SELECT file_id, name, unnest(list_filter("
                 "[CASE WHEN mem_execute = 1 THEN 'MEM_EXECUTE' END, CASE WHEN mem_write = 1 THEN 'MEM_WRITE' END, "
                 "CASE WHEN mem_read = 1 THEN 'MEM_READ' END], lambda x: x IS NOT NULL)) AS p FROM sb) q)")
        parts.append(f"SELECT file_id, {o + 161} + {_hb('t', 50)} AS slot, {_hs('t')} AS value FROM {chars} c")
        parts.append(f"SELECT file_id, {o + 211} + {_hb('entry', 10)} AS slot, {_hs('entry')} AS value FROM sg")
        parts.append(f"""SELECT file_id, {o + 221} + unnest(range(3)) AS slot,
            unnest([CAST(ov_size AS DOUBLE), ov_ratio, ov_entropy]) AS value FROM sg""")
    if "imports" in offsets:
        o = offsets["imports"]
        parts.append(f"""SELECT file_id, {o} + unnest(range(2)) AS slot,
            unnest([CAST(count(*) AS DOUBLE), CAST(count(DISTINCT lower(dll)) AS DOUBLE)]) AS value
            FROM tok GROUP BY file_id""")
        parts.append(f"""SELECT file_id, {o + 2} + {_hb('lib', 256)} AS slot, 1.0 AS value
            FROM (SELECT DISTINCT file_id, lower(dll) AS lib FROM tok) l""")
        parts.append(f"""SELECT file_id, {o + 258} + {_hb('q', 1024)} AS slot, 1.0 AS value
            FROM (SELECT file_id, lower(dll) || ':' || token AS q FROM tok) q""")
    if "exports" in offsets:
        o = offsets["exports"]
        parts.append(f"SELECT DISTINCT file_id, {o} AS slot, 128.0 AS value FROM tok WHERE etoken IS NOT NULL")
        parts.append(f"""SELECT file_id, {o + 1} + {_hb('etoken', 128)} AS slot, {_hs('etoken')} AS value
            FROM tok WHERE etoken IS NOT NULL""")
    if "datadirectories" in offsets:
        o = offsets["datadirectories"]
        parts.append(f"""SELECT file_id, {o} + 2 * i + unnest([0, 1]) AS slot,
            unnest([CAST((size_key * (i + 1) % 3) * 100 AS DOUBLE), CAST((size_key + i) * 4096 AS DOUBLE)]) AS value
            FROM (SELECT file_id, size_key, unnest(range(n_dirs - 1)) AS i FROM fb) d""")
        parts.append(f"""SELECT file_id, {o + 32} + unnest(range(2)) AS slot,
            unnest([CAST(has_relocs AS DOUBLE), CAST(has_dyn AS DOUBLE)]) AS value FROM fb""")
    if "richheader" in offsets:
        o = offsets["richheader"]
        parts.append(f"SELECT file_id, {o} AS slot, CAST(count(*) AS DOUBLE) AS value FROM v_pairs GROUP BY file_id")
        parts.append(f"""SELECT file_id, {o + 1} + {_hb('compid', 32)} AS slot, {_hs('compid')} * cnt AS value
            FROM v_pairs""")
    if "authenticode" in offsets:
        o = offsets["authenticode"]
        parts.append(f"""SELECT file_id, {o} + unnest(range(8)) AS slot,
            unnest([CAST(num_certs AS DOUBLE), self_signed, empty_program_name, no_countersigner, 0,
                    chain_max_depth, latest_signing_time, signing_time_diff]) AS value FROM aa""")
    return "\nUNION ALL\n".join(parts)


_ALL_CTES = [_FB, _SB, ("sg", _SEC_GEN), _TOK, ("aa", _AA)]
_VIEWS = ["v_sections", "v_imports", "v_pairs", "v_sigs"]


def _long_sql(offsets: dict[str, int]) -> str:
    return with_views(_VIEWS, f"""
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(slot AS INTEGER) AS slot, round(sum(value), 6) AS value
FROM ({_items_sql(offsets)}) it GROUP BY file_id, slot HAVING sum(value) <> 0""", _ALL_CTES)


def _spark_long(spark, sf_dir, groups):
    r = raw_records_b(spark, sf_dir)
    long = vec.vectorize_long(r, "file_id", groups)
    return round_doubles(long.select("file_id", F.col("slot").cast("int").alias("slot"), "value"))


def _make_group(name: str, qname: str):
    @register(qname, _long_sql({name: 0}))
    def q(spark, sf_dir):
        return _spark_long(spark, sf_dir, [name])
    q.__name__ = f"q_{qname}"


for _g, _q in (("header", "vec_header"), ("section", "vec_section"), ("imports", "vec_imports"),
               ("exports", "vec_exports"), ("datadirectories", "vec_datadirs"), ("richheader", "vec_rich"),
               ("authenticode", "vec_authenticode"), ("general", "vec_general_record")):
    _make_group(_g, _q)

_OFFSETS, _o = {}, 0
for _grp in vec.select_groups():
    if _grp.name != "pefilewarnings":
        _OFFSETS[_grp.name] = _o
    _o += _grp.dim


# Rules of the normalisation vocabulary used with the document sentences (id = position).
WARNING_RULES = ["...the", "...and", "The...", "Is...", "...ion", "Eau...", "...les", "Der...", "...que", "El..."]


def _vocab(spark):
    rules = spark.createDataFrame([(r, i) for i, r in enumerate(WARNING_RULES)], "rule string, id int")
    return vec.warning_vocab(rules)


def _sentences(spark, sf_dir, keep=lambda df, key: df):
    d = keep(table(spark, sf_dir, "documents"), "doc_id")
    return explode_array(d.withColumnRenamed("doc_id", "file_id"), ["file_id"], F.split("text", r"\. "), "warning")


_RULES_SQL = ("rules", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(WARNING_RULES))
              + ") r(rule, id)")
_NORM_SQL = ("norm", """
SELECT file_id, warning, rule, id FROM (
  SELECT s.file_id, s.warning, r.rule, r.id,
         row_number() OVER (PARTITION BY s.file_id, s.warning
                            ORDER BY CASE WHEN starts_with(r.rule, '...') THEN 0 ELSE 1 END, r.id) AS rn
  FROM (SELECT DISTINCT doc_id AS file_id, unnest(string_split(text, '. ')) AS warning FROM documents) s
  JOIN rules r ON (starts_with(r.rule, '...') AND ends_with(s.warning, substr(r.rule, 4)))
               OR (NOT starts_with(r.rule, '...') AND starts_with(s.warning, substr(r.rule, 1, length(r.rule) - 3)))
) t WHERE rn = 1""")


_WARNING_ITEMS_SQL = f"""
SELECT file_id, {_o - 88} + slot AS slot, value FROM (
  SELECT DISTINCT file_id, id AS slot, 1.0 AS value FROM norm
  UNION ALL SELECT file_id, {vec.N_WARNINGS} AS slot, CAST(count(DISTINCT rule) AS DOUBLE) FROM norm GROUP BY file_id) n
WHERE file_id IN (SELECT o_orderkey FROM orders)"""


@register("vectorize", with_views(_VIEWS, f"""
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(slot AS INTEGER) AS slot, round(sum(value), 6) AS value
FROM ({_items_sql(_OFFSETS)} UNION ALL {_WARNING_ITEMS_SQL}) it GROUP BY file_id, slot HAVING sum(value) <> 0""",
          [*_ALL_CTES, _RULES_SQL, _NORM_SQL]))
def q_vectorize(spark, sf_dir):
    long = vec.vectorize_long(_with_warnings(spark, sf_dir), "file_id")
    return round_doubles(long.select("file_id", F.col("slot").cast("int").alias("slot"), "value"))


def _with_warnings(spark, sf_dir, more=lambda keep: []):
    """Layout-B records with the ids of their warnings, and the columns of ``more`` (see ``raw_records_b``)."""
    def tables(keep):
        ids = vec.warning_normalise(_sentences(spark, sf_dir, keep), _vocab(spark)).groupBy("file_id") \
                 .agg(F.array_sort(F.collect_set("id")).alias("warning_ids"))
        return [ids, *more(keep)]

    r = raw_records_b(spark, sf_dir, tables)
    return r.withColumn("warning_ids", F.coalesce("warning_ids", F.array().cast("array<int>")))


@register("vectorize_dense", with_views(_VIEWS, f"""
SELECT CAST(file_id AS BIGINT) AS file_id, {_o} AS width, CAST(slot AS INTEGER) AS slot, round(CAST(CAST(sum(value) AS FLOAT) AS DOUBLE), 6) AS value
FROM ({_items_sql(_OFFSETS)} UNION ALL {_WARNING_ITEMS_SQL}) it GROUP BY file_id, slot HAVING CAST(sum(value) AS FLOAT) <> 0""",
          [*_ALL_CTES, _RULES_SQL, _NORM_SQL]))
def q_vectorize_dense(spark, sf_dir):
    """Dense vectors: every slot of every file, listed where it is not 0."""
    dense = vec.vectorize(_with_warnings(spark, sf_dir), "file_id")
    x = explode_array(dense, ["file_id", F.size("features").alias("width")], "features", "value", pos="slot").where("value <> 0")
    return round_doubles(x.select("file_id", "width", "slot", F.col("value").cast("double").alias("value")))


# ---- bins of the public hashers ----------------------------------------------------------
_EXACT, _w = {}, 0
for _grp in vec.select_groups(["section", "imports", "exports", "richheader"]):
    _EXACT[_grp.name] = _w
    _w += _grp.dim


@register("vectorize_exact", with_views(_VIEWS, f"""
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(slot AS INTEGER) AS slot, round(sum(value), 6) AS value
FROM ({_items_sql(_EXACT, _hb_exact, _hs_exact)}) it GROUP BY file_id, slot HAVING sum(value) <> 0""", _ALL_CTES))
def q_vectorize_exact(spark, sf_dir):
    """Sections, imports, exports and rich header with the bins and signs of the public feature hashers."""
    long = vec.vectorize_long(raw_records_b(spark, sf_dir), "file_id", list(_EXACT), hasher="murmur3")
    return round_doubles(long.select("file_id", F.col("slot").cast("int").alias("slot"), "value"))


# ---- byte groups, feature-list files and user groups ----------------------------------------
_BYTE_CTES = [_BL, _HIST, *_EH, _STRS, _ST]


def _byte_items_sql(offsets: dict[str, int]) -> str:
    parts = []
    if "histogram" in offsets:
        parts.append(f"SELECT h.doc_id AS file_id, {offsets['histogram']} + h.b AS slot, h.n / v.size AS value FROM hist h JOIN v_bytes v ON v.doc_id = h.doc_id")
    if "byteentropy" in offsets:
        parts.append(f"""SELECT doc_id, {offsets['byteentropy']} + hbin * 16 + nib, n / sum(n) OVER (PARTITION BY doc_id) FROM eh""")
    if "strings" in offsets:
        parts.append(f"SELECT doc_id, {offsets['strings']} + slot, value FROM ({_STRING_ITEMS}) si")
    return "\nUNION ALL\n".join(parts)


_FULL, _f = {}, 0
for _grp in vec.GROUPS:
    _FULL[_grp.name] = _f
    _f += _grp.dim
_RECORD_GROUPS = {k: v for k, v in _FULL.items() if k not in ("histogram", "byteentropy", "strings", "pefilewarnings")}


@register("vectorize_all", with_views([*_VIEWS, "v_bytes"], f"""
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(slot AS INTEGER) AS slot, round(sum(value) + 1e-9, 6) AS value
FROM ({_items_sql(_RECORD_GROUPS)} UNION ALL {_byte_items_sql(_FULL)} UNION ALL
      SELECT file_id, slot - {_o - 88} + {_FULL['pefilewarnings']}, value FROM ({_WARNING_ITEMS_SQL}) w) it
WHERE file_id IN (SELECT o_orderkey FROM orders) AND file_id IN (SELECT doc_id FROM documents)
GROUP BY file_id, slot HAVING sum(value) <> 0""", [*_ALL_CTES, _RULES_SQL, _NORM_SQL, *_BYTE_CTES]))
def q_vectorize_all(spark, sf_dir):
    """All twelve groups, byte groups too (2,568 slots), of the files that have a record and a content."""
    def contents(keep):
        return [keep(view(spark, sf_dir, "v_bytes"), "doc_id").select(F.col("doc_id").alias("file_id"), "content", F.lit(True).alias("_there"))]

    records = _with_warnings(spark, sf_dir, contents).where("_there").drop("_there")
    records = vec.raw_features(records, [g.name for g in vec.GROUPS])
    long = vec.vectorize_long(records, "file_id", [g.name for g in vec.GROUPS])
    return _off_ties(long)


def _off_ties(long):
    """Rounded values of shares: the two engines round exact ties (41 of 640 bytes) in different ways."""
    return round_doubles(long.withColumn("value", F.col("value") + 1e-9))


def _raw_shape(df):
    """Raw step of a user's group: lines, and commas of the first kibibyte."""
    text = F.decode("content", "ISO-8859-1")
    lines = F.size(F.split(text, "\n", -1))
    commas = F.length(F.regexp_replace(F.substring(text, 1, 1024), "[^,]", ""))
    return df.withColumn("shape", F.struct(lines.alias("lines"), commas.alias("commas")))


SHAPE = vec.VectorGroup("shape", 2, lambda offset: vec.GroupParts([(offset, [F.col("shape.lines"), F.col("shape.commas")])], [], F.col("shape").isNull()),
                        enabled=False, raw=_raw_shape, alias="TextShape")
_CHOICE = {"StringExtractor": {}, "ByteHistogram": {"normalised": True}, "GeneralFileInfo": {}, "HeaderFileInfo": None, "TextShape": {}}


@register("vectorize_selected", with_views(["v_bytes"], f"""
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(slot AS INTEGER) AS slot, round(value + 1e-9, 6) AS value FROM (
  SELECT v.doc_id AS file_id, unnest(range(7)) AS slot, unnest([CAST(v.size AS DOUBLE), e.entropy, 0.0,
         CASE WHEN v.size > 0 THEN CAST(('0x' || substr(hex(v.content), 1, 2)) AS INTEGER) ELSE 0 END, CASE WHEN v.size > 1 THEN CAST(('0x' || substr(hex(v.content), 3, 2)) AS INTEGER) ELSE 0 END,
         CASE WHEN v.size > 2 THEN CAST(('0x' || substr(hex(v.content), 5, 2)) AS INTEGER) ELSE 0 END, CASE WHEN v.size > 3 THEN CAST(('0x' || substr(hex(v.content), 7, 2)) AS INTEGER) ELSE 0 END]) AS value
  FROM v_bytes v LEFT JOIN (SELECT h.doc_id, -sum(h.n / t.size * log2(h.n / t.size)) AS entropy FROM hist h JOIN v_bytes t ON t.doc_id = h.doc_id GROUP BY h.doc_id) e ON e.doc_id = v.doc_id
  UNION ALL {_byte_items_sql({'histogram': 7, 'strings': 263})}
  UNION ALL SELECT doc_id, {263 + vec.N_STRING_SLOTS} + unnest([0, 1]), unnest([CAST(len(string_split(text, chr(10))) AS DOUBLE), length(regexp_replace(substr(text_1k, 1, 1024), '[^,]', '', 'g'))])
            FROM (SELECT doc_id, text, array_to_string(list_transform(range(least(size, 1024)), lambda i: CASE WHEN substr(hex(content), 2 * i + 1, 2) = '2C' THEN ',' ELSE '.' END), '') AS text_1k FROM v_bytes) x
) t WHERE value <> 0""", _BYTE_CTES))
def q_vectorize_selected(spark, sf_dir):
    """Groups that a feature-list file selects, a user's group among them, from contents alone."""
    path = io.scratch_path(spark, "feature-list")
    spark.createDataFrame([(json.dumps({"features": _CHOICE}),)], "value string").coalesce(1).write.text(path)
    vec.register_group(SHAPE, after="strings")
    try:
        names = vec.read_feature_list(spark, path)
        contents = view(spark, sf_dir, "v_bytes").select(F.col("doc_id").alias("file_id"), "content")
        long = vec.vectorize_long(vec.raw_features(contents, names), "file_id", names)
    finally:
        vec.unregister_group(SHAPE.name)
    return _off_ties(long)


# ---- smaller 2.E operators -------------------------------------------------------

@register("signed_hash_bin", f"""
SELECT p_partkey, {sql_hash_bin('p_name', 50)} AS bin, {sql_hash_sign('p_name')} AS sign,
       {sql_parity_bin('p_name', 8)[0]} AS bin8, {sql_parity_bin('p_name', 8)[1]} AS sign8 FROM part""")
def q_signed_hash_bin(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b8, s8 = signed_parity_bin(F.col("p_name"), 8)
    return p.select("p_partkey", hash_bin(F.col("p_name"), 50).alias("bin"), hash_sign(F.col("p_name")).alias("sign"),
                    b8.alias("bin8"), s8.alias("sign8"))


@register("signed_hash_bin_exact")
def q_signed_hash_bin_exact(spark, sf_dir):
    """BLAKE2b bins (reference digest) via an Arrow-batched UDF; no SQL twin (no BLAKE2b in DuckDB)."""
    p = table(spark, sf_dir, "part")
    h = p.select("p_partkey", blake2b_bins(F.array(F.col("p_name")), 8).alias("h"))
    return h.select("p_partkey", F.col("h")[0]["bin"].alias("bin8"), F.col("h")[0]["sign"].alias("sign8"))


@register("feature_hash", with_views(["v_sections"], f"""
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(slot AS INTEGER) AS slot, round(sum(value), 6) AS value FROM (
  SELECT file_id, {_hb('lower(name)', 50)} AS slot, {_hs('lower(name)')} * size AS value FROM v_sections) t
GROUP BY file_id, slot"""))
def q_feature_hash(spark, sf_dir):
    s = view(spark, sf_dir, "v_sections").withColumn("name", F.lower("name"))
    items = explode_array(s, ["file_id"], vec.hashed_items(F.array("name"), 50, weights=F.array("size")), "it")
    out = items.groupBy("file_id", F.col("it.slot").alias("slot")).agg(F.sum("it.value").alias("value"))
    return round_doubles(out.select("file_id", F.col("slot").cast("int").alias("slot"), "value"))


_MACHINE_OF_CUST = ("CASE c_custkey % 4 WHEN 0 THEN 'IMAGE_FILE_MACHINE_I386' WHEN 1 THEN 'IMAGE_FILE_MACHINE_AMD64' "
                    "WHEN 2 THEN 'IMAGE_FILE_MACHINE_ARM64' ELSE 'IMAGE_FILE_MACHINE_' || c_mktsegment END")


@register("category_index", f"""
SELECT c_custkey, CAST(COALESCE(list_position({_lst(vec.MACHINE_TYPES)}, {_MACHINE_OF_CUST}) - 1, 0) AS INTEGER)
       AS machine_idx FROM customer""")
def q_category_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", vec.category_index(F.expr(_MACHINE_OF_CUST), vec.MACHINE_TYPES).alias("machine_idx"))


@register("multi_hot", f"""
SELECT o_orderkey, CAST(i AS INTEGER) AS slot, CAST((({B_IMAGE_BITS}) >> i) & 1 AS INTEGER) AS hot
FROM (SELECT o_orderkey, unnest(range(16)) AS i FROM orders) t""")
def q_multi_hot(spark, sf_dir):
    from ..sources.records import _bits_to_names
    o = table(spark, sf_dir, "orders")
    flags = _bits_to_names(B_IMAGE_BITS, vec.IMAGE_CHARACTERISTICS)
    m = o.select("o_orderkey", vec.multi_hot(flags, vec.IMAGE_CHARACTERISTICS).alias("h"))
    return explode_array(m, ["o_orderkey"], "h", "hot", pos="slot")


@register("section_entry_name", with_views(_VIEWS, "SELECT CAST(file_id AS BIGINT) AS file_id, entry FROM sg",
                                           _ALL_CTES))
def q_section_entry_name(spark, sf_dir):
    return raw_records_b(spark, sf_dir).select("file_id", F.col("section.entry").alias("entry"))


@register("section_ratios", with_views(_VIEWS, """
SELECT CAST(file_id AS BIGINT) AS file_id,
       CAST(row_number() OVER (PARTITION BY file_id ORDER BY ord, name, size, vsize, entropy) - 1 AS INTEGER) AS idx,
       round(size_ratio, 6) AS size_ratio, round(vsize_ratio, 6) AS vsize_ratio FROM sb""", _ALL_CTES))
def q_section_ratios(spark, sf_dir):
    r = raw_records_b(spark, sf_dir)
    x = explode_array(r, ["file_id"], "section.sections", "s", pos="idx")
    return round_doubles(x.select("file_id", "idx", F.col("s.size_ratio").alias("size_ratio"),
                                  F.col("s.vsize_ratio").alias("vsize_ratio")))


@register("import_tokens", with_views(["v_imports"], "SELECT file_id, dll, token FROM tok", [_TOK]))
def q_import_tokens(spark, sf_dir):
    return rec.import_tokens(view(spark, sf_dir, "v_imports")).select("file_id", "dll", "token")


@register("export_tokens", with_views(["v_imports"], "SELECT file_id, etoken AS token FROM tok WHERE etoken IS NOT NULL",
                                      [_TOK]))
def q_export_tokens(spark, sf_dir):
    return rec.export_tokens(view(spark, sf_dir, "v_imports")).select("file_id", "token")


# ---- warnings -----------------------------------------------------------------------
@register("warning_normalise", with_views([], "SELECT file_id, warning, rule, CAST(id AS INTEGER) AS id FROM norm",
                                          [_RULES_SQL, _NORM_SQL]))
def q_warning_normalise(spark, sf_dir):
    return vec.warning_normalise(_sentences(spark, sf_dir), _vocab(spark))


@register("warning_dictionary_load", "SELECT rule, CAST(id AS INTEGER) AS id, CAST(CASE WHEN starts_with(rule, '...') THEN 0 ELSE 1 END AS INTEGER) AS kind, "
          "CASE WHEN starts_with(rule, '...') THEN substr(rule, 4) ELSE substr(rule, 1, length(rule) - 3) END AS part FROM ("
          "SELECT CASE WHEN p_partkey % 2 = 0 THEN '...' || p_name ELSE p_name || '...' END AS rule, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part) r")
def q_warning_dictionary_load(spark, sf_dir):
    """A rules file of one line per part, read back with line numbers."""
    path = io.scratch_path(spark, "rules")
    rules = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.expr("CASE WHEN p_partkey % 2 = 0 THEN '...' || p_name ELSE p_name || '...' END").alias("value"))
    rules.coalesce(1).write.text(path)
    return vec.warning_dictionary_load(spark, path)


@register("vec_warnings", with_views([], f"""
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(slot AS INTEGER) AS slot, value FROM (
  SELECT DISTINCT file_id, id AS slot, 1.0 AS value FROM norm
  UNION ALL SELECT file_id, {vec.N_WARNINGS} AS slot, CAST(count(DISTINCT rule) AS DOUBLE) FROM norm GROUP BY file_id)
t""", [_RULES_SQL, _NORM_SQL]))
def q_vec_warnings(spark, sf_dir):
    n = vec.warning_normalise(_sentences(spark, sf_dir), _vocab(spark))
    ids = n.groupBy("file_id").agg(F.array_sort(F.collect_set("id")).alias("warning_ids"))
    return vec.vectorize_long(ids, "file_id", ["pefilewarnings"])
