"""Layout-A raw records (one per order = one "file") built from the fixture views.

Scalar fields come from ``orders`` by fixed arithmetic rules; lists come from
the long views (sections, imports, rich pairs, signatures); warnings are the
sentences of the document whose ``doc_id`` equals the order key. The same
rules are rendered as SQL for the DuckDB twins (``RULES_SQL``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as rec
from ..operators.flat import HDR_OPT_FIELDS
from ..session import DROP_SHUFFLES, settings, shared_path
from .fixtures import view
from .tables import table, table_path

LINES_PER_TASK = 250_000
LINES_PER_SLICE = 10_000_000  # lines whose shuffles are on disk at the same time

# (field, SQL expression over orders columns) — portable between engines.
GENERAL_RULES = [
    ("size", "CAST(floor(o_totalprice) AS BIGINT)"),
    ("vsize", "CAST(floor(o_totalprice * 2) AS BIGINT)"),
    ("has_debug", "CAST(o_orderkey % 2 AS INTEGER)"),
    ("has_relocations", "CAST(o_custkey % 2 AS INTEGER)"),
    ("has_resources", "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END"),
    ("has_signature", "CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END"),
    ("has_tls", "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END"),
    ("symbols", "CAST(o_custkey % 100 AS BIGINT)"),
    ("imports", "CAST(o_orderkey % 50 AS BIGINT)"),
    ("exports", "CAST(o_custkey % 9 AS BIGINT)"),
]
FILE_RULES = [
    ("machine", "CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 332 ELSE 34404 END"),
    ("timestamp", "CAST(epoch(o_orderdate) AS BIGINT)"),
    ("characteristics", "CAST(o_orderkey % 16384 AS BIGINT)"),
]
OPTIONAL_RULES = [(f, f"CAST((o_orderkey * {i + 3} + o_custkey) % {97 * (i + 1)} AS BIGINT)")
                  for i, f in enumerate(HDR_OPT_FIELDS)]
OVERLAY_RULES = [
    ("size", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 1000 AS BIGINT) ELSE CAST(0 AS BIGINT) END"),
    ("size_ratio", "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000) / (floor(o_totalprice) + 1) "
                   "ELSE 0.0 END"),
    ("entropy", "(o_custkey % 80) / 10.0"),
]
LABEL_RULE = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"
# directory i of a file: size = (size_key * (i + 1) % 3) * 100, address = (size_key + i) * 4096


def _spark_expr(sql: str):
    return F.expr(sql.replace("epoch(o_orderdate)", "unix_timestamp(o_orderdate)"))


def _struct(rules):
    return F.struct(*[_spark_expr(e).alias(n) for n, e in rules])


def _count_lines(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(table_path(sf_dir, "lineitem")).count()  # from the footers


#: Rows of a table whose key is in a slice: (table, key) -> table.
Keep = Callable[[DataFrame, str], DataFrame]


def count_slices(spark: SparkSession, sf_dir: str) -> int:
    return max(1, -(-_count_lines(spark, sf_dir) // LINES_PER_SLICE))


def file_slice(k: int, n: int) -> Keep:
    """The files of slice k of n, by a hash of their key."""
    return lambda df, key: df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)


def _line_columns(spark: SparkSession, sf_dir: str, keep: Keep = file_slice(0, 1), slices: int = 1) -> DataFrame:
    """lineitem ⋈ orders (⟕ part) with the columns of every long view of a line.

    The record builders below take all per-file lists from this one frame in a
    single ``groupBy(file_id)``: one shuffle of the lines instead of one per view. Parts come
    first, so that the lines leave the join with orders placed by file, as the grouping needs them.
    Expressions are the ones of the fixture views (v_sections, v_imports, v_pairs, v_sigs).
    """
    li = keep(table(spark, sf_dir, "lineitem"), "l_orderkey")
    o = keep(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # a task sorts and groups its lines: their number is bounded, where the session's number of partitions does not do that
    parts = -(-_count_lines(spark, sf_dir) // (LINES_PER_TASK * slices))
    dealt = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = (li.repartition(parts, "l_partkey") if dealt else li).join(p, li["l_partkey"] == p["p_partkey"], "left")
    x = (x.repartition(parts, "l_orderkey") if dealt else x).join(o, li["l_orderkey"] == o["o_orderkey"])
    rf, ls, q = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    name = (F.when((rf == "A") & (ls == "F"), ".text").when(rf == "A", ".data")
             .when((rf == "N") & (ls == "F"), "UPX0").when(rf == "N", ".itext")
             .when(ls == "F", " .RSRC ").otherwise(".foo"))
    dll = F.expr("CASE l_suppkey % 7 WHEN 0 THEN 'USER32.dll' WHEN 1 THEN 'KERNEL32.dll' "
                 "WHEN 2 THEN 'VCRUNTIME140.dll' WHEN 3 THEN 'gdi32.dll' "
                 "WHEN 4 THEN 'api-ms-win-crt-heap-l1-1-0.dll' WHEN 5 THEN 'ADVAPI32.dll' ELSE 'ws2_32.dll' END")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return x.select(
        F.col("o_orderkey").alias("file_id"), F.col("l_linenumber").alias("ord"),
        name.alias("name"),
        F.when(q < 4, F.lit(0)).otherwise(F.floor("l_extendedprice")).cast("long").alias("size"),
        F.floor(F.col("l_extendedprice") / 2).cast("long").alias("vsize"),
        (q * 8 / 50).alias("entropy"),
        flag(F.col("l_discount") >= 0.05).alias("mem_execute"), flag(F.col("l_tax") >= 0.04).alias("mem_write"),
        flag(q >= 5).alias("mem_read"),
        F.col("p_partkey").isNotNull().alias("has_part"), dll.alias("dll"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("func"),
        F.col("l_partkey").alias("ordinal"), F.col("l_partkey").alias("compid"),
        q.cast("long").alias("cnt"), "l_suppkey", "l_partkey",
        flag(F.col("l_discount") == 0).alias("no_program_name"), flag(F.col("l_tax") == 0).alias("no_countersigner"),
        q.cast("long").alias("n_certs"), flag(F.col("l_partkey") % 13 == 0).alias("self_signed"),
        F.unix_timestamp("l_shipdate").cast("long").alias("signing_time"),
        F.unix_timestamp("o_orderdate").cast("long").alias("pe_timestamp"))


def _props() -> Column:
    flags = (("mem_execute", "MEM_EXECUTE"), ("mem_write", "MEM_WRITE"), ("mem_read", "MEM_READ"))
    return F.array_remove(F.array(*[F.when(F.col(c) == 1, F.lit(n)).otherwise(F.lit("")) for c, n in flags]), "")


def _file_lists(spark: SparkSession, sf_dir: str, layout: str, keep: Keep, slices: int) -> DataFrame:
    """One row per file with every list of its raw record (layout 'A' or 'B')."""
    # aggregates evaluate their inputs row by row without generated code: these are columns before
    lines = rec_tokens(_line_columns(spark, sf_dir, keep, slices)).withColumn("props", _props())
    if layout == "A":
        sec = F.struct("ord", "name", "size", "vsize", "entropy", "props")
    else:
        lines = lines.withColumn("name", F.lower("name")).withColumn("virtual_address", F.col("ord").cast("long") * 4096)
        sec = F.struct("ord", "name", "size", "vsize", "entropy", "virtual_address", "props")
    imp = F.when(F.col("has_part"), F.struct("dll", "token"))
    exp = (F.when(F.col("has_part") & F.col("func").isNotNull(), F.col("func")) if layout == "A"
           else F.when(F.col("has_part"), F.col("etoken")))
    agg = lines.groupBy("file_id").agg(
        F.sort_array(F.collect_list(sec)).alias("_secs"),
        F.sort_array(F.collect_list(imp)).alias("_imps"),
        (F.sort_array(F.collect_set(exp)) if layout == "A" else F.sort_array(F.collect_list(exp))).alias("_exps"),
        F.sort_array(F.collect_list(F.struct("ord", "compid", "cnt"))).alias("_pairs"),
        *rec.signature_aggs(["ord", "l_partkey", "l_suppkey"]))
    from ..operators.vector import AUTH_FIELDS
    return agg.select(
        "file_id", "_secs",
        rec.imports_from_pairs(F.col("_imps")).alias("imports"),
        F.when(F.size("_exps") > 0, F.col("_exps")).alias("exports"),
        F.flatten(F.transform("_pairs", lambda q: F.array(q["compid"].cast("long"), q["cnt"].cast("long"))))
         .alias("richheader"),
        F.struct(*[F.col(c) for c in AUTH_FIELDS]).alias("authenticode"))


def rec_tokens(lines: DataFrame) -> DataFrame:
    """Import token (name or dll:ordinalN) and export token (name or ordinalN) per line."""
    ok = F.col("func").isNotNull() & (F.length("func") > 0)
    return lines.withColumn("token", F.when(ok, F.substring("func", 1, 10000))
                            .otherwise(F.concat(F.col("dll"), F.lit(":ordinal"), F.col("ordinal").cast("string")))) \
                .withColumn("etoken", F.when(ok, F.substring("func", 1, 10000))
                            .when(F.col("ordinal").isNotNull(), F.concat(F.lit("ordinal"), F.col("ordinal").cast("string"))))


def _files(spark: SparkSession, sf_dir: str, layout: str, more: Callable[[Keep], list[DataFrame]] | None = None, only: Keep | None = None,
           of: int = 1) -> DataFrame:
    """The columns of each order with its lists, and the columns of ``more``: tables with a file_id, each row of which is met once.

    What is made from these columns is made after the joins, so that it does not go through their shuffles. Tables of more than
    ``LINES_PER_SLICE`` lines are joined slice by slice of the files; the joined rows go to the shared folder, and the
    shuffles of a slice are deleted before the next. ``only``: the files that are wanted, which are one of ``of`` slices.
    """
    slices = max(1, -(-count_slices(spark, sf_dir) // of))

    def joined(k: int) -> DataFrame:
        part = file_slice(k, slices)
        keep = (lambda df, key: only(part(df, key), key)) if only else part
        out = keep(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("file_id", F.col("o_orderkey"))
        for t in [_file_lists(spark, sf_dir, layout, keep, slices * of), *(more(keep) if more else [])]:
            out = out.join(t, "file_id", "left")  # one key, by which the lists are dealt already
        return out

    if slices == 1:
        return joined(0)
    path = shared_path(spark, f"files-{layout}")
    with settings(spark, DROP_SHUFFLES):
        for k in range(slices):
            rows = joined(k)
            rows.write.mode("append").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def raw_records(spark: SparkSession, sf_dir: str, only: Keep | None = None, of: int = 1) -> DataFrame:
    """file_id, label, general, header, section, datadirectories, imports, exports,
    richheader, authenticode, pefilewarnings — layout A. ``only`` and ``of``: see ``_files``."""
    def texts(keep: Keep) -> list[DataFrame]:
        return [keep(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("file_id"), F.split(F.col("text"), r"\. ").alias("pefilewarnings"))]

    out = _files(spark, sf_dir, "A", texts, only, of)
    out = out.withColumn("sections", F.transform("_secs", lambda x: F.struct(
        x["name"].alias("name"), x["size"].alias("size"), x["entropy"].alias("entropy"),
        x["vsize"].alias("vsize"), x["props"].alias("props")))).drop("_secs")

    dirs_n = F.col("o_custkey") % 16 + 1
    size_key = F.col("o_orderkey") % 5
    empty_secs = F.array().cast(out.schema["sections"].dataType)
    out = out.select(
        "file_id", "sections", "imports", "exports", "richheader", "authenticode", "pefilewarnings",
        _spark_expr(LABEL_RULE).alias("label"),
        _struct(GENERAL_RULES).alias("general"),
        F.struct(_struct(FILE_RULES).alias("file"), _struct(OPTIONAL_RULES).alias("optional")).alias("header"),
        _struct(OVERLAY_RULES).alias("_overlay"),
        rec.directory_list(dirs_n.cast("int"),
                           lambda i: (size_key * (i + 1) % 3) * 100,
                           lambda i: (size_key + i) * 4096).alias("datadirectories"),
    )
    return out.select(
        "file_id", "label", "general", "header",
        F.struct(F.lit("").alias("entry"), F.coalesce(F.col("sections"), empty_secs).alias("sections"),
                 F.col("_overlay").alias("overlay")).alias("section"),
        "datadirectories", "imports", "exports", "richheader", "authenticode", "pefilewarnings")


def rules_sql(rules, prefix: str) -> str:
    return ", ".join(f"{e} AS {prefix}{n}" for n, e in rules)


# ---- layout B (the byte extractor's raw shape) --------------------------------

def _bits_to_names(value_sql: str, names: list[str]):
    """Names of the set bits of an integer expression (bit i -> names[i])."""
    v = F.expr(value_sql)
    return F.filter(F.array(*[F.when(F.shiftright(v, i).bitwiseAND(1) == 1, F.lit(n))
                              for i, n in enumerate(names)]), lambda x: x.isNotNull())


B_FILE_SIZE = "CAST(floor(o_totalprice) AS BIGINT) + 1"
B_MACHINE = ("CASE o_custkey % 4 WHEN 0 THEN 'IMAGE_FILE_MACHINE_I386' WHEN 1 THEN 'IMAGE_FILE_MACHINE_AMD64' "
             "WHEN 2 THEN 'IMAGE_FILE_MACHINE_ARM64' ELSE 'IMAGE_FILE_MACHINE_BOGUS' END")
B_COFF_RULES = [
    ("timestamp", "CAST(epoch(o_orderdate) AS BIGINT)"),
    ("number_of_sections", "CAST(o_orderkey % 10 AS BIGINT)"),
    ("number_of_symbols", "CAST(o_custkey % 100 AS BIGINT)"),
    ("sizeof_optional_header", "CAST(224 + 16 * (o_orderkey % 2) AS BIGINT)"),
    ("pointer_to_symbol_table", "CAST(o_orderkey % 1000 AS BIGINT)"),
]
B_IMAGE_BITS = "o_orderkey % 65536"
B_DLL_BITS = "o_custkey % 2048"
B_ENTRY_POINT = "CAST((o_orderkey * 37) % 32768 AS BIGINT)"


def b_optional_rules():
    from ..operators.vector import OPTIONAL_VECTOR_FIELDS
    return [(f, f"CAST((o_orderkey * {i + 5} + o_custkey * 3) % {101 * (i + 1)} AS BIGINT)")
            for i, f in enumerate(OPTIONAL_VECTOR_FIELDS)]


def b_dos_rules():
    from ..operators.vector import DOS_MEMBERS
    return [(m, f"CAST((o_orderkey + {i} * o_custkey) % {61 * (i + 1)} AS BIGINT)") for i, m in enumerate(DOS_MEMBERS)]


def b_subsystem_sql():
    from ..operators.vector import SUBSYSTEM_TYPES
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SUBSYSTEM_TYPES))
    return f"CASE o_custkey % 16 {cases} ELSE 'IMAGE_SUBSYSTEM_OTHER' END"


def raw_records_b(spark: SparkSession, sf_dir: str, more: Callable[[Keep], list[DataFrame]] | None = None, only: Keep | None = None,
                  of: int = 1) -> DataFrame:
    """Layout-B raw records: general{size,entropy,is_pe,start_bytes}, header{coff,optional,dos}
    with category strings and flag-name lists, sections with addresses and ratios, reloc
    flags as the first directory entry, export tokens, and the signature rollup.

    ``more``: tables with a file_id, given which files to keep; their columns follow, null for files that they have not.
    ``only`` and ``of``: see ``_files``."""
    from ..operators import vector as vec

    fsize = _spark_expr(B_FILE_SIZE)
    o = _files(spark, sf_dir, "B", more, only, of)
    rest = [c for t in (more(file_slice(0, 1)) if more else []) for c in t.columns if c != "file_id"]
    o = o.withColumn("sections", F.transform("_secs", lambda x: F.struct(
        x["name"].alias("name"), x["size"].alias("size"), x["entropy"].alias("entropy"),
        x["vsize"].alias("vsize"), x["virtual_address"].alias("virtual_address"),
        x["props"].alias("props")))).drop("_secs")

    size_key = F.col("o_orderkey") % 5
    dirs = rec.directory_list((F.col("o_custkey") % 16 + 1).cast("int"),
                              lambda i: (size_key * (i + 1) % 3) * 100, lambda i: (size_key + i) * 4096)
    dirs = F.transform(dirs, lambda d: F.struct(d["name"].alias("name"), d["size"].alias("size"),
                                                d["virtual_address"].alias("virtual_address"),
                                                F.lit(None).cast("int").alias("has_relocs"),
                                                F.lit(None).cast("int").alias("has_dynamic_relocs")))
    reloc = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("size"),
                     F.lit(None).cast("long").alias("virtual_address"),
                     (F.col("o_custkey") % 2).cast("int").alias("has_relocs"),
                     (F.col("o_orderkey") % 2).cast("int").alias("has_dynamic_relocs"))
    ov_size = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 1000).otherwise(0).cast("long")
    # lists are columns of their own before they go into a struct: what reads a field of a struct
    # takes its expression over, so a list inside one would be made anew for every reader
    o = o.withColumn("_flags", _bits_to_names(B_IMAGE_BITS, vec.IMAGE_CHARACTERISTICS)) \
         .withColumn("_dll_flags", _bits_to_names(B_DLL_BITS, vec.DLL_CHARACTERISTICS))
    out = o.select(
        "file_id", "sections", "imports", "exports", "richheader", "authenticode", *rest,
        _spark_expr(LABEL_RULE).alias("label"),
        _spark_expr(B_ENTRY_POINT).alias("_ep"),
        fsize.alias("_fsize"),
        F.struct(fsize.alias("size"), ((F.col("o_custkey") % 80) / 10.0).alias("entropy"),
                 F.lit(1).alias("is_pe"),
                 F.array(F.lit(77), F.lit(90), (F.col("o_orderkey") % 256).cast("int"),
                         (F.col("o_custkey") % 256).cast("int")).alias("start_bytes")).alias("general"),
        F.struct(
            F.struct(*[_spark_expr(e).alias(n) for n, e in B_COFF_RULES], F.expr(B_MACHINE).alias("machine"),
                     F.col("_flags").alias("characteristics")).alias("coff"),
            F.struct(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 267 ELSE 523 END").alias("magic"),
                     F.expr(b_subsystem_sql()).alias("subsystem"),
                     *[F.expr(e).alias(n) for n, e in b_optional_rules()],
                     F.col("_dll_flags").alias("dll_characteristics"))
             .alias("optional"),
            F.struct(*[F.expr(e).alias(n) for n, e in b_dos_rules()]).alias("dos")).alias("header"),
        F.concat(F.array(reloc), dirs).alias("datadirectories"),
        F.struct(ov_size.alias("size"), (ov_size / fsize).alias("size_ratio"),
                 F.when(ov_size > 0, (F.col("o_custkey") % 80) / 10.0).otherwise(0.0).alias("entropy"))
         .alias("_overlay"),
    )
    empty = F.array().cast(o.schema["sections"].dataType)
    out = out.withColumn("_sections", vec.section_ratios(F.coalesce(F.col("sections"), empty), F.col("_fsize"))) \
             .withColumn("_entry", vec.section_entry_name(F.col("_sections"), F.col("_ep")))
    return out.select(
        "file_id", "label", "general", "header",
        F.struct(F.col("_entry").alias("entry"), F.col("_sections").alias("sections"),
                 F.col("_overlay").alias("overlay")).alias("section"),
        "datadirectories", "imports", "exports", "richheader", "authenticode", *rest)
