"""Assemble nested raw records from long (normalised) tables.

A raw record holds per-file lists (sections, imports, rich pairs). When those
arrive as long tables, each list is one ``groupBy(file)`` with
``collect_list`` — bounded by the size of one file's structure, never by the
corpus — and lists are sorted by the whole struct so results do not depend
on shuffle order. Aggregations on the same key keep the same hash
partitioning, so the final key joins do not reshuffle the aggregated sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Data-directory names in slot order.
DIRECTORY_NAMES = ["EXPORT", "IMPORT", "RESOURCE", "EXCEPTION", "SECURITY", "BASERELOC", "DEBUG",
                   "COPYRIGHT", "GLOBALPTR", "TLS", "LOAD_CONFIG", "BOUND_IMPORT", "IAT", "DELAY_IMPORT",
                   "COM_DESCRIPTOR", "RESERVED"]


def collect_sorted(df: DataFrame, key: str, fields: list[str | Column], out: str) -> DataFrame:
    """One row per key with the sorted array of struct(fields)."""
    st = F.struct(*[F.col(f) if isinstance(f, str) else f for f in fields])
    return df.groupBy(key).agg(F.sort_array(F.collect_list(st)).alias(out))


def section_list(sections: DataFrame, key: str = "file_id") -> DataFrame:
    """Long sections (name, size, vsize, entropy, mem_* flags) -> array<struct> with props."""
    props = F.filter(F.array(
        F.when(F.col("mem_execute") == 1, F.lit("MEM_EXECUTE")),
        F.when(F.col("mem_write") == 1, F.lit("MEM_WRITE")),
        F.when(F.col("mem_read") == 1, F.lit("MEM_READ"))), lambda p: p.isNotNull())
    s = sections.withColumn("props", props)
    agg = collect_sorted(s, key, ["ord", "name", "size", "vsize", "entropy", "props"], "_secs")
    return agg.select(key, F.transform("_secs", lambda x: F.struct(
        x["name"].alias("name"), x["size"].alias("size"), x["entropy"].alias("entropy"),
        x["vsize"].alias("vsize"), x["props"].alias("props"))).alias("sections"))


def import_tokens(symbols: DataFrame, dll: str = "dll", func: str = "func", ordinal: str = "ordinal",
                  out: str = "token") -> DataFrame:
    """Per symbol: the name clipped to 10,000 chars, else ``dll:ordinalN``."""
    name_ok = F.col(func).isNotNull() & (F.length(F.col(func)) > 0)
    tok = F.when(name_ok, F.substring(F.col(func), 1, 10000)) \
           .otherwise(F.concat(F.col(dll), F.lit(":ordinal"), F.col(ordinal).cast("string")))
    return symbols.withColumn(out, tok)


def export_tokens(symbols: DataFrame, func: str = "func", ordinal: str = "ordinal",
                  out: str = "token") -> DataFrame:
    """Per export: name clipped to 10,000 chars, else ``ordinalN``; neither -> dropped."""
    name_ok = F.col(func).isNotNull() & (F.length(F.col(func)) > 0)
    tok = F.when(name_ok, F.substring(F.col(func), 1, 10000)) \
           .when(F.col(ordinal).isNotNull(), F.concat(F.lit("ordinal"), F.col(ordinal).cast("string")))
    return symbols.withColumn(out, tok).filter(F.col(out).isNotNull())


def import_map(symbols: DataFrame, key: str = "file_id") -> DataFrame:
    """Long (file, dll, func, ordinal) -> imports map<dll, array<token>> per file."""
    t = import_tokens(symbols)
    per_dll = t.groupBy(key, "dll").agg(F.sort_array(F.collect_list("token")).alias("funcs"))
    return per_dll.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dll", "funcs")))).alias("imports"))


def export_list(symbols: DataFrame, key: str = "file_id") -> DataFrame:
    """Distinct exported names per file (sorted)."""
    return symbols.filter(F.col("func").isNotNull()).groupBy(key) \
                  .agg(F.sort_array(F.collect_set("func")).alias("exports"))


def rich_list(pairs: DataFrame, key: str = "file_id") -> DataFrame:
    """Long (ord, compid, cnt) -> flat [compid, count, compid, count, ...]."""
    agg = collect_sorted(pairs, key, ["ord", "compid", "cnt"], "_p")
    return agg.select(key, F.flatten(F.transform("_p", lambda p: F.array(
        p["compid"].cast("long"), p["cnt"].cast("long")))).alias("richheader"))


def directory_list(n_dirs: Column, size_of, va_of=None) -> Column:
    """First ``n_dirs`` named directories as array<struct<name,size,virtual_address>>.

    ``size_of(i)`` / ``va_of(i)`` give the size / address Column of slot i.
    """
    names = F.array(*[F.lit(n) for n in DIRECTORY_NAMES])
    va_of = va_of or (lambda i: F.lit(0).cast("long"))
    allv = F.transform(F.sequence(F.lit(0), F.lit(len(DIRECTORY_NAMES) - 1)), lambda i: F.struct(
        F.get(names, i).alias("name"), size_of(i).cast("long").alias("size"),
        va_of(i).cast("long").alias("virtual_address")))
    return F.slice(allv, 1, n_dirs)


def signature_aggs(order: list[str] | None = None) -> list[Column]:
    """Aggregate expressions of :func:`signature_rollup` (usable inside a wider groupBy)."""
    order = order or ["ord"]
    cs = F.col("no_countersigner") == 0
    ordkey = F.struct(*[F.col(c) for c in order], F.col("signing_time"), F.col("n_certs"))
    diff = (F.col("signing_time") - F.col("pe_timestamp")).cast("double")
    return [
        F.count(F.col("no_countersigner")).alias("num_certs"),
        F.max(F.when(F.col("self_signed") == 1, 1).when(F.col("self_signed").isNotNull(), 0)).alias("self_signed"),
        F.max(F.when(F.col("no_program_name") == 1, 1).when(F.col("no_program_name").isNotNull(), 0))
         .alias("empty_program_name"),
        F.max(F.when(~cs, 1).when(cs, 0)).alias("no_countersigner"),
        F.lit(0).alias("parse_error"),
        F.greatest(F.max(F.col("n_certs")), F.lit(0)).alias("chain_max_depth"),
        F.greatest(F.coalesce(F.max(F.when(cs, F.col("signing_time"))), F.lit(0)), F.lit(0))
         .cast("double").alias("latest_signing_time"),
        F.coalesce(F.max_by(F.when(cs, diff), F.when(cs, ordkey)), F.lit(0.0)).alias("signing_time_diff"),
    ]


def signature_rollup(sigs: DataFrame, key: str = "file_id", order: list[str] | None = None) -> DataFrame:
    """Per file over its signatures -> the 8 authenticode numbers.

    Columns expected: no_program_name, no_countersigner, n_certs, self_signed,
    signing_time, pe_timestamp; ``order`` gives the signature order (the time
    difference is taken from the last countersigned signature).
    """
    return sigs.groupBy(key).agg(*signature_aggs(order))


def imports_from_pairs(pairs: Column) -> Column:
    """array<struct<dll, token>> of one file, sorted (a column: it is read per dll) -> map dll -> sorted tokens (keys sorted)."""
    dlls = F.array_distinct(pairs["dll"])
    entries = F.transform(dlls, lambda d: F.struct(d.alias("dll"), F.filter(pairs, lambda x: x["dll"] == d)["token"].alias("funcs")))
    return F.when(F.size(pairs) > 0, F.map_from_entries(entries))
