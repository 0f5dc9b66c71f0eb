"""Byte-content features over a ``binary`` column (one row per file).

All operators are narrow (no shuffle). Counting kernels and the pattern automaton run as
Arrow UDFs over whole batches; everything derived from the counts is JVM-side
(codegen'd expressions and HOFs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytestats import (STEP, WINDOW, bind, byte_counts, byte_entropy_counts, entropy_of_counts, pattern_names,
                                   pattern_string_counts, printable_char_counts)
from ..functions.patterns import MIN_STRING

MAX_BYTES = 1 * 1024 * 1024  # fixed value: 1 MiB truncation constant


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def byte_at(content, i: int) -> Column:
    """Unsigned value of byte ``i`` (0-based); 0 when the content is shorter."""
    c = _c(content)
    return F.when(F.length(c) > i, F.conv(F.hex(F.substring(c, i + 1, 1)), 16, 10).cast("int")).otherwise(0)


def byte_histogram(df: DataFrame, content: str = "content", out: str = "histogram") -> DataFrame:
    """256 byte counts per file (array<long>)."""
    return df.withColumn(out, byte_counts(F.col(content)))


def normalise_counts(counts: Column) -> Column:
    """counts / sum(counts) (0 when the sum is 0)."""
    tot = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return bind(tot, lambda t: F.transform(counts, lambda x: F.coalesce(F.try_divide(x.cast("double"), t), F.lit(0.0))))


def byte_general(df: DataFrame, content: str = "content", histogram: str | None = None,
                 is_pe: Column | None = None) -> DataFrame:
    """size, Shannon entropy (log2) of the bytes, first four bytes (zero-padded), is_pe.

    Empty content gives size 0, entropy 0 and zero start bytes.
    """
    # the UDF result is materialised as a column first: HOF lambdas cannot call Python
    h = F.col(histogram) if histogram else F.col("_hist")
    base = df if histogram else df.withColumn("_hist", byte_counts(F.col(content)))
    size = F.coalesce(F.length(F.col(content)), F.lit(0))
    out = base.select("*",
                      size.cast("long").alias("size"),
                      entropy_of_counts(h).alias("entropy"),
                      (is_pe if is_pe is not None else F.lit(0)).cast("int").alias("is_pe"),
                      *[byte_at(content, i).alias(f"start_byte_{i}") for i in range(4)])
    return out if histogram else out.drop("_hist")


def vec_general(df: DataFrame, content: str = "content", is_pe: Column | None = None,
                out: str = "vec_general") -> DataFrame:
    """7 floats: size, entropy, is_pe, 4 start bytes."""
    g = byte_general(df, content, is_pe=is_pe)
    cols = ["size", "entropy", "is_pe"] + [f"start_byte_{i}" for i in range(4)]
    return g.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols])).drop(*cols)


def byte_entropy_hist(df: DataFrame, content: str = "content", window: int = WINDOW, step: int = STEP,
                      out: str = "byteentropy") -> DataFrame:
    """16x16 joint (window entropy bin, high nibble) histogram, flattened row-major."""
    return df.withColumn(out, byte_entropy_counts(F.col(content), window, step))


def printable_strings(content, min_len: int = MIN_STRING) -> Column:
    """Runs of bytes 0x20..0x7f of at least ``min_len`` (bytes decoded 1:1 as Latin-1)."""
    text = F.decode(_c(content), "ISO-8859-1")
    return F.regexp_extract_all(text, F.lit(f"([\\x20-\\x7f]{{{min_len},}})"), 1)


def string_stats(df: DataFrame, strings: str = "strings") -> DataFrame:
    """numstrings, avlength, printables, 96-slot char histogram, char entropy; zeros if none."""
    s = F.coalesce(F.col(strings), F.array().cast("array<string>"))
    n = F.size(s)
    total = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    base = df.withColumn("printabledist", printable_char_counts(s))
    return base.select("*",
                       n.cast("long").alias("numstrings"),
                       F.when(n > 0, total / n).otherwise(0.0).alias("avlength"),
                       total.alias("printables"),
                       F.when(n > 0, entropy_of_counts(F.col("printabledist"))).otherwise(0.0)
                        .alias("string_entropy"))


def ioc_pattern_counts(df: DataFrame, strings: str = "strings", fixed: bool = False,
                       out: str = "string_counts") -> DataFrame:
    """Per pattern: number of strings with at least one match (not number of matches).

    ``out`` = map<pattern, count> holding only patterns seen. An automaton finds the literals that
    patterns must contain in all strings of a batch at once; regular expressions (Python's, as the
    contract has it) look only at strings with such a literal, or at the joined text where a pattern has none.
    """
    base = df.withColumn("_ioc", pattern_string_counts(F.col(strings), fixed))
    names = F.array(*[F.lit(n) for n in pattern_names(fixed)])
    seen = F.filter(F.arrays_zip(names.alias("k"), F.col("_ioc").alias("v")), lambda e: e["v"] > 0)
    return base.withColumn(out, F.map_from_entries(seen)).drop("_ioc")


def string_vector(df: DataFrame, strings: str = "strings", fixed: bool = False,
                  out: str = "vec_strings") -> DataFrame:
    """177 floats: numstrings, avlength, printables, 96 normalised char counts, entropy,
    77 pattern counts in name order."""
    st = string_stats(df, strings).withColumn("_sc", pattern_string_counts(F.col(strings), fixed))
    div = F.when(F.col("printables") > 0, F.col("printables").cast("double")).otherwise(1.0)
    vec = F.concat(F.array(F.col("numstrings").cast("double"), F.col("avlength").cast("double"),
                           F.col("printables").cast("double")),
                   F.transform("printabledist", lambda x: x.cast("double") / div),
                   F.array(F.col("string_entropy").cast("double")),
                   F.transform("_sc", lambda x: x.cast("double")))
    return st.withColumn(out, vec).drop("_sc", "numstrings", "avlength", "printables", "printabledist",
                                        "string_entropy")


def content_hash(content) -> Column:
    """SHA-256 hex of the content."""
    return F.sha2(_c(content), 256)


def range_entropy(df: DataFrame, content: str, offset: Column, prefix: str = "overlay") -> DataFrame:
    """size, size ratio and entropy of the bytes after ``offset``; zeros if none."""
    total = F.length(F.col(content))
    suffix = F.when(total > offset, F.call_function("substr", F.col(content), offset + 1)) \
              .otherwise(F.lit(bytearray()))
    n = F.length(suffix)
    base = df.withColumn("_sfx_hist", byte_counts(suffix))
    return base.select("*",
                       n.cast("long").alias(f"{prefix}_size"),
                       F.when(n > 0, n / total).otherwise(0.0).alias(f"{prefix}_size_ratio"),
                       F.when(n > 0, entropy_of_counts(F.col("_sfx_hist"))).otherwise(0.0)
                        .alias(f"{prefix}_entropy")).drop("_sfx_hist")


def magic_prefix(content, magic: bytes) -> Column:
    """True when the bytes start with ``magic``."""
    c = _c(content)
    return F.substring(c, 1, len(magic)) == F.lit(bytearray(magic))


def truncate_content(content, cap: int = MAX_BYTES) -> Column:
    """First ``cap`` bytes."""
    return F.substring(_c(content), 1, cap)
