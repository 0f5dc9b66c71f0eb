"""Removal of lines that many documents share, by DataFrame functions alone.

Plan: explode the distinct normalised lines of each document, hash them, count documents
per hash (partially aggregated: a line that every document has costs one row per task) and
keep the frequent hashes, which are usually few and written once, so Spark knows their true
size and broadcasts them or not. Only (document, position, hash) of lines then meets that
table; the marks of a document's lines, in order, meet the document, and it is put together
from the lines that are not marked, in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import BLANKS, lower_az, whole


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return lower_az(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits of a key: both halves are hashes of its bytes, with two seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row per input row: ``id_col, n_lines, n_dropped, kept`` (the text that is left).

    Lines end at ``\\n``; a null or empty text is one empty line. A line's key is ``line_key``;
    keys of ``min_chars`` code points or more that ``min_docs`` documents or more contain lose all
    their lines in every row. Rows of one id are one document; rows without an id are a document each. A document whose lines all go has the empty text. An
    empty table gives an empty result. Other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    docs = docs.select("id", F.xxhash64("text", F.length("text")).alias("version"), F.split("text", "\n", -1).alias("lines"))

    # Documents per key.
    keys = docs.select("id", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key"))
    keys = keys.where(F.length("key") >= min_chars).select("id", key_hash(F.col("key")).alias("h"))
    repeated = docs.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select("id")
    repeated = materialise(repeated, "line-dedup-ids")
    if not repeated.isEmpty():  # of the rows of one id, a key counts once; the others need no look at their ids
        again = keys.join(repeated, "id", "left_semi").distinct()
        once = keys.join(repeated, "id", "left_anti")
        keys = once.unionAll(again)
    frequent = keys.groupBy("h").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("h")
    frequent = materialise(frequent, "line-dedup")

    # Which lines of a document are frequent, in order (repeated rows have the same).
    at = docs.select("id", "version", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    # Keys that are too short stand for themselves: as nulls they would all meet in one task.
    own = F.struct(F.xxhash64("version", "pos").alias("a"), F.xxhash64("pos", "version", "id").alias("b"))
    at = at.select("id", "version", "pos", F.when(F.length("key") >= min_chars, key_hash(F.col("key"))).otherwise(own).alias("h"))
    marked = at.join(frequent.withColumn("gone", F.lit(True)), "h", "left")
    marked = marked.groupBy("id", "version").agg(F.sort_array(F.collect_set(F.struct("pos", F.coalesce("gone", F.lit(False)).alias("gone")))).alias("marks"))

    # Each document put together from its other lines.
    d, g = docs.alias("d"), marked.alias("g")
    both = d.join(g, F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.version") == F.col("g.version")))
    left = F.array_compact(F.zip_with("lines", "marks", lambda line, mark: F.when(~mark["gone"], line)))
    both = both.select(F.col("d.id").alias("id"), F.size("lines").cast("long").alias("n"), left.alias("left"))
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_lines"), (F.col("n") - F.size("left")).cast("long").alias("n_dropped"),
                       F.array_join("left", "\n").alias("kept"))
