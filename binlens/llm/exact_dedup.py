"""Exact deduplication by a 128-bit content hash with a byte comparison inside groups.

Plan: hash every text; count rows and choose the staying id per hash (partially aggregated,
so a hash that a third of all rows share shuffles one row per task); move only the texts of
hashes with two rows or more, compare each with the text of its group's staying row in
salted groups of at most ``rows_per_salt`` rows; and group the texts that differ (hash
collisions) by their own bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import lower_az, whole


#: parts into which rows of one hash are dealt before its size is known
SALTS = 16


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] = lower_az,
                hash_fn: Callable[[Column], Column] = content_hash, rows_per_salt: int = 1000) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of rows with equal normalised texts the one with the smallest id stays (``keep="max"``:
    the largest). A null text equals the empty text. A null id never stays where its group
    has another id; in a group of null ids ``keep_id`` is null and all rows are kept. Rows
    that repeat an id count one by one in ``group_size``, and are kept together when theirs
    is ``keep_id``. An empty table gives an empty result. Other columns are not read, so
    their names cannot clash.
    """
    extreme = {"min": F.min, "max": F.max}[keep]
    base = df.select(F.col(id_col).alias("id"), normalise(whole(text_col)).alias("norm"))
    base = base.select("id", "norm", hash_fn(F.col("norm")).alias("h"))
    hashed = materialise(base.select("id", "h", F.sha2("norm", 256).alias("sha")), "hashed")
    groups = (hashed.groupBy("h").agg(F.count("*").alias("n"), extreme("id").alias("keep")).where("n > 1")
              .withColumn("salts", F.ceil(F.col("n") / rows_per_salt).cast("int")))
    # Always merged: its size follows the copies in the corpus, and the plan should not change with it.
    groups = materialise(groups, "groups").hint("merge")

    # Texts of hashes with several rows, each against the text of the staying row.
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("salts")).cast("int")
    # The join itself is salted too: every group is there SALTS times, and a row meets one of them.
    copies = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")).hint("merge")
    dealt = base.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    members = materialise(dealt.join(copies, ["h", "s"]).select("id", "h", "n", "keep", "salts", salt.alias("salt"), "norm"), "members")
    own = members.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("h", "salts").agg(F.min("norm").alias("own"))
    own = own.select("h", "own", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    same = F.col("norm") == F.col("own")
    compared = materialise(
        members.join(own, ["h", "salt"])
        .select("id", "h", "n", "keep", F.sha2("norm", 256).alias("sha"), same.alias("same"),
                F.when(~same, F.col("norm")).alias("other")), "compared")

    # Collisions: texts that differ from their group's, grouped by their bytes.
    others = compared.where(~F.col("same"))
    by_text = others.groupBy("h", "other").agg(F.count("*").alias("n2"), extreme("id").alias("keep2"))
    less = others.groupBy("h").agg(F.count("*").alias("less"))
    equal = (compared.where("same").join(less, "h", "left")
             .select("id", F.col("keep").alias("keep_id"), (F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"), "sha"))
    apart = others.join(by_text, ["h", "other"]).select("id", F.col("keep2").alias("keep_id"), F.col("n2").alias("group_size"), "sha")

    # Rows of hashes that only they have; salted as well, so that the rows of a hot hash are spread.
    alone = hashed.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(copies.select("h", "s"), ["h", "s"], "left_anti")
    single = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return (single.unionByName(equal).unionByName(apart)
            .select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")))
