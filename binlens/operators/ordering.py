"""Distributed ranks and hash-derived randomness.

``hash_ordinal`` numbers rows in the order of a hash of their key: the leading hex digits of
the hash are a bucket, buckets are counted per group, the small count table is cumulated, and
rows are numbered inside their bucket. Every step is a function of the row's key, so however
often a plan or a lost task is evaluated again, the numbers agree; a group with a third of all
rows is spread over all its buckets.

``running_totals`` cumulates counts in the order of a value. Its input has one row per distinct
value, so equal rows never meet in a task; the sorted table is written once and the offsets of
its partitions come from what was written.

Random draws are derived from md5 of (seed, tag, key): they depend only on
the row's key, never on partitioning or task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise_at

_ROW_BITS = 33  # monotonically_increasing_id = (partition << 33) + row-in-partition


def hash_key(seed, *parts) -> Column:
    """Hex md5 of ``seed:part1:part2...`` (parts are column names or Columns)."""
    cols = [F.lit(str(seed))] + [
        (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_uniform(seed, tag: str, key) -> Column:
    """Deterministic U[0,1) draw per (seed, tag, key) from 32 bits of md5."""
    h = hash_key(seed, F.lit(tag), key)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def hash_ordinal(df: DataFrame, hash_col: str, tie: str, out: str = "ordinal",
                 partition_by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Attach the 1-based rank of each row in the order (``hash_col``, ``tie``), within ``partition_by``.

    ``hash_col`` is a hex digest; its first ``digits`` digits are the bucket (16 ** digits of
    them a group). Rows that agree in hash and tie have any of their ranks.
    """
    groups = list(partition_by or [])
    rows = df.withColumn("_bucket", F.substring(hash_col, 1, digits))
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    # <= 16 ** digits rows a group
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_bucket").alias("_ob"), *[F.col(g).alias(f"_og{i}") for i, g in enumerate(groups)],
                         F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(hash_col, tie)
    ranked = rows.withColumn("_in", F.row_number().over(inside))
    # NULL-safe match so rows with a NULL group key are kept
    cond = [F.col("_bucket") == F.col("_ob")] + [F.col(g).eqNullSafe(F.col(f"_og{i}")) for i, g in enumerate(groups)]
    return (ranked.join(offs, cond).withColumn(out, (F.col("_off") + F.col("_in")).cast("long"))
            .drop("_bucket", "_in", "_ob", "_off", *[f"_og{i}" for i in range(len(groups))]))


def running_totals(counted: DataFrame, value: str, counts: list[str], partition_by: list[str] | None = None,
                   written: list[str] | None = None) -> DataFrame:
    """``counted`` (one row per group and value) with ``<c>_before``: the sum of count ``c`` over smaller values.

    The value order is ascending, NULL first. One job sorts and writes the table; its path is added to ``written``,
    for callers that delete it when they have read the result.
    """
    groups = list(partition_by or [])
    placed = (counted.repartitionByRange(*groups, value).sortWithinPartitions(*groups, value)
              .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), _ROW_BITS)))
    placed, path = materialise_at(placed, "running")
    if written is not None:
        written.append(path)
    parts = placed.groupBy(*groups, "_pid").agg(*[F.sum(c).alias(c) for c in counts])  # partitions x groups at most
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select(F.col("_pid").alias("_op"), *[F.col(g).alias(f"_og{i}") for i, g in enumerate(groups)],
                        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in counts])
    cond = [F.col("_pid") == F.col("_op")] + [F.col(g).eqNullSafe(F.col(f"_og{i}")) for i, g in enumerate(groups)]
    inside = Window.partitionBy(*groups, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offs, cond)
    return out.select(*counted.columns, *[(F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in counts])
