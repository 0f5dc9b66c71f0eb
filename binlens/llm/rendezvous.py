"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard scores a key with ``-weight / ln(u)``, ``u`` uniform in (0, 1) from the md5 of
(key, shard); the highest score has the record. A record's shard depends on its key and the
weights alone, and another shard takes records only into itself, so no data moves between
the others. Scoring is a narrow projection. Slots come from a two-level rank: buckets of the
key's hash within a shard are counted, the small count table is cumulated, and rows are
numbered inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _uniform(text: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of a text."""
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2 ** 52)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to ``len(weights) - 1``) with the highest score for a key; null keys count as empty.

    Shards of weight 0 get nothing; ties of the score go to the lower shard.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("one weight at least must be above zero")
    name = F.coalesce(key.cast("string"), F.lit(""))
    scored = [F.struct((F.lit(-float(w)) / F.log(_uniform(F.concat(name, F.lit(f"/{s}"))))).alias("score"),
                       F.lit(-s).alias("less")) for s, w in enumerate(weights) if w > 0]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["less"]).cast("int")


def shard(df: DataFrame, id_col: str = "doc_id", weights: Sequence[float] = (1.0,) * 8, carry: Sequence[str] = (), rows_per_bucket: int = 50_000) -> DataFrame:
    """``id_col``, ``carry``, ``shard``, ``slot``, ``grown_shard``: one row per input row.

    ``grown_shard`` is the shard with one more shard of the mean weight. Slots count from 0
    without gaps in each shard, in an order that the id and the carried values fix; equal rows
    have any of their slots. Null ids are one key like any other. An empty table gives
    an empty result. Only ``id_col`` and ``carry`` are read.
    """
    grown = (*weights, sum(weights) / len(weights))
    rows = df.select(id_col, *carry)
    used = set(rows.columns)
    new = {n: n if n not in used else f"{n}_of_key" for n in ("shard", "slot", "grown_shard")}
    rows = rows.select(*rows.columns, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_h"),
                       rendezvous_shard(F.col(id_col), weights).alias("_s"), rendezvous_shard(F.col(id_col), grown).alias("_g"))
    # Buckets: as many hex digits of the hash as leave rows_per_bucket rows in one.
    total = df.count()
    digits = 1
    while total / len(weights) / 16 ** digits > rows_per_bucket:
        digits += 1
    # Rows of one repeated id (or null) would fill a bucket; the carried values deal them over sub-buckets.
    rows = rows.select("*", F.substring("_h", 1, digits).alias("_b"), F.pmod(F.xxhash64(id_col, *carry), F.lit(16)).alias("_p"))
    counts = rows.groupBy("_s", "_b", "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b", "_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_s", "_b", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_s", "_b", "_p").orderBy("_h", id_col, *carry)
    out = rows.withColumn("_r", F.row_number().over(inside) - 1).join(starts, ["_s", "_b", "_p"])
    return out.select(id_col, *carry, F.col("_s").alias(new["shard"]), (F.col("_start") + F.col("_r")).cast("long").alias(new["slot"]),
                      F.col("_g").alias(new["grown_shard"]))
