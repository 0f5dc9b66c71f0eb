"""Sample selection from a catalogue table (family lookup with fallback, type filter, quota).

Per-family ranks use ``row_number() <= k`` windows, which Spark plans with a
partial group limit before the shuffle, so a family holding a third of the
catalogue ships at most ``k`` rows per map task. The global quota uses a
per-family total table (one row per family) for offsets instead of one
global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Selection constants of the sample collector.
PER_FAMILY_LIMIT = 1000
TARGET_TOTAL = 2000
ALLOWED_TYPES = ("exe", "dll")

RANKS_PER_BLOCK = 4096


def families_frame(spark: SparkSession, families: list[str]) -> DataFrame:
    """Ordered family list -> (family, priority)."""
    return spark.createDataFrame([(f, i) for i, f in enumerate(families)], "family string, priority int")


def lookup_with_fallback(cat: DataFrame, families: DataFrame, order: str = "doc_id",
                         tag: str = "tag", signature: str = "signature",
                         per_limit: int = PER_FAMILY_LIMIT) -> DataFrame:
    """Per family: up to ``per_limit`` entries by tag; families without any tag hit fall
    back to entries by signature. Output: family, priority, via, rank, catalogue columns."""
    # one scan: an entry is offered under its tag and under its signature, and met with the short, user-given family list
    names = F.explode(F.array(F.struct(F.lit("tag").alias("via"), F.col(tag).alias("name")), F.struct(F.lit("signature").alias("via"), F.col(signature).alias("name"))))
    fam = F.broadcast(families)
    both = cat.select("*", names.alias("_n")).join(fam, F.col("_n.name") == fam["family"]).withColumn("via", F.col("_n.via")).drop("_n")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("family", "via").orderBy(order))).filter(F.col("rank") <= per_limit)
    # at most 2 * per_limit rows a family from here on
    by_tag = F.max(F.col("via") == "tag").over(Window.partitionBy("family"))
    return ranked.withColumn("_tagged", by_tag).filter((F.col("via") == "tag") | ~F.col("_tagged")).drop("_tagged")


def filter_file_type(cat: DataFrame, col: str = "file_type", types=ALLOWED_TYPES) -> DataFrame:
    """Keep allowed file types; a missing type counts as 'unknown'."""
    return cat.filter(F.coalesce(F.col(col), F.lit("unknown")).isin(list(types)))


def quota_take(selected: DataFrame, total: int = TARGET_TOTAL, ok: str = "ok",
               priority: str = "priority", rank: str = "rank") -> DataFrame:
    """Walk families in priority order and entries in rank order; an entry is attempted
    while fewer than ``total`` successful (``ok``) entries precede it. Adds ``attempted``
    and ``taken`` (attempted and ok) and keeps only attempted rows."""
    okc = F.coalesce(F.col(ok), F.lit(0))
    # sums of blocks of ranks, then inside each block: no task sees more of a family than a block
    rows = selected.withColumn("_block", F.floor(F.col(rank) / RANKS_PER_BLOCK))
    per = rows.groupBy(priority, "_block").agg(F.sum(okc).alias("_ok"))
    inside_family = Window.partitionBy(priority).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.withColumn("_in_family", F.coalesce(F.sum("_ok").over(inside_family), F.lit(0)))
    families = per.groupBy(priority).agg(F.sum("_ok").alias("_family_ok"))
    before = Window.orderBy(priority).rowsBetween(Window.unboundedPreceding, -1)  # one row per family
    families = families.withColumn("_earlier", F.coalesce(F.sum("_family_ok").over(before), F.lit(0)))
    offs = blocks.join(F.broadcast(families), priority).select(priority, "_block", (F.col("_in_family") + F.col("_earlier")).alias("_off"))
    inside = Window.partitionBy(priority, "_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    x = rows.join(offs, [priority, "_block"]).withColumn("_before", F.col("_off") + F.coalesce(F.sum(okc).over(inside), F.lit(0)))
    return (x.withColumn("attempted", (F.col("_before") < total).cast("int"))
             .filter(F.col("attempted") == 1)
             .withColumn("taken", okc.cast("int"))
             .drop("_off", "_before", "_block"))
