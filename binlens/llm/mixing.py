"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources are ranked by code point, weigh ``weights`` in turn, and share ``share`` of all
words; a source stops at ``most`` times its size and its excess goes to the others by weight. That
is one level ``v`` with target = min(v * weight, most * size), found by a few sums over the source
table.

Copies: a row of a source with rate r = target / size of the source has floor(r) copies and one
more with probability p = r - floor(r). Pairs of such rows move words between their probabilities,
at random and without bias, until one of them is 0 or 1; the other goes on to the next pair. So
all but one row of a group become whole while the group's expected words stay as they were.
Groups are buckets of a hash within a source; the row left of each goes up a reduction tree, 64
groups to one, until a source has one row left, which is rounded on its own. The words taken from
a source then differ from its target by less than one document, and by little, since each group
goes from its long texts to its short ones, so that the row left is short. Orders and random numbers are
hashes of the row and the level, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import row_key, text_version

WORD_GAP = "[\\x20\\x09-\\x0D]+"
_TINY = 1e-9


def n_words(text):
    """Number of words of a text column; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def _uniform(h: np.ndarray, level: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes and a level (the finishing steps of splitmix64)."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round probabilities in (0, 1) of rows of ``size`` > 0 words, pair by pair in the given order.

    Returns them as 0 or 1, but for one row at most; the sum of p * size stays the same.
    """
    p = p.astype(float).copy()
    i = 0
    for j in range(1, len(p)):
        ratio = size[i] / size[j]
        up, down = min(1 - p[i], p[j] / ratio), min(p[i], (1 - p[j]) / ratio)
        if u[j] * (up + down) < down:
            p[i], p[j] = p[i] + up, p[j] - up * ratio
        else:
            p[i], p[j] = p[i] - down, p[j] + down * ratio
        for k in (i, j):
            if min(p[k], 1 - p[k]) < _TINY:
                p[k] = round(p[k])
        if p[i] in (0.0, 1.0):
            i = j  # when both are whole, the next pair leaves a whole row as it is
    return p


def rank_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``: 0, 1, ... in the order of ``source`` by code point, null last.

    The sorted rows are numbered within their partition and written once; offsets come from that
    table, so nothing depends on a second sampling of the range bounds.
    """
    order = [F.col("source").isNull(), F.col("source")]
    placed = materialise(sources.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (placed.withColumn("part", part).join(starts, "part")
            .select("source", "n", "source_size", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank")))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (``source, n, source_size``) with ``rank`` and ``target``."""
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = rank_sources(sources).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = materialise(ranked, "ranked")
    want = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # a step caps one more source at least, and usually many
        full = F.col("cap") < level * F.col("weight")
        n, taken, weight = ranked.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
                                      F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not weight:
            break
        level, capped = (want - taken) / weight, n
    return ranked.select("source", "n", "source_size", "rank", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _version(text_col: str, source_col: str):
    return F.xxhash64(text_version(text_col), F.col(source_col).cast("string"), F.col(source_col).isNull())


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3.0, 1.0, 2.0),
        share: float = 1.5, most: float = 2.0, rows_per_group: int = 4096) -> DataFrame:
    """One row per input row: ``id, version, nth`` (``version``: a hash of text and source; ``nth``: a number among
    rows that agree in both), ``size, source_size, target, copies``.

    A null text has no words, a null source is a source of its own and the last. A row without
    words takes its copies by its own random number. A source without words has target 0. Rows
    that repeat an id are rows of their own. An empty table gives an empty result. Other columns
    are not read.
    """
    if not 0 <= share <= most:
        raise ValueError("the share must lie between 0 and the most that sources give")
    light = df.select(F.col(id_col).alias("id"), _version(text_col, source_col).alias("version"),
                      F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    nth = F.row_number().over(Window.partitionBy("id", "version").orderBy("size"))
    rows = materialise(light.withColumn("nth", nth.cast("long")).withColumn("h", F.xxhash64("id", "version", "nth")), "rows")
    targets = source_targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, share, most)
    targets = materialise(targets, "targets")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    r, t = rows.alias("r"), targets.alias("t")
    rated = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.id", "version", "nth", "h", "size", "source_size", "target", "rank", "n", rate.alias("rate"))
    whole = F.floor(F.col("rate") + _TINY)
    rated = rated.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    # Bits of the hash that number a source's groups, so that one has rows_per_group rows or so.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rows_per_group))).cast("int")
    rated = rated.withColumn("bits", bits).withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(0))
    rated = materialise(rated, "rated")

    alone = (F.col("p") < _TINY) | (F.col("size") == 0)
    own = F.pmod(F.xxhash64("h", F.lit("own")), F.lit(1 << 30)) / float(1 << 30) < F.col("p")
    done = [rated.where(alone).select("h", "id", "version", "nth", own.cast("int").alias("extra"))]
    todo = rated.where(~alone).select("id", "version", "nth", "h", "size", "p", "rank", "bits", "bucket")
    deepest = rated.agg(F.max("bits")).first()[0] or 0
    schema = todo.schema

    def fold_at(level: int):
        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["size", "h"], ascending=[False, True], kind="stable")
            rows["p"] = pivotal(rows["p"].to_numpy(), rows["size"].to_numpy(float), _uniform(rows["h"].to_numpy(), level))
            return rows
        return fold

    for level in range(-(-deepest // 6) + 1):
        folded = materialise(todo.groupBy("rank", "bucket").applyInPandas(fold_at(level), schema), f"level-{level}")
        settled = F.col("p").isin(0.0, 1.0)
        done.append(folded.where(settled).select("h", "id", "version", "nth", F.col("p").cast("int").alias("extra")))
        todo = (folded.where(~settled).withColumn("bucket", F.shiftright("bucket", 6)))
    last = F.pmod(F.xxhash64("h", F.lit("last")), F.lit(1 << 30)) / float(1 << 30) < F.col("p")
    done.append(todo.select("h", "id", "version", "nth", last.cast("int").alias("extra")))
    extra = done[0]
    for more in done[1:]:
        extra = extra.unionByName(more)
    a, e = rated.alias("a"), extra.alias("e")
    same = (F.col("a.h") == F.col("e.h")) & F.col("a.id").eqNullSafe(F.col("e.id")) & (F.col("a.version") == F.col("e.version")) & (F.col("a.nth") == F.col("e.nth"))
    return a.join(e, same).select("a.id", "a.version", "a.nth", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def take_copies(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as ``mixed`` (of the same rows) says, with the columns of ``df``.

    Rows that agree in id, text and source share their copies out evenly.
    """
    copies = mixed.groupBy(row_key(F.col("id"), F.col("version")).alias("key")).agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    rows = df.select(F.struct("*").alias("row"), row_key(F.col(id_col), _version(text_col, source_col)).alias("key"))
    # Merged at any size: the rows are moved once, and lie by key for numbering those that agree.
    both = rows.join(copies.where("all > 0").hint("merge"), "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("rows"))
    own = F.floor(F.col("all") / F.col("rows")) + (F.col("nth") <= F.col("all") % F.col("rows")).cast("long")
    both = both.withColumn("nth", nth).withColumn("own", own).where("own > 0")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "own"))).select("row.*")
