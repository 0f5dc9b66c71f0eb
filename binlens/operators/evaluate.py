"""Evaluation of (label, probability) tables.

Every metric here is one scan with partial (map-side) aggregation; the only
post-aggregation work runs on tables whose size is bounded by the threshold
grid or the number of score buckets, never by the row count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_totals

# Threshold grids of the training, fine-tuning and evaluation scripts.
GRID_TRAIN = [0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50,
              0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10]
GRID_TUNE = [0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50,
             0.45, 0.40, 0.35, 0.30]
GRID_EVAL = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
TARGET_FPR = 0.10
DEFAULT_THRESHOLD = 0.5


def _ratio(num, den):
    """num/den with a zero (or NULL) denominator mapped to 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def classify(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "score",
             out: str = "pred") -> DataFrame:
    """Predicted class: 1 when ``score >= threshold`` (inclusive)."""
    return df.withColumn(out, (F.col(score) >= F.lit(threshold)).cast("int"))


def _confusion_aggs(label: str, score: str, threshold: float):
    y, p = F.col(label), F.col(score) >= F.lit(threshold)
    return [
        F.count_if((y == 0) & ~p).alias("tn"),
        F.count_if((y == 0) & p).alias("fp"),
        F.count_if((y == 1) & ~p).alias("fn"),
        F.count_if((y == 1) & p).alias("tp"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (df.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
              .withColumn("recall", _ratio(tp, tp + fn))
              .withColumn("fpr", _ratio(fp, fp + tn))
              .withColumn("fnr", _ratio(fn, fn + tp)))


def confusion_matrix(df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                     label: str = "label", score: str = "score") -> DataFrame:
    """One row: TN, FP, FN, TP (both classes always present, zero when absent)."""
    return df.agg(*_confusion_aggs(label, score, threshold))


def rates(df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
          label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts plus accuracy, recall, FPR, FNR (zero denominators -> 0)."""
    return _with_rates(confusion_matrix(df, threshold, label, score))


def eval_summary(df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                 label: str = "label", score: str = "score") -> DataFrame:
    """Row count, actual/predicted class counts, confusion and rates as one row."""
    y, p = F.col(label), F.col(score) >= F.lit(threshold)
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y == 0).alias("actual_0"),
        F.count_if(y == 1).alias("actual_1"),
        F.count_if(~p).alias("pred_0"),
        F.count_if(p).alias("pred_1"),
        *_confusion_aggs(label, score, threshold),
    )
    return _with_rates(out).withColumn("threshold", F.lit(float(threshold)))


def threshold_sweep(df: DataFrame, grid=GRID_TRAIN, label: str = "label",
                    score: str = "score") -> DataFrame:
    """Confusion and rates at every threshold of ``grid`` in one scan.

    Each row is assigned the bucket ``b`` = number of grid thresholds <= its
    score (it is predicted positive exactly at thresholds 1..b of the sorted
    grid). ``groupBy(bucket, label)`` reduces the data to at most
    2*(len(grid)+1) rows; the per-threshold counts are suffix sums over that
    table. Cost: one scan + one tiny shuffle, independent of the grid size.
    """
    spark = df.sparkSession
    ts = sorted(set(float(t) for t in grid))
    bucket = reduce(lambda a, b: a + b,
                    [(F.col(score) >= F.lit(t)).cast("int") for t in ts], F.lit(0))
    counts = (df.select(bucket.alias("bucket"), F.col(label).alias("_y"))
                .groupBy("bucket")
                .agg(F.count_if(F.col("_y") == 0).alias("neg"),
                     F.count_if(F.col("_y") == 1).alias("pos")))
    # bucket k >= 1 <-> threshold k of the ascending grid; bucket 0 = below all
    dim = spark.createDataFrame([(0, None)] + [(k + 1, t) for k, t in enumerate(ts)],
                                "bucket int, threshold double")
    # suffix sums over <= len(grid)+1 rows: a bounded, single-partition window
    w = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(F.lit(0))
    out = (dim.join(F.broadcast(counts), "bucket", "left").na.fill(0, ["neg", "pos"])
              .withColumn("fp", F.sum("neg").over(w))
              .withColumn("tp", F.sum("pos").over(w))
              .withColumn("n_neg", F.sum("neg").over(wall))
              .withColumn("n_pos", F.sum("pos").over(wall))
              .filter(F.col("threshold").isNotNull())
              .select("threshold",
                      (F.col("n_neg") - F.col("fp")).cast("long").alias("tn"),
                      F.col("fp").cast("long").alias("fp"),
                      (F.col("n_pos") - F.col("tp")).cast("long").alias("fn"),
                      F.col("tp").cast("long").alias("tp")))
    return _with_rates(out)


def pick_threshold(sweep: DataFrame, target_fpr: float = TARGET_FPR) -> DataFrame:
    """Max recall subject to FPR <= target; ties -> highest threshold; none -> empty."""
    return (sweep.filter(F.col("fpr") <= F.lit(target_fpr))
                 .orderBy(F.col("recall").desc(), F.col("threshold").desc())
                 .limit(1))


def metric_logloss(df: DataFrame, label: str = "label", score: str = "score",
                   eps: float = 1e-15) -> DataFrame:
    """Binary log loss with probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    ll = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return df.agg(F.avg(ll).alias("logloss"), F.count(F.lit(1)).alias("n"))


def binned_auc(df: DataFrame, label: str = "label", score: str = "score", bins: int = 4096) -> tuple[float, float]:
    """AUC from counts of scores (0 to 1) in ``bins`` equal bins, and how far it can be from the exact one.

    Counts of parts of the data add up, so one aggregation of at most ``bins`` rows does; pairs in one bin count half, which
    is off by half of their share at most. NaN where a class is missing.
    """
    bucket = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("b")
    rows = df.groupBy(bucket).agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).collect()
    return auc_of_counts({r.b: (r.neg, r.pos) for r in rows})


def auc_of_counts(counts: dict[int, tuple[int, int]]) -> tuple[float, float]:
    """AUC and error bound from (negatives, positives) per score bin."""
    below = num = tied = 0
    for b in sorted(counts):
        neg, pos = counts[b]
        num += pos * (2 * below + neg)
        tied += pos * neg
        below += neg
    pairs = below * sum(pos for _, pos in counts.values())
    return (num / (2 * pairs), tied / (2 * pairs)) if pairs else (float("nan"), float("nan"))


def metric_auc(df: DataFrame, label: str = "label", score: str = "score", written: list[str] | None = None) -> DataFrame:
    """Exact ROC AUC with tie mid-ranks.

    AUC = sum_s pos(s) * (neg(<s) + neg(s)/2) / (n_neg * n_pos) over distinct
    scores s. One scan counts labels per distinct score; ``neg(<s)`` is the running
    total over that table, whose sorted partitions no task exceeds. The table is written; its path is added to ``written``.
    """
    per_score = (df.select(F.col(score).cast("double").alias("s"), F.col(label).alias("_y"))
                   .groupBy("s")
                   .agg(F.count_if(F.col("_y") == 0).alias("neg"),
                        F.count_if(F.col("_y") == 1).alias("pos")))
    below = running_totals(per_score, "s", ["neg"], written=written)
    agg = below.agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("num"),
                    F.sum("neg").alias("n_neg"), F.sum("pos").alias("n_pos"))
    return agg.select(
        F.try_divide(F.col("num"), F.col("n_neg") * F.col("n_pos")).alias("auc"),
        F.col("n_neg").cast("long").alias("n_neg"), F.col("n_pos").cast("long").alias("n_pos"))


def false_positive_rows(df: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                        label: str = "label", score: str = "score") -> DataFrame:
    """All columns of rows with label 0 predicted 1."""
    return df.filter((F.col(label) == 0) & (F.col(score) >= F.lit(threshold)))
