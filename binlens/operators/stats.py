"""Exploratory statistics as tables (correlations, coverage, distributions).

Every statistic is a single scan with partial aggregation. Correlations use
central co-moments (``covar_pop``/``var_pop``, merged pairwise across
partitions, numerically stable) and ``try_divide`` so a constant column gives
NULL instead of an ANSI divide-by-zero. Quantiles are exact but never pull a
class or a value into one task: rows are counted per distinct value first, and ranks
are running totals of those counts (:func:`binlens.operators.ordering.running_totals`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordering import running_totals

# Feature groups of the exploratory report.
FAST_PREFIXES = ("gen_", "hdr_", "sec_", "datadir_")
GROUP_ORDER = ["gen_", "hdr_", "sec_", "imp_", "exp_", "datadir_", "str_", "byteH_", "byteEH_", "label"]
# np.linspace(0, 1, 11) edges, written out so edge ties match the reference
RATIO_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001,
               0.7000000000000001, 0.8, 0.9, 1.0]
CUTOFF_MB = 2.0
HIST_BINS = 80


def _num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _stack(pairs: list[tuple[str, str, Column]], names=("a", "b", "r")) -> list[Column]:
    """Unpivot a one-row frame into long form via ``stack`` (no join)."""
    args = ", ".join(f"'{a}', '{b}', `{v}`" for a, b, v in pairs)
    return [F.expr(f"stack({len(pairs)}, {args}) AS ({', '.join(names)})")]


def feature_cost_class(name: Column) -> Column:
    """'fast' (header/section/directory fields) or 'slow' (full-file scan) by name prefix."""
    return F.when(reduce(lambda a, b: a | b, [name.startswith(p) for p in FAST_PREFIXES]), "fast") \
            .otherwise("slow")


def feature_group(name: Column) -> Column:
    """Index of the first matching prefix of GROUP_ORDER, else 99."""
    expr = F.lit(99)
    for i, p in reversed(list(enumerate(GROUP_ORDER))):
        expr = F.when(name.startswith(p), F.lit(i)).otherwise(expr)
    return expr


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every ordered pair (a, b) of ``cols`` (missing -> 0 first): long (a, b, r).

    Each partition sends its row count, means and centred Gram matrix (one row per pair of
    columns, whatever its number of rows); these are merged per pair, so columns and rows
    both may be many. A constant column has zero variance -> r is NULL.
    """
    k = len(cols)
    x = df.select(F.array(*[_num(c) for c in cols]).alias("x"))

    def gram(frames):
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for f in frames:
            if not len(f):
                continue
            v = np.stack(f["x"].to_numpy())
            own = v[0] + (v - v[0]).mean(0)  # exact for a constant column
            dev = v - own
            shift = own - mean
            m2 += dev.T @ dev + np.outer(shift, shift) * (n * len(v) / (n + len(v)))
            mean = mean + shift * (len(v) / (n + len(v))) if n else own
            n += len(v)
        if n:
            i, j = np.triu_indices(k)
            yield pd.DataFrame({"i": i, "j": j, "n": n, "mi": mean[i], "mj": mean[j], "c": m2[i, j]})

    part = x.mapInPandas(gram, "i long, j long, n long, mi double, mj double, c double")
    # deviations of the partitions' means from one of them: nothing large cancels, and equal means give 0
    w, pair = F.col("n").cast("double"), Window.partitionBy("i", "j")  # as many rows as partitions
    part = part.withColumn("di", F.col("mi") - F.min("mi").over(pair)).withColumn("dj", F.col("mj") - F.min("mj").over(pair))
    m = part.groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum(w).alias("n"), F.sum(w * F.col("di")).alias("si"), F.sum(w * F.col("dj")).alias("sj"),
                                   F.sum(w * F.col("di") * F.col("dj")).alias("sij"))
    m = m.select("i", "j", (F.col("c") + F.col("sij") - F.col("si") * F.col("sj") / F.col("n")).alias("c"))
    var = m.filter(F.col("i") == F.col("j"))  # one row per column
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i long, name string")
    var = var.join(names, "i").select(F.col("i").alias("v"), F.col("c").alias("var"), "name")
    left = var.select(F.col("v").alias("i"), F.col("var").alias("vi"), F.col("name").alias("a"))
    right = var.select(F.col("v").alias("j"), F.col("var").alias("vj"), F.col("name").alias("b"))
    both = m.unionByName(m.filter(F.col("i") < F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    r = F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.try_divide(F.col("c"), F.sqrt(F.col("vi") * F.col("vj"))))
    return both.join(left, "i").join(right, "j").select("a", "b", r.alias("r"))


def target_correlation(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """r of each feature vs the label with its cost class, sorted by r desc (NULL last)."""
    x = df.select(_num(label).alias("_y"), *[_num(c).alias(f"c{i}") for i, c in enumerate(cols)])
    aggs = [F.var_pop("_y").alias("vy")]
    for i in range(len(cols)):
        aggs += [F.covar_pop(f"c{i}", "_y").alias(f"cy{i}"), F.var_pop(f"c{i}").alias(f"v{i}")]
    mom = x.agg(*aggs)
    rs = [F.try_divide(F.col(f"cy{i}"), F.sqrt(F.col(f"v{i}") * F.col("vy"))).alias(f"r{i}")
          for i in range(len(cols))]
    args = ", ".join(f"'{c}', `r{i}`" for i, c in enumerate(cols))
    long = mom.select(*rs).select(F.expr(f"stack({len(cols)}, {args}) AS (feature, r)"))
    return long.withColumn("cost", feature_cost_class(F.col("feature"))) \
               .orderBy(F.col("r").desc_nulls_last(), F.col("feature"))


def top_correlated(target: DataFrame, k: int = 15) -> DataFrame:
    """Top k by r (NULL last, as a descending sort keeps them) and bottom k (NULL dropped)."""
    wt = Window.orderBy(F.col("r").desc_nulls_last(), F.col("feature"))
    wb = Window.orderBy(F.col("r").asc(), F.col("feature"))
    # the input is one row per feature: bounded single-partition windows
    top = target.withColumn("rnk", F.row_number().over(wt)).filter(F.col("rnk") <= k) \
                .withColumn("side", F.lit("top"))
    bot = target.filter(F.col("r").isNotNull()).withColumn("rnk", F.row_number().over(wb)) \
                .filter(F.col("rnk") <= k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bot).select("side", "rnk", "feature", "r")


def rank_abs_correlation(target: DataFrame) -> DataFrame:
    """Features by |r| desc (NULL skipped) with their group index."""
    w = Window.orderBy(F.abs(F.col("r")).desc(), F.col("feature"))
    return (target.filter(F.col("r").isNotNull())
                  .withColumn("rnk", F.row_number().over(w))
                  .withColumn("grp", feature_group(F.col("feature")))
                  .select("rnk", "feature", "r", "grp"))


def group_order(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns ordered by group prefix: position, group, boundary flag, group midpoint,
    plus the non-zero count of each column (one aggregation over the data)."""
    nz = df.agg(*[F.count_if(_num(c) != 0).alias(f"n{i}") for i, c in enumerate(cols)])
    args = ", ".join(f"'{c}', {i}, `n{i}`" for i, c in enumerate(cols))
    long = nz.select(F.expr(f"stack({len(cols)}, {args}) AS (feature, src_pos, n_nonzero)"))
    g = long.withColumn("grp", feature_group(F.col("feature")))
    w = Window.orderBy("grp", "src_pos")  # one row per column: bounded
    g = g.withColumn("pos", F.row_number().over(w) - 1)
    g = g.withColumn("is_boundary", (F.coalesce(F.lag("grp").over(w), F.lit(-1)) != F.col("grp")).cast("int"))
    wg = Window.partitionBy("grp")
    g = g.withColumn("grp_mid", (F.min("pos").over(wg) + F.max("pos").over(wg) + 1) / 2.0)
    return g.select("feature", "grp", "pos", "is_boundary", "grp_mid",
                    F.col("n_nonzero").cast("long").alias("n_nonzero"))


def size_coverage(df: DataFrame, size_mb: str = "size_mb", label: str = "label",
                  cutoff_mb: float = CUTOFF_MB) -> DataFrame:
    """Rows at or under the cutoff, total and percent for all / malware / benign."""
    spark = df.sparkSession
    r = (df.rollup(label)
           .agg(F.count_if(F.col(size_mb) <= F.lit(cutoff_mb)).alias("n_under"),
                F.count(F.lit(1)).alias("n_total"),
                F.grouping_id().alias("_gid")))
    r = r.withColumn("scope", F.when(F.col("_gid") == 1, "all")
                                .when(F.col(label) == 1, "malware")
                                .when(F.col(label) == 0, "benign"))
    dim = spark.createDataFrame([("all",), ("malware",), ("benign",)], "scope string")
    out = dim.join(r.filter(F.col("scope").isNotNull()).select("scope", "n_under", "n_total"),
                   "scope", "left").na.fill(0, ["n_under", "n_total"])
    return out.withColumn("pct", F.coalesce(
        F.try_divide(F.col("n_under") * F.lit(100.0), F.col("n_total").cast("double")), F.lit(0.0)))


def cutoff_crosstab(df: DataFrame, size_mb: str = "size_mb", label: str = "label",
                    cutoff_mb: float = CUTOFF_MB) -> DataFrame:
    """Class counts at/under vs over the cutoff; absent cells are 0."""
    spark = df.sparkSession
    b = df.select(F.when(F.col(size_mb) <= F.lit(cutoff_mb), "under").otherwise("over").alias("side"),
                  F.col(label))
    p = b.groupBy("side").pivot(label, [0, 1]).count()
    dim = spark.createDataFrame([("under",), ("over",)], "side string")
    return (dim.join(p, "side", "left").na.fill(0, ["0", "1"])
               .select("side", F.col("0").cast("long").alias("n_benign"),
                       F.col("1").cast("long").alias("n_malware")))


def histogram_by_class(df: DataFrame, col: str, label: str = "label", bins: int = HIST_BINS) -> DataFrame:
    """Equal-width counts per class over the shared [min, max]; last bin right-closed.

    All bins x classes are returned (empty bins = 0).
    """
    spark = df.sparkSession
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()  # one row
    lo, hi = (mm["lo"], mm["hi"]) if mm["lo"] is not None else (0.0, 0.0)
    width = (hi - lo) / bins if hi > lo else 0.0
    v = F.col(col).cast("double")
    b = F.lit(0) if width == 0 else F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(label).alias("label"), b.cast("int").alias("bin")) \
               .agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(lab, i) for lab in (0, 1) for i in range(bins)], "label int, bin int")
    return (dim.join(counts, ["label", "bin"], "left").na.fill(0, ["n"])
               .withColumn("lo", F.lit(float(lo)) + F.col("bin") * F.lit(width))
               .withColumn("hi", F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(width))
               .select("label", "bin", "lo", "hi", F.col("n").cast("long").alias("n")))


def exact_quantiles(df: DataFrame, value: str, group: str, qs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group (pandas/numpy default), exact.

    Values are counted per (group, value), so a value that most rows have is one
    row of the ranked table; a quantile's neighbours are the values whose range of
    ranks holds them. One job writes the counted table.
    """
    counted = (df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
               .filter(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranked = running_totals(counted, "_v", ["_c"], partition_by=["_g"])
    sizes = ranked.groupBy(F.col("_g").alias("_tg")).agg(F.sum("_c").alias("_n"))  # from the written table, not from the input again
    qarr = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    pos = F.col("q") * (F.col("_n") - 1)
    targets = (sizes.select("_tg", "_n", F.explode(qarr).alias("_q")).select("_tg", "_n", "_q.qi", "_q.q")
                    .withColumn("frac", pos - F.floor(pos))
                    .withColumn("lo", F.floor(pos).cast("long"))
                    .withColumn("hi", F.ceil(pos).cast("long")))
    # a value holds the ranks [_c_before, _c_before + _c); all targets of its group are met in its row
    per_group = targets.groupBy("_tg").agg(F.collect_list(F.struct("qi", "q", "frac", "lo", "hi")).alias("_t"))  # len(qs) each
    holds = lambda r: (r >= F.col("_c_before")) & (r < F.col("_c_before") + F.col("_c"))
    hit = (ranked.join(per_group, F.col("_g").eqNullSafe(F.col("_tg")))
           .select("_g", "_v", "_c_before", "_c", F.explode("_t").alias("t"))
           .filter(holds(F.col("t.lo")) | holds(F.col("t.hi"))))
    res = hit.groupBy("_g", F.col("t.qi").alias("qi"), F.col("t.q").alias("q"), F.col("t.frac").alias("frac")).agg(
        F.max(F.when(holds(F.col("t.lo")), F.col("_v"))).alias("vlo"),
        F.max(F.when(holds(F.col("t.hi")), F.col("_v"))).alias("vhi"))
    return res.select(F.col("_g").alias(group), "q",
                      (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias("value"))


def _approximate(col: str, qs: list[float], accuracy: int) -> Column:
    return F.percentile_approx(F.col(col).cast("double"), F.array(*[F.lit(float(q)) for q in qs]), F.lit(accuracy))


def class_summary(df: DataFrame, col: str, label: str = "label", approx: int | None = None) -> DataFrame:
    """Per class: median, mean, sample std; plus median(malware) - median(benign).

    ``approx``: None gives the exact median (values are counted and ranked); a number takes a value whose rank is off by
    at most 1 / ``approx`` of the class, all in one scan with the moments.
    """
    if approx is not None:
        x = F.col(col).cast("double")
        out = df.groupBy(label).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(F.col(col)).alias("n"),
                                    F.get(_approximate(col, [0.5], approx), F.lit(0)).alias("median"))
        return _with_delta(out, label)
    med = exact_quantiles(df, col, label, [0.5]).select(label, F.col("value").alias("median"))
    mom = df.groupBy(label).agg(F.avg(F.col(col).cast("double")).alias("mean"),
                                F.stddev_samp(F.col(col).cast("double")).alias("std"),
                                F.count(F.col(col)).alias("n"))
    return _with_delta(mom.join(med, label, "left"), label)


def _with_delta(out: DataFrame, label: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0))  # one row per class: bounded
    d = (F.max(F.when(F.col(label) == 1, F.col("median"))).over(w)
         - F.max(F.when(F.col(label) == 0, F.col("median"))).over(w))
    return out.withColumn("delta_median", d).select(label, "n", "median", "mean", "std", "delta_median")


def class_quartiles(df: DataFrame, col: str, label: str = "label", approx: int | None = None) -> DataFrame:
    """Quartiles per class: exact and interpolated, or values of about those ranks (``approx`` as for ``class_summary``)."""
    if approx is not None:
        q = df.groupBy(label).agg(_approximate(col, [0.25, 0.5, 0.75], approx).alias("q"))
        return q.select(label, *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])
    q = exact_quantiles(df, col, label, [0.25, 0.5, 0.75])
    return q.groupBy(label).agg(*[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n)
                                  for v, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])


def discrete_distribution(df: DataFrame, col: str, label: str = "label", max_values: int = 1_000_000) -> DataFrame:
    """Share of each integer value 0..max+1 within each class (gaps are 0).

    One scan; the range comes from the counted table. Negative values count in a
    class's total but have no row. A largest value above ``max_values`` (a size in bytes, say) fails the job: the result
    would have a row for every number up to it.
    """
    v = F.floor(F.col(col).cast("double")).cast("long")
    counts = df.groupBy(F.col(label).alias("label"), v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "counts")
    totals = counts.groupBy("label").agg(F.sum("n").alias("tot"), F.max("value").alias("mx"))
    top = F.greatest(F.coalesce(F.max("mx").over(Window.partitionBy(F.lit(0))) + 1, F.lit(0)), F.lit(0))  # one row per class
    top = F.when(top > max_values, F.raise_error(F.concat(F.lit(f"more than {max_values} values: up to "), top.cast("string")))).otherwise(top)
    dim = (totals.withColumn("top", top.cast("long")).filter(F.col("label").isin(0, 1))
           .select("label", "tot", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("value")))
    return (dim.join(counts, ["label", "value"], "left").na.fill(0, ["n"])
               .select("label", "value",
                       F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("tot").cast("double")),
                                  F.lit(0.0)).alias("share")))


def ratio_profile(df: DataFrame, col: str, label: str = "label", edges=RATIO_EDGES) -> DataFrame:
    """Clip to [0,1], 10 buckets on literal edges (last right-closed), percent per class."""
    spark = df.sparkSession
    x = F.least(F.greatest(F.col(col).cast("double"), F.lit(0.0)), F.lit(1.0))
    inner = edges[1:-1]
    b = reduce(lambda a, c: a + c, [(x >= F.lit(e)).cast("int") for e in inner], F.lit(0))
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(label).alias("label"), b.alias("bucket")) \
               .agg(F.count(F.lit(1)).alias("n"))
    nb = len(edges) - 1
    dim = spark.createDataFrame([(l, i, edges[i], edges[i + 1]) for l in (0, 1) for i in range(nb)],
                                "label int, bucket int, lo double, hi double")
    w = Window.partitionBy("label")  # <= 2 x 10 rows
    out = dim.join(counts, ["label", "bucket"], "left").na.fill(0, ["n"])
    return out.withColumn("pct", F.coalesce(F.try_divide(F.col("n") * F.lit(100.0),
                                                         F.sum("n").over(w).cast("double")), F.lit(0.0))) \
              .select("label", "bucket", "lo", "hi", F.col("n").cast("long").alias("n"), "pct")


#: A value counts at grid points within so many bandwidths; beyond, its kernel is below exp(-32) of the peak.
KDE_REACH = 8.0


def kde_by_class(df: DataFrame, col: str, label: str = "label", grid: int = 200, bw: float | None = None, reach: float = KDE_REACH) -> DataFrame:
    """Gaussian KDE per class on ``grid`` points over the class range (Scott bandwidth, or ``bw``).

    Every row adds its kernel to the grid points within ``reach`` bandwidths: tasks sort the values of a batch and add,
    per grid point, the slice of values in reach to their own grid, so a row costs only the points near it and a task
    hands on at most classes x grid sums. What is left out is less than ``exp(-reach^2 / 2) / (h sqrt(2 pi))`` of
    density per point (h: the bandwidth). Nulls and NaN do not count; a class without spread has density 0.
    """
    v = F.col(col).cast("double")
    rows = df.select(F.col(label).alias("label"), v.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("label").isNotNull())
    per_class = rows.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"))
    stats = []  # one row per class
    for r in per_class.collect():
        h = float(bw) if bw else (r.sd or 0.0) * r.n ** -0.2
        stats.append((r.label, r.lo, r.hi, r.n, h if h > 0 else None))
    points = {k: (lo + (hi - lo) * np.arange(grid) / max(grid - 1, 1), h) for k, lo, hi, _, h in stats}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(grid) for k in points}
        for batch in batches:
            labels, x = batch["label"].to_numpy(zero_copy_only=False), batch["x"].to_numpy(zero_copy_only=False)
            for k, (at, h) in points.items():
                own = np.sort(x[labels == k]) if h else np.zeros(0)
                if not len(own):
                    continue
                begin, end = np.searchsorted(own, at - reach * h, "left"), np.searchsorted(own, at + reach * h, "right")
                for i in np.flatnonzero(end > begin):
                    z = (own[begin[i]:end[i]] - at[i]) / h
                    sums[k][i] += np.exp(-0.5 * z * z).sum()
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * grid, label_type), pa.array(np.arange(grid, dtype=np.int32)), pa.array(total)], names=["label", "gi", "mass"])

    kind = rows.schema["label"].dataType
    label_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind.simpleString()]
    mass = rows.mapInArrow(scatter, f"label {kind.simpleString()}, gi int, mass double").groupBy("label", "gi").agg(F.sum("mass").alias("mass"))
    dim = df.sparkSession.createDataFrame(stats, f"label {kind.simpleString()}, lo double, hi double, n long, h double")
    full = dim.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).join(mass, ["label", "gi"], "left")
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("gi") / F.lit(float(max(grid - 1, 1)))
    density = F.try_divide(F.col("mass"), F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return full.select("label", "gi", x.alias("x"), F.coalesce(density, F.lit(0.0)).alias("density"))
