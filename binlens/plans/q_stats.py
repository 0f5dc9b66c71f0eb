"""Queries for 2.I exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project as pj
from ..operators import stats as st
from ..sources import view, with_views
from .registry import register, round_doubles

NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant_col", "label"]
FEATS = NUM_COLS[:-1]


def _corr_sql(a: str, b: str) -> str:
    return (f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN var_pop({a}) = 0 OR var_pop({b}) = 0 THEN NULL "
            f"ELSE round(covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})), 6) END AS r FROM v_num")


_TARGET_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN var_pop({c}) = 0 THEN NULL "
    f"ELSE round(corr({c}, label), 6) END AS r, 'slow' AS cost FROM v_num" for c in FEATS)


@register("correlation_matrix", with_views(["v_num"], "\nUNION ALL\n".join(
    _corr_sql(a, b) for a in NUM_COLS for b in NUM_COLS)))
def q_correlation_matrix(spark, sf_dir):
    return round_doubles(st.correlation_matrix(view(spark, sf_dir, "v_num"), NUM_COLS))


@register("target_correlation", with_views(["v_num"], "SELECT * FROM t", [("t", _TARGET_SQL)]))
def q_target_correlation(spark, sf_dir):
    return round_doubles(st.target_correlation(view(spark, sf_dir, "v_num"), FEATS))


@register("top_correlated", with_views(["v_num"], """
SELECT 'top' AS side, CAST(row_number() OVER (ORDER BY r DESC NULLS LAST, feature) AS INTEGER) AS rnk, feature, r
FROM t QUALIFY rnk <= 15
UNION ALL
SELECT 'bottom', CAST(row_number() OVER (ORDER BY r, feature) AS INTEGER), feature, r
FROM t WHERE r IS NOT NULL QUALIFY row_number() OVER (ORDER BY r, feature) <= 15""",
                                       [("t", _TARGET_SQL)]))
def q_top_correlated(spark, sf_dir):
    t = st.target_correlation(view(spark, sf_dir, "v_num"), FEATS)
    return round_doubles(st.top_correlated(t, 15))


@register("rank_abs_correlation", with_views(["v_num"], """
SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS rnk, feature, r, 99 AS grp
FROM t WHERE r IS NOT NULL""", [("t", _TARGET_SQL)]))
def q_rank_abs_correlation(spark, sf_dir):
    t = st.target_correlation(view(spark, sf_dir, "v_num"), FEATS)
    return round_doubles(st.rank_abs_correlation(t))


_SIZED = """
SELECT b.doc_id, b.size / 1048576.0 AS size_mb, s.label
FROM v_bytes b JOIN v_scored s ON b.doc_id = s.doc_id WHERE s.label IN (0, 1)"""


def _sized(spark, sf_dir):
    b = pj.derive_size_mb(view(spark, sf_dir, "v_bytes").select("doc_id", "size"))
    s = pj.filter_labelled(view(spark, sf_dir, "v_scored")).select("doc_id", "label")
    return b.join(s, "doc_id")


_KIB = 1.0 / 1024.0


@register("size_coverage", with_views(["v_bytes", "v_scored"], f"""
SELECT scope, n_under, n_total,
       round(CASE WHEN n_total = 0 THEN 0 ELSE n_under * 100.0 / n_total END, 6) AS pct FROM (
  SELECT 'all' AS scope, CAST(count(*) FILTER (WHERE size_mb <= {_KIB!r}) AS BIGINT) AS n_under,
         CAST(count(*) AS BIGINT) AS n_total FROM sz
  UNION ALL SELECT 'malware', CAST(count(*) FILTER (WHERE size_mb <= {_KIB!r}) AS BIGINT),
         CAST(count(*) AS BIGINT) FROM sz WHERE label = 1
  UNION ALL SELECT 'benign', CAST(count(*) FILTER (WHERE size_mb <= {_KIB!r}) AS BIGINT),
         CAST(count(*) AS BIGINT) FROM sz WHERE label = 0) t""", [("sz", _SIZED)]))
def q_size_coverage(spark, sf_dir):
    return round_doubles(st.size_coverage(_sized(spark, sf_dir), cutoff_mb=_KIB))


@register("cutoff_crosstab", with_views(["v_bytes", "v_scored"], f"""
SELECT side, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS n_benign,
       CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_malware
FROM (SELECT CASE WHEN size_mb <= {_KIB!r} THEN 'under' ELSE 'over' END AS side, label FROM sz) t
GROUP BY side""", [("sz", _SIZED)]))
def q_cutoff_crosstab(spark, sf_dir):
    return st.cutoff_crosstab(_sized(spark, sf_dir), cutoff_mb=_KIB)


@register("histogram_by_class", with_views(["v_bytes", "v_scored"], """
SELECT d.label, d.bin, round(m.lo + d.bin * (m.hi - m.lo) / 80, 6) AS lo,
       round(m.lo + (d.bin + 1) * (m.hi - m.lo) / 80, 6) AS hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM (SELECT l.label, CAST(b.bin AS INTEGER) AS bin FROM (VALUES (0), (1)) l(label), range(80) b(bin)) d
CROSS JOIN (SELECT min(size_mb) AS lo, max(size_mb) AS hi FROM sz WHERE size_mb <= 10) m
LEFT JOIN (SELECT label, CAST(least(floor((size_mb - m2.lo) / (m2.hi - m2.lo) * 80), 79) AS INTEGER) AS bin,
                  count(*) AS n
           FROM sz, (SELECT min(size_mb) AS lo, max(size_mb) AS hi FROM sz WHERE size_mb <= 10) m2
           WHERE size_mb <= 10 GROUP BY ALL) c ON c.label = d.label AND c.bin = d.bin""",
                                           [("sz", _SIZED)]))
def q_histogram_by_class(spark, sf_dir):
    df = pj.filter_cap(_sized(spark, sf_dir), "size_mb", 10.0)
    return round_doubles(st.histogram_by_class(df, "size_mb", bins=80))


@register("class_summary", with_views(["v_num"], """
SELECT label, CAST(count(l_quantity) AS BIGINT) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS median,
       round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
       round(max(quantile_cont(l_quantity, 0.5)) FILTER (WHERE label = 1) OVER ()
             - max(quantile_cont(l_quantity, 0.5)) FILTER (WHERE label = 0) OVER (), 6) AS delta_median
FROM v_num GROUP BY label"""))
def q_class_summary(spark, sf_dir):
    return round_doubles(st.class_summary(view(spark, sf_dir, "v_num"), "l_quantity"))


@register("class_quartiles", with_views(["v_num"], """
SELECT label, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q2,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS q3
FROM v_num GROUP BY label"""))
def q_class_quartiles(spark, sf_dir):
    return round_doubles(st.class_quartiles(view(spark, sf_dir, "v_num"), "l_extendedprice"))


@register("discrete_distribution", with_views(["v_num"], """
SELECT d.label, d.value, round(CASE WHEN t.tot IS NULL OR t.tot = 0 THEN 0
                                    ELSE COALESCE(c.n, 0) * 1.0 / t.tot END, 6) AS share
FROM (SELECT l.label, v.value FROM (VALUES (0), (1)) l(label),
             range(0, (SELECT CAST(max(floor(l_quantity)) AS BIGINT) + 2 FROM v_num)) v(value)) d
JOIN (SELECT label, count(*) AS tot FROM v_num GROUP BY label) t ON t.label = d.label
LEFT JOIN (SELECT label, CAST(floor(l_quantity) AS BIGINT) AS value, count(*) AS n
           FROM v_num GROUP BY ALL) c ON c.label = d.label AND c.value = d.value"""))
def q_discrete_distribution(spark, sf_dir):
    return round_doubles(st.discrete_distribution(view(spark, sf_dir, "v_num"), "l_quantity"))


def _edges_case(x: str) -> str:
    inner = st.RATIO_EDGES[1:-1]
    return " + ".join(f"CASE WHEN {x} >= {e!r} THEN 1 ELSE 0 END" for e in inner)


@register("ratio_profile", with_views(["v_num"], f"""
SELECT d.label, d.bucket, d.lo, d.hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
       round(CASE WHEN sum(COALESCE(c.n, 0)) OVER (PARTITION BY d.label) = 0 THEN 0
                  ELSE COALESCE(c.n, 0) * 100.0 / sum(COALESCE(c.n, 0)) OVER (PARTITION BY d.label) END, 6) AS pct
FROM (SELECT l.label, CAST(b.i AS INTEGER) AS bucket, e.lo, e.hi
      FROM (VALUES (0), (1)) l(label), range(10) b(i),
           (SELECT unnest(range(10)) AS i, unnest([{', '.join(repr(e) for e in st.RATIO_EDGES[:-1])}]::DOUBLE[]) AS lo,
                   unnest([{', '.join(repr(e) for e in st.RATIO_EDGES[1:])}]::DOUBLE[]) AS hi) e
      WHERE e.i = b.i) d
LEFT JOIN (SELECT label, {_edges_case('least(greatest(l_discount * 10, 0.0), 1.0)')} AS bucket, count(*) AS n
           FROM v_num GROUP BY ALL) c ON c.label = d.label AND c.bucket = d.bucket"""))
def q_ratio_profile(spark, sf_dir):
    df = view(spark, sf_dir, "v_num").withColumn("exec_ratio", F.col("l_discount") * 10)
    return round_doubles(st.ratio_profile(df, "exec_ratio"))


@register("kde_by_class", with_views(["v_num"], """
SELECT s.label, CAST(g.gi AS INTEGER) AS gi, round(s.lo + (s.hi - s.lo) * g.gi / 199.0, 6) AS x,
       round(COALESCE(sum(exp(-power(((s.lo + (s.hi - s.lo) * g.gi / 199.0) - v.l_extendedprice) / s.h, 2) / 2))
                      / (s.n * s.h * sqrt(2 * pi())), 0) * 1000, 6) AS density
FROM st s, range(200) g(gi), v_num v
WHERE v.label = s.label
GROUP BY s.label, g.gi, s.lo, s.hi, s.n, s.h""", [
    ("st", """SELECT label, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n,
                     stddev_samp(l_extendedprice) * power(count(*), -0.2) AS h
              FROM v_num GROUP BY label""")]))
def q_kde_by_class(spark, sf_dir):
    """Density of prices, in thousandths, against the sum over all rows and grid points."""
    kde = st.kde_by_class(view(spark, sf_dir, "v_num"), "l_extendedprice")
    return round_doubles(kde.withColumn("density", F.col("density") * 1000))


_GROUP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant_col", "label"]


_GROUP_SQL = with_views(["v_num"], f"""
SELECT o.feature, o.grp, CAST(o.pos AS INTEGER) AS pos,
       CASE WHEN COALESCE(lag(o.grp) OVER (ORDER BY o.grp, o.src_pos), -1) <> o.grp THEN 1 ELSE 0 END AS is_boundary,
       (min(o.pos) OVER (PARTITION BY o.grp) + max(o.pos) OVER (PARTITION BY o.grp) + 1) / 2.0 AS grp_mid,
       nz.n_nonzero
FROM (SELECT feature, src_pos, grp, row_number() OVER (ORDER BY grp, src_pos) - 1 AS pos
      FROM (SELECT feature, src_pos, GRPCASE AS grp
            FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(_GROUP_COLS))}) c(feature, src_pos)) g) o
JOIN ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE COALESCE(CAST({c} AS DOUBLE), 0) <> 0) AS BIGINT) AS n_nonzero "
    f"FROM v_num" for c in _GROUP_COLS)}) nz ON nz.feature = o.feature""").replace("GRPCASE", "CASE WHEN starts_with(feature, 'gen_') THEN 0 WHEN starts_with(feature, 'hdr_') THEN 1 WHEN starts_with(feature, 'sec_') THEN 2 WHEN starts_with(feature, 'imp_') THEN 3 WHEN starts_with(feature, 'exp_') THEN 4 WHEN starts_with(feature, 'datadir_') THEN 5 WHEN starts_with(feature, 'str_') THEN 6 WHEN starts_with(feature, 'byteH_') THEN 7 WHEN starts_with(feature, 'byteEH_') THEN 8 WHEN starts_with(feature, 'label') THEN 9 ELSE 99 END")


@register("group_order", _GROUP_SQL)
def q_group_order(spark, sf_dir):
    g = st.group_order(view(spark, sf_dir, "v_num"), _GROUP_COLS)
    return g.select("feature", "grp", F.col("pos").cast("int").alias("pos"), "is_boundary", "grp_mid", "n_nonzero")
