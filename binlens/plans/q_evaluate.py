"""Queries for 2.B filters and 2.H evaluation over the scored fixture view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as ds
from ..operators import evaluate as ev
from ..operators import project as pj
from ..sources import view, with_views
from .registry import register, round_doubles

_LABELLED = "SELECT * FROM v_scored WHERE label IN (0, 1)"


def _scored(spark, sf_dir):
    return pj.filter_labelled(view(spark, sf_dir, "v_scored"))


def _grid_sql(grid) -> str:
    return "SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES " + \
        ", ".join(f"({t})" for t in grid) + ") g(t)"


def _sweep_body() -> str:
    return """
SELECT threshold, tn, fp, fn, tp,
       round(CASE WHEN tp+tn+fp+fn = 0 THEN 0 ELSE (tp+tn)/(tp+tn+fp+fn) END, 6) AS accuracy,
       round(CASE WHEN tp+fn = 0 THEN 0 ELSE tp/(tp+fn) END, 6) AS recall,
       round(CASE WHEN fp+tn = 0 THEN 0 ELSE fp/(fp+tn) END, 6) AS fpr,
       round(CASE WHEN fn+tp = 0 THEN 0 ELSE fn/(fn+tp) END, 6) AS fnr
FROM (SELECT g.threshold,
             CAST(SUM(CASE WHEN s.label = 0 AND s.score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(SUM(CASE WHEN s.label = 0 AND s.score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(SUM(CASE WHEN s.label = 1 AND s.score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(SUM(CASE WHEN s.label = 1 AND s.score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp
      FROM grid g, s GROUP BY g.threshold) c"""


def _sweep_sql(grid) -> str:
    return with_views(["v_scored"], _sweep_body(), [("s", _LABELLED), ("grid", _grid_sql(grid))])


@register("filter_labelled", with_views(["v_scored"],
          "SELECT doc_id, label, round(score, 6) AS score FROM v_scored WHERE label IN (0, 1)"))
def q_filter_labelled(spark, sf_dir):
    return round_doubles(_scored(spark, sf_dir).select("doc_id", "label", "score"))


@register("validate_binary_label", with_views(["v_label_text"], """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE v IS NULL OR NOT isfinite(v)) AS BIGINT) AS n_non_numeric,
       CAST(count(*) FILTER (WHERE CASE WHEN v IS NULL OR NOT isfinite(v) THEN -1 ELSE trunc(v) END NOT IN (0, 1)) AS BIGINT) AS n_not_binary
FROM (SELECT TRY_CAST(raw AS DOUBLE) AS v FROM v_label_text)"""))
def q_validate_binary_label(spark, sf_dir):
    return pj.validate_binary_label(view(spark, sf_dir, "v_label_text"), "raw")


@register("map_values", with_views(["v_scored"], """
SELECT doc_id, label, CASE label WHEN 1 THEN 'Malware' WHEN 0 THEN 'Benign' END AS label_name
FROM v_scored"""))
def q_map_values(spark, sf_dir):
    df = view(spark, sf_dir, "v_scored")
    return df.select("doc_id", "label", pj.map_values("label").alias("label_name"))


@register("classify", with_views(["v_scored"], """
SELECT doc_id, label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred
FROM v_scored WHERE label IN (0, 1)"""))
def q_classify(spark, sf_dir):
    return ev.classify(_scored(spark, sf_dir), 0.5).select("doc_id", "label", "pred")


_CONF_SQL = """
SELECT CAST(count(*) FILTER (WHERE label = 0 AND score < 0.5) AS BIGINT) AS tn,
       CAST(count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE label = 1 AND score < 0.5) AS BIGINT) AS fn,
       CAST(count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS BIGINT) AS tp
FROM v_scored WHERE label IN (0, 1)"""


@register("confusion_matrix", with_views(["v_scored"], _CONF_SQL))
def q_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_scored(spark, sf_dir), 0.5)


_RATES_SEL = """
       round(CASE WHEN tp+tn+fp+fn = 0 THEN 0 ELSE (tp+tn)/(tp+tn+fp+fn) END, 6) AS accuracy,
       round(CASE WHEN tp+fn = 0 THEN 0 ELSE tp/(tp+fn) END, 6) AS recall,
       round(CASE WHEN fp+tn = 0 THEN 0 ELSE fp/(fp+tn) END, 6) AS fpr,
       round(CASE WHEN fn+tp = 0 THEN 0 ELSE fn/(fn+tp) END, 6) AS fnr"""


@register("rates", with_views(["v_scored"], f"SELECT tn, fp, fn, tp, {_RATES_SEL} FROM c",
                              [("c", _CONF_SQL)]))
def q_rates(spark, sf_dir):
    return round_doubles(ev.rates(_scored(spark, sf_dir), 0.5))


@register("eval_summary", with_views(["v_scored"], f"""
SELECT n_rows, actual_0, actual_1, pred_0, pred_1, tn, fp, fn, tp, {_RATES_SEL},
       CAST(0.5 AS DOUBLE) AS threshold FROM c""", [("c", """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS actual_0,
       CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS actual_1,
       CAST(count(*) FILTER (WHERE score < 0.5) AS BIGINT) AS pred_0,
       CAST(count(*) FILTER (WHERE score >= 0.5) AS BIGINT) AS pred_1,
       CAST(count(*) FILTER (WHERE label = 0 AND score < 0.5) AS BIGINT) AS tn,
       CAST(count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE label = 1 AND score < 0.5) AS BIGINT) AS fn,
       CAST(count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS BIGINT) AS tp
FROM v_scored WHERE label IN (0, 1)""")]))
def q_eval_summary(spark, sf_dir):
    return round_doubles(ev.eval_summary(_scored(spark, sf_dir), 0.5))


@register("threshold_sweep", _sweep_sql(ev.GRID_TRAIN))
def q_threshold_sweep(spark, sf_dir):
    return round_doubles(ev.threshold_sweep(_scored(spark, sf_dir), ev.GRID_TRAIN))


@register("threshold_sweep_eval", _sweep_sql(ev.GRID_EVAL))
def q_threshold_sweep_eval(spark, sf_dir):
    return round_doubles(ev.threshold_sweep(_scored(spark, sf_dir), ev.GRID_EVAL))


@register("pick_threshold", with_views(["v_scored"], """
SELECT * FROM sweep WHERE fpr <= 0.1 ORDER BY recall DESC, threshold DESC LIMIT 1""",
          [("s", _LABELLED), ("grid", _grid_sql(ev.GRID_TRAIN)), ("sweep", _sweep_body())]))
def q_pick_threshold(spark, sf_dir):
    sweep = ev.threshold_sweep(_scored(spark, sf_dir), ev.GRID_TRAIN)
    return round_doubles(ev.pick_threshold(sweep, ev.TARGET_FPR))


@register("metric_auc", with_views(["v_scored"], """
SELECT round((SUM(CASE WHEN label = 1 THEN rnk END) - n1 * (n1 + 1) / 2.0) / (n0 * n1), 6) AS auc,
       CAST(n0 AS BIGINT) AS n_neg, CAST(n1 AS BIGINT) AS n_pos
FROM (SELECT label,
             rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk,
             count(*) FILTER (WHERE label = 0) OVER () AS n0,
             count(*) FILTER (WHERE label = 1) OVER () AS n1
      FROM v_scored WHERE label IN (0, 1)) r
GROUP BY n0, n1"""))
def q_metric_auc(spark, sf_dir):
    return round_doubles(ev.metric_auc(_scored(spark, sf_dir)))


@register("metric_logloss", with_views(["v_scored"], """
SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS logloss, CAST(count(*) AS BIGINT) AS n
FROM (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM v_scored WHERE label IN (0, 1)) t"""))
def q_metric_logloss(spark, sf_dir):
    return round_doubles(ev.metric_logloss(_scored(spark, sf_dir)))


@register("false_positive_rows", with_views(["v_scored"], """
SELECT doc_id, label, toxic, round(score, 6) AS score FROM v_scored
WHERE label = 0 AND score >= 0.5"""))
def q_false_positive_rows(spark, sf_dir):
    return round_doubles(ev.false_positive_rows(_scored(spark, sf_dir), 0.5))


@register("class_balance", with_views(["v_scored"], """
SELECT label, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share
FROM (SELECT COALESCE(c.label, d.label) AS label, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
      FROM (SELECT label, count(*) AS n FROM v_scored GROUP BY label) c
      FULL JOIN (VALUES (0), (1)) d(label) ON c.label = d.label) t"""))
def q_class_balance(spark, sf_dir):
    return round_doubles(ds.class_balance(view(spark, sf_dir, "v_scored")).select(
        F.col("label").cast("int").alias("label"), F.col("n").cast("long").alias("n"), "share"))
