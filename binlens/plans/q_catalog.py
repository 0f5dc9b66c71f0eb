"""Queries for 2.J sample selection over the catalogue fixture view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cg
from ..sources import view, with_views
from .registry import register

# family priority of the fixture catalogue (xx has no tag hit and falls back to signature)
FAMILIES = ["en", "fr", "xx", "de", "es"]
_FAM_SQL = ("fam", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(FAMILIES))
            + ") f(family, priority)")
_SEL_SQL = ("sel", """
SELECT family, priority, via, rank, doc_id, file_type, ok FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY doc_id) AS rank FROM (
    SELECT f.family, f.priority, 'tag' AS via, c.* FROM fam f JOIN v_catalog c ON c.tag = f.family
    UNION ALL
    SELECT f.family, f.priority, 'signature' AS via, c.* FROM fam f JOIN v_catalog c ON c.signature = f.family
    WHERE f.family NOT IN (SELECT DISTINCT c2.tag FROM v_catalog c2 WHERE c2.tag IS NOT NULL)) u) r
WHERE rank <= 1000""")


def _selected(spark, sf_dir):
    cat = view(spark, sf_dir, "v_catalog")
    return cg.lookup_with_fallback(cat, cg.families_frame(spark, FAMILIES))


@register("lookup_with_fallback", with_views(["v_catalog"], """
SELECT family, CAST(priority AS INTEGER) AS priority, via, CAST(rank AS INTEGER) AS rank, doc_id FROM sel""",
                                             [_FAM_SQL, _SEL_SQL]))
def q_lookup_with_fallback(spark, sf_dir):
    return _selected(spark, sf_dir).select("family", "priority", "via", F.col("rank").cast("int"), "doc_id")


@register("filter_file_type", with_views(["v_catalog"], """
SELECT doc_id, COALESCE(file_type, 'unknown') AS file_type FROM v_catalog
WHERE COALESCE(file_type, 'unknown') IN ('exe', 'dll')"""))
def q_filter_file_type(spark, sf_dir):
    c = cg.filter_file_type(view(spark, sf_dir, "v_catalog"))
    return c.select("doc_id", F.coalesce("file_type", F.lit("unknown")).alias("file_type"))


def _quota_sql(total: int) -> str:
    return with_views(["v_catalog"], f"""
SELECT family, doc_id, CAST(taken AS INTEGER) AS taken FROM (
  SELECT family, doc_id, ok AS taken,
         COALESCE(sum(ok) OVER (ORDER BY priority, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sel WHERE COALESCE(file_type, 'unknown') IN ('exe', 'dll')) t
WHERE before < {total}""", [_FAM_SQL, _SEL_SQL])


def _quota(spark, sf_dir, total):
    sel = cg.filter_file_type(_selected(spark, sf_dir))
    q = cg.quota_take(sel, total=total)
    return q.select("family", "doc_id", "taken")


@register("quota_take", _quota_sql(cg.TARGET_TOTAL))
def q_quota_take(spark, sf_dir):
    return _quota(spark, sf_dir, cg.TARGET_TOTAL)


@register("quota_take_binding", _quota_sql(100))
def q_quota_take_binding(spark, sf_dir):
    """Same operator with a quota that binds inside the second family."""
    return _quota(spark, sf_dir, 100)
