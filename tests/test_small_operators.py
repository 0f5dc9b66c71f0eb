"""Approximate options, bounds and one-pass selections against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binlens.operators import catalog as cg
from binlens.operators import dataset as ds
from binlens.operators import stats as st


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, rng.gauss(10 * (i % 2), 3)) for i in range(4000)] + [(5000, 0, None), (5001, None, 4.0), (5002, 1, float("nan"))]
    return spark.createDataFrame(rows, "id int, label int, x double").repartition(4).cache(), rows


@pytest.mark.parametrize("reach", [8.0, 2.0])
def test_density_is_the_sum_over_all_rows_within_its_bound(values, reach):
    df, rows = values
    got = {(r.label, r.gi): r for r in st.kde_by_class(df, "x", grid=50, reach=reach).collect()}
    assert len(got) == 100
    for k in (0, 1):
        x = np.array([v for _, lab, v in rows if lab == k and v is not None and not math.isnan(v)])
        h = x.std(ddof=1) * len(x) ** -0.2
        bound = math.exp(-reach ** 2 / 2) / (h * math.sqrt(2 * math.pi))
        for gi, at in enumerate(np.linspace(x.min(), x.max(), 50)):
            want = np.exp(-(((x - at) / h) ** 2) / 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
            assert abs(got[k, gi].x - at) < 1e-9 and -1e-12 <= want - got[k, gi].density <= bound + 1e-12


def test_density_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(0, 1.0)] * 3 + [(1, 2.0)], "label int, x double")
    assert {r.density for r in st.kde_by_class(df, "x", grid=4).collect()} == {0.0}
    assert st.kde_by_class(df.limit(0), "x", grid=4).collect() == []
    assert max(r.density for r in st.kde_by_class(df, "x", grid=4, bw=0.5).collect()) > 0.7


def test_approximate_quantiles_are_near_in_rank(values):
    df, rows = values
    df = df.where("label is not null and not isnan(x)")
    exact = {r.label: r for r in st.class_quartiles(df, "x").collect()}
    for accuracy in (100, 10_000):
        about = {r.label: r for r in st.class_quartiles(df, "x", approx=accuracy).collect()}
        summary = {r.label: r for r in st.class_summary(df, "x", approx=accuracy).collect()}
        for k in (0, 1):
            x = sorted(v for _, lab, v in rows if lab == k and v is not None and not math.isnan(v))
            for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")):
                rank = np.searchsorted(x, about[k][name])
                assert abs(rank / len(x) - q) <= 1 / accuracy + 2 / len(x)
            assert summary[k]["median"] == about[k].q2 and abs(summary[k]["mean"] - np.mean(x)) < 1e-9
    assert abs(exact[0].q2 - about[0].q2) < 0.1


def test_discrete_values_have_a_bound(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 5.0)], "label int, x double")
    assert st.discrete_distribution(df, "x", max_values=6).count() == 14
    with pytest.raises(Exception, match="more than 5 values"):
        st.discrete_distribution(df, "x", max_values=5).collect()


def test_threshold_split_needs_no_shuffle_and_is_near_the_share(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    s = ds.stratified_split(df, "id", frac=0.15, approx=True)
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
    shares = {r.label: r.s for r in s.groupBy("label").agg(F.avg((F.col("split") == "val").cast("int")).alias("s")).collect()}
    assert all(abs(v - 0.15) < 0.015 for v in shares.values())
    again = ds.stratified_split(df.repartition(7), "id", frac=0.15, approx=True)
    assert s.exceptAll(again).isEmpty()


def slow_selection(rows, families, k):
    out = []
    for p, f in enumerate(families):
        tagged = sorted(i for i, tag, _, _ in rows if tag == f)
        via, ids = ("tag", tagged) if tagged else ("signature", sorted(i for i, _, sig, _ in rows if sig == f))
        out += [(f, p, via, r + 1, i) for r, i in enumerate(ids[:k])]
    return sorted(out)


def test_lookup_reads_the_catalogue_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["a", "c", "d", None]), rng.randint(0, 1)) for i in range(500)]
    cat = spark.createDataFrame(rows, "doc_id int, tag string, signature string, ok int")
    families = ["d", "a", "nosuch", "b", "c"]
    sel = cg.lookup_with_fallback(cat, cg.families_frame(spark, families), per_limit=30)
    assert sorted((r.family, r.priority, r.via, r["rank"], r.doc_id) for r in sel.collect()) == slow_selection(rows, families, 30)
    plan = cg.lookup_with_fallback(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("lang").alias("tag"), F.col("source").alias("signature")),
                                   cg.families_frame(spark, families))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 or plan.count("Scan parquet") == 1


@pytest.mark.parametrize("block,total", [(4096, 40), (7, 40), (1, 3), (7, 0), (7, 10_000)])
def test_quota_in_blocks_of_ranks(spark, monkeypatch, block, total):
    monkeypatch.setattr(cg, "RANKS_PER_BLOCK", block)
    rng = random.Random(4)
    rows = [(p, r + 1, rng.choice([0, 1, None])) for p in range(4) for r in range(rng.randint(0, 60))]
    df = spark.createDataFrame(rows, "priority int, `rank` int, ok int")
    got = sorted((r.priority, r["rank"], r.taken) for r in cg.quota_take(df, total=total).collect())
    want, taken = [], 0
    for p, r, ok in sorted(rows, key=lambda x: x[:2]):
        if taken < total:
            want.append((p, r, ok or 0))
            taken += ok or 0
    assert got == want
