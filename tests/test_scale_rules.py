"""Results that must hold beyond the size of a fixture: ranks, splits, hot values, readers, booster state."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binlens.functions.bytestats import entropy_of_counts, moments
from binlens.operators import boost as bo
from binlens.operators import dataset as ds
from binlens.operators import evaluate as ev
from binlens.operators import project as pj
from binlens.operators import stats as st
from binlens.session import materialise
from binlens.sources import io


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(200_000, numPartitions=8).select(
        F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"),
        F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload"))


def test_shuffle_numbers_every_row_once(many):
    out = materialise(ds.seeded_shuffle(many, "key"), "t")
    got = out.agg(F.count("*"), F.countDistinct("ordinal"), F.min("ordinal"), F.max("ordinal"), F.countDistinct("payload")).first()
    assert tuple(got) == (200_000, 200_000, 1, 200_000, 200_000)


def test_splits_written_apart_hold_every_row(many):
    split = ds.stratified_split(many, "key", frac=0.15)
    parts = {s: materialise(split.filter(F.col("split") == s), "t") for s in ("train", "val")}
    assert {(r.label, r["count"]) for r in parts["val"].groupBy("label").count().collect()} == {(0, 15_000), (1, 15_000)}
    both = parts["train"].unionByName(parts["val"])
    assert both.count() == 200_000 and both.select("key").distinct().count() == 200_000
    nested = ds.nested_split(many.repartition(3), "key").groupBy("label", "split").count().collect()
    assert {(r.label, r.split, r["count"]) for r in nested} == {(c, s, n) for c in (0, 1) for s, n in (("vault", 20_000), ("val", 16_000), ("train", 64_000))}


def test_null_class_is_kept(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "key long, label int")
    assert ds.stratified_split(df, "key").count() == 40


def test_quantiles_where_most_values_agree(spark):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(20_000) < 0.9, 0.0, rng.normal(size=20_000))
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "v double, label int").repartition(7)
    got = {r.label: (r.q1, r.q2, r.q3) for r in st.class_quartiles(df, "v").collect()}
    tails = {(r.label, r.q): r.value for r in st.exact_quantiles(df, "v", "label", [0.01, 0.99, 0.0, 1.0]).collect()}
    for c in (0, 1):
        own = values[np.arange(20_000) % 2 == c]
        assert got[c] == pytest.approx(tuple(np.quantile(own, [0.25, 0.5, 0.75])))
        for q in (0.01, 0.99, 0.0, 1.0):
            assert tails[c, q] == pytest.approx(np.quantile(own, q))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    s = np.where(rng.random(3000) < 0.6, 0.5, np.round(rng.random(3000), 2))
    y = (rng.random(3000) < 0.3 + 0.4 * s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert ev.metric_auc(df).first().auc == pytest.approx(want)


@pytest.mark.parametrize("counts", [[5.0], [3.0, 0.0, 1.0, 7.0], [2.0] * 256, [0.0, 0.0], [1e9, 1e9 + 1, 1e9 + 2]])
def test_one_pass_statistics(spark, counts):
    r = spark.createDataFrame([(counts,)], "c array<double>").select(moments(F.col("c")).alias("m"), entropy_of_counts(F.col("c")).alias("e")).first()
    x = np.array(counts)
    assert r.m.n == len(x) and r.m.mean == pytest.approx(x.mean())
    assert r.m.m2 == pytest.approx(((x - x.mean()) ** 2).sum(), abs=1e-9) and r.m.m3 == pytest.approx(((x - x.mean()) ** 3).sum(), abs=1e-6)
    p = x[x > 0] / max(x.sum(), 1)
    assert r.e == pytest.approx(-(p * np.log2(p)).sum() if len(p) else 0.0, abs=1e-9)


def test_labels_are_truncated_and_nan_is_no_number(spark):
    df = spark.createDataFrame([(x,) for x in ("NaN", "-0.5", "1.7", "Infinity", "x", None, "2", "0")], "raw string")
    assert [r[0] for r in df.select(pj.binary_label("raw")).collect()] == [-1, 0, 1, -1, -1, -1, 2, 0]
    assert tuple(pj.validate_binary_label(df, "raw").first()) == (8, 4, 5)
    with pytest.raises(ValueError):
        pj.assert_binary_label(df, "raw")


def test_readers_reject_loudly(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": oops\n')
    with pytest.raises(Exception):
        io.scan_jsonl(spark, str(tmp_path / "*.jsonl"), "x int").collect()
    rows = io.scan_jsonl(spark, str(tmp_path / "*.jsonl"), "x int, _corrupt_record string", mode="PERMISSIVE").collect()
    assert sum(r._corrupt_record is not None for r in rows) == 1
    (tmp_path / "p1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "p2.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception):
        io.scan_csv(spark, str(tmp_path / "p*.csv"), "a int, b int").collect()
    assert [tuple(r) for r in io.scan_csv(spark, str(tmp_path / "p2.csv"), "a int, b int, c int").collect()] == [(4, 3, None)]


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 2] + 0.3 * rng.normal(size=600) > 0).astype(int)
    return spark.createDataFrame([(i, int(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, y))], "file_id long, label int, a double, b double, c double")


SMALL = dict(max_depth=2, max_leaves=4, min_data_in_leaf=5, max_bins=16, checkpoint_interval=2, monotone={}, feature_fraction=1.0)


def test_fine_tuning_without_a_column(toy):
    base = bo.boost_monotone(toy, ["a", "b", "c"], params=bo.BoostParams(**{**SMALL, "n_rounds": 2}))
    tuned = bo.fine_tune(toy.drop("a"), base, n_rounds=2, max_depth=2, checkpoint_interval=1)
    assert tuned.features == ["a", "b", "c"] and len(tuned.trees) == 4 and tuned.edges == base.edges
    assert all(n["feature"] != 0 for t in tuned.trees[2:] for n in t)
    missing = {r.file_id: r.score for r in bo.score(toy.drop("a"), tuned).collect()}
    nulled = {r.file_id: r.score for r in bo.score(toy.withColumn("a", F.lit(None).cast("double")), tuned).collect()}
    assert missing == nulled


def test_training_leaves_nothing_cached_and_tracks_auc(spark, toy):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = bo.boost_monotone(toy.filter("file_id % 4 <> 0"), ["a", "b", "c"], params=bo.BoostParams(**{**SMALL, "n_rounds": 5, "early_stopping_rounds": 2}),
                              valid=toy.filter("file_id % 4 = 0"))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert all(0.5 < h["valid_auc"] <= 1 and math.isfinite(h["valid_logloss"]) for h in model.history)
    assert len(model.trees) == model.best_iteration


def test_stopping_by_the_first_metric_to_stall():
    best = {"auc": (float("-inf"), 0), "logloss": (float("-inf"), 0)}
    seen = []
    for rnd, (auc, loss) in enumerate([(0.6, 0.7), (0.8, 0.6), (0.7, 0.5), (0.75, 0.4), (0.7, 0.3)], 1):
        best, keep, stop = bo.stopping_step(best, {"round": rnd, "valid_auc": auc, "valid_logloss": loss}, 2)
        seen.append((keep, stop))
    assert seen[:4] == [(1, False), (2, False), (2, False), (2, True)]


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 40)) @ rng.normal(size=(40, 40)) + 1.7e9
    x[:, 5] = 0.1
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(40)]).repartition(6)
    got = {(r.a, r.b): r.r for r in st.correlation_matrix(df, df.columns).collect()}
    with np.errstate(all="ignore"):
        want = np.corrcoef(x, rowvar=False)
    assert len(got) == 1600
    for (a, b), r in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert (r is None) if 5 in (i, j) else r == pytest.approx(want[i, j], abs=1e-9)


def test_flags_and_odd_imports_of_raw_records(spark, tmp_path):
    from binlens.operators import flat as fl
    from binlens.sources.schemas import RAW_SCHEMA, normalise_raw
    (tmp_path / "r.jsonl").write_text(
        '{"sha256": "a", "label": 1, "imports": {"kernel32.dll": ["A", "B"], "user32.dll": "oops", "x.dll": null}, '
        '"authenticode": {"num_certs": 2, "self_signed": true, "parse_error": 0, "no_countersigner": false}}\n'
        '{"sha256": "b", "label": 0, "imports": [], "authenticode": null}\n')
    raw = normalise_raw(io.scan_jsonl(spark, str(tmp_path / "r.jsonl"), RAW_SCHEMA))
    a, b = fl.flatten_record(raw, keep=["sha256"]).orderBy("sha256").collect()
    assert (a.imp_available, a.imp_dll_count, a.imp_func_count, a.imp_has_gui_libs) == (1, 3, 2, 1)
    assert (a.auth_num_certs, a.auth_self_signed, a.auth_parse_error, a.auth_no_countersigner) == (2, 1, 0, 0)
    assert (b.imp_available, b.imp_dll_count, b.auth_num_certs, b.auth_self_signed) == (0, 0, 0, 0)
