"""Literal cases and properties of individual operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binlens.functions.patterns import patterns
from binlens.operators import boost as bo
from binlens.operators import bytes as bt
from binlens.operators import dataset as ds
from binlens.operators import evaluate as ev
from binlens.operators import flat as fl
from binlens.operators import stats as st
from binlens.operators import vector as vec
from binlens.operators.ordering import hash_key, hash_ordinal, running_totals

from scales import SF_SMALL

SEC = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()),
                    T.StructField("entropy", T.DoubleType()), T.StructField("vsize", T.LongType()),
                    T.StructField("props", T.ArrayType(T.StringType()))])
DIR = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()),
                    T.StructField("virtual_address", T.LongType())])


def _records(spark, rows):
    schema = T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("section", T.StructType([T.StructField("sections", T.ArrayType(SEC))])),
        T.StructField("datadirectories", T.ArrayType(DIR)),
        T.StructField("richheader", T.ArrayType(T.LongType())),
    ])
    return spark.createDataFrame(rows, schema)


def test_flatten_handles_empty_null_and_absent(spark):
    df = _records(spark, [(1, {"sections": []}, [], []), (2, None, None, None), (3, {"sections": None}, None, [7])])
    out = {r["id"]: r for r in fl.flatten_record(df, keep=["id"], label=None).collect()}
    for r in out.values():
        assert r["sec_count"] == 0 and r["sec_entropy_std"] == 0 and r["has_upx_sections"] == 0
        assert r["datadir_count"] == 0 and r["rich_num_pairs"] == 0
        assert r["gen_size"] == 0 and r["imp_available"] == 0 and r["pe_warn_count"] == 0
    assert len(out[1]) == 1 + len(fl.FEATURE_COLS)


def test_section_stats_against_numpy(spark):
    secs = [(" UPX0 ", 10, 7.5, 4, ["MEM_EXECUTE", "MEM_READ"]), (".TEXT", 0, 1.0, 9, ["MEM_WRITE"]),
            (".itext", 5, 7.0, 0, None)]
    df = _records(spark, [(1, {"sections": secs}, None, None)])
    r = fl.flatten_record(df, keep=["id"], label=None).first()
    ent = np.array([7.5, 1.0, 7.0])
    assert r["sec_count"] == 3
    assert math.isclose(r["sec_entropy_std"], float(np.std(ent)))
    assert math.isclose(r["sec_rawsize_mean"], 5.0) and r["sec_rawsize_max"] == 10
    assert r["sec_exec_count"] == 1 and r["sec_write_count"] == 1 and r["sec_read_count"] == 1
    assert math.isclose(r["sec_high_entropy_frac"], 1 / 3)  # 7.0 is not > 7.0
    assert math.isclose(r["sec_std_name_frac"], 1 / 3)  # ".text" after lower+strip
    assert r["has_upx_sections"] == 1 and r["has_inno_sections"] == 1


def test_datadirs_short_lists(spark):
    d = lambda n, s: {"name": n, "size": s, "virtual_address": 0}
    rows = [(1, None, [d("A", 1), d("B", 0)], None),
            (2, None, [d("A", 1), d("B", 0), d("R", 9), d("E", 0)], None),
            (3, None, [d("A", 1), d("B", 0), d("R", 9), d("E", 0), d("S", 5)], None)]
    out = {r["id"]: r for r in fl.flatten_record(_records(spark, rows), keep=["id"], label=None).collect()}
    assert (out[1]["dd_resource_size"], out[1]["dd_cert_present"]) == (0, 0)
    assert (out[2]["dd_resource_size"], out[2]["dd_cert_present"]) == (9, 0)
    assert (out[3]["dd_resource_size"], out[3]["dd_cert_present"], out[3]["datadir_nonempty"]) == (9, 1, 3)


def test_rich_pairs_odd_and_single(spark):
    out = {r["id"]: r for r in fl.flatten_record(
        _records(spark, [(1, None, None, [5]), (2, None, None, [5, 3, 9])]), keep=["id"], label=None).collect()}
    assert out[1]["rich_num_pairs"] == 0
    assert out[2]["rich_num_pairs"] == 1
    assert math.isclose(abs(sum(out[2][f"rich_hash_{i}"] for i in range(8))), 3.0)


def test_rich_exact_hash_matches_blake2b(spark):
    import hashlib
    df = _records(spark, [(1, None, None, [123, 4, 77, 2])])
    r = fl.flatten_record(df, keep=["id"], label=None, exact_hash=True).first()
    want = [0.0] * 8
    for comp, cnt in ((123, 4), (77, 2)):
        dg = hashlib.blake2b(str(comp).encode(), digest_size=8).digest()
        want[int.from_bytes(dg, "little") % 8] += (-1.0 if dg[0] & 1 else 1.0) * cnt
    assert [r[f"rich_hash_{i}"] for i in range(8)] == want


def _entropy_hist_ref(b: bytes, window=2048, step=1024):
    a = np.frombuffer(b, dtype=np.uint8)
    out = np.zeros((16, 16), dtype=np.int64)
    blocks = [a] if a.size < window else [a[s:s + window] for s in range(0, a.size - window + 1, step)]
    for blk in blocks:
        c = np.bincount(blk >> 4, minlength=16)
        p = c / window
        h = -sum(x * math.log2(x) for x in p if x > 0) * 2
        out[min(int(h * 2), 15)] += c
    return out.ravel().tolist()


@pytest.mark.parametrize("n", [0, 1, 4, 2047, 2048, 3072, 3073])
def test_byte_kernels_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    data = bytes(rng.integers(0, 256, n, dtype=np.uint8)) if n else b""
    df = spark.createDataFrame([(1, bytearray(data))], "id int, content binary")
    r = bt.byte_entropy_hist(bt.byte_histogram(df)).first()
    assert r["histogram"] == np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist()
    assert r["byteentropy"] == _entropy_hist_ref(data)
    g = bt.byte_general(df).first()
    assert g["size"] == n and g["start_byte_0"] == (data[0] if n else 0) and g["start_byte_3"] == (data[3] if n > 3 else 0)


def test_printable_strings_runs(spark):
    data = b"abcd\x00abcde\x01ab\x7fcd\x10" + b"x" * 6
    df = spark.createDataFrame([(1, bytearray(data))], "id int, content binary")
    got = df.select(bt.printable_strings("content").alias("s")).first()["s"]
    assert got == [m.decode() for m in re.findall(rb"[\x20-\x7f]{5,}", data)] == ["abcde", "ab\x7fcd", "xxxxxx"]


def test_ioc_patterns_agree_with_python_re(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("html").collect()
    strings = [s for r in pages for s in re.findall(r"[\x20-\x7f]{5,}", r["html"])][:3000]
    strings += ["see http://a.b/c?d=[1]", "ip 10.0.0.255 ok", "mac 00:11:22:33:44:55", "onclick=go()",
                "HKCU\\Soft", "C:/x", "!This program cannot", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"]
    df = spark.createDataFrame([(1, strings)], "id int, strings array<string>")
    got = bt.ioc_pattern_counts(df).first()["string_counts"]
    want = {}
    for name, p in patterns():
        rx = re.compile(p.replace(r"\-", "-").replace(r"\[", "["))
        c = sum(1 for s in strings if rx.search(s))
        if c:
            want[name] = c
    assert dict(got) == want


def test_threshold_edge_cases(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.2), (0, 0.1)], "label int, score double")
    cm = ev.confusion_matrix(df, 0.5).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (1, 1, 1, 1)  # score == threshold is positive
    only_benign = spark.createDataFrame([(0, 0.9), (0, 0.1)], "label int, score double")
    r = ev.rates(only_benign, 0.5).first()
    assert r["recall"] == 0.0 and r["fnr"] == 0.0 and r["fpr"] == 0.5
    assert ev.pick_threshold(ev.threshold_sweep(only_benign, [0.05]), 0.1).count() == 0


def test_pick_threshold_ties_take_highest(spark):
    df = spark.createDataFrame([(1, 0.95), (1, 0.96), (0, 0.1)], "label int, score double")
    best = ev.pick_threshold(ev.threshold_sweep(df, ev.GRID_TRAIN)).first()
    assert best["threshold"] == 0.95 and best["recall"] == 1.0


def test_sweep_monotone_and_partition_invariant(spark):
    s = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        (F.col("doc_id") % 2).alias("label"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("score"))
    a = ev.threshold_sweep(s.repartition(1), ev.GRID_TRAIN).orderBy("threshold").collect()
    b = ev.threshold_sweep(s.repartition(8), ev.GRID_TRAIN).orderBy("threshold").collect()
    assert a == b
    assert all(x["tp"] >= y["tp"] and x["fp"] >= y["fp"] for x, y in zip(a, a[1:]))


def test_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.random(500), 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = ev.metric_auc(df).first()["auc"]
    order = np.argsort(s, kind="mergesort")
    ranks = np.empty(500)
    ranks[order] = np.arange(1, 501)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n1, n0 = y.sum(), (1 - y).sum()
    assert math.isclose(got, (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n0 * n1), rel_tol=1e-12)


def test_constant_feature_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1), (2.0, 0.0, 0), (3.0, 0.0, 1)], "a double, c double, label int")
    rs = {(r["a"], r["b"]): r["r"] for r in st.correlation_matrix(df, ["a", "c", "label"]).collect()}
    assert rs[("a", "c")] is None and rs[("c", "c")] is None
    assert math.isclose(rs[("a", "a")], 1.0) and rs[("a", "label")] == rs[("label", "a")]


def test_split_disjoint_complete_and_stratified(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        "doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("label"))
    a = ds.stratified_split(df.repartition(1), "doc_id", frac=0.15)
    b = ds.stratified_split(df.repartition(8), "doc_id", frac=0.15)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == df.count() and a.select("doc_id").distinct().count() == df.count()
    for lab, n in df.groupBy("label").count().collect():
        assert a.filter((F.col("label") == lab) & (F.col("split") == "val")).count() == math.ceil(0.15 * n)


def test_hash_ordinal_global_and_grouped(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g")).withColumn("h", hash_key(1, "k"))
    r = hash_ordinal(df.repartition(5), "h", "k", out="o", digits=2).orderBy("h").select("o").collect()
    assert [x["o"] for x in r] == list(range(1, 1001))
    g = hash_ordinal(df, "h", "k", out="o", partition_by=["g"], digits=1).groupBy("g").agg(F.min("o"), F.max("o"), F.count("*"))
    for row in g.collect():
        assert row[1] == 1 and row[2] == row[3]


def test_running_totals_global_and_grouped(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("n"))
    rows = [(r.v, r.g, r.n) for r in df.collect()]
    for by in ([], ["g"]):
        for r in running_totals(df.repartition(4), "v", ["n"], partition_by=by).collect():
            assert r.n_before == sum(n for v, g, n in rows if v < r.v and (not by or g == r.g))


def test_dropout_zeroes_groups_as_a_unit(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.lit(3).alias("imp_available"),
                                  F.lit(4).alias("imp_dll_count"), F.lit(5).alias("exp_count"))
    out = ds.group_dropout(df, "k", {"imp": ["imp_available", "imp_dll_count"], "exp": ["exp_count", "absent"]})
    rows = out.collect()
    assert all((r["imp_available"] == 0) == (r["imp_dll_count"] == 0) for r in rows)
    rate = sum(r["imp_available"] == 0 for r in rows) / len(rows)
    assert 0.25 < rate < 0.35


def test_warning_suffix_rule_wins(spark):
    rules = spark.createDataFrame([("Bad...", 0), ("...section", 1), ("Bad sec...", 2)], "rule string, id int")
    w = spark.createDataFrame([(1, "Bad section"), (1, "Bad section"), (1, "Bad import"), (1, "nothing")],
                              "file_id int, warning string")
    voc = vec.warning_vocab(rules)
    got = sorted((r["warning"], r["rule"]) for r in vec.warning_normalise(w, voc).collect())
    assert got == [("Bad import", "Bad..."), ("Bad section", "...section")]
    assert [r["warning"] for r in vec.unknown_warnings(w, voc).collect()] == ["nothing"]


def test_monotone_constraint_holds(spark):
    rng = np.random.default_rng(0)
    n = 3000
    x1 = rng.random(n)
    x2 = rng.integers(0, 2, n)
    y = (rng.random(n) < 0.2 + 0.6 * x1 * (x2 == 1)).astype(int)  # x2 raises the rate: constraint says no
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))],
                               "id long, x1 double, x2 double, label int")
    p = bo.BoostParams(n_rounds=3, max_depth=3, max_leaves=8, min_data_in_leaf=20, max_bins=16,
                       min_gain_to_split=0.0, monotone={"x2": -1}, checkpoint_interval=2)
    m = bo.boost_monotone(df, ["x1", "x2"], "label", "id", params=p)
    grid = spark.createDataFrame([(i, float(a), float(b)) for i, a in enumerate(np.linspace(0, 1, 21))
                                  for b in (0.0, 1.0)], "id long, x1 double, x2 double")
    sc = {(r["x1"], r["x2"]): r["score"] for r in bo.score(grid, m).collect()}
    assert all(sc[(a, 1.0)] <= sc[(a, 0.0)] + 1e-12 for a, _ in sc)
    assert len(m.trees) == 3


def test_hist_stats_population_skew(spark):
    h = list(range(256))
    r = spark.createDataFrame([(h,)], "h array<long>").select(*fl.feat_hist_stats(F.col("h"))).first()
    arr = np.array(h, dtype=float)
    sd = arr.std()
    assert math.isclose(r["byteH_std"], sd) and math.isclose(
        r["byteH_skew"], float(np.mean((arr - arr.mean()) ** 3) / (sd ** 3 + 1e-12)), abs_tol=1e-9)


def test_warning_dictionary_load(spark, tmp_path):
    path = tmp_path / "warnings.txt"
    path.write_text("Suspicious...\n...bad checksum\nImport...\n")
    voc = vec.warning_dictionary_load(spark, str(path))
    rows = sorted((r["id"], r["rule"], r["kind"], r["part"]) for r in voc.collect())
    assert rows == [(0, "Suspicious...", 1, "Suspicious"), (1, "...bad checksum", 0, "bad checksum"),
                    (2, "Import...", 1, "Import")]
