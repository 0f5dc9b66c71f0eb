"""What training and record assembly do per row and per task does not grow with the table."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from binlens.functions.kernels import md5_heads
from binlens.operators import boost as bo
from binlens.operators import dataset as ds
from binlens.operators.ordering import hash_key, hash_uniform


def test_md5_of_many_keys():
    rng = random.Random(1)
    parts = [b":%d" % rng.randrange(10 ** rng.randrange(1, 19)) for _ in range(500)] + [b"", b"x" * 47, b"x" * 48, b"x" * 49, b"z" * 500, "é".encode() * 20]
    data, edges = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    for prefix in (b"42:bag0", b"", b"q" * 70):
        assert md5_heads(prefix, data, edges).tolist() == [int(hashlib.md5(prefix + p).hexdigest()[:8], 16) for p in parts]
    assert len(md5_heads(b"a", data[:0], np.zeros(1, np.int64))) == 0


def test_training_frame_has_a_record_per_batch_and_bags_by_key(spark):
    keys = [None, "", "a", "é", *(f"key {i}" for i in range(996))]
    df = spark.createDataFrame([(k, float(i % 7), i % 2) for i, k in enumerate(keys)], "key string, a double, label int").coalesce(1)
    p = bo.BoostParams(bagging_fraction=0.6)
    frame = bo._binned_frame(bo._prepare(df, ["a"], "label", None, "key"), ["a"], [[1.0, 4.0]], 255, 0.25, [], p)
    (r,) = frame.collect()
    assert r.n == 1000 and len(r.bins) == 1000 and len(r.w) == 0 and set(np.frombuffer(r.margin)) == {0.25}
    want = [x.bag for x in df.select((hash_uniform(p.seed, "bag0", F.col("key")) < 0.6).alias("bag")).collect()]
    assert np.frombuffer(r.bag, bool).tolist() == want and 500 < sum(want) < 700


def test_split_sorts_only_the_rows_near_the_share(spark):
    df = spark.range(20_000).select(F.col("id").alias("key"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).cast("int").alias("label"))
    for frac in (0.0, 0.15, 1.0):
        got = {(r.key, r.split) for r in ds.stratified_split(df, "key", frac=frac).collect()}
        want, ranked = set(), {}
        for r in df.withColumn("h", hash_key(ds.SEED, "key")).collect():
            ranked.setdefault(r.label, []).append((r.h, r.key))
        for rows in ranked.values():
            share = int(np.ceil(frac * len(rows)))
            want |= {(key, "val" if i < share else "train") for i, (_, key) in enumerate(sorted(rows))}
        assert got == want
    split = ds.stratified_split(df, "key", frac=0.15)
    split.collect()
    plan = split._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "SortMergeJoin" not in final  # rows meet their border where they are


def test_trees_of_mllib_get_partitions_of_bounded_rows(spark, monkeypatch):
    seen = []
    from pyspark.ml import Pipeline
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    df = spark.range(1000, numPartitions=2).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 > 4).cast("int").alias("label"))
    monkeypatch.setattr(bo, "_GBT_ROWS", 100)
    model = bo.train_gbt(df, ["a"], max_iter=1, max_depth=1, min_instances=1, subsampling=1.0)
    assert model.transform(df).where("prediction <> label").isEmpty()
    monkeypatch.setattr(bo, "_GBT_ROWS", 1000)
    bo.train_gbt(df, ["a"], max_iter=1, max_depth=1, min_instances=1)
    assert seen == [10, 2]


def test_record_assembly_has_tasks_of_bounded_lines(spark, monkeypatch):
    from binlens.sources import records
    from scales import SF_SMALL
    before = records.raw_records(spark, SF_SMALL).select("file_id", "imports", "exports").collect()
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    monkeypatch.setattr(records, "LINES_PER_TASK", -(-lines // 20))
    few = records._line_columns(spark, SF_SMALL)
    assert few.rdd.getNumPartitions() == 20
    after = records.raw_records(spark, SF_SMALL).select("file_id", "imports", "exports").collect()
    assert sorted(before, key=str) == sorted(after, key=str)
