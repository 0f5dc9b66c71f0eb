"""End-to-end: raw JSONL shards -> (batch | streaming) flat features -> training -> evaluation."""

import math
import os
import tempfile

from pyspark.sql import functions as F

from binlens.operators import boost as bo
from binlens.operators import flat as fl
from binlens.plans import workflows as wf
from binlens.sources.records import raw_records
from binlens.streaming.shards import ingest_shards

from scales import SF_SMALL


def _write_shards(spark, tmp):
    recs = raw_records(spark, SF_SMALL).withColumn("sha256", F.sha2(F.col("file_id").cast("string"), 256))
    recs = recs.withColumn("datadirectories", F.to_json("datadirectories")) \
               .withColumn("exports", F.to_json("exports")) \
               .withColumn("richheader", F.to_json("richheader")) \
               .withColumn("pefilewarnings", F.to_json("pefilewarnings")).drop("file_id")
    shard_dir = os.path.join(tmp, "shards")
    recs.repartition(4).write.json(shard_dir)
    return shard_dir


def test_batch_and_stream_flatten_agree_and_train(spark):
    tmp = tempfile.mkdtemp(prefix="binlens-wf-", dir="/tmp")
    shards = _write_shards(spark, tmp)
    batch = wf.flat_features(spark, f"{shards}/*.json")
    # the JSON round trip reproduces the in-memory flattening
    direct = fl.flatten_record(raw_records(spark, SF_SMALL).withColumn(
        "sha256", F.sha2(F.col("file_id").cast("string"), 256)), keep=["sha256"])
    a = {r["file_key"]: r for r in batch.collect()}
    b = {r["sha256"]: r for r in direct.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in fl.FEATURE_COLS:
            assert math.isclose(float(a[k][c]), float(b[k][c]), rel_tol=1e-9, abs_tol=1e-9), (k, c)

    q = ingest_shards(spark, shards, os.path.join(tmp, "flat"), os.path.join(tmp, "ckpt"), files_per_batch=2)
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(tmp, "flat"))
    assert streamed.count() == batch.count()

    params = bo.BoostParams(n_rounds=2, max_depth=3, max_leaves=8, min_data_in_leaf=5, max_bins=16,
                            checkpoint_interval=1)
    res = wf.train_model(spark, f"{shards}/*.json", os.path.join(tmp, "model"), params=params)
    assert len(res.sweep) == 18 and res.auc is not None
    model = bo.BoostModel.load(spark, os.path.join(tmp, "model"))
    assert len(model.trees) == len(res.model.trees)
