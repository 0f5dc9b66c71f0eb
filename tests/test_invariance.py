"""Partition invariance (same results with 1 and 8 shuffle partitions) and a hot-group case."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from binlens.operators.ordering import hash_key, hash_ordinal
from binlens.testing import normalise_rows

from scales import SF_SMALL

QUERIES = entry.queries()
RANKED = ["seeded_shuffle", "stratified_split", "nested_split", "metric_auc", "class_quartiles", "class_summary",
          "quota_take_binding", "lookup_with_fallback", "threshold_sweep", "vec_rich", "correlation_matrix"]


@pytest.mark.parametrize("name", RANKED)
def test_same_result_with_1_and_8_partitions(spark, name):
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, SF_SMALL)
        out.append(normalise_rows(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def test_hot_group_is_split_over_tasks(spark):
    # one group holds half of all rows: its ranks must still be exact and spread over tasks
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("g"), "id").withColumn("h", hash_key(1, "id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = hash_ordinal(df, "h", "id", out="o", partition_by=["g"])
    hot = r.filter(F.col("g") == 0)
    assert tuple(hot.select(F.min("o"), F.max("o"), F.countDistinct("o")).first()) == (1, 10000, 10000)
    parts = hot.select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1
