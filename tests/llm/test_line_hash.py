import xxhash
from pyspark.sql import functions as F

from binlens.llm.line_dedup import key_hash


def test_both_halves_are_hashes_of_the_key(spark):
    """The second half is made from the bytes of the key, and not from the first half."""
    keys = ["", "a", "a line", "é" * 40, "x" * 1000]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    rows = df.select("key", key_hash(F.col("key")).alias("h"), F.xxhash64(F.lit(1)).alias("seed")).collect()
    full = 1 << 64
    for r in rows:
        b = r.key.encode()
        assert r.h.a % full == xxhash.xxh64_intdigest(b, 42) and r.h.b % full == xxhash.xxh64_intdigest(b, r.seed % full)
    assert len({r.h.a for r in rows} | {r.h.b for r in rows}) == 2 * len(keys)
