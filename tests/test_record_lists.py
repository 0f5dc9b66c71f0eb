"""Bins and lists that the record queries make once: tests with rows of their own."""

import pyarrow as pa

from binlens.functions.hashing import hash_bin, hash_sign, md5_bins
from binlens.operators import flat as fl
from binlens.operators import vector as vec
from binlens.operators.record_layout import normalize_layout


def test_md5_bins_are_those_of_the_expressions(spark):
    tokens = ["", ".text", "KERNEL32.dll:ordinal7", "Straße", ".text"]
    bins, signs = md5_bins(pa.array(tokens + [None]), 50)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").orderBy("i")
    want = df.select(hash_bin("t", 50), hash_sign("t")).collect()
    assert [(b, s) for b, s in zip(bins[:-1], signs[:-1])] == [tuple(r) for r in want]
    assert (bins[-1], signs[-1]) == (0, 1.0)


def test_vector_tokens_travel_as_they_are(spark):
    """Rich header: no list of item structs is made in the row, and a null token adds its weight to slot 0."""
    df = spark.createDataFrame([(1, [7, 3, 9, 5, 7, 4]), (2, []), (3, None), (4, [None, 6])], "file_id long, richheader array<bigint>")
    got = {(r.file_id, r.slot): r.value for r in vec.vectorize_long(df, "file_id", ["richheader"]).collect()}
    bins, signs = md5_bins(pa.array(["7", "9"]), 32)
    want = {(1, 0): 3.0, (4, 0): 1.0 + 6.0}
    for b, s, w in zip(bins, signs, (7.0, 5.0)):
        want[1, 1 + int(b)] = want.get((1, 1 + int(b)), 0.0) + s * w
    assert got == want
    plan = vec.vectorize_long(df, "file_id", ["richheader"])._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan


def test_section_lists_are_made_once(spark):
    rows = [(1, (None, [(".TEXT ", 10, 7.5, 4, ["MEM_READ"]), ("upx0", 30, 1.0, 4, None)]))]
    kind = "struct<entry:string,sections:array<struct<name:string,size:bigint,entropy:double,vsize:bigint,props:array<string>>>>"
    flat = fl.flatten_record(normalize_layout(spark.createDataFrame(rows, f"file_id long, section {kind}"), "B"), keep=["file_id"])
    r = flat.first()
    assert (r.sec_count, r.sec_entropy_max, r.sec_entropy_min, r.sec_rawsize_mean, r.sec_std_name_frac, r.has_upx_sections) == (2, 7.5, 1.0, 20.0, 0.5, 1)
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 1
