"""The vector kernel, hash functions, group registry and feature-list files."""

import hashlib
import json
import os
import random
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binlens.functions.hashing import blake2b_pairs, murmur3, murmur3_bins
from binlens.operators import vector as vec

# public vectors of the 32-bit Murmur3 hash: text, seed, unsigned result
PUBLIC = [("", 0, 0), ("", 1, 0x514E28B7), ("", 0xFFFFFFFF, 0x81F16F39), ("test", 0, 0xBA6BD213), ("Hello, world!", 0, 0xC0363E43), ("abc", 0, 0xB3DD93FA),
          ("The quick brown fox jumps over the lazy dog", 0, 0x2E4FF723), ("aaaa", 0x9747B28C, 0x5A97808A), ("aaa", 0x9747B28C, 0x283E0130),
          ("aa", 0x9747B28C, 0x5D211726), ("a", 0x9747B28C, 0x7FA09EA6)]


def slow_murmur3(data: bytes, h: int = 0) -> int:
    """The definition, with Python integers."""
    mask = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (rot(h ^ (rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask), 13) * 5 + 0xE6546B64) & mask
    if tail := int.from_bytes(data[whole:], "little"):
        h ^= rot(tail * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return h ^ (h >> 16)


def test_murmur3_public_vectors():
    for text, seed, want in PUBLIC:
        assert int(murmur3(pa.array([text]), seed).view(np.uint32)[0]) == want == slow_murmur3(text.encode(), seed)


def test_murmur3_of_many_strings():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé\U0001f600.:Z\x00") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    got = murmur3(pa.array(["cut", *texts])[1:]).view(np.uint32).tolist()
    assert got == [slow_murmur3(t.encode()) for t in texts]
    bins, sign = murmur3_bins(pa.array(texts, pa.large_string()), np.full(len(texts), 50))
    signed = [h - 2 ** 32 if h >= 2 ** 31 else h for h in got]
    assert bins.tolist() == [abs(h) % 50 for h in signed] and sign.tolist() == [1.0 if h >= 0 else -1.0 for h in signed]


def test_blake2b_literal_digests():
    # 8-byte digests of the public hash
    literal = {"a": "40f89e395b66422f", "": "e4a6a0577479b2b4"}
    tokens = ["a", "", "a"]
    for bins in (8, 1000):
        bin_, sign = blake2b_pairs(pa.array(tokens), bins)
        for t, b, s in zip(tokens, bin_, sign):
            number = int.from_bytes(bytes.fromhex(literal[t]), "little")
            assert (b, s) == (number % bins, -1.0 if number % 2 else 1.0)
    assert hashlib.blake2b(b"a", digest_size=8).hexdigest() == literal["a"]


RECORDS = [(1, {"k.dll": ["f", "g", "f"], "K.DLL": ["f"]}, ["x", "x", "y"], [1, 5, 1, -5, 7]), (2, None, None, None), (3, {}, [], [])]
SCHEMA = "file_id int, imports map<string,array<string>>, exports array<string>, richheader array<bigint>"


def slow_vector(imports, exports, rich, signed_hash):
    out = np.zeros(1282 + 129 + 33)

    def add(token, bins, offset, weight=1.0, signed=True):
        h = signed_hash(token)
        out[offset + abs(h) % bins] += weight * (-1.0 if signed and h < 0 else 1.0)

    if imports:
        names = [f"{k.lower()}:{f}" for k, v in imports.items() for f in v]
        libraries = {k.lower() for k in imports}
        out[:2] = len(names), len(libraries)
        for t in libraries:
            add(t, 256, 2, signed=False)
        for t in names:
            add(t, 1024, 258, signed=False)
    if exports:
        out[1282] = 128
        for t in exports:
            add(t, 128, 1283)
    if rich:
        out[1411] = len(rich) // 2
        for k in range(len(rich) // 2):
            add(str(rich[2 * k]), 32, 1412, rich[2 * k + 1])
    return out


def test_exact_vectors_entry_by_entry(spark):
    df = spark.createDataFrame(RECORDS, SCHEMA)
    groups = ["imports", "exports", "richheader"]
    signed = lambda t: int(np.uint32(slow_murmur3(t.encode())).view(np.int32))
    want = {r[0]: slow_vector(*r[1:], signed) for r in RECORDS}
    dense = {r.file_id: r.features for r in vec.vectorize(df, groups=groups, hasher="murmur3").collect()}
    assert {k: v for k, v in dense.items()} == {k: v.tolist() for k, v in want.items()}
    for hasher in ("murmur3", "md5"):
        full = {r.file_id: r.features for r in vec.vectorize(df, groups=groups, hasher=hasher).collect()}
        long = [(r.file_id, r.slot, r.value) for r in vec.vectorize_long(df, groups=groups, hasher=hasher).collect()]
        assert sorted(long) == sorted((k, s, v) for k, row in full.items() for s, v in enumerate(row) if v)
    kept = vec.vectorize_long(df, groups=["richheader"], drop_zero=False).where("file_id = 1").count()
    dropped = vec.vectorize_long(df, groups=["richheader"]).where("file_id = 1").count()
    assert (kept, dropped) == (2, 1)  # the two counts of compid 1 cancel out
    with pytest.raises(ValueError):
        vec.vectorize(df, groups=groups, hasher="crc")


def test_many_rows_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vec, "ROWS_AT_ONCE", 3)
    df = spark.range(20).select(F.col("id").alias("file_id"), F.array(F.lit(1).cast("long"), "id").alias("richheader"))
    got = {r.file_id: r.features for r in vec.vectorize(df, groups=["richheader"]).collect()}
    assert len(got) == 20 and all(abs(sum(v[1:])) == k and v[0] == 1 for k, v in got.items())
    assert vec.vectorize(df.limit(0), groups=["richheader"]).collect() == []


def test_groups_are_chosen_by_name_and_unknown_names_fail(spark):
    assert sum(g.dim for g in vec.select_groups()) == 1879 and sum(g.dim for g in vec.GROUPS) == 2568
    assert [g.name for g in vec.select_groups(["ExportsInfo", "histogram"])] == ["histogram", "exports"]
    with pytest.raises(ValueError, match="nosuch"):
        vec.select_groups(["header", "nosuch"])
    with pytest.raises(ValueError, match="header"):
        vec.register_group(vec.VectorGroup("mine", 1, vec.parts_general, alias="header"))
    with pytest.raises(ValueError, match="nosuch"):
        vec.register_group(vec.VectorGroup("mine", 1, vec.parts_general), after="nosuch")
    path = os.path.join(tempfile.mkdtemp(prefix="binlens-list-", dir="/tmp"), "features.json")
    for content, names in (({"features": {"ByteHistogram": {}, "header": None}}, ["ByteHistogram"]), ({"features": {"NoSuch": None}}, None), ({"groups": {}}, None)):
        with open(path, "w") as f:
            json.dump(content, f, indent=1)
        if names is None:
            with pytest.raises(ValueError):
                vec.read_feature_list(spark, path)
        else:
            assert vec.read_feature_list(spark, path) == names


def test_raw_steps_make_what_records_lack(spark):
    df = spark.createDataFrame([(1, b"MZ hello http://x.y"), (2, b""), (3, None)], "file_id int, content binary")
    raw = vec.raw_features(df, ["general", "histogram", "byteentropy", "strings"])
    assert set(raw.columns) == {"file_id", "content", "general", "histogram", "byteentropy", "strings"}
    got = {r.file_id: np.array(r.features) for r in vec.vectorize(raw, groups=["general", "histogram", "byteentropy", "strings"]).collect()}
    assert got[1][[0, 2, 3, 4]].tolist() == [19, 1, 77, 90] and abs(got[1][7:263].sum() - 1) < 1e-6 and abs(got[1][263:519].sum() - 1) < 1e-6
    assert got[1][519:522].tolist() == [1, 19, 19] and len(got[1]) == 7 + 256 + 256 + 177
    assert not got[2].any() and not got[3].any()
    with pytest.raises(ValueError, match="header"):
        vec.raw_features(df, ["header"])


def test_rules_are_numbered_by_line_whatever_the_splits(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="binlens-rules-", dir="/tmp"), "rules.txt")
    lines = [f"rule {k}..." if k % 2 else f"...rule {k}" for k in range(3000)]
    with open(path, "w") as f:
        f.write("\r\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.id: (r.rule, r.kind, r.part) for r in vec.warning_dictionary_load(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: (x, k % 2, f"rule {k}") for k, x in enumerate(lines)}
