import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from binlens.llm.exact_dedup import exact_dedup
from binlens.llm.line_dedup import line_dedup
from binlens.llm.rendezvous import shard


def low(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("bits", [None, 1])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_is_brute_force(odd, odd_rows, keep, bits):
    """Also with a hash of one hex digit, where most groups hold different texts."""
    weak = {} if bits is None else {"hash_fn": lambda c: F.substring(F.md5(c.cast("binary")), 1, bits), "rows_per_salt": 3}
    got = Counter(map(tuple, exact_dedup(odd, keep=keep, **weak).collect()))
    groups = defaultdict(list)
    for r in odd_rows:
        groups[low(r[1])].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        k = {"min": min, "max": max}[keep]([i for i in ids if i is not None], default=None)
        for i in ids:
            want[(i, k, len(ids), i == k, hashlib.sha256(t).hexdigest())] += 1
    assert got == want


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 0), (3, 5)])
def test_line_dedup_is_brute_force(odd, odd_rows, min_docs, min_chars):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    # rows of one id are one document, rows without an id a document each
    pairs = {(r[0] if r[0] is not None else f"row {n}", key(x)) for n, r in enumerate(odd_rows) for x in (r[1] or "").split("\n")}
    docs = Counter(k for _, k in pairs)
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    want = Counter()
    for r in odd_rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if key(x) not in gone]
        want[(r[0], len(lines), len(lines) - len(left), "\n".join(left))] += 1
    got = Counter(map(tuple, line_dedup(odd, min_docs=min_docs, min_chars=min_chars).collect()))
    assert got == want


def test_a_repeated_id_is_one_document(spark):
    rows = spark.createDataFrame([(1, "shared\nown")] * 12 + [(k, "common\nown") for k in range(20, 31)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_dropped, r.kept) for r in line_dedup(rows, min_docs=10).collect())
    assert got == Counter({(1, 1, "shared"): 12, **{(k, 2, ""): 1 for k in range(20, 31)}})


def test_line_dedup_of_nothing(empty):
    assert line_dedup(empty).count() == 0


def test_shards(odd, odd_rows, empty):
    plain = odd.withColumnRenamed("shard", "s0").withColumnRenamed("slot", "s1")
    out = shard(plain, carry=("n_chars",), rows_per_bucket=2).collect()
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((r[0], r[4]) for r in odd_rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    clash = shard(odd, carry=("shard", "slot")).columns
    assert clash == ["doc_id", "shard", "slot", "shard_of_key", "slot_of_key", "grown_shard"]
    assert shard(empty).count() == 0


def test_shards_follow_weights_and_growth(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    out = shard(ids, weights=(1, 2, 0, 1)).toPandas()
    part = out["shard"].value_counts(normalize=True)
    assert abs(part[1] - 0.5) < 0.02 and abs(part[0] - 0.25) < 0.02 and 2 not in part
    grown = shard(ids, weights=(1, 2, 0, 1, 1)).toPandas().set_index("doc_id")["shard"].sort_index()
    out = out.sort_values("doc_id")
    assert (grown == out.set_index("doc_id")["grown_shard"]).all()
    assert abs((grown == 4).mean() - 0.2) < 0.02
    assert (grown[grown != 4] == out.set_index("doc_id")["shard"][grown != 4]).all()


def test_sharding_query(spark):
    from binlens.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = QUERIES["op4_rendezvous_sharding"](spark, d).collect()
    assert len(out) == len(text)
    for r in out:
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "key"
