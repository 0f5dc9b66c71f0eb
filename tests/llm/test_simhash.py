import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from binlens.llm.components import connected_components
from binlens.llm.simhash import HammingBlock, keep_one_of_each, links, simhash_components


def slow_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, d=3):
    fps = {f for _, f in rows}
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= d:
                up[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)


def test_components_are_brute_force(odd, odd_rows, empty):
    rows = [(r[0], slow_fingerprint(r[1])) for r in odd_rows]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(odd).collect())
    assert got == brute(rows)
    assert simhash_components(empty).count() == 0


def test_query_is_brute_force(spark):
    from binlens.llm.queries import QUERIES
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op5_simhash_near_dedup"](spark, d).collect())) == brute(rows)


@pytest.mark.parametrize("blocks,bits", [(2, 3), (4, 3), (2, 5)])
def test_no_link_is_lost(spark, blocks, bits):
    rng = random.Random(blocks)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(8):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {frozenset(r) for r in links(df, bits, blocks).collect()}
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= bits}
    assert got == want


def test_hamming_anchors_cover():
    code, x = HammingBlock(4), np.arange(1 << 15).astype(np.uint64)
    home = code.home(x)
    assert (np.bitwise_count(x ^ home) <= 1).all() and (code.syndrome(home) == 0).all()
    rows, anchors = code.within(x[:300], 2)
    words = np.unique(home)
    for i in range(300):
        assert set(anchors[rows == i]) == set(words[np.bitwise_count(words ^ x[i]) <= 2])


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    rng.shuffle(edges)
    got = {}
    for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(301)), [1000 + i for i in range(200)], [6000, 6001]]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_stays(odd, odd_rows):
    kept = keep_one_of_each(odd, simhash_components(odd))
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    roots = {r.fingerprint: r.root for r in simhash_components(odd).collect()}
    assert len(rows) == len(set(roots.values()))
    stay = {roots[f"{slow_fingerprint(t):016x}"]: i for i, t in rows}
    assert len(stay) == len(rows)
    for root, i in stay.items():
        ids = [r[0] for r in odd_rows if roots[f"{slow_fingerprint(r[1]):016x}"] == root and r[0] is not None]
        assert i == min(ids, default=None)
