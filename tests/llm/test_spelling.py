import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binlens.llm.spelling import follow, near_words, one_edit_pairs, spelling_forms, spelling_variants

D = "/root/testdata/sf0.01"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_counts(rows, min_length=5, min_count=3):
    count = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}


def slow_forms(count, ratio=2):
    """All pairs that share what is left after deleting a code point of one or both, checked one by one."""
    by_rest = {}
    for w in count:
        for rest in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            by_rest.setdefault(rest, set()).add(w)
    around = {w: set() for w in count}
    for group in by_rest.values():
        for a in group:
            around[a] |= {b for b in group if b not in around[a] and near(a, b)}
    form = {}
    for w, n in count.items():
        best = min(around[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), None if form[w] is None else count[form[w]]))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_scan_against_all_pairs():
    rng = random.Random(1)
    for _ in range(150):
        rows = sorted({(g, "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 6)))) for g in range(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))})
        if not rows:
            continue
        asks = np.array([rng.random() < 0.7 for _ in rows])
        i, j = one_edit_pairs(pa.array([r[1] for r in rows]), np.array([r[0] for r in rows]), asks, states_at_once=rng.choice([50, 1000, 400_000]))
        want = [(x, y) for x in range(len(rows)) for y in range(len(rows)) if asks[x] and rows[x][0] == rows[y][0] and near(rows[x][1], rows[y][1])]
        assert sorted(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("max_group", [50_000, 12, 1])
def test_zones_lose_no_pair(spark, max_group):
    rng = random.Random(max_group)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(900)} | {"prefix" + x for x in "abcdefgh"} | {"a" * k for k in range(1, 12)}
    count = {w: rng.choice([3, 4, 9, 20, 50]) for w in words}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    pairs = [(r.word, r.near, r.near_n) for r in near_words(df, max_group).collect()]
    assert len(pairs) == len(set(pairs))
    assert rows_of(spelling_forms(df, max_group=max_group)) == slow_forms(count)


def test_chains_are_followed_to_the_end(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w5")]
    got = {r.word: r.root for r in follow(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in chain}


def test_query_against_brute_force(spark):
    from binlens.llm.queries import QUERIES
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op12_spelling_variants"](spark, D))
    assert got == slow_forms(slow_counts(docs))
    assert sum(r[1] is not None for r in got) > 10


def test_odd_rows(spark, odd, odd_rows, empty):
    extra = spark.createDataFrame([(None, "Straße École école École× École Straze"), (3, "straze STRAZE İnner ẞeta q" + "u" * 30_000)] * 3, "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionAll(extra)
    both = odd.unionByName(extra, allowMissingColumns=True)
    got = rows_of(spelling_variants(both, min_length=3, max_group=5))
    assert got == slow_forms(slow_counts([(r.doc_id, r.text) for r in rows.collect()], min_length=3))
    assert spelling_variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(odd, ratio=1)


def test_one_hot_prefix_is_split(spark):
    # all words share their first five letters: their group is halved until it is small, and nothing is lost
    words = spark.range(20_000).select(F.concat(F.lit("hotly"), F.translate(F.conv(F.col("id").cast("string"), 10, 20), "0123456789ABCDEFGHIJ", "abcdefghijklmnopqrst")).alias("word"), F.lit(3).alias("n"))
    count = {r.word: 3 for r in words.collect()}
    got = {(r.word, r.n_near) for r in spelling_forms(words, max_group=500).collect()}
    assert got == {(r[0], r[4]) for r in slow_forms(count)}
