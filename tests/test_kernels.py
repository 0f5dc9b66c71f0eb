"""Batch kernels of byte contents and strings against one-at-a-time code."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binlens.functions import kernels
from binlens.functions.bytestats import byte_counts, byte_entropy_counts, byte_features, pattern_names
from binlens.functions.patterns import IOC_PATTERNS, patterns, required_literals
from binlens.operators import bytes as bt

RNG = random.Random(1)
CONTENTS = [None, b"", b"a", b"ab" * 600] + [bytes(RNG.choice(b"abc\x00\xff") for _ in range(n)) for n in (5, 1023, 1024, 1025, 2047, 2048, 2049, 3071, 3072, 3073, 9000)]


def slow_histogram(content):
    c = Counter(content or b"")
    return [c.get(b, 0) for b in range(256)]


def slow_entropy_histogram(content, window, step):
    content = content or b""
    starts = [0] if 0 < len(content) < window else range(0, len(content) - window + 1, step)
    out = np.zeros((16, 16), np.int64)
    for s in starts:
        c = Counter(b >> 4 for b in content[s:s + window])
        h = 2 * sum(-(n / window) * math.log2(n / window) for n in c.values())
        for v, n in c.items():
            out[min(int(2 * h), 15), v] += n
    return out.ravel().tolist()


@pytest.mark.parametrize("chunk", [1, 777, 1 << 20])
def test_histograms(monkeypatch, chunk):
    monkeypatch.setattr(kernels, "CHUNK", chunk)
    batch = pa.array([b"cut", *CONTENTS, b"cut"])[1:-1]
    if chunk > 1:
        for window, step in ((2048, 1024), (2048, 2048), (2000, 700), (100, 150)):
            assert kernels.entropy_histograms(batch, window, step).tolist() == [slow_entropy_histogram(c, window, step) for c in CONTENTS]
    assert kernels.histograms(batch).tolist() == [slow_histogram(c) for c in CONTENTS]
    assert kernels.histograms(pa.array([], pa.binary())).shape == (0, 256)


PIECES = ["http://a", "https://x.y", "ftp://", "HTTP/1.1", "get /", "GET /", "xhttp://q", " .click", "onclick(", "click", "KHEY_", "aKHLM", "C:/w", "1.2.3.4", "256.1.1.1",
          "aa:bb:cc:dd:ee:ff", "::1", "1:2:3:4:5:6:7:8", "1" * 30, "/dev/", "PowerShell", "invoke-command", "Invoke-Command", "crypt", "CRYPT",
          "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", " ", "x", "_", "a@b.co", "\n", "HKLM", "HKCU"]


@pytest.mark.parametrize("fixed", [False, True])
def test_automaton_finds_what_every_pattern_finds(fixed):
    rng = random.Random(2)
    for turn in range(150):
        strings = ["".join(rng.choice(PIECES + ["é", "İ"] * (turn % 5 == 0)) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))]
        want = sorted((i, j) for i, t in enumerate(strings) for j, (_, p) in enumerate(patterns(fixed)) if re.search(p, t))
        assert sorted(map(tuple, kernels.pattern_strings(strings, fixed).tolist())) == want


def test_required_literals_are_in_all_matches():
    for name, pattern in IOC_PATTERNS:
        needs, whole = required_literals(name, pattern)
        assert whole or name in {"url", "file_path", "registry_key", ".click(", "base64string", "ipv4_addr", "ipv6_addr", "mac_addr", "email_addr", "btc_wallet"}
        for piece in PIECES:
            if needs and (m := re.search(pattern, piece)):
                assert any(n.lower() in m[0].lower() for n in needs)


def test_columns(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(CONTENTS)], "id int, content binary").repartition(3)
    got = {r.id: r for r in df.select("id", byte_counts("content").alias("h"), byte_entropy_counts(F.col("content")).alias("e")).collect()}
    for k, c in enumerate(CONTENTS):
        assert got[k].h == (None if c is None else slow_histogram(c)) and got[k].e == (None if c is None else slow_entropy_histogram(c, 2048, 1024))


def test_one_read_gives_what_the_single_operators_give(spark):
    contents = [*CONTENTS, b"\x00http://a.b\x01GET /x HTTP/1.1\xffab\x00C:/windows C:/"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "id int, content binary")
    one = {r.id: r.f for r in df.select("id", byte_features(F.col("content")).alias("f")).collect()}
    many = bt.byte_general(bt.byte_entropy_hist(bt.byte_histogram(df)), histogram="histogram").withColumn("strings", bt.printable_strings("content"))
    many = bt.string_stats(bt.ioc_pattern_counts(many)).collect()
    for r in many:
        f = one[r.id]
        assert f.histogram == (r.histogram or [0] * 256) and f.byteentropy == (r.byteentropy or [0] * 256) and abs(f.entropy - r.entropy) < 1e-9
        assert (f.strings.numstrings, f.strings.printables) == (r.numstrings, r.printables) and abs(f.strings.avlength - r.avlength) < 1e-9
        assert f.strings.printabledist == (r.printabledist or [0] * 96) and abs(f.strings.entropy - r.string_entropy) < 1e-9
        assert {n: c for n, c in zip(pattern_names(), f.strings.string_counts) if c} == r.string_counts


def test_null_lists_and_strings_match_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, "http://x", None])], "id int, strings array<string>")
    got = {r.id: r.string_counts for r in bt.ioc_pattern_counts(df).collect()}
    assert got == {1: {}, 2: {}, 3: {"http://": 1, "url": 1}}
