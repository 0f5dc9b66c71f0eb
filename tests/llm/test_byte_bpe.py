import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binlens.llm.byte_bpe import NEWER_LETTERS_AND_NUMBERS, ByteBpe, PerfectHash, decode_ids, encode_texts, merge_bytes

D = "/root/testdata/sf0.01"
FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(FILE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_hash_is_minimal_and_perfect(n):
    rng = random.Random(n)
    keys = list({bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 20))) + str(k).encode() for k in range(n)})
    table = PerfectHash(keys)
    assert table.find(pa.array(keys, pa.large_binary())).tolist() == list(range(n))
    assert sorted(table.item.tolist()) == list(range(n))  # every slot has one string: no gaps
    others = [b"", b"\x00", b"zz", *(k + b"\x00" for k in keys), b"x" * 100]
    assert (table.find(pa.array(others, pa.large_binary())) == [-1 if o not in keys else keys.index(o) for o in others]).all()


def test_distinct_strings_are_asked_for():
    for keys in ([], [b"a", b"a"]):
        with pytest.raises(ValueError):
            PerfectHash(keys)


def slow_merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        k = min(pairs)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.randoms())
def test_heap_joins_in_the_order_of_ranks(piece, rng):
    piece = bytes(b"abc"[b % 3] for b in piece)
    strings = [bytes([b]) for b in range(256)] + [bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    ranks = {s: r for r, s in enumerate(dict.fromkeys(strings))}
    assert merge_bytes(piece, ranks) == slow_merge(piece, ranks)


def test_as_the_library_on_odd_texts(bpe, library):
    rng = random.Random(3)
    newer = [c for c in NEWER_LETTERS_AND_NUMBERS if c != "-"]
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "\U0001f600", "中", "日本", "'s", "'LL", "'ll", "1", "²", "٣", "\x00", "\x1c", "\x85",
             " ", "​", "　", "!", "...", "<|endoftext|>", "Привет", "ﬁ"]
    texts = ["".join(rng.choice(parts + newer[:len(newer) * (k % 3 == 0)]) for _ in range(rng.randint(0, 60))) for k in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000, "".join(rng.choice("abcdef") for _ in range(30_000))]
    got = bpe.encode_many(texts)
    assert [ids_of(g) for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(g) for g in got] == [t.encode() for t in texts]
    assert bpe.encode_many(texts[:200], at_once=7) == got[:200]


def test_memory_of_pieces_is_bounded():
    small = ByteBpe(FILE, public_tokenizers.PATTERN, remember=10)
    texts = ["qxzjk vvwqx zzkqj " * 3, "jjxqk wwzxv kkqzx qqxzj " * 2]
    first = small.encode_many(texts)
    assert small.encode_many(texts) == first and len(small.known) < 30


def test_a_file_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(255)))
    with pytest.raises(ValueError, match="255"):
        ByteBpe(str(path), public_tokenizers.PATTERN)


def test_query_against_the_library(spark, library):
    from binlens.llm.queries import QUERIES
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_byte_bpe"](spark, D).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(library.encode_ordinary(d.text or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


def test_odd_rows(spark, odd, odd_rows, empty, library):
    out = encode_texts(odd).withColumn("back", decode_ids(F.col("ids"))).collect()
    want = sorted(repr((i, library.encode_ordinary(t or ""), (t or "").encode())) for i, t, *_ in odd_rows)
    assert sorted(repr((r.doc_id, ids_of(r.ids), bytes(r.back))) for r in out) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    assert encode_texts(empty).collect() == []


def test_unknown_ids_are_an_error(bpe):
    assert bpe.decode(b"") == b""
    with pytest.raises(ValueError, match="4000000"):
        bpe.decode(np.array([4_000_000], "<u4").tobytes())
