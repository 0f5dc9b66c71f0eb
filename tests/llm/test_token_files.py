import random
import zlib

import numpy as np
import pytest

from binlens.llm.token_files import Encoder, crc32_join, read_token_files, shuffle_planes, unshuffle_planes, vocabulary_path, write_token_files
from binlens.session import shared_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_pieces_encode_like_whole_texts(library):
    rng = random.Random(2)
    parts = ["a", "é", " ", "  ", "\n", "\n\n", "\t", " ", "\x85", "\x1c", "\0", "1", "23", "'s", "'t", "!", "...", ".", ",", "a.", "<|endoftext|>", "ß", "The", " x", "\r", "😀", "　", "​", "́", "x" * 60]
    encoder = Encoder("byte_bpe_50k.json", remember=50)
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library(text), repr(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1001])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    planes = shuffle_planes(ids, kind)
    assert len(planes) == {"byte": 4, "bit": 32}[kind]
    assert (unshuffle_planes(planes, n) == ids).all()


def test_crc32_join():
    rng = random.Random(3)
    for _ in range(100):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 400))
        assert crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("kind,block_ids", [("byte", 64), ("bit", 1 << 16)])
def test_files_hold_every_text(spark, odd, odd_rows, library, kind, block_ids):
    """With small blocks, long texts lie in many."""
    path = shared_path(spark, "test-token-files")
    write_token_files(odd, path, kind=kind, block_ids=block_ids)
    got = sorted(map(tuple, read_token_files(spark.read.parquet(f"{path}/ids")).collect()), key=lambda r: r[1])
    at, want = 0, []
    for start, r in enumerate(got):
        assert r[1] == at
        at += r[2]
        want.append(r[0])
    assert want == sorted(want, key=lambda i: (i is not None, i))
    sums = sorted((-1 if r[0] is None else r[0], len(x := [*library(r[1] or ""), 2]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in odd_rows)
    assert sorted((-1 if i is None else i, n, c) for i, _, n, c in got) == sums


def test_ids_come_back(spark, odd, odd_rows, library):
    path = shared_path(spark, "test-token-files")
    write_token_files(odd.where("doc_id = 11"), path)
    block = spark.read.parquet(f"{path}/ids").first()
    assert unshuffle_planes(block.planes, block.n_ids).tolist() == [*library("123 456"), 2] and block.docs == [11]


def test_no_rows(spark, empty):
    path = shared_path(spark, "test-token-files")
    write_token_files(empty, path)
    assert read_token_files(spark.read.parquet(f"{path}/ids")).count() == 0
