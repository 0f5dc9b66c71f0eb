import random
import zlib

import numpy as np

from binlens.llm.token_files import Encoder, read_token_files, vocabulary_path, write_token_files
from binlens.session import shared_path


def loaded():
    """The tokenizer as its file says."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_files_have_the_ids_of_the_tokenizer_as_loaded(spark):
    library, texts = loaded(), ["one <|endoftext|> two", "<|endoftext|>", "a.<|endoftext|>\n<|endoftext|>. b", "plain"]
    path = shared_path(spark, "test-token-files")
    write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in read_token_files(spark.read.parquet(f"{path}/ids")).collect()}
    assert got == {i: (len(x := [*library(t), 2]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in enumerate(texts)}


def test_pieces_with_special_tokens_encode_like_whole_texts():
    library, rng, encoder = loaded(), random.Random(4), Encoder("byte_bpe_50k.json", remember=50)
    parts = ["a", "é", " ", "  ", "\n", "\n\n", "\t", "\0", "1", "'s", "!", ".", ",", "a.", "<|endoftext|>", "<|endoftext|>", "<|", "|>", "The", " x", "​", "x" * 60]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library(text), repr(text)
