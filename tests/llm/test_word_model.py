import random
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from binlens.llm.pitman_yor import tokens_of
from binlens.llm.text import hash_bits
from binlens.llm.word_model import number_words, pair_probabilities, word_hash, word_pair_scores

from test_models import fold, slow_base


def test_pairs_of_rare_words_are_learned(spark, tmp_path):
    """Each of 3,000 rare words (all with one ending) has its own next word; the same words in another order are unlikelier."""
    from binlens.llm.queries import QUERIES
    rng = random.Random(1)
    follow = [(f"l{i}xx", f"r{i}xx") for i in range(3000)]
    rows = []
    for i in range(3000):
        if fold(i, 10):
            rows.append((i, " ".join(w for k in range(20) for w in follow[(20 * i + k) % 3000])))
    held = [i for i in range(3000, 9000) if fold(i, 10) == 0][:2]
    some = rng.sample(follow, 200)
    rows.append((held[0], " ".join(f"{a} {b}" for a, b in some)))
    rows.append((held[1], " ".join(f"{a} {b}" for (a, _), (_, b) in zip(some, some[1:] + some[:1]))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.score for r in QUERIES["op2_pitman_yor"](spark, str(tmp_path)).where("held_out").collect()}
    assert out[held[0]] > out[held[1]] + 100


def test_word_scores_of_odd_rows(odd, odd_rows, empty):
    got = word_pair_scores(odd, hash_bits(F.col("doc_id"), 10) == 0, block_bytes=3000).collect()
    seen = Counter((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert seen == slow_base([(r[0], r[1]) for r in odd_rows], lambda i: fold(i, 10) == 0)
    assert all(r.score < 0 for r in got)
    whole = word_pair_scores(odd, hash_bits(F.col("doc_id"), 10) == 0).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in whole) == Counter((r.doc_id, round(r.score, 5)) for r in got)
    assert word_pair_scores(empty, F.lit(False)).count() == 0
    untrained = word_pair_scores(odd, F.lit(True)).collect()
    assert len(untrained) == len(odd_rows) and {r.n_known for r in untrained} == {0} and {r.train_tokens for r in untrained} == {0}


def test_probabilities_after_a_context_sum_to_one(spark):
    texts = ["a b a c a b d a b a b", "b b a", "c", "a b " * 100]
    seen, words = Counter(), Counter()
    for t in texts:
        toks = tokens_of(t.encode())
        words.update(toks)
        seen.update(zip([b"", *toks], toks))
    rows = [(word_hash(u, 0), word_hash(w, 0), seen[u, w]) for u in [*words, b"new"] for w in [*words, b"new"]]
    pairs = spark.createDataFrame(rows, "u long, w long, c long")
    table = spark.createDataFrame([(word_hash(w, 0), words[w]) for w in [*words, b"new"]], "w long, c long")
    out, total = pair_probabilities(pairs, table, 4, 1, 1.0)
    sums = Counter()
    for r in out.collect():
        sums[r.u] += 10 ** r.lp
    assert total == sum(words.values()) and len(sums) == len(words) + 1
    assert all(s == pytest.approx(1) for s in sums.values())


def test_words_never_share_a_number(spark):
    """Numbers of three bits at the first seed, of 64 at the next."""
    rows = spark.createDataFrame([(False, b"a b c d e f g h i j a"), (True, b"k a")], "held_out boolean, text binary")
    words, seed = number_words(rows, lambda w, s: word_hash(w, s) if s else word_hash(w, s) % 8)
    assert seed == 1 and {r.w: r.c for r in words.collect()} == {word_hash(w, 1): c for w, c in [(b"", 1), (b"a", 2), (b"k", 0), *((x.encode(), 1) for x in "bcdefghij")]}


def test_blocks_buckets_and_shards_keep_every_pair(spark, odd, odd_rows):
    """Many small blocks, buckets and shards give each text the sum of its pairs' probabilities; only arrays are kept between jobs, no row per pair."""
    seen, words = Counter(), Counter()
    for i, t in ((r[0], r[1]) for r in odd_rows):
        toks, n = tokens_of((t or "").encode()), int(fold(i, 10) != 0)
        for u, w in zip([b"", *toks], toks):
            seen[u, w] += n
            words[w] += n
    pairs = spark.createDataFrame([(word_hash(u, 0), word_hash(w, 0), c) for (u, w), c in seen.items()], "u long, w long, c long")
    model, _ = pair_probabilities(pairs, spark.createDataFrame([(word_hash(w, 0), c) for w, c in words.items()], "w long, c long"), 5, 2, 1.0)
    lp = {(r.u, r.w): r.lp for r in model.collect()}
    want = []
    for i, t in ((r[0], r[1]) for r in odd_rows):
        own = [word_hash(w, 0) for w in tokens_of((t or "").encode())]
        want.append((-1 if i is None else i, sum(lp[p] for p in zip([word_hash(b"", 0), *own], own))))
    kept = Path(unquote(urlparse(spark.sparkContext.getCheckpointDir()).path))
    before = set(kept.iterdir())
    got = word_pair_scores(odd, hash_bits(F.col("doc_id"), 10) == 0, block_bytes=8000, bucket_tokens=1500).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got)
    assert [i for i, _ in got] == sorted(i for i, _ in want)
    assert [x for _, x in got] == pytest.approx([x for _, x in sorted(want)], rel=1e-9)
    made = [x for x in kept.iterdir() if x not in before and not x.name.startswith("words-")]
    assert made and all(pq.ParquetFile(f).metadata.num_rows < len(seen) / 2 for x in made for f in x.glob("*.parquet"))
