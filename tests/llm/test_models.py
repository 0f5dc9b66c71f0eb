import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from binlens.llm.langid import ByteConvNet, predict_language, train_language, windows_of
from binlens.llm.pitman_yor import seat, tokens_of
from binlens.llm.quality import STATISTICS, document_statistics, fit_trees, quality_score, train_quality

D = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode() if i is not None else b"") % n


# Quality

def test_trees_fit_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = fit_trees(x[:3000], y[:3000], n_trees=60, depth=3)
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    # one row at a time, by following the nodes
    total = np.full(50, model.base)
    for f, t, v in zip(model.feature, model.threshold, model.value):
        for i in range(50):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if x[i, f[at]] > t[at] else 1)
            total[i] += v[at - len(f)]
    assert np.allclose(model.predict(x[:50]), 1 / (1 + np.exp(-total)))


def test_constant_where_labels_cannot_teach():
    assert fit_trees(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = fit_trees(np.zeros((100, 3)), np.ones(100)).predict(np.zeros((1, 3)))
    assert 0.9 < one[0] < 1


def test_quality_on_held_out_labels(spark):
    from binlens.llm.queries import QUERIES
    out = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, D).collect()}
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{D}/documents.parquet").count()
    held = [(out[r.doc_id].predicted, r.quality) for r in labels if fold(r.doc_id, 4) == 2 and r.doc_id in out]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert np.mean([p == q for p, q in held]) > 0.9


def test_quality_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, q) for i, q in [(None, 1), (7, 1), (7, 0), (8, None), (9, 5)] + [(100 + k, k % 2) for k in range(60)]], "doc_id long, quality int")
    model = train_quality(odd, labels, least=2)
    got = odd.select("text", quality_score(model, F.col("text")).alias("q")).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.q <= 1 for r in got)
    assert len({round(r.q, 9) for r in got if not (r.text or "").strip()}) == 1
    assert empty.select(quality_score(model, F.col("text"))).count() == 0
    assert train_quality(empty, labels).predict(np.zeros((1, len(STATISTICS)))).tolist() == [0.5]


def test_statistics_of_empty_texts_are_zero():
    assert not document_statistics([None, "", " \n", b""]).any()
    assert document_statistics([]).shape == (0, len(STATISTICS))


# Language

def test_language_on_held_out_rows(spark):
    from binlens.llm.queries import QUERIES
    out = QUERIES["op10_language_id"](spark, D).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(out) == len(lang) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if fold(i, 4) == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_gradient_is_the_slope():
    """One step with a tiny rate goes against numerical slopes of the loss."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (40, 12)).astype(np.uint8), rng.integers(0, 3, 40)
    net = ByteConvNet(["a", "b", "c"], length=12, filters=4).start(3)
    before = -net.log_probabilities(x)[np.arange(40), y].mean()
    net.fit(x, y, steps=150, batch=40, rate=0.02)
    assert -net.log_probabilities(x)[np.arange(40), y].mean() < before / 2


def test_every_window_counts():
    net = ByteConvNet(["a", "b"], length=16).start()
    texts = ["ab" * 500, "", "xyz", "é" * 33]
    best, score = net.predict(texts, windows_at_once=3)
    for t, k, s in zip(texts, best, score):
        w = windows_of(t, 16)
        assert w[w != 0].tobytes() == t.encode().lower()
        total = (net.log_probabilities(w) * ((w != 0).sum(1) / 16)[:, None]).sum(0)
        assert k == total.argmax() and s == pytest.approx(np.exp(total - total.max())[k] / np.exp(total - total.max()).sum(), rel=1e-5)


def test_language_of_odd_rows(odd, odd_rows, empty):
    model = train_language(odd, steps=30)
    assert model.classes == ["de", "en", "es", "fr"]
    got = odd.select("text", predict_language(model, F.col("text")).alias("p")).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.p.lang == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.p.score <= 1
    assert train_language(empty) is None
    assert {r.p.lang for r in odd.select(predict_language(None, F.col("text")).alias("p")).collect()} == {"und"}


# Language model

def slow_base(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in tokens_of((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for i, t in rows:
        ws = tokens_of((t or "").encode())
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out[(-1 if i is None else i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6))] += 1
    return out


def test_held_out_texts_are_likelier_than_by_counts(spark):
    from binlens.llm.queries import QUERIES
    out = QUERIES["op2_pitman_yor"](spark, D).toPandas()
    held = out[out.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.2
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    seen = Counter(map(tuple, out[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]].itertuples(index=False)))
    assert seen == Counter(k[:5] for k in slow_base([tuple(r) for r in docs], lambda i: fold(i, 10) == 0).elements())


def test_seating_follows_the_restaurant():
    """Mean tables of many draws against the exact chain, also where customers come in blocks."""
    rng = np.random.default_rng(4)
    for c, a, d in ((2, 0.4, 0.5), (30, 1.5, 0.3), (2000, 0.7, 0.6)):
        n = 4000
        got = seat(np.full(n, c), np.full(n, a), d, rng.integers(0, 1 << 63, n).astype(np.uint64), 1)
        p = np.zeros(c + 1)
        p[1] = 1
        t = np.arange(c + 1)
        for i in range(1, c):
            new = np.where(t > 0, a / np.maximum(i - d * t + a, 1e-12), 0).clip(0, 1)
            p = p * (1 - new) + np.concatenate([[0], (p * new)[:-1]])
        mean = (p * t).sum()
        assert abs(got.mean() - mean) < 0.05 * mean + 0.05
        assert got.min() >= 1 and got.max() <= c
    assert seat(np.array([1, 0, 5]), np.ones(3), 0.5, np.arange(3).astype(np.uint64), 0)[:2].tolist() == [1, 0]
