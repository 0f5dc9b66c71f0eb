"""Document quality by histogram gradient-boosted trees over document statistics.

The statistics of a text (lengths, character classes, repetition of words, word pairs and
lines) are computed in Arrow batches where the rows lie. Trees are fitted with numpy on the
statistics of at most ``max_rows`` labelled documents, with the logistic loss, on quantile
bins; each tree is a complete binary tree in two flat arrays, so that a batch of rows goes
down all trees level by level with array operations only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ["log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "top_word", "distinct_pairs",
              "upper", "digit", "non_ascii", "stop", "comma", "bang", "symbols", "pipe", "log_lines", "line_bytes",
              "repeated_lines", "closed_lines", "entropy", "capital_words", "short_words"]


def document_statistics(texts: Iterable[str | bytes | None]) -> np.ndarray:
    """One row of ``STATISTICS`` per text; a null or empty text has zeros."""
    out = []
    for t in texts:
        b = b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        words = b.split()
        if not words:
            out.append(np.zeros(len(STATISTICS), np.float32))
            continue
        c = np.bincount(np.frombuffer(b, np.uint8), minlength=256).astype(np.float64)
        n, k = len(b), len(words)
        upper, lower, digit, wide = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
        blank, stop, comma, bang, pipe = c[9:14].sum() + c[32], c[46], c[44], c[33], c[124]
        rest = n - upper - lower - digit - wide - blank - stop - comma - bang - pipe
        seen = Counter(words)
        lines = [x for x in b.split(b"\n") if x.strip()]
        p = c[c > 0] / n
        size = np.fromiter(map(len, words), np.int64, k)
        out.append(np.array([
            np.log1p(n), np.log1p(k), size.mean(), size.max(), len(seen) / k, max(seen.values()) / k,
            len(set(zip(words, words[1:]))) / max(1, k - 1), upper / max(1, upper + lower), digit / n, wide / n,
            stop / k, comma / k, bang / k, rest / k, pipe / k, np.log1p(len(lines)), n / len(lines),
            1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
            -(p * np.log2(p)).sum(), sum(x[:1].isupper() for x in words) / k, (size <= 3).mean()], np.float32))
    return np.stack(out) if out else np.zeros((0, len(STATISTICS)), np.float32)


@dataclass
class Trees:
    """``feature`` and ``threshold`` of inner nodes (trees x (2^depth - 1), node i has children 2i+1 and 2i+2),
    ``value`` of leaves (trees x 2^depth), and the log odds to start from."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 per row."""
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while inner and (at < inner).any():
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64,
              least: int = 20, l2: float = 2.0) -> Trees:
    """Boost ``n_trees`` level-wise trees on quantile bins. One class only (or no rows) gives a constant score."""
    inner = 2 ** depth - 1
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * least or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    m, total = x.shape[1], np.full(len(y), base)
    feature = np.zeros((n_trees, inner), np.int64)
    threshold = np.full((n_trees, inner), np.inf)
    value = np.zeros((n_trees, inner + 1))
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2 ** level - 1, 2 ** level
            cell = ((at - first)[:, None] * m + np.arange(m)) * bins + binned
            hist = [np.bincount(cell.ravel(), np.repeat(w, m), nodes * m * bins).reshape(nodes, m, bins) for w in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = (a.cumsum(2) for a in hist), (a.sum(2, keepdims=True) for a in hist)
            gain = gl ** 2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga ** 2 / (ha + l2)
            gain[(nl < least) | (na - nl < least)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for i, b in enumerate(best):
                j, k = divmod(int(b), bins)
                if gain[i, j, k] > 1e-9 and k < len(edges[j]):
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = rate * gs / (hs + l2)
        total += value[t, leaf]
    return Trees(feature, threshold, value, base)


def _statistics_udf():
    @F.pandas_udf("array<float>")
    def statistics(text: pd.Series) -> pd.Series:
        return pd.Series(list(document_statistics(text)))
    return statistics


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  max_rows: int = 20_000, **fit) -> Trees:
    """Fit trees on labelled documents: of the labels 0 and 1, the ``max_rows`` with the smallest hash of the id.

    ``max_rows`` bounds what reaches the driver (a vector of statistics a row, never a text).
    Null labels and ids are passed over; an id with several labels has the largest.
    """
    picked = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(picked), "_id")  # max_rows rows at most
            .select("_id", "_label", _statistics_udf()("_text").alias("_x"))
            .orderBy(F.xxhash64("_id"), "_id").limit(max_rows).toPandas())
    x = np.stack(rows["_x"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, len(STATISTICS)))
    return fit_trees(x, rows["_label"].to_numpy(np.float64), **fit)


def quality_score(model: Trees, text: Column) -> Column:
    """The probability of label 1; a null text is scored as the empty one."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.predict(document_statistics(texts).astype(np.float64)))
    return score(text)
