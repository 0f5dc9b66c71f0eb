"""Language identification by a convolutional network over bytes, trained and applied with numpy.

A text is cut into windows of fixed length. Filters of several widths slide over a window's
one-hot bytes (so a filter is a table of byte weights per offset), the largest activation of
each filter is kept, and a softmax layer turns them into log probabilities, which are averaged
over all windows of the text by length. Training takes windows of at most ``max_rows`` labelled
texts and runs Adam on the cross entropy; applying it is one narrow pass over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows_of(text: str | bytes, length: int) -> np.ndarray:
    """All windows of the lower-cased bytes, the last one filled up with zero bytes."""
    b = (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower()
    n = max(1, -(-len(b) // length))
    return np.frombuffer(b.ljust(n * length, b"\0"), np.uint8).reshape(n, length)


@dataclass
class ByteConvNet:
    classes: list[str]
    length: int = 192
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    tables: list[np.ndarray] = field(default_factory=list)  # per width: offsets x 256 x filters
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def start(self, seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        total = self.filters * len(self.widths)
        self.tables = [rng.normal(0, 0.3, (w, 256, self.filters)).astype(np.float32) for w in self.widths]
        for t in self.tables:
            t[:, 0] = 0  # the filling
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, len(self.classes))).astype(np.float32)
        self.out_bias = np.zeros(len(self.classes), np.float32)
        return self

    def _maps(self, x: np.ndarray) -> list[np.ndarray]:
        maps = []
        for w, table in zip(self.widths, self.tables):
            n = x.shape[1] - w + 1
            m = table[0][x[:, :n]]
            for j in range(1, w):
                m += table[j][x[:, j:j + n]]
            maps.append(m)
        return maps

    def log_probabilities(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        """Per window, in steps that stay in the processor's cache."""
        parts = []
        for i in range(0, len(x), step):
            pooled = np.concatenate([m.max(1) for m in self._maps(x[i:i + step])], 1)
            z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(parts)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            xb, yb = x[pick], y[pick]
            maps = self._maps(xb)
            where = [m.argmax(1) for m in maps]
            pooled = np.concatenate([np.take_along_axis(m, a[:, None], 1)[:, 0] for m, a in zip(maps, where)], 1) + self.bias
            hidden = np.maximum(pooled, 0)
            z = hidden @ self.out + self.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(batch), yb] -= 1
            p /= batch
            back = (p @ self.out.T) * (pooled > 0)
            grads = []
            for k, (w, a) in enumerate(zip(self.widths, where)):
                g = np.zeros_like(self.tables[k])
                part = back[:, k * self.filters:(k + 1) * self.filters]
                f = np.broadcast_to(np.arange(self.filters), a.shape)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, a + j, 1), f), part)
                g[:, 0] = 0
                grads.append(g)
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self

    def predict(self, texts: Sequence[str | bytes], windows_at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Class number and probability per text; every window of a text counts, by its length."""
        sums = np.zeros((len(texts), len(self.classes)))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> None:
            if held:
                x, who = np.concatenate(held), np.concatenate(owner)
                weight = (x != 0).sum(1) / self.length
                np.add.at(sums, who, self.log_probabilities(x) * weight[:, None])
                held.clear()
                owner.clear()

        waiting = 0
        for i, t in enumerate(texts):
            w = windows_of(t, self.length)
            for at in range(0, len(w), windows_at_once):
                part = w[at:at + windows_at_once]
                held.append(part)
                owner.append(np.full(len(part), i))
                waiting += len(part)
                if waiting >= windows_at_once:
                    flush()
                    waiting = 0
        flush()
        best = sums.argmax(1)
        p = np.exp(sums - sums.max(1, keepdims=True))
        return best, p[np.arange(len(texts)), best] / p.sum(1) if len(texts) else np.zeros(0)


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many of each language's rows are taken: all alike, and what small languages leave goes to the others; one each at least."""
    out: dict[str, int] = {}
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, (most - sum(out.values())) // (len(counts) - i)))
    return out


def train_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   max_rows: int = 4000, max_windows: int = 6, steps: int = 400, **net) -> ByteConvNet | None:
    """Fit a network on ``max_rows`` rows (a few less where hashes lie badly) with text and language, of each language those
    whose id has the smallest hash.

    Every language has rows among them, so that each is a class; more languages than ``max_rows`` are an error. Those rows are a bounded sample, and give ``max_windows`` windows each, spread over the
    text; both bounds hold for training alone. Without such rows there is no network (None).
    """
    shape = ByteConvNet([], **net)

    @F.pandas_udf("binary")
    def windows(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            w = windows_of(t, shape.length)
            out.append(w[np.unique(np.linspace(0, len(w) - 1, max_windows).astype(int))].tobytes())
        return pd.Series(out)

    ready = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    ready = ready.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)).alias("_h"))
    per_class = ready.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_h").alias("least")).collect()  # a row per class of the network
    counts, least = {r[0]: r.n for r in per_class}, {r[0]: r.least for r in per_class}
    if len(counts) > max_rows:
        raise ValueError(f"{len(counts)} languages are more than the {max_rows} rows of the sample")
    take = shares(counts, max_rows)
    if not take:
        return None
    most = max(take.values())
    # Hashes are uniform, so a language's rows of smallest hash lie below its share and six standard deviations;
    # the smallest of all is always taken, also where rows repeat one id.
    quota = docs.sparkSession.createDataFrame([(k, t, min(1.0, (t + 6 * t ** 0.5 + 10) / counts[k]), least[k]) for k, t in take.items()],
                                              "_lang string, _take int, _share double, _least long")

    def first(rows: DataFrame, *order: str) -> DataFrame:
        """Each language's share of rows in that order; only rows whose hash is small enough to be among them are ranked."""
        small = rows.join(F.broadcast(quota), "_lang").where(((F.col("_h") / F.lit(2.0 ** 64) + 0.5) <= F.col("_share")) | (F.col("_h") == F.col("_least")))
        ranked = small.withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy(*order))).where(F.col("_r") <= most)
        return ranked.where("_r <= _take").drop("_take", "_share", "_least")

    # The sample is found by language and hash alone; only its rows are cut into windows.
    picked = first(ready.select("_lang", "_h"), "_h").groupBy("_lang").agg(F.max("_h").alias("_most")).collect()
    picked = docs.sparkSession.createDataFrame([tuple(r) for r in picked], "_lang string, _most long")
    near = ready.join(F.broadcast(picked), "_lang").where("_h <= _most").select("_lang", "_h", windows("_text").alias("_w"))
    rows = first(near, "_h", "_w").select("_lang", "_h", "_w").orderBy("_h", "_lang", "_w").toPandas()
    shape.classes = sorted(rows["_lang"].unique())
    code = {c: i for i, c in enumerate(shape.classes)}
    xs = [np.frombuffer(w, np.uint8).reshape(-1, shape.length) for w in rows["_w"]]
    y = np.repeat([code[c] for c in rows["_lang"]], [len(x) for x in xs])
    return shape.start().fit(np.concatenate(xs), y, steps=steps)


def predict_language(model: ByteConvNet | None, text: Column) -> Column:
    """``struct(lang string, score double)``: ``und`` with score 0 for a text that is null or has no letter,
    and for every text where there is no network."""
    @F.pandas_udf("lang string, score double")
    def apply(texts: pd.Series) -> pd.DataFrame:
        best, score = model.predict([t if t is not None else "" for t in texts])
        return pd.DataFrame({"lang": [model.classes[i] for i in best], "score": score})

    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return none
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), apply(text)).otherwise(none)
