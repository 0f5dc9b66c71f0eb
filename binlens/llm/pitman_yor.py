"""Seating of a hierarchical Pitman-Yor process, and tokens of texts in blocks.

A restaurant with discount d, concentration q, c customers of a dish at t tables (C and T in all) gives the
dish (c - d t + (q + d T) P(dish in the parent)) / (q + C).

Seating: a Gibbs sweep takes all customers of a dish in a restaurant away and seats them again one
by one, each at a new table with the probability of the Chinese restaurant process given how many
are seated, the tables of the whole restaurant and the parent's probability after the sweep
before; each table sends a customer to the parent. Beyond ``EXACT`` customers they arrive in
blocks of a sixteenth of those seated, with the block's new tables drawn at once, so that a dish of
any size takes a number of steps like its logarithm. Random numbers are hashes of dish, sweep and
step, so retried tasks agree. ``word_model`` has the restaurants, the sweeps as Spark jobs and the scores.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = b""  # the end of a text, counted as a token; also the context of its first token
EXACT = 64
_FLUSH = 400_000
_MANY = 0xFFFF


def tokens_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words and the end."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


# Seating

def _uniform(key: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys (the finishing steps of splitmix64)."""
    with np.errstate(over="ignore"):
        x = key + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + step + (sweep << 32))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def _draw(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many of ``n`` customers open a table: by inversion where that is few, else by the normal law."""
    mean = n * p
    out = np.zeros(len(n))
    few = mean < 20
    if few.any():
        m, w = mean[few], u[few]
        term, k = np.exp(-m), np.zeros(len(m))
        total = term.copy()
        for i in range(1, 80):
            more = w > total
            if not more.any():
                break
            k += more
            term = term * m / i
            total += term
        out[few] = k
    if not few.all():
        z = np.sqrt(-2 * np.log(u[~few])) * np.cos(2 * np.pi * v[~few])
        out[~few] = np.rint(mean[~few] + z * np.sqrt(mean[~few] * (1 - p[~few])))
    return np.clip(out, 0, n)


def seat(c: np.ndarray, new: np.ndarray, d: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of ``c`` customers each; ``new``: the weight (q + d T) P(parent) of another table."""
    order = np.argsort(-c, kind="stable")
    c, new, key = c[order].astype(np.float64), new[order], key[order]
    t = (c > 0).astype(np.float64)
    seated, step = 1.0, 0
    left = int(np.searchsorted(-c, -1.0, side="left"))  # rows with more than one customer come first
    while left:
        n = 1.0 if seated < EXACT else np.floor(seated / 16)
        size = np.minimum(n, c[:left] - seated)
        mid = seated + (size - 1) / 2
        p = new[:left] / (mid - d * t[:left] + new[:left])
        u = _uniform(key[:left], sweep, 2 * step)
        t[:left] += (u < p) if n == 1 else _draw(size, np.clip(p, 0, 1), u, _uniform(key[:left], sweep, 2 * step + 1))
        seated, step = seated + n, step + 1
        left = int(np.searchsorted(-c[:left], -seated, side="left"))
    out = np.empty_like(t)
    out[order] = t
    return out


def discount(counts: DataFrame, col: str) -> float:
    """The discount from the numbers of dishes with one and two customers."""
    return discount_of(*counts.agg(F.count(F.when(F.col(col) == 1, 1)), F.count(F.when(F.col(col) == 2, 1))).first())


def discount_of(one: int | None, two: int | None) -> float:
    one, two = one or 0, two or 0
    return float(np.clip(one / (one + 2 * two) if one else 0.5, 0.05, 0.95))


# Symbols


class Block:
    """The tokens of some texts as numbers: their words are numbered as they come up."""

    def __init__(self):
        self.number, self.ids, self.lengths, self.bytes = defaultdict(), [], [], 0
        self.number.default_factory = self.number.__len__

    def add(self, text: bytes | None) -> int:
        toks = tokens_of(text)
        self.ids.append(np.fromiter(map(self.number.__getitem__, toks), np.int32, len(toks)))
        self.lengths.append(len(toks))
        self.bytes += len(text or b"")
        return self.bytes
