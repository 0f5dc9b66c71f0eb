"""Counting kernels over Arrow batches: one pass over the buffer that holds all contents of a batch.

Each kernel takes an Arrow array and returns numpy arrays with a row per file; nothing is boxed per
row, and work arrays are bounded by ``CHUNK`` bytes of content at a time beside one byte per content byte.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa

from .patterns import MIN_STRING, patterns, required_literals

WINDOW = 2048
STEP = 1024
CHUNK = 1 << 20


def flat_bytes(contents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string array one after the other, and where each row begins (and the last ends); nulls are empty."""
    contents = contents.cast(pa.large_binary())
    if contents.null_count:
        contents = contents.fill_null(b"")
    _, offsets, data = contents.buffers()
    offsets = np.frombuffer(offsets, np.int64)[contents.offset:contents.offset + len(contents) + 1] if len(contents) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


_MD5_TURNS = np.tile(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32), (1, 4)).reshape(-1)
_MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)


def md5_heads(prefix: bytes, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of the first 8 hex digits of md5(``prefix`` + part), for the parts of ``data`` between ``edges``.

    Parts that fit in one block of md5 with the prefix are hashed together, longer ones one by one."""
    edges = edges.astype(np.int64)
    size, at = np.diff(edges) + len(prefix), len(prefix)
    out = np.empty(len(size), np.uint32)
    for i in np.flatnonzero(size > 55):
        out[i] = int.from_bytes(hashlib.md5(prefix + data[edges[i]:edges[i + 1]].tobytes()).digest()[:4])
    short = np.flatnonzero(size <= 55)
    size = size[short]
    block = np.zeros((len(short), 64), np.uint8)
    block[:, :at] = np.frombuffer(prefix[:64], np.uint8) if len(short) else 0
    for j in range(int(size.max(initial=0)) - at):
        rows = np.flatnonzero(size > at + j)
        block[rows, at + j] = data[edges[short[rows]] + j]
    block[np.arange(len(short)), size] = 0x80
    block[:, 56:] = (size * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    words = np.ascontiguousarray(block.view("<u4").T)
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(short), x) for x in first)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _MD5_ADDED[i] + words[g]
        a, d, c, b = d, c, b, b + ((f << _MD5_TURNS[i]) | (f >> (np.uint32(32) - _MD5_TURNS[i])))
    out[short] = (a + first[0]).astype("<u4").view(">u4")
    return out


def _grouped_counts(values: np.ndarray, edges: np.ndarray, width: int) -> np.ndarray:
    """Counts (groups x width) of the byte values in each group; ``edges``: where groups begin, and the end."""
    out = np.zeros((len(edges) - 1, width), np.int64)
    flat = out.reshape(-1)
    for at in range(0, len(values), CHUNK):
        part = values[at:at + CHUNK]
        first = int(np.searchsorted(edges, at, "right")) - 1
        last = int(np.searchsorted(edges, at + len(part), "left"))
        sizes = np.diff(np.clip(edges[first:last + 1], at, at + len(part)))
        cell = np.repeat(np.arange(last - first) * width, sizes) + part
        flat[first * width:last * width] += np.bincount(cell, minlength=(last - first) * width)
    return out


def histograms(contents: pa.Array) -> np.ndarray:
    """256 byte counts per row."""
    data, offsets = flat_bytes(contents)
    return _grouped_counts(data, offsets, 256)


def entropy_histograms(contents: pa.Array, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    """16 x 16 (entropy bin of the window, high nibble) counts per row, row-major, over windows at every ``step`` bytes.

    Contents shorter than a window are one window; p still divides by ``window``. Incomplete windows at the end are left out.
    Bytes are counted once, in blocks of the greatest common divisor of window and step; windows add blocks.
    """
    data, offsets = flat_bytes(contents)
    n = len(offsets) - 1
    size = np.diff(offsets)
    block = int(np.gcd(window, step))
    blocks = -(-size // block)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    inside = np.arange(total) - np.repeat(first, blocks)
    edges = np.append(np.repeat(offsets[:-1], blocks) + inside * block, offsets[-1])
    upto = np.zeros((total + 1, 16), np.int64)
    np.cumsum(_grouped_counts(data >> 4, edges, 16), axis=0, out=upto[1:])
    windows = np.where(size >= window, (size - window) // step + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(n), windows)
    nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    start = first[row] + nth * (step // block)
    counts = upto[np.minimum(start + window // block, first[row] + blocks[row])] - upto[start]
    p = counts / float(window)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(counts > 0, -p * np.log2(np.where(counts > 0, p, 1.0)), 0.0).sum(axis=1) * 2
    cell = (row * 16 + np.minimum((h * 2).astype(np.int64), 15))[:, None] * 16 + np.arange(16)
    return np.bincount(cell.reshape(-1), weights=counts.reshape(-1), minlength=n * 256).astype(np.int64).reshape(n, 256)


@cache
def _matcher(fixed: bool):
    """(names, automaton of the literals, patterns with literals, patterns without) of the pattern list."""
    import ahocorasick
    names, literal, other, plain = [], {}, [], {}
    for i, (name, pattern) in enumerate(patterns(fixed)):
        names.append(name)
        needs, whole = required_literals(name, pattern)
        ci = pattern.startswith("(?i)")
        for text in needs:
            # a whole literal is a match by itself, other literals only make their string a candidate
            literal.setdefault(text.lower(), []).append((i, None if ci else text, whole))
        if not needs:
            other.append((i, re.compile(pattern)))
        elif not whole:
            plain[i] = re.compile(pattern)
    automaton = ahocorasick.Automaton()
    for text, what in literal.items():
        automaton.add_word(text, (len(text), tuple(what)))
    automaton.make_automaton()
    return names, automaton, plain, other


def pattern_strings(strings: list[str], fixed: bool = False) -> np.ndarray:
    """Rows (string, pattern) of all patterns that each string matches at least once (``re.search``), in any order.

    One automaton reads the strings joined by line feeds, which no pattern can match, and finds the literals that patterns must
    contain; the regular expressions of the others run over the joined text as a whole.
    """
    names, automaton, candidates, other = _matcher(fixed)
    joined = "\n".join(strings)
    lowered = joined.lower()
    if len(lowered) != len(joined):  # letters whose lower case is longer: strings one by one
        return np.array([(s, i) for s, text in enumerate(strings) for i, (_, p) in enumerate(patterns(fixed)) if re.search(p, text)], np.int64).reshape(-1, 2)
    begin = np.zeros(len(strings) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 1, out=begin[1:])
    at, which = [], []
    loose: dict[int, set[int]] = {}
    for end, (size, what) in automaton.iter(lowered):
        for i, text, whole in what:
            if text is not None and joined[end - size + 1:end + 1] != text:
                continue
            if whole:
                at.append(end)
                which.append(i)
            else:
                loose.setdefault(i, set()).add(end)
    for i, ends in loose.items():
        for s in np.unique(np.searchsorted(begin, np.fromiter(ends, np.int64, len(ends)), "right") - 1).tolist():
            if candidates[i].search(strings[s]):
                at.append(int(begin[s]))
                which.append(i)
    for i, expression in other:
        for m in expression.finditer(joined):
            at.append(m.start())
            which.append(i)
    found = np.stack([np.searchsorted(begin, np.array(at, np.int64), "right") - 1, np.array(which, np.int64)], 1)
    return np.unique(found, axis=0)


def _slices(lengths: np.ndarray, at_once: int) -> list[tuple[int, int]]:
    """Runs of rows with about ``at_once`` characters each."""
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // at_once)) + 1
    bounds = [0, *cuts.tolist(), len(lengths)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]


def pattern_counts(strings: list[str], owner: np.ndarray, rows: int, fixed: bool = False, at_once: int = 4 << 20) -> np.ndarray:
    """Strings that match, per (row, pattern in name order); ``owner``: each string's row."""
    k = len(patterns(fixed))
    out = np.zeros(rows * k, np.int64)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for a, b in _slices(lengths, at_once):
        found = pattern_strings(strings[a:b], fixed)
        out += np.bincount(owner[a + found[:, 0]] * k + found[:, 1], minlength=rows * k)
    return out.reshape(rows, k)


_PRINTABLE = re.compile(rb"[\x20-\x7f]{%d,}" % MIN_STRING)


def printable_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Printable runs of all rows, and the row of each."""
    out, counts = [], []
    view = memoryview(np.ascontiguousarray(data))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        runs = _PRINTABLE.findall(view[a:b]) if b > a else []
        out += runs
        counts.append(len(runs))
    return out, np.repeat(np.arange(len(counts)), counts)


def shannon(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row of counts; 0 for rows without any."""
    total = counts.sum(axis=1, keepdims=True).astype(np.float64)
    p = counts / np.maximum(total, 1)
    return np.maximum(-(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1), 0.0)


def list_column(values: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column; rows marked ``null`` are null."""
    n, k = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * k)
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)), mask=None if null is None or not null.any() else pa.array(null))


def nulls(array: pa.Array) -> np.ndarray:
    return array.is_null().to_numpy(zero_copy_only=False)
