"""Fill-in-the-middle examples cut at unit boundaries, found eight bytes at a time.

A unit is a run of A-Z and a-z or any other single code point. The texts of an Arrow batch lie
one after the other in UTF-8, so the kernel reads them as 64-bit words: a few additions and
shifts mark, in bit 7 of every byte, the bytes at which a unit ends. ``bitwise_count`` of the
marked words, summed up, is the number of units before each word; the word that holds unit ``k``
is found by binary search in those sums, and the byte inside the word by comparing ``k`` with the
running counts of its eight bytes, which one multiplication makes. Code points are counted on
the same words. The kernel never looks at a character by itself, and all texts of a batch are
cut at once. Work is in the row: no shuffle, and a lost task is simply done again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import whole

#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")

_U = np.uint64
_ONES = _U(0x0101010101010101)
_TOP = _U(0x8080808080808080)
_LOW7 = _U(0x7F7F7F7F7F7F7F7F)


def _letters(w: np.ndarray) -> np.ndarray:
    """Bit 7 of every byte that is an ASCII letter."""
    folded = (w | _U(0x20) * _ONES) & _LOW7
    from_a = folded + _U(0x80 - ord("a")) * _ONES
    past_z = folded + _U(0x80 - ord("z") - 1) * _ONES
    return from_a & ~past_z & ~w & _TOP


def _inside(w: np.ndarray) -> np.ndarray:
    """Bit 7 of every byte that continues a code point."""
    return w & ~(w << _U(1)) & _TOP


class UnitIndex:
    """Ranks and selects of units and code points over a buffer of UTF-8 texts.

    ``data``: the bytes; ``offsets``: the first byte of each text and the end of the last.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = 1 << 16):
        self.offsets = offsets.astype(np.int64)
        first, end = int(self.offsets[0]), int(self.offsets[-1])
        self.offsets -= first
        n = end - first
        words = np.zeros(n // 8 + 2, "<u8")  # one word at least follows the last byte
        words.view(np.uint8)[:n] = data[first:end]
        self.ends = np.empty(len(words), "<u8")
        self.leads = np.empty(len(words), "<u8")
        for at in range(0, len(words), block):
            w = words[at:at + block + 1]
            letter, inside = _letters(w), _inside(w)
            k = min(block, len(words) - at)
            # the marks of each byte's successor: the word moved down by a byte, the next word's first byte on top
            after = np.zeros((2, k), "<u8")
            after[0, :len(w) - 1] = letter[1:k + 1] << _U(56)
            after[1, :len(w) - 1] = inside[1:k + 1] << _U(56)
            next_letter, next_inside = (letter[:k] >> _U(8)) | after[0], (inside[:k] >> _U(8)) | after[1]
            self.ends[at:at + k] = _TOP & ~next_inside & ~(letter[:k] & next_letter)
            self.leads[at:at + k] = _TOP & ~inside[:k]
        # A unit ends with its text, whatever the next text starts with; bytes after the last text count for nothing.
        last = self.offsets[1:][self.offsets[1:] > self.offsets[:-1]] - 1
        np.bitwise_or.at(self.ends, last >> 3, _U(0x80) << ((last & 7) << 3).astype(np.uint64))
        for marks in (self.ends, self.leads):
            marks[n >> 3] &= (_U(1) << _U((n & 7) << 3)) - _U(1)
            marks[(n >> 3) + 1:] = 0
        self.ends_before = self._before(self.ends)
        self.leads_before = self._before(self.leads)

    @staticmethod
    def _before(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=total[1:])
        return total

    @staticmethod
    def _rank(marks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before ``at``."""
        below = (_U(1) << ((at & 7) << 3).astype(np.uint64)) - _U(1)
        return before[at >> 3] + np.bitwise_count(marks[at >> 3] & below)

    def units(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self._rank(self.ends, self.ends_before, self.offsets))

    def after_unit(self, count: np.ndarray) -> np.ndarray:
        """For each text, the byte of the buffer after its first ``count`` units."""
        start = self.offsets[:-1]
        wanted = self._rank(self.ends, self.ends_before, start) + count  # the wanted-th mark of the buffer, from 1
        word = np.maximum(np.searchsorted(self.ends_before, wanted, "left") - 1, 0)
        inside = np.clip(wanted - self.ends_before[word], 1, 8).astype(np.uint64)
        running = (self.ends[word] >> _U(7)) * _ONES  # byte j: marks in bytes 0 to j
        reached = ((running | _TOP) - inside * _ONES) & _TOP
        return np.where(count == 0, start, word * 8 + (8 - np.bitwise_count(reached)) + 1)

    def code_points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._rank(self.leads, self.leads_before, end) - self._rank(self.leads, self.leads_before, start)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def cut_batch(texts: pa.Array, draw1: np.ndarray, draw2: np.ndarray, form: Sequence[str], markers: Sequence[str] = MARKERS) -> pa.StructArray:
    """``n, prefix_chars, middle_chars, output`` for each text of an Arrow array without nulls."""
    data, offsets = _buffers(texts)
    index = UnitIndex(data, offsets)
    n = index.units()
    one, two = draw1 % (n + 1), draw2 % (n + 1)
    base = int(offsets[0])
    start, end = index.offsets[:-1], index.offsets[1:]
    a, b = index.after_unit(np.minimum(one, two)), index.after_unit(np.maximum(one, two))
    form = np.asarray(form, dtype=object)
    plain = form == "plain"
    prefix, middle = index.code_points(start, a), index.code_points(a, b)
    p, s, m = (x.encode() for x in markers)
    raw = memoryview(data)[base:]
    out = []
    for f, t0, t1, t2, t3 in zip(form, start.tolist(), a.tolist(), b.tolist(), end.tolist()):
        if f == "plain":
            out.append(bytes(raw[t0:t3]))
        elif f == "psm":
            out.append(b"".join((p, raw[t0:t1], s, raw[t2:t3], m, raw[t1:t2])))
        else:
            out.append(b"".join((s, raw[t2:t3], p, raw[t0:t1], m, raw[t1:t2])))
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
        ["n", "prefix_chars", "middle_chars", "output"])


def draws(key: Column, epoch: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers: the first four groups of 8 digits of the hex sha256 of ``epoch:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20,
                   epoch: int = 1, markers: Sequence[str] = MARKERS) -> DataFrame:
    """One row per input row: ``id_col, n, form, prefix_chars, middle_chars, output``.

    ``n``: units of the whole text. ``form``: ``plain`` (the text as it is) for empty texts, texts
    that hold a marker and about ``plain_percent`` in 100 of the others; else ``spm`` for about
    ``spm_percent`` in 100 and ``psm`` for the rest. Cuts and forms depend on id and epoch alone,
    so equal ids with equal texts get equal rows, and reruns agree. The two lengths are in code
    points, null where the form is plain. A null text is the empty text, a null id an empty one. An
    empty table gives an empty result. Other columns are not read; a text of any length is cut
    as a whole.
    """
    h1, h2, h3, h4 = draws(F.col(id_col), epoch)
    text = whole(text_col)
    held = F.lit(False)
    for m in markers:
        held = held | F.contains(text, F.lit(m))
    form = F.when((text == "") | held | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = cut_batch(batch["text"], batch["h1"].to_numpy(), batch["h2"].to_numpy(), batch["form"].to_pylist(), markers)
                n, prefix, middle, output = got.flatten()
                yield pa.RecordBatch.from_arrays([batch["id"], n, batch["form"], prefix, middle, output],
                                                 names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = df.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(cut, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of a form was made from.

    No marker lies in a text that is not plain, and no part of one ends where another begins, so
    the parts between the markers are those that were put there.
    """
    parts = F.split(output, "|".join(r"\Q" + m + r"\E" for m in markers), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2)))
            .otherwise(F.concat(part(2), part(3), part(1))))
