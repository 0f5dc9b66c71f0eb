"""Byte-level BPE by rank files: a minimal perfect hash for whole pre-tokens, a heap for the rest.

The vocabulary's N byte strings are hashed into buckets, and each bucket has a displacement under
which all its strings go to slots that no other string has; the slots are 0 to N - 1, so the
table has no gaps, and a lookup reads one displacement and one slot, whose string is then compared.
All distinct pre-tokens of a batch are looked up at once, as rows of 64-bit words. A pre-token that
is no entry is merged from its bytes: the bytes are a linked list, a heap holds the adjacent
pairs that are entries by rank, then place, and the smallest is joined until none is left. That is the
order in which the library merges. The tables hang on the vocabulary alone; every Python
worker makes them once. Encoding is in the row: no shuffle, and a lost task is simply done again.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import whole
from .token_files import vocabulary_path

# Letters and numbers of newer Unicode versions, which the regex module knows as such
# and the tiktoken library does not.
NEWER_LETTERS_AND_NUMBERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _rows(strings: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of at most ``8 * width`` bytes as rows of words (filled up with zeros), and their lengths."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    length = np.diff(offsets)
    out = np.zeros((len(strings), 8 * width), np.uint8)
    if data is not None and offsets[-1] > offsets[0]:
        place = np.arange(offsets[-1] - offsets[0]) + np.repeat(np.arange(len(length)) * 8 * width - (offsets[:-1] - offsets[0]), length)
        out.reshape(-1)[place] = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return out.view("<u8"), length


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: ``find`` gives each string's place in the list, or -1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        if len(set(keys)) != len(keys) or not keys:
            raise ValueError("the strings of a perfect hash must be distinct, and one at least")
        self.width = max(1, -(-max(map(len, keys)) // 8))
        self.n = len(keys)
        self.buckets = self.n // per_bucket + 1
        words, length = _rows(pa.array(keys, pa.large_binary()), self.width)
        for self.seed in range(1, 100):
            place = self._place(words, length)
            if place is not None:
                break
        else:
            raise RuntimeError("no perfect hash found")
        self.words, self.length, self.item = np.empty_like(words), np.empty_like(length), np.empty(self.n, np.int64)
        self.words[place], self.length[place], self.item[place] = words, length, np.arange(self.n)

    def _hashes(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(length.astype(np.uint64) + _U(self.seed) * _U(0x9E3779B97F4A7C15))
        for k in range(words.shape[1]):
            h = _mix(h ^ words[:, k]) + _U(k)
        return (h % _U(self.buckets)).astype(np.int64), _mix(h + _U(0x9E3779B97F4A7C15))

    def _slot(self, h: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        return (_mix(h ^ _mix(displacement.astype(np.uint64))) % _U(self.n)).astype(np.int64)

    def _place(self, words: np.ndarray, length: np.ndarray, tries: int = 1 << 18, step: int = 128) -> np.ndarray | None:
        """The slot of every string, ``self.displacement`` by the way; None if some bucket fits under no displacement."""
        bucket, h = self._hashes(words, length)
        size = np.bincount(bucket, minlength=self.buckets)
        order = np.argsort(bucket, kind="stable")
        begin = np.cumsum(size) - size
        self.displacement = np.zeros(self.buckets, np.int64)
        place, taken = np.empty(self.n, np.int64), np.zeros(self.n, bool)
        by_size = np.argsort(-size, kind="stable")
        for b in by_size[:int((size > 1).sum())].tolist():
            members = order[begin[b]:begin[b] + size[b]]
            for at in range(0, tries, step):
                slots = np.sort(self._slot(h[members][None, :], np.arange(at, at + step)[:, None]), axis=1)
                good = np.flatnonzero(~taken[slots].any(1) & (slots[:, 1:] != slots[:, :-1]).all(1))
                if len(good):
                    break
            else:
                return None
            self.displacement[b] = at + good[0]
            place[members] = self._slot(h[members], np.full(len(members), at + good[0]))
            taken[place[members]] = True
        # A string alone in its bucket takes any free slot, which its displacement names.
        alone = by_size[int((size > 1).sum()):int((size > 0).sum())]
        free = np.flatnonzero(~taken)
        self.displacement[alone] = -free - 1
        place[order[begin[alone]]] = free
        return place

    def find(self, strings: pa.Array) -> np.ndarray:
        """For each string of an Arrow array without nulls its place in the list of keys; -1 for strings that are no keys."""
        out = np.full(len(strings), -1, np.int64)
        binary = strings.cast(pa.large_binary())
        length = np.diff(np.frombuffer(binary.buffers()[1], np.int64)[binary.offset:binary.offset + len(binary) + 1]) if len(binary) else np.zeros(0, np.int64)
        fits = np.flatnonzero(length <= 8 * self.width)
        if len(fits):
            words, length = _rows(binary.take(pa.array(fits)), self.width)
            bucket, h = self._hashes(words, length)
            d = self.displacement[bucket]
            slot = np.where(d < 0, -d - 1, self._slot(h, np.maximum(d, 0)))
            equal = (self.length[slot] == length) & (self.words[slot] == words).all(1)
            out[fits] = np.where(equal, self.item[slot], -1)
        return out


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a piece's parts after joining, again and again, the adjacent pair of the lowest rank (the leftmost of equals)."""
    n = len(piece)
    m, get = n + 2, ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))  # part i is piece[i:after[i]]; of a part that is gone, after is n
    # (rank, start, end) of a pair in one number
    heap = [(r * m + i) * m + i + 2 for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        pair, end = divmod(heappop(heap), m)
        i = pair % m
        j = after[i]
        if j >= n or after[j] != end:
            continue  # one of the two has been joined with another part since
        after[j], after[i], before[end] = n, end, i
        if end < n and (r := get(piece[i:after[end]])) is not None:
            heappush(heap, (r * m + i) * m + after[end])
        if (k := before[i]) >= 0 and (r := get(piece[k:end])) is not None:
            heappush(heap, (r * m + k) * m + end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Ids of whole texts by the ranks of a file and a pattern of pre-tokens, as the tiktoken library gives them without special tokens.

    ``path``: lines of a base64 string and its rank; all single bytes must be among them.
    ``remember``: merged pre-tokens outside the vocabulary kept for later batches.
    """

    def __init__(self, path: str, pattern: str, remember: int = 400_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the rank file lacks the bytes {missing}")
        self.entries = list(self.ranks)
        self.rank = np.fromiter(self.ranks.values(), np.uint32, len(self.ranks))
        self.hash = PerfectHash(self.entries)
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.newer = re.compile(f"[{NEWER_LETTERS_AND_NUMBERS}]")
        new = NEWER_LETTERS_AND_NUMBERS
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])")
        for kind in (r"\p{L}", r"\p{N}"):
            strict = regex.sub(rf"(?<!\\s|\\p\{{L\}})(?<!\[\^[^\]]*){regex.escape(kind)}", lambda m: rf"(?:(?![{new}]){m[0]})", strict)
        self.strict = regex.compile(strict)
        self.known: dict[bytes, bytes] = {}
        self.remember = remember

    def _is_new(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.newer.search(text) is not None
        return False

    def _pieces(self, text: str, at_once: int = 250_000) -> Iterator[list[str]]:
        pattern = self.strict if self._is_new(text) else self.pattern
        if len(text) <= 2 * at_once:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while some := list(islice(found, at_once)):
                yield some

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after the other, and where each pre-token's ids end."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary())
        item = self.hash.find(distinct)
        length = np.ones(len(distinct), np.int64)
        missed = np.flatnonzero(item < 0)
        merged = []
        if len(self.known) > self.remember:  # the pieces learned last are the rarest
            for piece in list(islice(self.known, self.remember // 2, None)):
                del self.known[piece]
        for piece in distinct.take(pa.array(missed)).to_pylist():
            ids = self.known.get(piece)
            if ids is None:
                ids = array("I", merge_bytes(piece, self.ranks)).tobytes()
                if len(piece) <= 64:
                    self.known[piece] = ids
            merged.append(ids)
        length[missed] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        begin = np.cumsum(length) - length
        pool = np.empty(int(length.sum()), np.uint32)
        hit = np.flatnonzero(item >= 0)
        pool[begin[hit]] = self.rank[item[hit]]
        if merged:
            inside = np.frombuffer(b"".join(merged), np.uint32)
            n = length[missed]
            pool[np.arange(len(inside)) + np.repeat(begin[missed] - (np.cumsum(n) - n), n)] = inside
        index = np.asarray(coded.indices)
        each = length[index]
        ends = np.cumsum(each)
        return pool[np.arange(int(each.sum())) + np.repeat(begin[index] - (ends - each), each)], ends

    def encode_many(self, texts: list[str], at_once: int = 250_000) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush():
            if held:
                ids, ends = self._ids(held)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                upto = at = 0
                for i, k in owners:
                    upto += k
                    end = int(ends[upto - 1]) * 4
                    parts[i].append(bytes(raw[at:end]))
                    at = end
                held.clear()
                owners.clear()

        for i, text in enumerate(texts):
            for some in self._pieces(text, at_once):
                if some:
                    held += some
                    owners.append((i, len(some)))
                if len(held) >= at_once:
                    flush()
        flush()
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id that the file lacks is an error."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as e:
            raise ValueError(f"no entry has the id {e.args[0]}") from None


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _loaded(vocabulary: str, pattern: str | None) -> ByteBpe:
    """This worker's tables of a public tokenizer's file."""
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    if (vocabulary, pattern) not in _LOADED:
        _LOADED[vocabulary, pattern] = ByteBpe(vocabulary_path(vocabulary), pattern)
    return _LOADED[vocabulary, pattern]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken",
                 pattern: str | None = None) -> DataFrame:
    """One row per input row: ``id_col, n_tokens`` and ``ids``, the ids as little-endian unsigned 32-bit integers in a binary.

    ``pattern``: what finds the pre-tokens; that of the public tokenizers if None. Text that no
    match covers has no ids, as in the library. A null or empty text has no ids; the names of special
    tokens are text like any other. Repeated rows are encoded each; a null id stays null; an empty
    table gives an empty result. Other columns are not read. Texts of any length are encoded whole,
    a quarter of a million pre-tokens at a time.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary, pattern)
        for batch in batches:
            gc.disable()  # merging makes many small objects and no cycles
            try:
                ids = bpe.encode_many(batch["text"].to_pylist())
            finally:
                gc.enable()
            n = pa.array(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
            yield pa.RecordBatch.from_arrays([batch["id"], n, pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {id_type}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(ids: Column, vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> Column:
    """The bytes of a column of ids as ``encode_texts`` gives them; null gives no bytes."""
    @F.arrow_udf("binary")
    def decode(batch: pa.Array) -> pa.Array:
        bpe = _loaded(vocabulary, pattern)
        return pa.array([bpe.decode(x or b"") for x in batch.to_pylist()], pa.binary())

    return decode(ids)
