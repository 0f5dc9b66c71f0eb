"""SimHash near-duplicates by anchor-point covering.

Fingerprints: bit i is set when more than half of a text's shingle hashes have it; computed in
Arrow batches, shingle by shingle in bounded chunks, and written once (24 bytes a row).

Links: equal fingerprints are one node, so copies cost nothing from here on. Two fingerprints
with at most ``d`` differing bits have at most ``d // blocks`` of them in one of ``blocks`` equal
blocks. In a block, the anchors are the codewords of the Hamming code of length 2^m - 1 on its
first bits, a perfect code of covering radius 1: every block value has one anchor within
distance 1, its home. A fingerprint goes to its home, and as a copy to every anchor within
1 + ``d // blocks``; a pair that is close in the block then meets at the home of either one, and
is compared there on all 64 bits. Nothing is emitted but the links.

Components: contraction over links of distinct fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components
from .text import row_key, text_version

_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 without a word."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles: Iterator[bytes] = iter([b" ".join(w)])
        count = 1
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(w, i, None) for i in range(words))))
        count = len(w) - words + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        n = min(_CHUNK, count - at)
        h = np.fromiter((digest(s, seed) for s in itertools.islice(shingles, n)), np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, version, fp`` per row (``version`` a hash of the text, ``fp`` the fingerprint's 64 bits as a signed long); null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), pa.array(fps.view(np.int64))], names=["id", "version", "fp"])

    rows = df.select(F.col(id_col).alias("id"), text_version(text_col).alias("version"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, version long, fp long")


class HammingBlock:
    """The perfect Hamming code of length n = 2^m - 1 as anchors of an n-bit block.

    The syndrome of a value (the exclusive-or of the positions, from 1, of its set bits) is 0 for a
    codeword, and otherwise the position of the bit that leads to the one codeword at distance 1.
    """

    def __init__(self, m: int):
        self.n = (1 << m) - 1
        # bit k of the syndrome is the parity of the value under a fixed mask
        self.masks = [sum(1 << (p - 1) for p in range(1, self.n + 1) if p >> k & 1) for k in range(m)]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for k, mask in enumerate(self.masks):
            out |= (np.bitwise_count(x & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
        return out

    @staticmethod
    def flip(x: np.ndarray, position: np.ndarray) -> np.ndarray:
        """x with the bit of a position (from 1) changed; position 0 changes nothing."""
        bit = np.where(position > 0, np.uint64(1) << (np.maximum(position, 1) - 1).astype(np.uint64), 0).astype(np.uint64)
        return x ^ bit

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.flip(x, self.syndrome(x))

    def within(self, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) for all anchors within ``distance``, which is at least the covering radius 1.

        Changing ``distance - 1`` bits or fewer and going home from there reaches each of them.
        """
        rows, anchors = [], []
        for k in range(distance):
            for bits in itertools.combinations(range(self.n), k):
                rows.append(np.arange(len(x)))
                anchors.append(self.home(x ^ np.uint64(sum(1 << b for b in bits))))
        both = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(anchors)], 1), axis=0)
        return both[:, 0].astype(np.int64), both[:, 1]


def deal_to_anchors(fps: DataFrame, max_bits: int, blocks: int = 2, slice_rows: int = 20_000) -> DataFrame:
    """``anchor, fp, home`` for distinct fingerprints ``fp``: a row for each block's home and copies."""
    width = 64 // blocks
    m = (width + 1).bit_length() - 1
    code, reach = HammingBlock(m), 1 + max_bits // blocks
    if reach > 3:
        raise ValueError("more blocks are needed: a block may differ in two bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            everything = np.asarray(batch.column("fp")).astype(np.int64).view(np.uint64)
            for at in range(0, len(everything), slice_rows):
                fp = everything[at:at + slice_rows]
                for block in range(blocks):
                    x = (fp >> np.uint64(block * width)) & np.uint64((1 << code.n) - 1)
                    rows, anchors = code.within(x, reach)
                    home = anchors == code.home(x)[rows]
                    key = anchors | np.uint64(block) << np.uint64(58)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(fps: DataFrame, max_bits: int = 3, blocks: int = 2, rows_per_task: int = 20_000) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints (``fp``, each once) with ``max_bits`` or fewer differing bits.

    Fingerprints are few bytes but become about thirty rows each, so they are dealt over tasks by their number and not by
    their size. The join is one that Spark splits where an anchor holds very many fingerprints.
    """
    tasks = max(1, -(-fps.count() // rows_per_task))
    dealt = materialise(deal_to_anchors(fps.select("fp").repartition(tasks, "fp"), max_bits, blocks), "anchors")
    homes = dealt.where("home").select("anchor", F.col("fp").alias("a"))
    copies = dealt.select("anchor", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return homes.join(copies, (homes["anchor"] == copies["anchor"]) & close).select("a", "b")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits), ``component_id``, ``version, root``.

    ``component_id`` is the smallest id in the row's component of links, itself included. Shingles
    are ``words`` words with repeats; fewer words are one shingle; a text without words (or null)
    has fingerprint 0 and is linked like any other. Rows that repeat an id or a text lie in one
    component. A null id counts only where its component has no other: then ``component_id`` is
    null, and ``root`` (a fingerprint of the component) still tells components apart. An empty table gives an empty result. Other columns are not read.
    """
    fps = materialise(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links(nodes, max_bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "root", "component_id")
    return fps.join(of_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "version", "root")


def keep_one_of_each(df: DataFrame, components: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` (all columns) that stay when one of each of its ``components`` does.

    That is the row of the smallest id (null last), then of the smallest text hash; of rows that
    agree in both, any one.
    """
    best = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "version")).alias("x")
    keep = components.groupBy("root").agg(best).select(row_key(F.col("x.id"), F.col("x.version")).alias("key"))
    rows = df.select(F.struct("*").alias("row"), row_key(F.col(id_col), text_version(text_col)).alias("key"))
    # Merged at any size, so that the rows are moved once and lie by key for the next step.
    kept = rows.join(keep.hint("merge"), "key", "left_semi")
    return kept.groupBy("key").agg(F.first("row").alias("row")).select("row.*")
