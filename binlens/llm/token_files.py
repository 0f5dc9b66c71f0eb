"""Token ids in files of bit-plane-shuffled, compressed blocks with a chunk index.

Format: a folder ``ids`` of Parquet files, one row per block of at most ``block_ids`` ids, in the
order (``part``, ``block``): ``first`` (ids of the part before the block), ``n_ids``, ``planes`` (the
little-endian 32-bit ids transposed into 4 byte planes, or 32 bit planes, each compressed with
zstandard on its own), and the chunk index: for each document piece in the block, ``docs`` (its
id), ``seq`` (the document's number in the part), ``piece`` (0, 1, ... within the document),
``at`` and ``count`` (its ids in the block). A block is decoded alone, and a document found from
the index columns without touching planes. Spark's writer commits the files, so lost tasks leave
nothing behind, and any store that Spark writes to will do.

Order: documents are dealt over range partitions by id before they are encoded, and encoded in
sorted order. ``start`` of a document is the sum of the parts before (a small table) plus its
offset in its part.
"""

from __future__ import annotations

import gc
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

_CACHE: dict[str, dict[str, bytes]] = {}
_TOKENIZERS: dict[str, object] = {}


def vocabulary_path(name: str) -> str:
    """The place of a public tokenizer's file on the machine where this runs."""
    import public_tokenizers
    return public_tokenizers.path(name)


#: white space of any script but single spaces and line feeds inside a text, or a zero byte
_ODD_SPACE = (r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
              r"|[ \n][ \n]|\A[ \n]|[ \n]\z")


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, as little-endian 32-bit bytes.

    Its pre-tokenizer always cuts before a single space, and around a single line feed, between
    characters that are not white space, and between a letter and a full stop or comma. Pieces
    between such cuts are found by Arrow, encoded by the library once and remembered (up to
    ``remember`` short pieces); a text with any other white space goes to the library whole.
    The tokenizer is used as loaded: the name of a special token in a text is that token's one id.
    """

    def __init__(self, name: str, remember: int = 1_200_000):
        if name not in _TOKENIZERS:
            import os
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer
            _TOKENIZERS[name] = Tokenizer.from_file(vocabulary_path(name))
        self.tokenizer, self.known, self.remember = _TOKENIZERS[name], _CACHE.setdefault(name, {}), remember
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def library(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        ids = [array("I", e.ids) for e in found]
        if sys.byteorder == "big":
            for x in ids:
                x.byteswap()
        return [x.tobytes() for x in ids]

    def joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, encoded as lines of one text: lines are cut apart where the line feed's id is.

        A line feed that became part of another token shows in their number; the pieces are then encoded one by one.
        """
        if self.feed is None:
            return self.library(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ids == self.feed)
        if len(cut) != len(pieces) - 1:
            return self.library(pieces)
        raw = ids.tobytes()
        return [raw[4 * x:4 * y] for x, y in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])]

    def _learn(self, pieces: set[str]) -> None:
        known = self.known
        stems = [p for p in pieces if p[-1:] in (".", ",") and p[-2:-1].isalpha()]
        new = list((pieces.difference(stems) | {p[:-1] for p in stems} | {".", ","}).difference(known))
        lines = {p for p in ("", "\n") if p in new}
        known.update(zip(lines, self.library(list(lines))))
        new = [p for p in new if p not in lines]
        for at in range(0, len(new), 2_000):
            known.update(zip(new[at:at + 2_000], self.joined(new[at:at + 2_000])))
        known.update([(p, known[p[:-1]] + known[p[-1]]) for p in stems])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        known = self.known
        if len(known) > self.remember:  # the pieces learned last are the rarest
            for p in list(known)[self.remember // 2:]:
                del known[p]
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        plain = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        missing = set(filterfalse(known.__contains__, pieces))
        self._learn(missing)
        found = list(map(known.__getitem__, pieces))
        for p in [p for p in missing if len(p) > 48]:
            del known[p]
        # every piece's ids in the place of the piece
        pool = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = np.asarray(coded.indices)
        each = length[index]
        ends = np.cumsum(each)
        begin = (np.cumsum(length) - length)[index]
        ids = pool[np.arange(int(each.sum())) + np.repeat(begin - (ends - each), each)]
        upto = np.concatenate(([0], ends))
        offsets = np.asarray(cut.offsets)
        counts = upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]
        where = np.flatnonzero(np.asarray(odd))
        if len(where):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, t in zip(where, texts.take(pa.array(where)).to_pylist()):
                parts[i] = np.frombuffer(self.library([t])[0], "<u4")
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode_array(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[e - n:e].tobytes() for e, n in zip(ends, counts)]


def shuffle_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The byte or bit planes of 32-bit ids, lowest first, each compressed."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [raw[:, k].tobytes() for k in range(4)]
    elif kind == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    else:
        raise ValueError(f"no such planes: {kind}")
    return [zstandard.compress(p, 3) for p in planes]


def unshuffle_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of ``n`` from its 4 byte planes or 32 bit planes."""
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(zstandard.decompress(p), np.uint8) for p in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(zstandard.decompress(p), np.uint8), bitorder="little")[:n] for p in planes], 1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)[:n]


def _image(columns: list[int], v: int) -> int:
    """A vector of bits under a linear map, given by the images of the 32 bits."""
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= columns[k]
        v, k = v >> 1, k + 1
    return out


@cache
def _zeros_appended(power: int) -> list[int]:
    """What 2 ** power zero bytes do to the state of a crc32."""
    if power == 0:
        return [zlib.crc32(b"\0", (1 << k) ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for k in range(32)]
    half = _zeros_appended(power - 1)
    return [_image(half, c) for c in half]


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from theirs; ``length``: of the second."""
    power = 0
    while length:
        if length & 1:
            first = _image(_zeros_appended(power), first)
        length, power = length >> 1, power + 1
    return first ^ second


def _file_rows(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())),
                      ("docs", pa.list_(id_type)), ("seq", pa.list_(pa.int64())), ("piece", pa.list_(pa.int32())),
                      ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.int32()))])


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of texts of about ``size`` bytes."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(total // size)) + 1
    bounds = [0, *cuts.tolist(), len(texts)]
    return ((a, b - a) for a, b in zip(bounds, bounds[1:]) if b > a)


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json",
                      end_id: int = 2, block_ids: int = 1 << 16, kind: str = "byte", slice_bytes: int = 4 << 20, remember: int = 1_200_000) -> None:
    """Encode every whole text (null: empty) by the tokenizer as loaded, end it with ``end_id``, and write the ids to ``path`` by ascending id.

    Null ids come first; rows that repeat an id stand side by side, ordered by a hash of their
    texts. Texts of any length flow from block to block. An empty table gives an empty folder.
    ``remember`` bounds the pieces a worker keeps (about 200 bytes each): fewer cost time.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    id_type = pa.int64() if rows.schema["id"].dataType.simpleString() == "bigint" else pa.string()
    if id_type == pa.string():
        rows = rows.withColumn("id", F.col("id").cast("string"))
    schema = _file_rows(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(vocabulary, remember), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held, index, first, block, seq = bytearray(), [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal first, block
            ids = np.frombuffer(bytes(held), "<u4")
            cols = list(zip(*index))
            out = pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip([part, block, first, len(ids), shuffle_planes(ids, kind), *map(list, cols)], schema)], schema=schema)
            first, block = first + len(ids), block + 1
            held.clear()
            index.clear()
            return out

        gc.disable()  # millions of small strings are remembered, and no cycles are made
        for batch in batches:
            for at, size in _slices(batch.column("text"), slice_bytes):
                some = batch.slice(at, size)
                ids, counts = encoder.encode_array(some.column("text"))
                ends = np.cumsum(counts)
                for name, own in zip(some.column("id").to_pylist(), (ids[e - n:e].tobytes() for e, n in zip(ends, counts))):
                    ids_, piece, done = own + end, 0, 0
                    while done < len(ids_):
                        take = min(len(ids_) - done, 4 * block_ids - len(held))
                        index.append((name, seq, piece, len(held) // 4, take // 4))
                        held += ids_[done:done + take]
                        done, piece = done + take, piece + 1
                        if len(held) == 4 * block_ids:
                            yield close()
                    seq += 1
        gc.enable()
        if held:
            yield close()

    kind_of = "bigint" if id_type == pa.int64() else "string"
    rows.mapInArrow(run, "part int, block long, first long, n_ids int, planes array<binary>, "
                         f"docs array<{kind_of}>, seq array<long>, piece array<int>, at array<int>, count array<int>").write.parquet(f"{path}/ids")


def read_token_files(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document in files read with ``spark.read.parquet(path + "/ids")``.

    Every block is decoded and every document's ids are summed from it; pieces of a document
    that lies in several blocks are joined by their crc32 in order.
    """
    kind = df.schema["docs"].dataType.elementType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                ids = unshuffle_planes(r["planes"], r["n_ids"])
                for name, seq, piece, at, count in zip(r["docs"], r["seq"], r["piece"], r["at"], r["count"]):
                    out.append((r["part"], seq, name, piece, r["first"] + at, count, zlib.crc32(ids[at:at + count])))
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int32(), pa.int64(), id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["part", "seq", "id", "piece", "at", "n", "crc"])

    pieces = df.mapInArrow(run, f"part int, seq long, id {kind}, piece int, at long, n long, crc long")
    pieces = materialise(pieces, "pieces")

    @F.pandas_udf("long")
    def joined(lists):
        import pandas as pd
        out = []
        for parts in lists:
            crc = 0
            for p in sorted(parts, key=lambda p: p["piece"]):
                crc = crc32_join(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    several = pieces.where("piece > 0").select("part", "seq").distinct()
    alone = pieces.join(several, ["part", "seq"], "left_anti").select("part", "id", "at", "n", "crc")
    split = (pieces.join(several, ["part", "seq"]).groupBy("part", "seq")
             .agg(F.first("id").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.collect_list(F.struct("piece", "n", "crc")).alias("l"))
             .select("part", "id", "at", "n", joined("l").alias("crc")))
    totals = df.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row per file part
    before = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (alone.unionByName(split).join(before, "part")
            .select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")))
