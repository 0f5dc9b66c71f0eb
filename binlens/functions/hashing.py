"""Token hashing for the hashing trick.

Native form (default): the bin is md5-derived and has a portable SQL twin. ``hash_bin`` and
``hash_sign`` are expressions; ``md5_bins`` gives the same over the distinct tokens of an Arrow batch:

    bin  = pmod(int(md5(token)[0:15], 16), bins)
    sign = -1 when bit 0 of md5 byte 15 is set (independent of the bin bits)

``signed_parity_bin`` keeps the reference's 8-bin rule where the sign is the
parity of the same integer that gives the bin (odd bins are always negative).

Exact forms, for models trained on such bins: BLAKE2b (``blake2b_bins``, rich-header counts) and
the 32-bit Murmur3 of public feature hashers (``murmur3``), both over the distinct tokens of an Arrow batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_str(token) -> Column:
    return (F.col(token) if isinstance(token, str) else token).cast("string")


def md5_int(token) -> Column:
    """60-bit non-negative integer from the first 15 hex digits of md5(token)."""
    return F.conv(F.substring(F.md5(_as_str(token)), 1, 15), 16, 10).cast("long")


def hash_bin(token, bins: int) -> Column:
    return F.pmod(md5_int(token), F.lit(bins)).cast("int")


def hash_sign(token) -> Column:
    """+1/-1 from the low bit of the 16th hex digit of md5 (independent of the bin)."""
    nib = F.conv(F.substring(F.md5(_as_str(token)), 16, 1), 16, 10).cast("int")
    return F.when(F.pmod(nib, F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def md5_bins(tokens: pa.Array, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """``hash_bin`` and ``hash_sign`` of each token of a string array; each distinct token is digested once. Nulls: bin 0, sign 1."""
    coded = tokens.dictionary_encode()
    digests = b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest()[:8] for t in coded.dictionary.to_pylist())
    at = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    number = np.append(np.frombuffer(digests, ">u8").astype(np.uint64), np.uint64(0))
    bin_, sign = ((number >> np.uint64(4)) % np.uint64(bins)).astype(np.int64), np.where(number & np.uint64(1), -1.0, 1.0)
    return bin_[at], sign[at]


def signed_parity_bin(token, bins: int = 8) -> tuple[Column, Column]:
    """(bin, sign) where sign is negative exactly when the hashed integer is odd."""
    h = md5_int(token)
    return F.pmod(h, F.lit(bins)).cast("int"), F.when(F.pmod(h, F.lit(2)) == 1, -1.0).otherwise(1.0)


def sql_hash_bin(token_sql: str, bins: int) -> str:
    """DuckDB twin of :func:`hash_bin`."""
    return f"CAST((('0x' || substr(md5(CAST({token_sql} AS VARCHAR)), 1, 15))::BIGINT) % {bins} AS INTEGER)"


def sql_hash_sign(token_sql: str) -> str:
    return (f"CAST(CASE WHEN (('0x' || substr(md5(CAST({token_sql} AS VARCHAR)), 16, 1))::INTEGER) % 2 = 1 "
            f"THEN -1.0 ELSE 1.0 END AS DOUBLE)")


def sql_parity_bin(token_sql: str, bins: int = 8) -> tuple[str, str]:
    h = f"(('0x' || substr(md5(CAST({token_sql} AS VARCHAR)), 1, 15))::BIGINT)"
    return f"CAST({h} % {bins} AS INTEGER)", f"CAST(CASE WHEN {h} % 2 = 1 THEN -1.0 ELSE 1.0 END AS DOUBLE)"


def blake2b_pairs(tokens: pa.Array, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and sign of each token of a string array, from the 8-byte digest read as a little-endian number; each distinct token is digested once."""
    coded = tokens.cast(pa.large_string()).dictionary_encode()
    digests = b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in coded.dictionary.to_pylist())
    number = np.frombuffer(digests, "<u8")[np.asarray(coded.indices)] if len(tokens) else np.zeros(0, np.uint64)
    return (number % np.uint64(bins)).astype(np.int32), np.where(number & np.uint64(1), -1.0, 1.0)


def blake2b_bins(tokens: Column, bins: int = 8) -> Column:
    """array<string> -> array<struct<bin:int, sign:double>> with the reference digest; a null token is the text None."""
    rt = T.ArrayType(T.StructType([T.StructField("bin", T.IntegerType()),
                                   T.StructField("sign", T.DoubleType())]))

    @F.arrow_udf(rt)
    def _udf(lists: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        bin_, sign = blake2b_pairs(lists.flatten().fill_null("None"), bins)
        items = pa.StructArray.from_arrays([pa.array(bin_), pa.array(sign)], ["bin", "sign"])
        null = lists.is_null() if lists.null_count else None
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), items, mask=null)

    return _udf(tokens)


# ---- the 32-bit Murmur3 hash of public feature hashers -----------------------------

def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _scrambled(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def murmur3(tokens: pa.Array, seed: int = 0) -> np.ndarray:
    """Signed 32-bit Murmur3 (x86 variant, public definition) of the UTF-8 bytes of each string, all strings at once.

    Full words of four bytes are mixed word by word for the strings that still have one; the one to three
    bytes that are left enter unmixed with the state, which is where Spark's own ``hash`` differs.
    """
    binary = tokens.cast(pa.large_binary())
    _, offsets, data = binary.buffers()
    if not len(binary):
        return np.zeros(0, np.int32)
    offsets = np.frombuffer(offsets, np.int64)[binary.offset:binary.offset + len(binary) + 1]
    raw = np.append(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(4, np.uint8)).astype(np.uint8)
    begin, length = offsets[:-1], np.diff(offsets)
    h = np.full(len(binary), seed, np.uint32)
    byte = lambda at: raw[at].astype(np.uint32)
    live, word = np.flatnonzero(length >= 4), 0
    while len(live):
        at = begin[live] + 4 * word
        k = byte(at) | byte(at + 1) << np.uint32(8) | byte(at + 2) << np.uint32(16) | byte(at + 3) << np.uint32(24)
        h[live] = _rotated(h[live] ^ _scrambled(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        word += 1
        live = live[length[live] >= 4 * (word + 1)]
    rest, at = length & 3, begin + (length & ~3)
    k = np.zeros(len(binary), np.uint32)
    for i in (2, 1, 0):
        has = np.flatnonzero(rest > i)
        k[has] |= byte(at[has] + i) << np.uint32(8 * i)
    h ^= np.where(rest > 0, _scrambled(k), np.uint32(0))
    h ^= length.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def murmur3_bins(tokens: pa.Array, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin (absolute value modulo the number of bins) and sign of the hash of each token; ``bins``: one number per token."""
    coded = tokens.dictionary_encode()
    h = murmur3(coded.dictionary)[np.asarray(coded.indices)].astype(np.int64) if len(tokens) else np.zeros(0, np.int64)
    # the absolute value of the least number is no 32-bit number: public hashers take 2^31 - bins for it
    bin_ = np.where(h == -2 ** 31, (2 ** 31 - 1 - (bins - 1)) % bins, np.abs(h) % bins)
    return bin_, np.where(h >= 0, 1.0, -1.0)


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``body`` with ``name`` bound to a value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def sql_murmur3(token: str) -> str:
    """DuckDB: the unsigned Murmur3 hash of a text, written anew with lists and 64-bit numbers."""
    m = 2 ** 32
    times = lambda x, c: f"(({x}) * {c}::UBIGINT) % {m}::UBIGINT"
    rot = lambda x, r: f"({times(x, 2 ** r)} + ({x} // {2 ** (32 - r)}::UBIGINT))"
    mixed = lambda k, v: times(_let(times(k, 0xCC9E2D51), v, rot(v, 15)), 0x1B873593)
    byte = lambda i: f"('0x' || substr(hx, {i} + 1, 2))::UBIGINT"
    word = " + ".join(f"('0x' || substr(hx, 8 * wi + {2 * i} + 1, 2))::UBIGINT * {256 ** i}::UBIGINT" for i in range(4))
    words = f"list_transform(range(length(hx) // 8), lambda wi: {mixed(f'({word})', 'kv')})"
    body = f"list_reduce(list_prepend(0::UBIGINT, {words}), lambda st, kw: ({_let('xor(st, kw)', 'rv', rot('rv', 13))} * 5::UBIGINT + {0xE6546B64}::UBIGINT) % {m}::UBIGINT)"
    tail_at = "(8 * (length(hx) // 8))"
    tail = " + ".join(f"CASE WHEN length(hx) % 8 > {2 * i} THEN {byte(f'({tail_at} + {2 * i})')} * {256 ** i}::UBIGINT ELSE 0::UBIGINT END" for i in range(3))
    end = f"xor(xor({body}, CASE WHEN length(hx) % 8 > 0 THEN {mixed(f'({tail})', 'tv')} ELSE 0::UBIGINT END), (length(hx) // 2)::UBIGINT)"
    for n, (shift, factor) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None))):
        x = _let(end, f"f{n}", f"xor(f{n}, f{n} // {2 ** shift}::UBIGINT)")
        end = x if factor is None else times(x, factor)
    return _let(f"hex(encode(CAST({token} AS VARCHAR)))", "hx", end)


def sql_murmur3_bin(token: str, bins: int) -> str:
    """Bin of a hash column of :func:`sql_murmur3` (for token the name of that column)."""
    return (f"CAST(CASE WHEN {token} = {2 ** 31} THEN {(2 ** 31 - bins) % bins} WHEN {token} > {2 ** 31} THEN ({2 ** 32} - {token}::BIGINT) % {bins} "
            f"ELSE {token}::BIGINT % {bins} END AS INTEGER)")


def sql_murmur3_sign(token: str) -> str:
    return f"CAST(CASE WHEN {token} >= {2 ** 31} THEN -1.0 ELSE 1.0 END AS DOUBLE)"
