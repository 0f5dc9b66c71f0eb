"""Statistics of byte contents: Arrow UDFs over the kernels, and expressions over count arrays.

Only the ``content`` column crosses to Python, as the buffer of a whole Arrow batch; counts come back as
arrays without a Python object per row. Statistics derived from the counts (entropy,
normalisation, skew) are JVM-side higher-order functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .kernels import STEP, WINDOW
from .patterns import patterns

_LONGS = T.ArrayType(T.LongType())


@F.arrow_udf(_LONGS)
def byte_counts(content: pa.Array) -> pa.Array:
    """256 byte-value counts per file; null for null."""
    return kernels.list_column(kernels.histograms(content), kernels.nulls(content))


def byte_entropy_counts(content: Column, window: int = WINDOW, step: int = STEP) -> Column:
    """16x16 (entropy bin, high nibble) counts over sliding windows, row-major; null for null."""

    @F.arrow_udf("array<bigint>")
    def _udf(batch: pa.Array) -> pa.Array:
        return kernels.list_column(kernels.entropy_histograms(batch, window, step), kernels.nulls(batch))

    return _udf(content)


def _strings_of(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All strings of a list column without nulls, and the row of each."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    strings, owner = lists.flatten(), np.repeat(np.arange(len(lists)), sizes)
    if strings.null_count:
        keep = ~kernels.nulls(strings)
        strings, owner = strings.drop_null(), owner[keep]
    return strings, owner


@F.arrow_udf(_LONGS)
def printable_char_counts(strings: pa.Array) -> pa.Array:
    """96 counts of characters 0x20..0x7f over all printable strings of a file; null for null."""
    values, owner = _strings_of(strings)
    data, offsets = kernels.flat_bytes(values.cast(pa.large_binary()))
    upto = np.append(np.searchsorted(owner, np.arange(len(strings)), "left"), len(owner))
    counts = kernels._grouped_counts(data, offsets[upto], 256)[:, 0x20:0x80]
    return kernels.list_column(np.ascontiguousarray(counts), kernels.nulls(strings))


def pattern_string_counts(strings: Column, fixed: bool = False) -> Column:
    """Per pattern, in name order: strings of an array with at least one match (a null array has none)."""

    @F.arrow_udf("array<bigint>")
    def _udf(batch: pa.Array) -> pa.Array:
        values, owner = _strings_of(batch)
        return kernels.list_column(kernels.pattern_counts(values.to_pylist(), owner, len(batch), fixed))

    return _udf(strings)


BYTE_FEATURES = ("struct<histogram:array<bigint>,byteentropy:array<bigint>,strings:struct<numstrings:bigint,avlength:double,printables:bigint,"
                 "printabledist:array<bigint>,entropy:double,string_counts:array<bigint>>,entropy:double>")


def byte_features(content: Column, fixed: bool = False) -> Column:
    """Histogram, window entropy histogram, statistics of printable strings and entropy of a content, from one read of its buffer.

    ``string_counts`` has a count per pattern in name order. A null content counts as empty.
    """

    @F.arrow_udf(BYTE_FEATURES)
    def _udf(batch: pa.Array) -> pa.Array:
        n = len(batch)
        data, offsets = kernels.flat_bytes(batch)
        contents = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        hist = kernels.histograms(contents)
        runs, owner = kernels.printable_runs(data, offsets)
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        number = np.bincount(owner, minlength=n)
        printables = np.bincount(owner, weights=lengths, minlength=n).astype(np.int64)
        edges = np.append(0, np.cumsum(printables))
        chars = np.ascontiguousarray(kernels._grouped_counts(np.frombuffer(b"".join(runs), np.uint8), edges, 256)[:, 0x20:0x80])
        counts = kernels.pattern_counts([r.decode("latin-1") for r in runs], owner, n, fixed)
        strings = pa.StructArray.from_arrays(
            [pa.array(number), pa.array(printables / np.maximum(number, 1)), pa.array(printables), kernels.list_column(chars),
             pa.array(kernels.shannon(chars)), kernels.list_column(counts)],
            ["numstrings", "avlength", "printables", "printabledist", "entropy", "string_counts"])
        return pa.StructArray.from_arrays(
            [kernels.list_column(hist), kernels.list_column(kernels.entropy_histograms(contents)), strings, pa.array(kernels.shannon(hist))],
            ["histogram", "byteentropy", "strings", "entropy"])

    return _udf(content)


def pattern_names(fixed: bool = False) -> list[str]:
    return [n for n, _ in patterns(fixed)]


def _moment_state(n, mean, m2, m3) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"), m3.alias("m3"))


def moments(values: Column) -> Column:
    """``struct(n, mean, m2, m3)`` of an array of doubles: size, mean and sums of 2nd and 3rd powers of
    deviations, in one pass over the array (Welford's updates; nothing outside the lambda is evaluated per element)."""
    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        delta = x - acc["mean"]
        part = delta / n
        term = delta * part * acc["n"]
        return _moment_state(n, acc["mean"] + part, acc["m2"] + term,
                             acc["m3"] + term * part * (n - 2.0) - part * acc["m2"] * 3.0)

    zero = F.lit(0.0)
    return F.aggregate(values, _moment_state(zero, zero, zero, zero), step)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy_of_counts(counts: Column, total: Column | None = None) -> Column:
    """Shannon entropy (bits) of a count array; p = count / total (default: sum).

    From the sum s and the sum of c * log2(c), in one pass: (s * log2(t) - sum) / t.
    """
    def step(acc: Column, x: Column) -> Column:
        v = x.cast("double")
        return F.struct((acc["s"] + v).alias("s"), (acc["l"] + F.when(v > 0, v * F.log2(v)).otherwise(0.0)).alias("l"))

    sums = F.aggregate(counts, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("l")), step)

    def entropy(a: Column) -> Column:
        t = total.cast("double") if total is not None else a["s"]
        return F.when(t > 0, F.greatest((a["s"] * F.log2(t) - a["l"]) / t, F.lit(0.0)))

    return F.coalesce(bind(sums, entropy), F.lit(0.0))
