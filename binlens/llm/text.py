"""Text helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space between words: the space and U+0009 to U+000D. ``bytes.split()`` of
#: Python splits at exactly these, and ``bytes.lower()`` lowers exactly A-Z.
BLANKS = " \t\n\x0b\f\r"


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that on pure ASCII, and is much the faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_bits(col: Column, modulus: int) -> Column:
    """crc32 of a value written as text, modulo ``modulus``; null counts as empty."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def text_version(text_col: str) -> Column:
    """A 64-bit hash that tells texts (and null) apart, beside an id."""
    return F.xxhash64(whole(text_col), F.length(whole(text_col)), F.col(text_col).isNull())


def row_key(id_: Column, version: Column) -> Column:
    """Id and version as one text that is never null, so that plain equality joins rows with null ids."""
    return F.concat_ws("/", F.coalesce(id_.cast("string"), F.lit("null")), version.cast("string"))
