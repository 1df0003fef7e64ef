"""Pagination keys: integers, unsigned 64-bit numbers as decimals, and bytes in byte order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSIGNED = "decimal(20,0)"
#: The largest unsigned 64-bit number and the most bytes of a largest binary key.
MAX_UNSIGNED, MAX_BINARY_BYTES = 18446744073709551615, 4096


def unsigned(column: Column, bits: int) -> Column:
    """A signed reading of an unsigned number, put right; always a decimal that holds 64 bits."""
    wide = column.cast(UNSIGNED)
    return F.when(wide < 0, (wide + F.lit(str(2**bits)).cast(UNSIGNED)).cast(UNSIGNED)).otherwise(wide)


def to_hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def padded(key: Column, size: int) -> Column:
    """Bytes filled up with zero bytes to a fixed size; longer ones are an error of the input and stay as they are."""
    return F.when(F.octet_length(key) >= size, key).otherwise(F.rpad(key, size, F.lit(b"\x00")))


def numeric_position(key: Column, binary: bool) -> Column:
    """A number for progress reports: of a binary key the first 8 bytes, big-endian."""
    if not binary:
        return key.cast("double")
    head = F.substring(F.rpad(F.substring(key, 1, 8), 8, F.lit(b"\x00")), 1, 8)
    return F.conv(F.hex(head), 16, 10).cast(UNSIGNED).cast("double")


def is_max(key: Column, binary: bool) -> Column:
    """Whether a key is the largest of its kind, which also marks a completed table."""
    return F.hex(key).rlike("^(FF)+$") if binary else key.cast(UNSIGNED) == F.lit(str(MAX_UNSIGNED)).cast(UNSIGNED)


def max_key(size: int | None = None) -> Column:
    """The largest number, or the largest binary key of a column of ``size`` bytes. The smallest is no bound at all: null."""
    return F.lit(str(MAX_UNSIGNED)).cast(UNSIGNED) if size is None else F.lit(b"\xff" * min(size, MAX_BINARY_BYTES))


def key_text(key: Column, kind: T.DataType) -> Column:
    """A key of any type as text that ``key_value`` makes the same key of: bytes in hexadecimal digits."""
    return to_hex(key) if isinstance(kind, T.BinaryType) else key.cast("string")


def key_value(text: Column, kind: T.DataType) -> Column:
    return from_hex(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, F.lit(-1)).when(a == b, F.lit(0)).when(a > b, F.lit(1))


def key_json(column: str, key: Column, binary: bool) -> Column:
    """A key as JSON, with its kind: numbers as text that keeps all digits, bytes in hex."""
    value = to_hex(key) if binary else key.cast("string")
    return F.to_json(F.struct(F.lit("binary" if binary else "uint64").alias("type"), value.alias("value"), F.lit(column).alias("column")))


def key_of_json(text: Column) -> Column:
    """The struct of a key's JSON: type, value, column."""
    return F.from_json(text, "type string, value string, column string")
