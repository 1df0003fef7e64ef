"""Row fingerprints: an MD5 over the MD5s of the columns' canonical text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands for NULL in a fingerprint, and in the older form of it.
NULL_TEXT = "NULL_PBj}b]74P@JTo$5G_null"
OLD_NULL_TEXT = "NULL"


def canonical(column: Column, kind: T.DataType) -> Column:
    """The text of a value that is hashed: minus zero is zero, whole floats have no fraction, booleans are 0 and 1.

    Bytes are hashed as they are; JSON text is left as it is (``canonical_json``
    makes texts of equal JSON values equal).
    """
    if isinstance(kind, T.FloatType | T.DoubleType):
        zeroed = F.when(column == 0, F.lit(0.0).cast(kind)).otherwise(column)
        return F.regexp_replace(zeroed.cast("string"), r"\.0$", "")
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("string")
    if isinstance(kind, T.BinaryType):
        return column
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        raise TypeError(f"a row fingerprint takes no {kind.simpleString()} columns")
    return column.cast("string")


def canonical_json(column: Column) -> Column:
    """JSON text in one form; 52.0 and 52 are equal, the empty text is null."""
    return F.to_json(F.parse_json(F.coalesce(F.nullif(column, F.lit("")), F.lit("null"))))


def column_md5(column: Column, kind: T.DataType, null_text: str = NULL_TEXT) -> Column:
    text = canonical(column, kind)
    missing = F.lit(null_text).cast("binary") if isinstance(kind, T.BinaryType) else F.lit(null_text)
    return F.md5(F.coalesce(text, missing).cast("binary"))


def row_fingerprint(df: DataFrame, ignored: Iterable[str] = (), null_text: str = NULL_TEXT) -> Column:
    """MD5 of the columns' MD5s, in the table's column order, without the ignored ones."""
    skip = set(ignored)
    parts = [column_md5(F.col(f"`{f.name}`"), f.dataType, null_text) for f in df.schema if f.name not in skip]
    return F.md5(F.concat(*parts).cast("binary"))


def raw_row_hash(df: DataFrame, columns: Iterable[str]) -> Column:
    """MD5 of the columns' bytes one after another. Columns shift into each other here; use ``row_fingerprint`` for new work."""
    return F.md5(F.concat(*(F.coalesce(F.col(c).cast("string").cast("binary"), F.lit(b"")) for c in columns)))


def hash60(digest: Column) -> Column:
    """The first 15 hexadecimal digits of a digest as a number; it fits a bigint on every engine."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def table_checksum(df: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """One row: row count and two sums over fingerprints that do not depend on the rows' order."""
    h = hash60(row_fingerprint(df, ignored))
    return df.select(h.alias("h")).agg(F.count("*").alias("row_count"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h") % 1_000_003).alias("sum_hash"))
