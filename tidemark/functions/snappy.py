"""Compressed columns: the one place where values pass through Python, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain_size(block: bytes) -> int:
    """Length of the plain text, from the variable-length number a raw block starts with."""
    size = shift = 0
    for byte in block:
        size |= (byte & 0x7F) << shift
        if byte < 0x80:
            return size
        shift += 7
    raise ValueError("a compressed value ends within its length")


@F.pandas_udf(T.BinaryType())
def unsnapped(blocks: pd.Series) -> pd.Series:
    """Raw Snappy blocks, decompressed; null stays null and a broken block fails the job."""
    import pyarrow as pa

    return blocks.map(lambda b: None if b is None else (b"" if _plain_size(b) == 0 else pa.decompress(b, decompressed_size=_plain_size(b), codec="snappy", asbytes=True)))


@F.pandas_udf(T.BinaryType())
def snapped(plain: pd.Series) -> pd.Series:
    """Raw Snappy blocks of byte strings."""
    import pyarrow as pa

    return plain.map(lambda b: None if b is None else pa.compress(b, codec="snappy", asbytes=True))


#: Algorithm name (upper case) → decompressing function.
ALGORITHMS = {"SNAPPY": unsnapped}


def decompressed(column, algorithm: str):
    """A column decompressed by an algorithm's name, in any case."""
    try:
        return ALGORITHMS[algorithm.upper()](column)
    except KeyError:
        raise ValueError(f"unsupported compression {algorithm!r}") from None
