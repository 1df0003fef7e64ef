"""How many rows a batch may have, by the size of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: parameters that one statement takes at most.
PARAMETERS = 65535


def interpolated(row_size: Column, points: dict[int, int]) -> Column:
    """Batch size between control points (row size → rows), each term rounded down; beyond the ends the nearest point's."""
    sizes = sorted(points)
    out = F.when(row_size <= sizes[0], F.lit(points[sizes[0]]))
    for a, b in zip(sizes, sizes[1:], strict=False):
        share = F.floor(points[a] * (b - row_size) / (b - a)) + F.floor(points[b] * (row_size - a) / (b - a))
        out = out.when(row_size <= b, F.when(row_size == b, F.lit(points[b])).otherwise(share))
    return out.otherwise(F.lit(points[sizes[-1]])).cast("bigint")


def most_rows(columns: Column) -> Column:
    """Rows of that many columns that one statement takes."""
    return F.floor(F.lit(PARAMETERS) / columns).cast("bigint")


def batch_rows(row_size: Column, columns: Column, points: dict[int, int]) -> Column:
    return F.least(interpolated(row_size, points), most_rows(columns))
