"""Checksums of a table as a tree over ranges of its keys.

The span of both sides' keys is cut into ``FANOUT`` ranges, each of those into
as many, and so on. A range's sums do not depend on the order of its rows. Both
sides compute the sums of one level, a row for each range, and go down only in
ranges whose sums differ; where those are few rows, or most, they are compared
row by row. So what is shuffled are sums, and the rows of ranges that differ.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fingerprint import hash60, row_fingerprint
from ..functions.keys import numeric_position
from ..scratch import written
from . import diff

#: Ranges that a range is cut into, levels at most, rows of a range that is not cut again, and differing ranges beyond which no level is added.
FANOUT, LEVELS, FEW_ROWS, MOST = 64, 4, 1000, 10_000
#: Neighbouring ranges whose bounds reach the files' readers as filters.
FILTERS = 16


def _place(key: str, kind: T.DataType) -> Column:
    """A number in the order of the keys; text and bytes by their first eight bytes."""
    text = isinstance(kind, T.StringType | T.BinaryType)
    return numeric_position(F.col(key).cast("binary") if isinstance(kind, T.StringType) else F.col(key), text)


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


class Tree:
    """The ranges of two tables' keys. Keys whose type has no numbers are one range. Keys are not null: rows without one, in the first range, match no row where that differs."""

    def __init__(self, source: DataFrame, target: DataFrame, key: str, ignored: Iterable[str] = ()):
        self.key, self.ignored, self.kind = key, list(ignored), source.schema[key].dataType
        self.sides = (source, target)
        self.place = _place(key, self.kind) if _numeric(self.kind) or isinstance(self.kind, T.StringType | T.BinaryType) else F.lit(0.0)
        ends = [df.select(self.place.alias("p")).agg(F.min("p"), F.max("p")).first() for df in self.sides]
        found = [x for e in ends for x in e if x is not None]
        self.low, self.high = (min(found), max(found)) if found else (0.0, 0.0)

    def number(self, level: int) -> Column:
        """Which of a level's ranges a row is in."""
        n = FANOUT**level
        if self.high == self.low:
            return F.lit(0).cast("bigint")
        share = (self.place - F.lit(self.low)) / F.lit(self.high - self.low)
        return F.coalesce(F.least(F.floor(share * n), F.lit(n - 1)), F.lit(0)).cast("bigint")

    def bounds(self, level: int, number: int) -> tuple[float, float]:
        width = (self.high - self.low) / FANOUT**level
        return self.low + number * width, self.low + (number + 1) * width

    def within(self, df: DataFrame, level: int, numbers: DataFrame, known: list[int]) -> DataFrame:
        """The rows of some of a level's ranges; few neighbours also as bounds of the key, which files can be skipped by."""
        if _numeric(self.kind) and known and known[-1] - known[0] < FILTERS * len(known) and self.high > self.low:
            low, high = self.bounds(level, known[0])[0], self.bounds(level, known[-1])[1]
            step = (high - low) * 1e-9 + 1  # what rounding may take
            df = df.where(F.col(self.key).isNull() | (F.col(self.key).between(F.lit(low - step).cast(self.kind), F.lit(high + step).cast(self.kind))) if abs(high + step) < 2**62 else F.lit(True))
        return df.join(F.broadcast(numbers), self.number(level) == F.col("__range"), "left_semi")

    def sums(self, level: int, of: DataFrame, side: str) -> DataFrame:
        h = hash60(row_fingerprint(of, self.ignored))
        rows = of.select(self.number(level).alias("range"), h.alias("h"))
        return rows.groupBy("range").agg(F.count("*").alias(f"{side}_rows"), F.bit_xor("h").alias(f"{side}_xor"), F.sum(F.col("h") % 1_000_003).alias(f"{side}_sum"))

    def level(self, level: int, sides: tuple[DataFrame, DataFrame]) -> DataFrame:
        """range, source_rows and target_rows of the ranges of a level whose sums differ."""
        both = self.sums(level, sides[0], "source").join(self.sums(level, sides[1], "target"), "range", "full_outer")
        same = reduce(Column.__and__, (F.col(f"source_{c}").eqNullSafe(F.col(f"target_{c}")) for c in ("rows", "xor", "sum")))
        return both.where(~same).select("range", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), F.coalesce("target_rows", F.lit(0)).alias("target_rows"))


def differing(source: DataFrame, target: DataFrame, key: str, ignored: Iterable[str] = ()) -> tuple[Tree, int, DataFrame | None, list[int]]:
    """How far the two sides' tree was gone down, and the ranges that differ there: none, if all is equal."""
    tree = Tree(source, target, key, ignored)
    sides, found, level, known = tree.sides, None, 0, []
    while True:
        found = written(tree.level(level, sides), "ranges")
        known = sorted(r["range"] for r in found.select("range").limit(MOST + 1).collect())
        if not known:
            return tree, level, None, []
        rows, most = found.agg(F.sum("source_rows") + F.sum("target_rows"), F.max(F.col("source_rows") + F.col("target_rows"))).first()
        if most <= FEW_ROWS or level >= LEVELS or len(known) * FANOUT > MOST * FANOUT // 2 or tree.high == tree.low:
            return tree, level, found, known
        numbers = found.select(F.col("range").alias("__range"))
        sides = tuple(tree.within(df, level, numbers, known) for df in tree.sides) if level else sides
        level += 1


def ranges(source: DataFrame, target: DataFrame, key: str, ignored: Iterable[str] = ()) -> DataFrame:
    """level, low, high (numbers of the keys' order), source_rows and target_rows of the ranges that differ, at the level that was reached."""
    tree, level, found, _ = differing(source, target, key, ignored)
    if found is None:
        return source.sparkSession.createDataFrame([], "level int, low double, high double, source_rows bigint, target_rows bigint")
    width = (tree.high - tree.low) / FANOUT**level
    return found.select(F.lit(level).alias("level"), (F.lit(tree.low) + F.col("range") * width).alias("low"), (F.lit(tree.low) + (F.col("range") + 1) * width).alias("high"), "source_rows", "target_rows")


def differences(source: DataFrame, target: DataFrame, key: str, ignored: Iterable[str] = ()) -> DataFrame:
    """The classified difference (``diff.classified``) of two tables, for which only the rows of differing ranges are shuffled."""
    ignored = list(ignored)
    tree, level, found, known = differing(source, target, key, ignored)
    if found is None:
        return diff.classified(source.limit(0), target.limit(0), key, ignored)
    sides = tree.sides
    if level and len(known) <= MOST:
        numbers = found.select(F.col("range").alias("__range"))
        sides = tuple(tree.within(df, level, numbers, known) for df in sides)
    return diff.classified(*sides, key, ignored)
