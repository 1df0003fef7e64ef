"""Positions that are more than a number: (file, offset) of a log of many files, and sets of transaction ids.

A file's number grows by a digit when it must, so files are ordered by the
number at the end of their names, not as text. A set of transaction ids holds,
for each source, intervals of ids: columns source, first_id, last_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(text: Column) -> Column:
    """``file:offset`` as a struct that compares as the positions do: the file's number, the offset. Null if it is no position."""
    number = F.nullif(F.regexp_extract(text, r"(\d+):\d+$", 1), F.lit("")).cast("bigint")
    offset = F.nullif(F.regexp_extract(text, r"\d+:(\d+)$", 1), F.lit("")).cast("bigint")
    return F.when(number.isNotNull(), F.struct(number.alias("file"), offset.alias("offset")))


def text_of(file: Column, offset: Column, digits: int = 6, stem: str = "log.") -> Column:
    """A position as text: the file's number with ``digits`` digits at least."""
    number = file.cast("string")
    return F.concat(F.lit(stem), F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number), F.lit(":"), offset.cast("string"))


def scalar(position: Column, bits: int = 40) -> Column:
    """A position as one number in the same order, for logs that hold one: offsets must fit ``bits`` bits."""
    wide = F.when(position["offset"] < 2**bits, F.shiftleft(position["file"], bits) + position["offset"])
    return F.coalesce(wide, F.raise_error(F.lit(f"an offset does not fit {bits} bits")).cast("bigint"))


def places(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``place``: the number of its position among the distinct ones, from 1, without a task that sees them all."""
    from ..operators.scan import numbered

    keys = df.select(at(F.col(column)).alias("__at")).distinct()
    ranked = numbered(keys, "__at").select(F.col("__at"), (F.col("place") + 1).alias("place"))
    return df.withColumn("__at", at(F.col(column))).join(ranked, "__at").drop("__at")


def union(*sets: DataFrame) -> DataFrame:
    """The ids of several sets, as the fewest intervals: those that touch become one.

    Equal intervals meet before they are sorted; the intervals of one source
    are sorted in one task, and are as few as its gaps.
    """
    every = sets[0].select("source", "first_id", "last_id")
    for s in sets[1:]:
        every = every.unionByName(s.select("source", "first_id", "last_id"))
    every = _joined(every.distinct().withColumn("__span", F.floor(F.col("first_id") / SPAN)), ["source", "__span"])  # neighbours first, span by span
    return _joined(every, ["source"]).select("source", "first_id", "last_id")


#: Ids of a span within which intervals are joined before those of a whole source are.
SPAN = 100_000


def _joined(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Intervals that touch within a group as one: a new one begins where the ids reached so far end."""
    order = Window.partitionBy(*by).orderBy("first_id", "last_id")
    reached = F.max("last_id").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("first_id") > reached + 1), 1).otherwise(0)
    marked = intervals.withColumn("__new", begins).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__island").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")).drop("__island")


def missing(whole: DataFrame, part: DataFrame) -> DataFrame:
    """The intervals of ``part`` that do not lie in ``whole``; none if that contains it. An interval of a union lies in one interval or in none whole."""
    inside = union(whole).select("source", F.col("first_id").alias("__from"), F.col("last_id").alias("__to"))
    mine = union(part)
    # the interval that begins last before or at each of ours, of its source
    both = mine.withColumn("__own", F.lit(True)).unionByName(inside.select("source", F.col("__from").alias("first_id"), F.col("__to").alias("last_id")).withColumn("__own", F.lit(False)))
    order = Window.partitionBy("source").orderBy("first_id", F.col("__own")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.max(F.when(~F.col("__own"), F.col("last_id"))).over(order)
    return both.withColumn("__upto", upto).where(F.col("__own") & (F.col("__upto").isNull() | (F.col("__upto") < F.col("last_id")))).select("source", "first_id", "last_id")


def contains(whole: DataFrame, part: DataFrame) -> bool:
    """Whether every id of one set is in another."""
    return missing(whole, part).isEmpty()
