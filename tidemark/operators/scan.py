"""Scans in key order: pages, batches, largest keys, table order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Texts that are joined at a time.
TEXTS_AT_ONCE = 10_000


def keyset_page(df: DataFrame, key: str, last: object | None, rows: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The next ``rows`` rows after key ``last`` (None: from the start), in key order.

    The bound is an ordinary filter, so it reaches the Parquet scan; a top-k
    takes the page, without a sort of the rest.
    """
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    page = rest.orderBy(key).limit(rows)
    return page.select(*columns) if columns else page


def _in_ranges(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` sorted by ranges of ``by`` and written, with __part and __place: a row's range and its place there."""
    sorted_ = df.repartitionByRange(_parts(df), *by).sortWithinPartitions(*by)
    # consecutive within a partition, with the partition's number in the upper bits
    marked = written(sorted_.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    return marked.withColumn("__part", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """key and its place (0, 1, ...) in the order of all keys, without a task that sees them all.

    Keys are sorted in ranges; a place is the rank within its range plus the
    rows of the ranges before, of which there is one number each.
    """
    return _placed(df.select(key), [key]).select(key, "place")


def _placed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    marked = _in_ranges(df, by)
    counts = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return marked.join(F.broadcast(before) if _parts(df) <= 10_000 else before, "__part").withColumn("place", F.col("__place") + F.col("__before"))


def running_sum(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row in the order of its group, however large a group is.

    Rows are sorted in ranges of (by, order): a sum is that within the row's
    range plus the group's in the ranges before, of which there is one number
    for each range and group that meet, a group's ranges being neighbours.
    """
    marked = _in_ranges(df, [by, order])
    group = F.col(by).eqNullSafe(F.col("__by"))
    sums = marked.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__p")).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy("__by").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__by", "__p", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", by).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumn("__in", F.sum(value).over(inside)).join(before, (F.col("__part") == F.col("__p")) & group)
    return summed.select(*df.columns, (F.col("__in") + F.col("__before")).alias(name))


def joined_texts(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """by and ``text``: the texts of each group as one, in order and however many they are.

    Rows are sorted in ranges and joined there, ``TEXTS_AT_ONCE`` at a time; a
    task that ends a group gets a text for so many rows, and no row.
    """
    marked = _in_ranges(df, [*by, *order])
    joined = lambda *places: F.array_join(F.array_sort(F.collect_list(F.struct(*places, text))).getField(text), "").alias(text)
    some = marked.groupBy(*by, "__part", F.floor(F.col("__place") / TEXTS_AT_ONCE).alias("__some")).agg(joined("__place"))
    return some.groupBy(*by).agg(joined("__part", "__some"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def key_batches(df: DataFrame, key: str, rows: int) -> DataFrame:
    """batch, row_count, first_key, last_key for batches of ``rows`` neighbouring keys."""
    batch = F.floor(F.col("place") / rows).cast("bigint")
    return numbered(df, key).groupBy(batch.alias("batch")).agg(F.count("*").alias("row_count"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def not_advancing(batches: DataFrame) -> DataFrame:
    """Batches whose last key is not beyond that of the batch before; a sound scan has none."""
    before = batches.select((F.col("batch") + 1).alias("batch"), F.col("last_key").alias("before"))
    return batches.join(before, "batch").where("last_key <= before").select(*batches.columns, "before")


def set_batches(keys: DataFrame, by: Sequence[str], key: str, rows: int) -> DataFrame:
    """Distinct keys in batches of ``rows`` within each table: the columns of ``by``, key and batch.

    Keys of all tables are numbered in ranges; a table's first number is taken off.
    """
    placed = _placed(keys.select(*by, key).distinct(), [*by, key])
    firsts = placed.groupBy(*by).agg(F.min("place").alias("__first"))
    return placed.join(firsts, list(by)).select(*by, key, F.floor((F.col("place") - F.col("__first")) / rows).cast("bigint").alias("batch"))


def max_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table_name, max_key (bigint) and row_count of each table; an empty table has no largest key."""
    one = [df.agg(F.lit(n).alias("table_name"), F.max(k).cast("bigint").alias("max_key"), F.count("*").alias("row_count")) for n, (df, k) in tables.items()]
    return reduce(DataFrame.unionByName, one)


def split_empty(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with rows, and empty ones."""
    return keys.where("max_key IS NOT NULL"), keys.where("max_key IS NULL")


def remaining(tables: DataFrame, completed: DataFrame) -> DataFrame:
    """Tables that are not completed yet."""
    return tables.join(completed.select("table_name"), "table_name", "left_anti")


def by_largest(tables: DataFrame, size: str) -> DataFrame:
    """Largest first, so that the last to end is not the longest; ties by name."""
    return tables.orderBy(F.col(size).desc(), "table_name")


def by_priority(tables: DataFrame, first: Sequence[str]) -> DataFrame:
    """The listed tables in the given order, then the rest by name; unknown names are ignored."""
    place = F.nullif(F.array_position(F.array(*(F.lit(x) for x in first)) if first else F.array().cast("array<string>"), F.col("table_name")), F.lit(0).cast("bigint"))
    return tables.withColumn("place", place).orderBy(F.col("place").asc_nulls_last(), "table_name")


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """row_count, key_count and usable: whether the columns name a row, which paging needs."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("row_count"), F.count("*").alias("key_count")).withColumn("usable", F.col("row_count") == F.col("key_count"))


def with_keys(df: DataFrame, key: str, keys: DataFrame | Sequence) -> DataFrame:
    """Rows with one of the keys; a missing key has no row and a repeated one still only its row."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(*keys))


def row_predicate(old: Sequence[Column], new: Sequence[Column]) -> Column:
    """All columns equal, nulls too."""
    return reduce(Column.__and__, (a.eqNullSafe(b) for a, b in zip(old, new, strict=True)))
