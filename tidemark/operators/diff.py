"""Differences between a source and a target table, by row fingerprint and by column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import column_md5, row_fingerprint, table_checksum
from .scan import joined_texts

#: The kinds of mismatch.
MISSING_ON_SOURCE, MISSING_ON_TARGET = "row missing on source", "row missing on target"
CHECKSUM_DIFFERS, VALUE_DIFFERS = "rows checksum difference", "column value difference"
COLUMN_MISSING_ON_SOURCE, COLUMN_MISSING_ON_TARGET = "column missing on source", "column missing on target"
#: Fixed value: how a message begins.
FAILED = "cutover verification failed for: "
#: Keys of a table that a message names; of more it says how many there are.
NAMED = 1000


def hashes(df: DataFrame, key: str, ignored: Iterable[str] = ()) -> DataFrame:
    """key and row_md5; only these go into a shuffle."""
    return df.select(F.col(key), row_fingerprint(df, ignored).alias("row_md5"))


def classified(source: DataFrame, target: DataFrame, key: str, ignored: Iterable[str] = ()) -> DataFrame:
    """key, mismatch_type, source_md5, target_md5 of every row that is not the same on both sides."""
    ignored = list(ignored)
    s = hashes(source, key, ignored).withColumnRenamed("row_md5", "source_md5")
    t = hashes(target, key, ignored).withColumnRenamed("row_md5", "target_md5")
    return s.join(t, key, "full_outer").withColumn("mismatch_type", _kind()).where("mismatch_type IS NOT NULL").select(key, "mismatch_type", "source_md5", "target_md5")


def _kind() -> Column:
    s, t = F.col("source_md5"), F.col("target_md5")
    return F.when(s.isNull(), F.lit(MISSING_ON_SOURCE)).when(t.isNull(), F.lit(MISSING_ON_TARGET)).when(s != t, F.lit(CHECKSUM_DIFFERS))


def symmetric(source: DataFrame, target: DataFrame, key: str, ignored: Iterable[str] = ()) -> DataFrame:
    """Keys whose rows differ or are on one side only."""
    return classified(source, target, key, ignored).select(key)


def lookup_diff(source: DataFrame, target: DataFrame, key: str, keys: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """The classified difference for a set of keys; a key on neither side is none."""
    wanted = keys.select(key).distinct()
    return classified(source.join(wanted, key, "left_semi"), target.join(wanted, key, "left_semi"), key, ignored)


def by_column(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The first column, in the order given, that differs in each row, with the MD5 of both values.

    A column that one table lacks differs in every row that both have.
    """
    kinds = {f.name: f.dataType for f in (*source.schema, *target.schema)}

    def side(df: DataFrame, as_: str) -> DataFrame:
        parts = [column_md5(F.col(c), kinds[c]).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return df.select(F.col(key), F.struct(*parts).alias(as_))

    def found(c: str) -> Column:
        s, t = F.col(f"s.`{c}`"), F.col(f"t.`{c}`")
        if c not in source.columns or c not in target.columns:
            kind, differs = F.lit(COLUMN_MISSING_ON_SOURCE if c not in source.columns else COLUMN_MISSING_ON_TARGET), F.lit(True)
        else:
            kind, differs = F.lit(VALUE_DIFFERS), s != t
        return F.when(differs, F.struct(kind.alias("mismatch_type"), F.lit(c).alias("mismatch_column"), s.alias("source_md5"), t.alias("target_md5")))

    nothing = lambda k: F.struct(F.lit(k).alias("mismatch_type"), F.lit(None).cast("string").alias("mismatch_column"), F.lit(None).cast("string").alias("source_md5"), F.lit(None).cast("string").alias("target_md5"))
    both = side(source, "s").join(side(target, "t"), key, "full_outer")
    first = F.when(F.col("s").isNull(), nothing(MISSING_ON_SOURCE)).when(F.col("t").isNull(), nothing(MISSING_ON_TARGET)).otherwise(F.coalesce(*(found(c) for c in columns)))
    return both.select(key, first.alias("m")).where("m IS NOT NULL").select(key, "m.*")


def merged(by_hash: DataFrame, by_value: DataFrame, key: str) -> DataFrame:
    """Both sets of mismatches; where a key is in both, the one by column stands."""
    names = ["mismatch_type", "mismatch_column", "source_md5", "target_md5"]
    full = lambda df: df if "mismatch_column" in df.columns else df.withColumn("mismatch_column", F.lit(None).cast("string"))
    h = full(by_hash).select(key, F.struct(*names).alias("h"))
    v = full(by_value).select(key, F.struct(*names).alias("v"))
    return h.join(v, key, "full_outer").select(key, F.coalesce("v", "h").alias("m")).select(key, "m.*")


def message(mismatches: DataFrame, most: int | None = NAMED) -> DataFrame:
    """One row: the text that names the mismatches, tables and keys in order.

    ``mismatches``: db, table_name, pk (text, with ``pk_order`` to sort by),
    mismatch_type, source_md5, target_md5, mismatch_column. Of a table's keys
    the first ``most`` are named, which Spark picks where the rows are; the
    rest is counted. None names all, in a text of about 94 bytes a row. The
    whole list is the table ``mismatches`` itself.
    """
    def part(label: str, c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))).otherwise(F.lit(""))

    by = ["db", "table_name"]
    one = F.concat(F.col("pk"), F.lit(" (type: "), F.col("mismatch_type"), part(", source: ", "source_md5"), part(", target: ", "target_md5"), part(", column: ", "mismatch_column"), F.lit(") "))
    lines = mismatches.select(*by, "pk_order", one.alias("text"))
    if most is None:
        tables, named = joined_texts(lines, by, ["pk_order", "text"], "text"), F.col("text")
    else:
        counts = lines.groupBy(*by).agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy("pk_order", "text"))
        first = lines.withColumn("place", place).where(F.col("place") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("rows"))
        more = F.when(F.col("n") > most, F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more "))).otherwise(F.lit(""))
        tables, named = first.join(counts, by), F.concat(F.array_join(F.col("rows.text"), ""), more)
    text = F.concat("db", F.lit("."), "table_name", F.lit(" [PKs: "), named, F.lit("] "))
    all_ = tables.agg(F.array_sort(F.collect_list(F.struct("db", "table_name", text.alias("text")))).alias("tables"))
    return all_.select(F.concat(F.lit(FAILED), F.array_join(F.col("tables.text"), "")).alias("message"), F.transform("tables", lambda x: F.concat_ws(".", x["db"], x["table_name"])).alias("incorrect_tables"))


def checksums_differ(pairs: dict[str, tuple[DataFrame, DataFrame]], ignored: Iterable[str] = ()) -> DataFrame:
    """table_name and equal for every pair of tables, by checksums that row order does not change."""
    def one(name: str, source: DataFrame, target: DataFrame) -> DataFrame:
        sums = table_checksum(source, ignored).unionByName(table_checksum(target, ignored)).select(F.struct("*").alias("sums"))
        return sums.agg(F.lit(name).alias("table_name"), (F.min("sums") == F.max("sums")).alias("equal"))

    return reduce(DataFrame.unionByName, (one(n, s, t) for n, (s, t) in pairs.items()))
