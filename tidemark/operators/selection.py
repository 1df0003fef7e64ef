"""Which tables, rows and change events belong to a copy."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import keyset_page

#: Databases of the server's own.
SYSTEM_DATABASES = ("mysql", "information_schema", "performance_schema", "sys")


def tenant_rows(df: DataFrame, tenant: str, value: object) -> DataFrame:
    return df.where(F.col(tenant) == F.lit(value))


def tenant_page(df: DataFrame, tenant: str, value: object, key: str, last: object | None, rows: int) -> DataFrame:
    return keyset_page(tenant_rows(df, tenant, value), key, last, rows)


def tenant_page_late(df: DataFrame, tenant: str, value: object, key: str, last: object | None, rows: int) -> DataFrame:
    """The same page, its keys first and the wide rows by a join; for tables with very wide rows.

    A page has at most ``rows`` keys, so they are broadcast.
    """
    keys = tenant_page(df.select(key, tenant), tenant, value, key, last, rows).select(key)
    return df.join(F.broadcast(keys) if rows <= 100_000 else keys, key)


@dataclass(frozen=True)
class JoinTable:
    """A table that links a tenant to the keys of a table without a tenant column."""

    df: DataFrame
    tenant: str
    join_column: str


def joined_rows(df: DataFrame, key: str, links: Sequence[JoinTable], value: object, last: object | None = None, rows: int | None = None) -> DataFrame:
    """Rows whose key a link table names for the tenant; with ``rows``, those of the next so many keys.

    A table that is listed twice counts once.
    """
    one = [tenant_rows(x.df, x.tenant, value).select(F.col(x.join_column).alias(key)) for x in dict.fromkeys(links)]
    keys = reduce(DataFrame.union, one).distinct()
    if last is not None:
        keys = keys.where(F.col(key) > F.lit(last))
    if rows is not None:
        keys = keys.orderBy(key).limit(rows)
    return df.join(keys, key, "left_semi")


def primary_key_rows(df: DataFrame, key: str, value: object, last: object | None = None) -> DataFrame:
    """The row of a table whose key is the tenant itself."""
    rows = df.where(F.col(key) == F.lit(value))
    return rows if last is None else rows.where(F.col(key) > F.lit(last))


@dataclass(frozen=True)
class StaticTableFilter:
    """Databases and tables by name: a list of those wanted, or else of those not wanted."""

    dbs: tuple[str, ...] = ()
    not_dbs: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    not_tables: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.dbs and self.not_dbs or self.tables and self.not_tables:
            raise ValueError("give the wanted names or the unwanted ones, not both")

    def predicate(self) -> Column:
        def of(column: str, wanted: tuple[str, ...], unwanted: tuple[str, ...]) -> Column:
            return F.col(column).isin(*wanted) if wanted else ~F.col(column).isin(*unwanted) if unwanted else F.lit(True)

        return of("db", self.dbs, self.not_dbs) & of("table_name", self.tables, self.not_tables) & ~F.col("db").isin(*SYSTEM_DATABASES)

    def apply(self, catalog: DataFrame) -> DataFrame:
        return catalog.where(self.predicate())


@dataclass(frozen=True)
class ShardedTableFilter:
    """Tables of one database that hold a tenant's rows: with the tenant column, joined, or keyed by the tenant."""

    db: str
    tenant: str
    joined: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    included: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.ignored and self.included:
            raise ValueError("give the included tables or the ignored ones, not both")
        for p in (*self.ignored, *self.included):
            re.compile(p)

    def apply(self, columns: DataFrame) -> DataFrame:
        """``columns``: db, table_name, column_name. A table that qualifies twice is listed once."""
        name = F.col("table_name")
        kept = columns.where(F.col("db") == self.db)
        if self.included:
            kept = kept.where(reduce(Column.__or__, (name.rlike(p) for p in self.included)))
        for p in self.ignored:
            kept = kept.where(~name.rlike(p))
        kind = F.when(name.isin(*self.joined), "joined").when(name.isin(*self.primary_key), "primary_key").when(F.max(F.col("column_name") == self.tenant), "tenant")
        return kept.groupBy("db", "table_name").agg(kind.alias("kind")).where("kind IS NOT NULL")


def renamed(column: Column, names: dict[str, str]) -> Column:
    """A name's new name, or itself."""
    if not names:
        return column
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), column), column)


def inverse(names: dict[str, str]) -> dict[str, str]:
    """The renaming backwards; two names for one target are an error."""
    back = {v: k for k, v in names.items()}
    if len(back) < len(names):
        raise ValueError("two names are rewritten to the same one")
    return back
