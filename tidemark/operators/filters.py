"""What a run copies of a table: rows at the source, and events of its log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import changes
from .selection import JoinTable, joined_rows, primary_key_rows, tenant_rows


@runtime_checkable
class CopyFilter(Protocol):
    """The rows of a table that belong to a run, and the events (old, new) that do."""

    def rows(self, df: DataFrame) -> DataFrame: ...

    def events(self, events: DataFrame) -> DataFrame: ...


@runtime_checkable
class TableFilter(Protocol):
    """The tables (db, table_name, ...) of a catalog that belong to a run."""

    def apply(self, catalog: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class AllRows:
    """Everything."""

    def rows(self, df: DataFrame) -> DataFrame:
        return df

    def events(self, events: DataFrame) -> DataFrame:
        return events


@dataclass(frozen=True)
class TenantRows:
    """A tenant's rows; a row that changes its tenant ends the run, unless ``strict`` is off."""

    tenant: str
    value: object
    strict: bool = True

    def rows(self, df: DataFrame) -> DataFrame:
        return tenant_rows(df, self.tenant, self.value)

    def events(self, events: DataFrame) -> DataFrame:
        return changes.of_tenant(events, self.tenant, self.value, self.strict)


@dataclass(frozen=True)
class JoinedRows:
    """Rows that link tables name for a tenant. Their events name no tenant, so none is the run's: copy them again at cutover."""

    key: str
    links: Callable[[], Sequence[JoinTable]]
    value: object

    def rows(self, df: DataFrame) -> DataFrame:
        return joined_rows(df, self.key, self.links(), self.value)

    def events(self, events: DataFrame) -> DataFrame:
        return events.where(F.lit(False))


@dataclass(frozen=True)
class PrimaryKeyRow:
    """The row whose key is the tenant; copied at cutover only."""

    key: str
    value: object

    def rows(self, df: DataFrame) -> DataFrame:
        return primary_key_rows(df, self.key, self.value)

    def events(self, events: DataFrame) -> DataFrame:
        return events.where(F.lit(False))
