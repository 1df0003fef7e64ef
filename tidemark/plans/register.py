"""How plans add their query and its SQL to the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Tables made by rule, as DuckDB says them.
ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(18,2) AS o_totalprice, o_orderpriority FROM orders)"
SOURCE = f"(SELECT * FROM {ORDERS} WHERE o_orderkey % 89 <> 7)"
TARGET = f"(SELECT * REPLACE (CASE WHEN o_orderkey % 101 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM {ORDERS} WHERE o_orderkey % 97 <> 3)"
NULL_TEXT = "NULL_PBj}b]74P@JTo$5G_null"
LOG = """(SELECT event_id AS position, user_id AS key, CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
  CASE WHEN event_type <> 'signup' THEN lag((value::DECIMAL(18,2) * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) END AS old_v,
  CASE WHEN event_type <> 'error' THEN (value::DECIMAL(18,2) * 100)::BIGINT END AS new_v FROM events)"""
BALANCES = "(SELECT c_custkey AS k, (c_acctbal::DECIMAL(18,2) * 100)::BIGINT AS v FROM customer WHERE c_custkey % 2 = 0)"


def fingerprint_sql(columns: list[str], null_text: str = NULL_TEXT) -> str:
    """The row fingerprint of columns whose text is the same on both engines."""
    return "md5(" + " || ".join(f"md5(coalesce({c}::VARCHAR, '{null_text}'))" for c in columns) + ")"


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that are compared across engines."""
    return df.select(*(F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema))


def plain_sql(sql: str) -> str:
    """The same for a query over orders."""
    return f"SELECT * REPLACE (o_totalprice::DOUBLE AS o_totalprice) FROM ({sql})"


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
