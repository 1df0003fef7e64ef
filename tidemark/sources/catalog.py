"""Tables of the session's catalog: what there is, which column pages it, and empty copies of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import uniqueness
from ..operators.selection import SYSTEM_DATABASES, StaticTableFilter, inverse

#: Types a key may have; text is compared byte by byte here, as a key must be.
KEY_TYPES = (T.IntegralType, T.DecimalType, T.BinaryType, T.StringType)


class SchemaError(ValueError):
    """A table can't be copied as it is."""


@dataclass(frozen=True)
class TableSpec:
    """One table: its name, schema and key, and columns left out of or decompressed for verification."""

    db: str
    name: str
    schema: T.StructType
    key: str
    ignored: tuple[str, ...] = ()
    compressed: Mapping[str, str] = field(default_factory=dict)

    @property
    def full_name(self) -> str:
        return f"{self.db}.{self.name}"


def resolve_key(table: str, schema: T.StructType, chosen: Mapping[str, str], primary: Mapping[str, Sequence[str]], fallback: str | None = None) -> str:
    """The column that pages a table: chosen for it, else its single primary key column, else the fallback."""
    names = schema.names
    key = chosen.get(table)
    if key is None and len(primary.get(table, ())) == 1:
        key = primary[table][0]
    if key is None and fallback in names:
        key = fallback
    if key is None:
        raise SchemaError(f"{table} has no column to page by: no single primary key, none chosen and no fallback")
    if key not in names:
        raise SchemaError(f"{table} has no column {key}")
    kind = schema[key].dataType
    if not isinstance(kind, KEY_TYPES) or isinstance(kind, T.StringType) and kind.collation != "UTF8_BINARY":
        raise SchemaError(f"{table}.{key} is {kind.simpleString()}, which has no order of bytes or numbers")
    return key


def databases(spark: SparkSession) -> list[str]:
    """Databases but the server's own."""
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name not in SYSTEM_DATABASES)


def tables_of(spark: SparkSession, db: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(db) if not t.isTemporary)


def load_tables(
    spark: SparkSession, wanted: StaticTableFilter | None = None, chosen: Mapping[str, str] | None = None, primary: Mapping[str, Sequence[str]] | None = None,
    fallback: str | None = None, check_unique: bool = True,
) -> dict[str, TableSpec]:
    """``db.table`` → spec of every table wanted. A key whose values repeat is an error, since rows would be skipped."""
    listed = [(d, t) for d in databases(spark) for t in tables_of(spark, d)]
    if wanted and listed:
        listed = [tuple(r) for r in wanted.apply(spark.createDataFrame(listed, "db string, table_name string")).collect()]
    out = {}
    for db, name in sorted(listed):
        df, full = spark.table(f"`{db}`.`{name}`"), f"{db}.{name}"
        key = resolve_key(full, df.schema, chosen or {}, primary or {}, fallback)
        if check_unique and not uniqueness(df, [key]).first()["usable"]:
            raise SchemaError(f"{full}.{key} has values that repeat")
        out[full] = TableSpec(db, name, df.schema, key)
    return out


def foreign_keys(constraints: DataFrame, dbs: Sequence[str]) -> DataFrame:
    """db, table_name, foreign_keys: how many foreign keys each table has (``constraints``: db, table_name, constraint_name, constraint_type).

    A constraint is listed once for each of its columns and counts once.
    """
    own = constraints.where(F.col("db").isin(*dbs) & (F.col("constraint_type") == "FOREIGN KEY"))
    return own.groupBy("db", "table_name").agg(F.count_distinct("constraint_name").alias("foreign_keys"))


def check_no_foreign_keys(constraints: DataFrame, dbs: Sequence[str]) -> None:
    """Rows are copied in any order, which a foreign key would refuse."""
    found = foreign_keys(constraints, dbs).orderBy("db", "table_name").limit(20).collect()
    if found:
        raise SchemaError("tables with foreign keys: " + ", ".join(f"{r['db']}.{r['table_name']} ({r['foreign_keys']})" for r in found))


def check_single_keys(key_columns: DataFrame, tables: DataFrame) -> None:
    """Tables that a tenant keys must have a primary key of one column (``key_columns``: db, table_name, column_name; ``tables``: db, table_name, kind)."""
    keyed = tables.where("kind = 'primary_key'").join(key_columns, ["db", "table_name"], "left").groupBy("db", "table_name").agg(F.count("column_name").alias("n"))
    bad = keyed.where("n <> 1").orderBy("db", "table_name").limit(20).collect()
    if bad:
        raise SchemaError("primary keys that are not one column: " + ", ".join(f"{r['db']}.{r['table_name']} ({r['n']})" for r in bad))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, as their file system says."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """table_name, bytes of tables by their paths; ``scan.by_largest`` orders them."""
    return spark.createDataFrame([(n, bytes_of(spark, p)) for n, p in paths.items()], "table_name string, bytes bigint")


def create_like(spark: SparkSession, specs: Sequence[TableSpec], db_names: Mapping[str, str] | None = None, table_names: Mapping[str, str] | None = None, allow_existing: bool = False, first: Sequence[str] = ()) -> list[str]:
    """Empty tables with the sources' schemas under their new names, those of ``first`` before the rest."""
    dbs, tables = dict(db_names or {}), dict(table_names or {})
    inverse(tables)
    order = {n: i for i, n in enumerate(first)}
    made = []
    for spec in sorted(specs, key=lambda s: (order.get(s.full_name, len(order)), s.full_name)):
        db, name = dbs.get(spec.db, spec.db), tables.get(spec.name, spec.name)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
        spark.createDataFrame([], spec.schema).write.mode("ignore" if allow_existing else "error").saveAsTable(f"`{db}`.`{name}`")
        made.append(f"{db}.{name}")
    return made


def check_columns(df: DataFrame, schema: T.StructType, name: str) -> None:
    """Rows must have the table's columns, in number and name."""
    if df.columns != schema.names:
        raise SchemaError(f"{name} has {len(schema.names)} columns but event has {len(df.columns)} columns")


#: Events by type → what turns them into change-log rows; an unknown type is an error.
Handlers = Mapping[str, Callable[[DataFrame], DataFrame | None]]
EVENT_TYPES = ("rows", "rotate", "format", "query", "commit", "ddl")


def handled(raw: DataFrame, handlers: Handlers) -> list[DataFrame]:
    """What each handler makes of the events of its type (column ``event_type``)."""
    for kind in handlers:
        if kind not in EVENT_TYPES:
            raise SchemaError(f"unknown event type {kind}")
    return [f(raw.where(raw["event_type"] == kind)) for kind, f in handlers.items()]
