"""Change events as MySQL statements, annotations, and names in backticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import padded


def quoted(*names: str) -> str:
    """Names in backticks, joined by dots."""
    return ".".join(f"`{n.replace('`', '``')}`" for n in names)


def full_name(db: Column, table: Column) -> Column:
    return F.concat_ws(".", db, table)


def escaped(text: Column) -> Column:
    """A text literal's inside: quotes doubled, backslashes as they are."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def literal(column: Column, kind: T.DataType, json: bool = False, fixed_size: int | None = None) -> Column:
    """A value as a literal of its column's type; null is NULL."""
    if json:
        text = F.concat(F.lit("CAST('"), escaped(F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit("null"))), F.lit("' AS JSON)"))
    elif isinstance(kind, T.BooleanType):
        text = column.cast("int").cast("string")
    elif isinstance(kind, T.IntegralType):
        text = column.cast("string")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        text = F.regexp_replace(column.cast("string"), r"\.0$", "")
    elif isinstance(kind, T.BinaryType):
        bytes_ = padded(column, fixed_size) if fixed_size else column
        text = F.concat(F.lit("_binary'"), escaped(F.decode(bytes_, "ISO-8859-1")), F.lit("'"))
    elif isinstance(kind, T.StringType | T.DecimalType | T.DateType | T.TimestampType | T.TimestampNTZType):
        text = F.concat(F.lit("'"), escaped(column.cast("string")), F.lit("'"))
    else:
        raise TypeError(f"no literal for {kind.simpleString()}")
    return F.when(column.isNull(), F.lit("NULL")).otherwise(text)


def _values(image: str, row: T.StructType, json: set[str]) -> dict[str, Column]:
    return {f.name: literal(F.col(f"{image}.`{f.name}`"), f.dataType, f.name in json) for f in row}


def statement(row: T.StructType, db: str, table: str, json_columns: tuple[str, ...] = ()) -> Column:
    """The statement of an event (op, old, new): insert unless there, update and delete only the row as it was.

    A null in the old row is asked for with IS NULL.
    """
    json, name = set(json_columns), quoted(db, table)
    new, old = _values("new", row, json), _values("old", row, json)
    columns = ",".join(quoted(c) for c in new)
    where = F.concat_ws(" AND ", *(F.when(F.col(f"old.`{c}`").isNull(), F.lit(f"{quoted(c)} IS NULL")).otherwise(F.concat(F.lit(f"{quoted(c)}="), v)) for c, v in old.items()))
    sets = F.concat_ws(",", *(F.concat(F.lit(f"{quoted(c)}="), v) for c, v in new.items()))
    return (
        F.when(F.col("op") == "I", F.concat(F.lit(f"INSERT IGNORE INTO {name} ({columns}) VALUES ("), F.concat_ws(",", *new.values()), F.lit(")")))
        .when(F.col("op") == "U", F.concat(F.lit(f"UPDATE {name} SET "), sets, F.lit(" WHERE "), where))
        .when(F.col("op") == "D", F.concat(F.lit(f"DELETE FROM {name} WHERE "), where))
    )


def insert_rows(rows: DataFrame, db: str, table: str, batch: Column, order: str, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """batch, row_count and one statement for the rows of each batch, in order; what is there stays.

    A batch is what one statement takes, so its rows fit a task.
    """
    values = [literal(F.col(f"`{f.name}`"), f.dataType, f.name in json_columns) for f in rows.schema]
    one = F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")"))
    head = f"INSERT IGNORE INTO {quoted(db, table)} ({','.join(quoted(c) for c in rows.columns)}) VALUES "
    by = rows.select(batch.alias("batch"), F.struct(F.col(order).alias("at"), one.alias("values")).alias("row")).groupBy("batch")
    return by.agg(F.count("*").alias("row_count"), F.array_sort(F.collect_list("row")).alias("rows")).select("batch", "row_count", F.concat(F.lit(head), F.array_join("rows.values", ",")).alias("statement"))


def annotated(sql: Column, annotation: str) -> Column:
    return F.concat(F.lit(f"/*{annotation}*/ "), sql)


def annotation(sql: Column) -> Column:
    """The comment at a statement's very start; '' if there is none."""
    return F.regexp_extract(sql, r"^/\*(.*?)\*/", 1)
