"""Sources, damaged targets and change logs made of the driver's tables by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table


def money(column: str) -> Column:
    """A double as a decimal, which all engines write alike."""
    return F.col(column).cast("decimal(18,2)")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").alias("o_totalprice"), "o_orderpriority")


def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where("o_orderkey % 89 <> 7")


def damaged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that lacks rows, has others' statuses, and has rows the source has not."""
    status = F.when(F.col("o_orderkey") % 101 == 5, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return orders(spark, sf_dir).where("o_orderkey % 97 <> 3").withColumn("o_orderstatus", status)


def cents(column: str) -> Column:
    return (F.col(column).cast("decimal(18,2)") * 100).cast("bigint")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, op, key, old, new over ``events``: signup inserts, error deletes, all else updates from the value before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", cents("value").alias("v"))
    before = F.lag("v").over(Window.partitionBy("user_id").orderBy("event_id"))
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    row = lambda v: F.struct(F.col("user_id").alias("k"), v.alias("v"))
    named = events.withColumn("op", op).withColumn("before", before)
    return named.select(
        F.col("event_id").alias("position"), "op", F.col("user_id").alias("key"),
        F.when(F.col("op") != "I", row(F.col("before"))).alias("old"), F.when(F.col("op") != "D", row(F.col("v"))).alias("new"),
    )


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, v: a table the log applies to."""
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), cents("c_acctbal").alias("v"))


def catalog_columns(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """db, table_name, column_name, at of the tables' columns."""
    rows = [("tpch", n, c, i) for n in names for i, c in enumerate(table(spark, sf_dir, n).columns)]
    return spark.createDataFrame(rows, "db string, table_name string, column_name string, at int")
