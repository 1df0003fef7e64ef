"""Queries over keys, batch sizes and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batch_size, keys
from ..operators import progress
from ..session import table
from ..sources import fixtures
from .register import query

POINTS = {100: 2000, 10000: 200}


@query("""SELECT p_partkey, (CASE WHEN s <= 100 THEN 2000 WHEN s >= 10000 THEN 200 ELSE 2000 * (10000 - s) // 9900 + 200 * (s - 100) // 9900 END)::BIGINT AS batch_size
FROM (SELECT p_partkey, p_partkey % 12000 AS s FROM part)""")
def batch_size_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch by the size of a row."""
    return table(spark, sf_dir, "part").select("p_partkey", batch_size.interpolated(F.col("p_partkey") % 12000, POINTS).alias("batch_size"))


@query("""SELECT p_partkey, least((CASE WHEN s <= 100 THEN 2000 WHEN s >= 10000 THEN 200 ELSE 2000 * (10000 - s) // 9900 + 200 * (s - 100) // 9900 END)::BIGINT, 65535 // c)::BIGINT AS batch_size
FROM (SELECT p_partkey, p_partkey % 12000 AS s, 1 + p_partkey % 90 AS c FROM part)""")
def batch_size_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, within what one statement takes."""
    return table(spark, sf_dir, "part").select("p_partkey", batch_size.batch_rows(F.col("p_partkey") % 12000, 1 + F.col("p_partkey") % 90, POINTS).alias("batch_size"))


@query("""SELECT c_nationkey, count(*) AS row_count, sum(length('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'))::BIGINT AS bytes FROM customer GROUP BY 1""")
def batch_byte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of rows as JSON, by nation."""
    rows = table(spark, sf_dir, "customer")
    sized = rows.select("c_nationkey", progress.row_bytes(rows.select("c_custkey", "c_name")).alias("bytes"))
    return progress.written_by_table(sized.withColumnRenamed("c_nationkey", "table_name")).withColumnRenamed("table_name", "c_nationkey")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tables: target by key, position by key, none, or beyond."""
    n = table(spark, sf_dir, "nation")
    at = F.when(F.col("n_nationkey") % 4 == 0, None).when(F.col("n_nationkey") % 4 == 1, F.col("n_nationkey") * 10).otherwise(F.col("n_nationkey") * 100 + 5)
    to = F.when(F.col("n_nationkey") % 7 != 6, F.col("n_nationkey") * 100)
    return n.select(F.col("n_name").alias("table_name"), at.cast("bigint").alias("position"), to.cast("bigint").alias("target_position"))


_PROGRESS = """(SELECT n_name AS table_name, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN n_nationkey * 10 ELSE n_nationkey * 100 + 5 END::BIGINT AS position,
  CASE WHEN n_nationkey % 7 <> 6 THEN n_nationkey * 100 END::BIGINT AS target_position FROM nation)"""
_STATE = "CASE WHEN target_position IS NULL OR position >= target_position THEN 'completed' WHEN position IS NULL THEN 'waiting' ELSE 'copying' END"


@query(f"""SELECT coalesce(sum(target_position), 0)::BIGINT AS target_total, coalesce(sum(least(coalesce(position, 0), coalesce(target_position, 0))), 0)::BIGINT AS done_total,
count(*) AS tables, count(*) FILTER (WHERE {_STATE} = 'completed') AS completed, count(*) FILTER (WHERE {_STATE} = 'copying') AS active FROM {_PROGRESS}""")
def progress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's progress in one row."""
    return progress.totals(_progress(spark, sf_dir))


@query(f"SELECT {_STATE} AS state, count(*) AS tables, string_agg(table_name, ',' ORDER BY table_name) AS names FROM {_PROGRESS} GROUP BY 1")
def progress_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by state."""
    return progress.by_state(_progress(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN secs > first_value(secs) OVER w THEN (event_id - first_value(event_id) OVER w)::DOUBLE / (secs - first_value(secs) OVER w)::DOUBLE END AS speed
FROM (SELECT event_id, user_id, (event_id * 3 + event_id % 2) AS secs FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY secs ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""")
def speed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed over the last forty samples of each run."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), F.col("event_id").alias("position"), (F.col("event_id") * 3 + F.col("event_id") % 2).alias("at"))
    return progress.speed(e, "run", 40).select("event_id", "speed")


@query("SELECT event_id, (sum((value::DECIMAL(18,2) * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS position FROM events")
def cumulative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position so far, by sums of deltas."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", fixtures.cents("value").alias("delta"))
    return progress.cumulative(e, "user_id", "event_id", "delta").select("event_id", "position")


@query("SELECT n_nationkey, ceil(greatest(1000 - n_nationkey * 50, 0) / nullif(n_nationkey % 4, 0)::DOUBLE)::BIGINT AS eta FROM nation")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left at a speed."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", progress.seconds_left(k * 50, F.lit(1000), (k % 4).cast("double")).alias("eta"))


@query("SELECT event_id, (epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts)))::BIGINT AS lag FROM events")
def lag_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each event at a given time."""
    return table(spark, sf_dir, "events").select("event_id", progress.lag_seconds(F.lit("2030-01-01").cast("timestamp"), F.col("ts")).alias("lag"))


_HEX = "md5(o_orderkey::VARCHAR)"


@query(f"""SELECT o_orderkey, {_HEX} AS hex, left({_HEX}, 8) || '00000000' AS padded, ('0x' || left({_HEX}, 15))::BIGINT AS head60, false AS is_max,
'{{"type":"binary","value":"' || {_HEX} || '","column":"id"}}' AS json FROM orders""")
def binary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary keys as hex, padded, as a number and as JSON."""
    key = F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    return o.select(
        "o_orderkey", keys.to_hex(F.col("key")).alias("hex"), keys.to_hex(keys.padded(F.substring("key", 1, 4), 8)).alias("padded"),
        F.floor(F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("bigint")).alias("head60"), keys.is_max(F.col("key"), True).alias("is_max"), keys.key_json("id", F.col("key"), True).alias("json"),
    )


@query(f"SELECT {_HEX} AS hex FROM orders ORDER BY unhex({_HEX}) LIMIT 50")
def binary_key_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page in the order of bytes."""
    from ..operators.scan import keyset_page

    o = table(spark, sf_dir, "orders").select(F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary"))).alias("key"))
    return keyset_page(o, "key", None, 50).select(keys.to_hex(F.col("key")).alias("hex"))


@query("""SELECT c_custkey, CASE WHEN c_custkey < c_nationkey * 50 THEN -1 WHEN c_custkey = c_nationkey * 50 THEN 0 ELSE 1 END AS compared,
'{"type":"uint64","value":"' || c_custkey || '","column":"id"}' AS json, c_custkey::DOUBLE AS position, false AS is_max FROM customer""")
def integer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer keys compared, as JSON and as a number."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", keys.compare(k, F.col("c_nationkey") * 50).alias("compared"), keys.key_json("id", k, False).alias("json"), keys.numeric_position(k, False).alias("position"), keys.is_max(k, False).alias("is_max"))
