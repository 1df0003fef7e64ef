"""Progress of a run: totals, speed, time left, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batch_size import PARAMETERS
from .scan import running_sum

#: Table states, in the order of a status list.
STATES = ("waiting", "copying", "completed")


def table_state(position: Column, target: Column) -> Column:
    """waiting, copying or completed, by the position reached and the one to reach."""
    return F.when(target.isNull() | (position >= target), F.lit("completed")).when(position.isNull(), F.lit("waiting")).otherwise(F.lit("copying"))


def totals(tables: DataFrame) -> DataFrame:
    """One row over tables (position, target_position): sums and counts by state."""
    state = table_state(F.col("position"), F.col("target_position"))
    reached = F.least(F.coalesce("position", F.lit(0)), F.coalesce("target_position", F.lit(0)))
    return tables.withColumn("state", state).agg(
        F.coalesce(F.sum("target_position"), F.lit(0)).cast("bigint").alias("target_total"), F.coalesce(F.sum(reached), F.lit(0)).cast("bigint").alias("done_total"),
        F.count("*").alias("tables"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "copying").alias("active"),
    )


def by_state(tables: DataFrame) -> DataFrame:
    """state and tables with their names in order."""
    named = tables.withColumn("state", table_state(F.col("position"), F.col("target_position")))
    return named.groupBy("state").agg(F.count("*").alias("tables"), F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("names"))


def speed(samples: DataFrame, run: str, window: int) -> DataFrame:
    """Rows a second between the newest and the oldest of the last ``window`` samples (position, at in seconds).

    No speed while there is one sample, or none in between.
    """
    ring = Window.partitionBy(run).orderBy("at").rowsBetween(-(window - 1), 0)
    moved, took = F.col("position") - F.first("position").over(ring), F.col("at") - F.first("at").over(ring)
    return samples.withColumn("speed", F.when(took > 0, moved / took))


def cumulative(deltas: DataFrame, by: str, order: str, delta: str) -> DataFrame:
    """Position so far of each table."""
    return running_sum(deltas, by, order, delta, "position")


def seconds_left(done: Column, target: Column, speed_: Column) -> Column:
    """Whole seconds to go at a speed; null without one, never negative."""
    return F.ceil(F.greatest(target - done, F.lit(0)) / F.nullif(speed_, F.lit(0))).cast("bigint")


def lag_seconds(now: Column, event: Column) -> Column:
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(event.cast("timestamp"))


def written_by_table(batches: DataFrame) -> DataFrame:
    """rows and bytes written to each table."""
    return batches.groupBy("table_name").agg(F.count("*").alias("row_count"), F.sum("bytes").alias("bytes"))


def row_bytes(df: DataFrame) -> Column:
    """A row's size: the length of its values as JSON."""
    return F.length(F.to_json(F.struct(*df.columns))).cast("bigint")


def most_batch_rows(columns: DataFrame) -> DataFrame:
    """Rows one statement can take, by table; ``columns`` has a row for each column of a table."""
    return columns.groupBy("db", "table_name").agg(F.floor(F.lit(PARAMETERS) / F.count("*")).cast("bigint").alias("max_batch"))


def catalog_with_limits(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their largest batch."""
    return tables.join(most_batch_rows(columns), ["db", "table_name"])
