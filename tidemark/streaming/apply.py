"""The change log as a stream: applying it to a store, and counting what must be verified again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import key_text
from ..operators import changes
from ..sources.change_log import log_stream as log_stream
from ..sources.store import TableStore

Gate = Callable[[], None]
Listener = Callable[[DataFrame, int], None]


def applier(store: TableStore, gate: Gate | None = None, listeners: tuple[Listener, ...] = (), log: str = "log", prepared: Callable[[DataFrame], DataFrame] | None = None) -> Listener:
    """A batch function: fold the batch into the store once, then tell the listeners, in order.

    ``prepared`` makes events (key, position, op, old, new) of what the log
    holds. The store remembers up to which position it has the log, so events
    that come again are not folded again, whatever batch they come in;
    listeners are told with that position and see to that themselves. ``gate``
    is called before a batch and may hold it back.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if gate:
            gate()
        batch = batch.persist()
        try:
            if (last := batch.agg(F.max("position")).first()[0]) is None:
                return
            events = prepared(batch) if prepared else batch
            fold(store, events, log, last)
            for listener in listeners:
                listener(events, last)
        finally:
            batch.unpersist()

    return run


def fold(store: TableStore, events: DataFrame, log: str, last: int) -> bool:
    """Fold the events of a log that a store does not have yet into it, up to position ``last``."""
    fresh = events.where(F.col("position") > store.applied(log))
    return store.update(fresh.select(F.col("key").alias(store.key)), lambda rows: changes.apply_changes(rows, fresh, store.key), (log, last))


def start(stream: DataFrame, run: Listener, checkpoint: str, seconds: float | None = 0.0, mode: str = "append") -> StreamingQuery:
    """Apply batch after batch, looking for more every so many seconds; None: those files that are there, and stop."""
    writer = stream.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def drain(stream: DataFrame, run: Listener, checkpoint: str, mode: str = "append") -> list[dict]:
    """Apply all that is there, in as many batches as the source makes of it, and stop; a report of each batch with events."""
    query = start(stream, run, checkpoint, mode=mode)
    try:
        query.processAllAvailable()
        return [p for p in map(_report, query.recentProgress) if p["rows"]]
    finally:
        query.stop()


def _report(progress) -> dict:
    return {"batch": progress["batchId"], "rows": progress["numInputRows"], "end": progress["sources"][0]["endOffset"]}


STORE_SCHEMA = "id string, db string, table_name string, key string, changes bigint"


class ReverifyStore:
    """Counts of changes by key; a key stays until as many were verified as were added.

    Keys of all types are held as text (``keys.key_text``), beside their table.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.store = TableStore(spark, path, T._parse_datatype_string(STORE_SCHEMA), "id", buckets)
        self.closed = False

    @staticmethod
    def _named(events: DataFrame) -> DataFrame:
        text = key_text(F.col("key"), events.schema["key"].dataType)
        out = events.withColumn("key", text)
        return out.withColumn("id", F.concat_ws("\x1f", "db", "table_name", "key"))

    def add(self, events: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Count the events' keys (db, table_name, key); after cutover began none may come."""
        if self.closed:
            if not events.isEmpty():
                raise RuntimeError("an event arrived after cutover had begun")
            return
        named = self._named(events.select("db", "table_name", "key"))
        counted = changes.changes_by_key(named).withColumn("id", F.concat_ws("\x1f", "db", "table_name", "key"))
        sums = lambda now: now.unionByName(counted).groupBy("id", "db", "table_name", "key").agg(F.sum("changes").alias("changes"))
        self.store.update(named.select("id"), sums, batch)

    def entries(self) -> DataFrame:
        """db, table_name, key (text), changes."""
        return self.store.read().drop("id")

    def take_off(self, verified: DataFrame) -> None:
        """Less the changes that were verified; what came meanwhile stays."""
        named = self._named(verified)
        self.store.update(named.select("id"), lambda now: changes.after_verifying(now, named))

    def rows(self) -> int:
        return changes.store_size(self.entries()).first()["row_count"]
