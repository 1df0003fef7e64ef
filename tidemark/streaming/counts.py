"""Changes by key as the keyed state of a stream.

Every key has one number, its changes so far, in the stream's own state, which
RocksDB keeps beside the tasks and the checkpoint makes good after a failure. A
batch touches the keys that it holds and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChangesByKey(StatefulProcessor):
    """Adds a batch's changes to a key's number and tells the new one.

    With ``again_ms`` a key that was told is told once more after that time
    without a change, so that it is verified again; then it is forgotten.
    """

    def __init__(self, again_ms: int | None = None):
        self.again_ms = again_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getValueState("changes", T.StructType([T.StructField("changes", T.LongType())]))

    def _told(self, key, changes: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "changes": [changes]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.changes.get() if self.changes.exists() else None
        total = (before[0] if before else 0) + sum(int(part["changes"].sum()) for part in rows)
        self.changes.update((total,))
        if self.again_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.again_ms)
        yield from self._told(key, total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.changes.get()
        self.changes.clear()
        if now is not None:
            yield from self._told(key, now[0])

    def close(self) -> None:
        pass


def counted_changes(stream: DataFrame, again_ms: int | None = None) -> DataFrame:
    """key and changes (so far) of every key that a batch of a stream has changed; update mode.

    A key's rows of a batch reach its state as Arrow batches, one number each.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema["key"].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("changes", T.LongType())])
    ones = stream.select("key", F.lit(1).cast("bigint").alias("changes"))
    mode = "None" if again_ms is None else "ProcessingTime"
    return ones.groupBy("key").transformWithStateInPandas(ChangesByKey(again_ms), out, "Update", mode)
