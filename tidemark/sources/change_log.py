"""Change logs as a stream source whose batches end where transactions do.

A log is a folder of Parquet files to which events are appended: what is not
there yet lies after all that is. An event has a ``position`` (bigint) and, if
the log tells where transactions end, a ``resumable_position``: the position of
the last such end so far, the event's own if it is one itself. Without that
column every position is an end.

The offset of a log is the position of an end, and the file that holds it. A
batch takes events from one end to another, ``events_per_batch`` of them at
most, or one transaction if that has more: events of a transaction that is still
open stay in the log until its end is there. The source begins after the
positions it is given, which the stores that are written to hold, so it does not
matter what a checkpoint remembers.

What is read to plan a batch are footers, and the two position columns of the
row groups from the last end to the next. Where row groups overlap, more are
read, but of no more positions than a batch has is anything kept. Events are
read in tasks, by row group, as Arrow batches. Files are opened by Arrow's file
systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Events of a batch, unless one transaction has more, and those that a task reads.
EVENTS_A_BATCH, EVENTS_A_TASK = 1_000_000, 250_000
#: Where a log is before its first event.
START = -1
POSITION, ENDED = "position", "resumable_position"


@dataclass(frozen=True)
class Unit:
    """A row group of a log's file: the positions in it, and how many events."""

    file: str
    group: int
    low: int
    high: int
    rows: int


class Span(InputPartition):
    """Row groups of a log that one task reads, and the positions it takes of them: after ``low`` up to ``high``."""

    def __init__(self, log: str, folder: str, groups: list[tuple[str, int]], low: int, high: int):
        self.log, self.folder, self.groups, self.low, self.high = log, folder, groups, low, high


class LogFolder:
    """The files of one log, as far as they have been looked at."""

    def __init__(self, folder: str):
        self.fs, self.path = arrow_fs.FileSystem.from_uri(folder)
        self._known: dict[str, list[Unit]] = {}

    def open(self, name: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.fs.open_input_file(f"{self.path}/{name}"))

    def units(self) -> list[Unit]:
        """All row groups, by their first position. The footer of a file is read once."""
        for info in self.fs.get_file_info(arrow_fs.FileSelector(self.path, allow_not_found=True)):
            name = info.base_name
            if info.is_file and name.endswith(".parquet") and not name.startswith(("_", ".")) and name not in self._known:
                self._known[name] = self._groups(name)
        return sorted((u for units in self._known.values() for u in units), key=lambda u: (u.low, u.high, u.file, u.group))

    def _groups(self, name: str) -> list[Unit]:
        file, out = self.open(name), []
        column = next(i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == POSITION)
        for g in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(g)
            if not group.num_rows:
                continue
            stats = group.column(column).statistics
            if stats is not None and stats.has_min_max:
                low, high = stats.min, stats.max
            else:
                low, high = (f(file.read_row_group(g, columns=[POSITION]).column(0)).as_py() for f in (pc.min, pc.max))
            out.append(Unit(name, g, low, high, group.num_rows))
        return out

    def _positions(self, unit: Unit, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The positions of a row group after ``last``, and which are ends, so many at a time."""
        file = self.open(unit.file)
        names = [n for n in (POSITION, ENDED) if n in file.schema_arrow.names]
        for part in file.iter_batches(EVENTS_A_TASK, row_groups=[unit.group], columns=names):
            part = pa.Table.from_batches([part]).filter(pc.field(POSITION) > last)
            position = part[POSITION].to_numpy()
            yield position, pc.fill_null(pc.equal(part[ENDED], part[POSITION]), False).to_numpy() if ENDED in names else np.ones(len(position), bool)

    def next_end(self, last: int, events: int) -> tuple[int, str]:
        """The last end of a transaction within ``events`` events after ``last``, else the first end after those, else ``last`` itself; and its file.

        A position that several rows share is taken whole or not at all. In
        memory are so many positions and ends, however the rows lie in the
        files and however long a transaction is.
        """
        units = [u for u in self.units() if u.high > last]
        least, ends, rows = _Least(events + 1), _Least(events), 0
        for i, unit in enumerate(units):
            for position, end in self._positions(unit, last):
                least.add(position)
                ends.add(position[end])
                rows += len(position)
            below = units[i + 1].low if i + 1 < len(units) else None  # of the positions before the next row group nothing is missing
            if below is not None and (rows < events or (least.found() < below).sum() < events):
                continue
            found = least.found()
            fit = ends.found()[ends.found() < found.max()] if len(found) > events else ends.found()
            first = ends.found().min(initial=np.iinfo(np.int64).max)
            if len(fit) or len(ends.found()) and (below is None or first < below):
                chosen = int(fit.max() if len(fit) else first)
                return chosen, next(u.file for u in units if u.low <= chosen <= u.high and any((p[e] == chosen).any() for p, e in self._positions(u, last)))
        return last, ""

    def read(self, groups: list[tuple[str, int]], low: int, high: int, log: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for name, group in groups:
            file = self.open(name)
            here = [f.name for f in schema if f.name in file.schema_arrow.names]
            for part in file.iter_batches(10_000, row_groups=[group], columns=here):
                table = pa.Table.from_batches([part]).filter((pc.field(POSITION) > low) & (pc.field(POSITION) <= high))
                columns = [table[f.name].cast(f.type) if f.name in here else pa.array([log] * table.num_rows, f.type) if f.name == "log" else pa.nulls(table.num_rows, f.type) for f in schema]
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches()


class _Least:
    """The least of many numbers, ``most`` of them."""

    def __init__(self, most: int):
        self.most, self.held, self.parts = most, 0, [np.empty(0, np.int64)]

    def add(self, numbers: np.ndarray) -> None:
        self.parts.append(numbers)
        self.held += len(numbers)
        if self.held > self.most + EVENTS_A_TASK:
            self.found()

    def found(self) -> np.ndarray:
        if len(self.parts) > 1:
            least = np.concatenate(self.parts)
            if len(least) > self.most:
                least.partition(self.most - 1)
                least = least[: self.most].copy()
            self.parts, self.held = [least], len(least)
        return self.parts[0]


def spans(log: str, folder: str, units: list[Unit], low: int, high: int) -> list[Span]:
    """Tasks for the events of a log after ``low`` up to ``high``."""
    out, some, rows = [], [], 0
    for u in units:
        if u.high > low and u.low <= high:
            some.append((u.file, u.group))
            rows += u.rows
            if rows >= EVENTS_A_TASK:
                out.append(Span(log, folder, some, low, high))
                some, rows = [], 0
    return [*out, Span(log, folder, some, low, high)] if some else out


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.paths: dict[str, str] = json.loads(options["logs"])
        self.after: dict[str, int] = json.loads(options.get("after", "{}"))
        self.events = int(options.get("events_per_batch", EVENTS_A_BATCH))
        if self.events < 1:
            raise ValueError("a batch needs an event at least")
        self._folders: dict[str, LogFolder] = {}

    def folder(self, log: str) -> LogFolder:
        if log not in self._folders:
            self._folders[log] = LogFolder(self.paths[log])
        return self._folders[log]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        return LogFolder(partition.folder).read(partition.groups, partition.low, partition.high, partition.log, schema)


class LogStream(_Reading, DataSourceStreamReader):
    """Offsets: {log: {"position": the end of a transaction, "file": where it is}}."""

    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.at: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        return {log: {"position": self.after.get(log, START), "file": ""} for log in self.paths}

    def latestOffset(self) -> dict:
        now = self.at or self.initialOffset()
        out = {}
        for log in self.paths:
            position, file = self.folder(log).next_end(now[log]["position"], self.events)
            out[log] = {"position": position, "file": file} if position > now[log]["position"] else now[log]
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self._seen(end)
        return [s for log, path in self.paths.items() if end[log]["position"] > start[log]["position"] for s in spans(log, path, self.folder(log).units(), start[log]["position"], end[log]["position"])]

    def commit(self, end: dict) -> None:
        self._seen(end)

    def _seen(self, end: dict) -> None:
        """A query that goes on from a checkpoint is at least where that was."""
        now = self.at or self.initialOffset()
        self.at = {log: max(now[log], end.get(log, now[log]), key=lambda o: o["position"]) for log in self.paths}


class LogRead(_Reading, DataSourceReader):
    """All whole transactions after the given positions."""

    def partitions(self) -> list[Span]:
        out = []
        for log, path in self.paths.items():
            low = high = self.after.get(log, START)
            while (end := self.folder(log).next_end(high, self.events)[0]) > high:
                high = end
            out += spans(log, path, self.folder(log).units(), low, high)
        return out or [Span("", "", [], 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.groups else iter(())


class ChangeLog(DataSource):
    """Options: ``logs`` and ``after`` (JSON: folder and position by log), ``events_per_batch``; the schema is the user's."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def streamReader(self, schema: T.StructType) -> LogStream:
        return LogStream(schema, self.options)

    def reader(self, schema: T.StructType) -> LogRead:
        return LogRead(schema, self.options)


def append(events: DataFrame, folder: str) -> None:
    """Append events to a log, in files of neighbouring positions, as one who writes a log does."""
    events.repartitionByRange(POSITION).sortWithinPartitions(POSITION).write.mode("append").parquet(folder)


def _options(reader, logs: dict[str, str], schema: T.StructType, after: dict[str, int] | None, events: int):
    return reader.format("change_log").schema(schema).option("logs", json.dumps(logs)).option("after", json.dumps(after or {})).option("events_per_batch", events)


def log_stream(spark: SparkSession, logs: dict[str, str] | str, schema: T.StructType, events_per_batch: int = EVENTS_A_BATCH, after: dict[str, int] | int = START) -> DataFrame:
    """Logs (one folder, or folders by name, of one schema) as a stream of whole transactions after the given positions.

    A column ``log`` of the schema gets a log's name.
    """
    spark.dataSource.register(ChangeLog)
    logs, after = ({"log": logs}, {"log": after}) if isinstance(logs, str) else (logs, after or {})
    return _options(spark.readStream, logs, schema, after, events_per_batch).load()


def read_log(spark: SparkSession, logs: dict[str, str] | str, schema: T.StructType, after: dict[str, int] | int = START) -> DataFrame:
    """The whole transactions that logs hold now."""
    spark.dataSource.register(ChangeLog)
    logs, after = ({"log": logs}, {"log": after}) if isinstance(logs, str) else (logs, after or {})
    return _options(spark.read, logs, schema, after, EVENTS_A_BATCH).load()
