"""A whole run: copy, apply changes meanwhile, verify, cut over."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from contextlib import nullcontext
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_text, key_value
from ..metrics import Metrics
from ..scratch import written
from ..sources.catalog import Handlers, check_columns, handled
from ..sources.change_log import EVENTS_A_BATCH, log_stream
from ..sources.store import ROWS_A_BUCKET, TableStore
from ..state import RunState
from ..streaming.apply import ReverifyStore, drain, fold
from . import changes, progress, scan
from .filters import AllRows, CopyFilter, JoinedRows, PrimaryKeyRow, TenantRows
from .selection import JoinTable
from .verifiers import SMALL, InlineVerifier, Verifier
from .verifiers import VerificationFailed as VerificationFailed


class Stage(Enum):
    STARTING = "starting"
    COPYING = "copying"
    WAITING = "wait-for-cutover"
    VERIFYING = "verify-before-cutover"
    CUTOVER = "cutover"
    DONE = "done"


#: Fixed value: seconds by which a log's last event may be old for a run to count as almost caught up.
ALMOST = 10.0
#: Rows between two places at which a batch may end.
STEP = 1000
#: Seconds that a job takes from which on it loads fewer batches, and how many times as many the next one loads until then.
JOB_SECONDS, JOB_GROWTH = 30.0, 4


class Stopped(RuntimeError):
    """A run was asked to stop; its state says where to go on."""


class Throttler:
    """Holds work back while paused, or while a lag is over its limit. Off during cutover."""

    def __init__(self, lag: Callable[[], float | None] | None = None, most: float = float("inf"), wait: float = 0.05):
        self.lag, self.most, self.wait, self.paused, self.disabled = lag, most, wait, False, False

    def blocked(self) -> bool:
        if self.disabled:
            return False
        late = self.lag() if self.lag else None
        return self.paused or (late is not None and late > self.most)

    def __call__(self) -> None:
        while self.blocked():
            time.sleep(self.wait)


def wait_until(reached: Callable[[], int | None], position: int, timeout: float, poll: float = 0.05) -> None:
    """Until a replica has a position; a timeout is an error."""
    end = time.monotonic() + timeout
    while (at := reached()) is None or at < position:
        if time.monotonic() > end:
            raise TimeoutError(f"position {position} was not reached: {at}")
        time.sleep(poll)


def retried(action: Callable[[], object], times: int, wait: float = 0.0) -> object:
    """An action tried again after an error, ``times`` times in all (0: without end)."""
    tries = 0
    while True:
        try:
            return action()
        except Exception:
            tries += 1
            if times and tries >= times:
                raise
            time.sleep(wait)


@dataclass
class Table:
    """One table of a run. ``source`` reads its rows as they are now; ``log`` is its change log's folder.

    ``filter`` says which rows and events are the run's. ``when``: 'copy'
    before cutover, 'delta' once more at cutover (rows of joined tables, whose
    events name no tenant), 'last' at cutover only.

    A log holds either events (key, position, op, old, new) or raw row events
    (position, db, table_name, op, rows), also of other tables with the same
    columns; ``source_db`` and ``source_name`` are the names it knows, if the
    table is renamed. Raw logs with event types pass ``handlers`` first. Tables
    with one log are changed batch by batch together; if their targets are of
    one ``StoreGroup``, at once.
    """

    name: str
    key: str
    source: Callable[[], DataFrame]
    target: TableStore
    log: str | None = None
    rows_about: int = 0
    when: str = "copy"
    filter: CopyFilter = field(default_factory=AllRows)
    db: str = ""
    source_db: str | None = None
    source_name: str | None = None
    log_schema: object = None
    handlers: Handlers | None = None
    ignored: tuple[str, ...] = ()

    def rows(self) -> DataFrame:
        """The rows at the source that are the run's."""
        return self.filter.rows(self.source())

    def prepared(self, log: DataFrame) -> DataFrame:
        """Events of the run's rows out of what the log holds."""
        if self.handlers:
            found = [df for df in handled(log, self.handlers) if df is not None]
            log = found[0]
            for more in found[1:]:
                log = log.unionByName(more)
        if "rows" not in log.columns:
            return self.filter.events(log)
        raw = log.where((F.col("db") == (self.source_db if self.source_db is not None else self.db)) & (F.col("table_name") == (self.source_name or self.name)))
        events = changes.decoded(raw)
        check_columns(events.select("new.*"), self.target.schema, self.name)
        return changes.key_changes_split(changes.with_key(self.filter.events(events), self.key), self.key).transform(lambda e: changes.with_key(e, self.key))


def tenant_tables(
    tenant: str, value: object, own: Sequence[Table], joined: Sequence[tuple[Table, Callable[[], Sequence[JoinTable]]]] = (), keyed: Sequence[Table] = ()
) -> list[Table]:
    """The tables of a run that moves one tenant: its own rows, joined tables (again at cutover), and the table it is the key of (last)."""
    out = []
    for t in own:
        t.filter = TenantRows(tenant, value)
        out.append(t)
    for t, links in joined:
        t.filter, t.when = JoinedRows(t.key, links, value), "delta"
        out.append(t)
    for t in keyed:
        t.filter, t.when = PrimaryKeyRow(t.key, value), "last"
        out.append(t)
    return out


@dataclass
class Migration:
    """Moves tables while they change, and proves it.

    Each log is read from its beginning, or from where an earlier run's state
    ends in it, so nothing between is lost; stores remember how far they have a
    log, so nothing is applied twice. Batches are whole transactions, of
    ``events_per_batch`` events at most unless one has more.
    ``batch_rows``: rows of a copied batch, or a function that is asked before
    each; None copies a table at once, which Spark does in parallel anyway.
    Where nobody looks at batches one by one (``on_batch``, or such a function),
    a job loads several neighbours, more and more while it is short; what then
    holds for each batch holds for those together.
    """

    spark: SparkSession
    tables: list[Table]
    log_schema: object
    checkpoint: str
    ignored: tuple[str, ...] = ()
    enforce: bool = False
    threads: int = 4
    throttler: Throttler = field(default_factory=Throttler)
    state: RunState = field(default_factory=RunState)
    lock: Callable[[], None] = lambda: None
    unlock: Callable[[], None] = lambda: None
    most_downtime: float = 0.0
    stage: Stage = Stage.STARTING
    on_copied: tuple[Callable[[Table], None], ...] = ()
    on_batch: tuple[Callable[[Table, DataFrame], None], ...] = ()
    on_error: Callable[[str, BaseException], None] | None = None
    metrics: Metrics = field(default_factory=Metrics)
    verifier: Verifier | None = None
    batch_rows: int | Callable[[], int] | None = None
    order: Callable[[Table], object] = lambda t: -t.rows_about
    retries: int = 1
    reverify_every: float = 0.0
    hold_cutover: bool = False
    events_per_batch: int = EVENTS_A_BATCH

    def __post_init__(self) -> None:
        self.reverify = ReverifyStore(self.spark, f"{self.checkpoint}/reverify")
        self.by_name = {t.name: t for t in self.tables}
        for t in self.tables:
            t.ignored = t.ignored or self.ignored
        self.verifier = self.verifier or InlineVerifier(self.most_downtime)
        self.verifier.run = self
        self._allowed, self._stopping, self._positions = threading.Event(), threading.Event(), threading.Lock()
        self._lag_told = 0.0
        self.tag = f"tidemark-{uuid.uuid4().hex}"
        self.copied: dict[str, dict] = {}  # by table: rows and bytes copied, and when that began and ended
        self.last_events: dict[str, float] = {}  # by log: when its last applied event was made, in seconds since 1970
        self.batches: list[dict] = []  # a report of each batch of a log
        self._cut = threading.Event()  # an error elsewhere has ended the run
        if not self.hold_cutover:
            self._allowed.set()
        self._resume_store()

    def _resume_store(self) -> None:
        """Keys that an earlier run had still to verify are verified by this one."""
        if self.state.reverify:
            rows = self.spark.createDataFrame([tuple(r) for r in self.state.reverify], "db string, table_name string, key string, changes bigint")
            self.reverify.add(rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("changes").cast("int")))).drop("n", "changes"), ("resumed", 0))
        elif self.state.reverify_path and self.state.reverify_path != self.reverify.store.path:
            held = ReverifyStore(self.spark, self.state.reverify_path).entries()
            self.reverify.add(held.select("db", "table_name", "key"), ("resumed", 0))

    # --- copy ---

    def _gate(self) -> None:
        """Before each piece of work: wait while held back, end if asked to."""
        while self.throttler.blocked():
            if self._stopping.is_set() or self._cut.is_set():
                break
            time.sleep(self.throttler.wait)
        if (self._stopping.is_set() or self._cut.is_set()) and self.stage is not Stage.CUTOVER:
            raise Stopped("the run was stopped")

    def _insert(self, table: Table, rows: DataFrame, low: str | None = None, high: str | None = None) -> None:
        """Load rows, again after an error as often as allowed, and count what was loaded."""
        began = time.monotonic()
        loaded, size = retried(lambda: table.target.insert(rows, low, high), self.retries)
        with self._positions:
            now = self.copied.setdefault(table.name, {"rows": 0, "bytes": 0, "began": began, "ended": began})
            now["rows"], now["bytes"], now["ended"] = now["rows"] + loaded, now["bytes"] + size, time.monotonic()
        self.metrics.count("copied_rows", loaded, {"table": table.name})
        self.metrics.count("copied_bytes", size, {"table": table.name})

    def _batches(self, table: Table, rows: DataFrame, last: str | None) -> Iterable[tuple[DataFrame, str | None, str]]:
        """Rows by key, in the order of keys and after ``last``, with the key before each batch, or those of a job, and its last one as text."""
        kind, key = table.target.schema[table.key].dataType, F.col(table.key)
        if last is not None:
            rows = rows.where(key > key_value(F.lit(last), kind))
        size = self.batch_rows if callable(self.batch_rows) else lambda: self.batch_rows
        step = max(1, min(STEP, size()))
        steps = written(scan.key_batches(rows, table.key, step).select("batch", key_text(F.col("last_key"), kind).alias("last_key")), "steps")
        low, taken, end, together = last, 0, None, 1
        wanted = -(-size() // step)

        def between(low: str | None, high: str) -> DataFrame:
            part = rows.where(key <= key_value(F.lit(high), kind))
            return part if low is None else part.where(key > key_value(F.lit(low), kind))

        for r in steps.orderBy("batch").toLocalIterator():  # one row at a time, and as few as there are steps
            taken, end = taken + 1, r["last_key"]
            if taken >= wanted:
                began = time.monotonic()
                yield between(low, end), low, end
                low, taken, rows_now = end, 0, size()
                if self.on_batch or callable(self.batch_rows):
                    together = 1
                else:
                    together = together * JOB_GROWTH if time.monotonic() - began < JOB_SECONDS else together // JOB_GROWTH
                    together = max(1, min(together, ROWS_A_BUCKET // max(1, rows_now)))  # a job's rows are one file of the target
                wanted = -(-rows_now // step) * together
        if taken:
            yield between(low, end), low, end

    def copy_table(self, table: Table, enforce: bool | None = None) -> None:
        """Load what the target lacks; then have the verifier look at it, which either fails or verifies again later."""
        enforce = self.enforce if enforce is None else enforce
        self._gate()
        if self.batch_rows is None or table.when != "copy":
            self._insert(table, table.rows())
            self.verifier.copied(table, None, enforce)
        else:
            for part, low, last in self._batches(table, table.rows(), self.state.last_keys.get(table.name)):
                self._gate()
                self._insert(table, part, low, last)
                self.verifier.copied(table, (low, last), enforce)
                for listener in self.on_batch:
                    listener(table, part)
                with self._positions:
                    self.state.last_keys[table.name] = last
        with self._positions:
            if table.name not in self.state.completed:
                self.state.completed.append(table.name)
        self.metrics.count("copied_tables", tags={"table": table.name})
        for listener in self.on_copied:
            listener(table)

    def copy(self) -> None:
        """All tables, the largest first; the first error cancels what the others are doing and ends the run."""
        self.stage = Stage.COPYING
        todo = sorted((t for t in self.tables if t.when != "last" and t.name not in self.state.completed), key=self.order)
        with ThreadPoolExecutor(self.threads) as pool:
            tasks = [pool.submit(self._tagged, t) for t in todo]
            failed = [f for f in wait(tasks, return_when=FIRST_EXCEPTION).done if f.exception()]
            if failed:
                self._cut.set()
                for f in tasks:
                    f.cancel()
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
        if failed:
            self._raise(failed[0].exception())

    def _tagged(self, table: Table) -> None:
        """A table's copy in a pool of its own, so that tables share the cluster fairly, with jobs that can be cancelled."""
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.addJobTag(f"{self.tag}-{table.name}")
        context.setLocalProperty("spark.scheduler.pool", table.name)
        try:
            self.copy_table(table)
        finally:
            context.removeJobTag(self.tag)
            context.removeJobTag(f"{self.tag}-{table.name}")
            context.setLocalProperty("spark.scheduler.pool", None)

    def _raise(self, error: BaseException) -> None:
        """The error of a job that a stop has cancelled is the stop."""
        if self._stopping.is_set() and not isinstance(error, Stopped | KeyboardInterrupt):
            raise Stopped("the run was stopped") from error
        raise error

    def copy_standalone(self, names: Sequence[str]) -> None:
        """Copy some tables again, whatever the state says; a row that differs on the target is an error."""
        for name in names:
            self.copy_table(self.by_name[name], enforce=True)

    # --- changes ---

    def _logs(self) -> dict[str, list[Table]]:
        """The tables of each log."""
        out: dict[str, list[Table]] = {}
        for t in self.tables:
            if t.log:
                out.setdefault(t.log, []).append(t)
        return out

    def catch_up(self) -> float:
        """Apply every log up to where it ends now; the seconds it took."""
        began = time.monotonic()
        for log, tables in self._logs().items():
            self._apply(log, tables)
        return time.monotonic() - began

    def wait_until_almost_caught_up(self, most: float = ALMOST) -> None:
        """Catch up again until every log was quiet, its last event is young, or a round took so little that no log can be far ahead."""
        while True:
            seen = len(self.batches)
            took = self.catch_up()
            ages = [self.age(log) for log in self._logs()]
            if len(self.batches) == seen or took <= most or all(a is not None and a <= most for a in ages):
                return

    def age(self, log: str) -> float | None:
        """Seconds since the last applied event of a log was made, if its events say when."""
        return None if log not in self.last_events else time.time() - self.last_events[log]

    def _apply(self, log: str, tables: list[Table]) -> None:
        """Apply a log's whole transactions to its tables, batch by batch, from where state and stores have it."""

        def run(batch: DataFrame, _: int) -> None:
            self._gate()
            batch = batch.persist()
            try:
                ends = [F.max("position").alias("position")]
                if "ts" in batch.columns:
                    ends.append(F.unix_seconds(F.max(F.col("ts").cast("timestamp"))).alias("ts"))
                last = batch.agg(*ends).first()
                if last["position"] is not None:
                    self._applied(log, tables, batch, last["position"], last["ts"] if "ts" in batch.columns else None)
            finally:
                batch.unpersist()

        schema = tables[0].log_schema or self.log_schema
        stream = log_stream(self.spark, log, schema, self.events_per_batch, self.state.resume_from(log))
        try:
            # where to begin is known from the state, so that a checkpoint is of this query alone
            self.batches += [{"log": log, **b} for b in drain(stream, run, f"{self.checkpoint}/log-{uuid.uuid4().hex}")]
        except Exception as error:
            self._raise(error)

    def _applied(self, log: str, tables: list[Table], batch: DataFrame, position: int, made: float | None) -> None:
        """One batch into the tables' targets, then to the verifier; positions are told when each has all of it."""
        events = {t.name: t.prepared(batch) for t in tables}
        groups = {id(t.target.group): t.target.group for t in tables}
        group = next(iter(groups.values())) if len(groups) == 1 else None
        with group.transaction(**{log: position}) if group is not None else nullcontext():
            for t in tables:
                fold(t.target, events[t.name], log, position)
        with self._positions:
            self.state.verified.setdefault(log, self.state.resume_from(log))  # until the verifier has the batch
            self.state.written[log] = max(self.state.written.get(log, position), position)
        for t in tables:
            self.verifier.changed(events[t.name], t, (f"{log} {t.name}", position))
        with self._positions:
            self.state.verified[log] = max(self.state.verified.get(log, position), position)
        if made is not None:
            self.last_events[log] = made
            if time.monotonic() - self._lag_told >= 1:
                self._lag_told = time.monotonic()
                self.metrics.gauge("lag", time.time() - made, {"log": log})

    # --- verification ---

    def verify(self) -> str:
        """A pass now; what it says, '' if all is right. What differs is verified again later."""
        return self.verifier.once().message

    def verify_before_cutover(self) -> None:
        self.stage = Stage.VERIFYING
        self.verifier.before_cutover().raised()

    # --- the run ---

    def cutover(self) -> None:
        """Under the lock: the last changes, joined tables once more, strict verification, the tenant's own row."""
        self.stage = Stage.CUTOVER
        self.lock()
        try:
            self.throttler.disabled = True
            self.catch_up()
            for table in (t for t in self.tables if t.when == "delta"):
                self.copy_table(table, enforce=True)
            self.verifier.at_cutover().raised()
            for table in (t for t in self.tables if t.when == "last"):
                self.copy_table(table, enforce=True)
        finally:
            self.unlock()
        self.stage = Stage.DONE

    def run(self, meanwhile: Iterable[Callable[[], None]] = ()) -> RunState:
        """Copy, catch up, verify, cut over. ``meanwhile``: called in turn after the copy, each before a catch-up.

        An error, or an interrupt from outside, ends the run after its state
        was handed to ``on_error``.
        """
        end_passes = self.verifier.start_in_background(self.reverify_every) if self.reverify_every else lambda: None
        try:
            try:
                with self.metrics.measure("copy"):
                    self.copy()
                for step in meanwhile:
                    step()
                    self.catch_up()
                self.stage = Stage.WAITING
                self.wait_until_almost_caught_up()
                while not self._allowed.wait(0.05):
                    self._gate()
                    self.catch_up()
            finally:
                end_passes()
            with self.metrics.measure("verify_before_cutover"):
                self.verify_before_cutover()
            with self.metrics.measure("cutover"):
                self.cutover()
        except BaseException as error:
            if self.on_error:
                self.on_error(self.dump(), error)
            raise
        return self.state

    # --- control ---

    def pause(self) -> None:
        self.throttler.paused = True

    def unpause(self) -> None:
        self.throttler.paused = False

    def allow_cutover(self) -> None:
        """Let a run that holds before its cutover go on."""
        self._allowed.set()

    def stop(self) -> None:
        """End the run: cancel the copies' jobs, and go no further than the batch of a log at hand; refused during cutover."""
        if self.stage is Stage.CUTOVER:
            raise RuntimeError("a run in cutover can't be interrupted")
        self._stopping.set()
        self._allowed.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def settings(self, **new: object) -> dict[str, object]:
        """What may be changed while a run goes on, after setting what is given: batch_rows, max_lag, reverify_every."""
        if unknown := set(new) - {"batch_rows", "max_lag", "reverify_every"}:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        for name, value in new.items():
            if name == "max_lag":
                self.throttler.most = value
            else:
                setattr(self, name, value)
        return {"batch_rows": self.batch_rows, "max_lag": self.throttler.most, "reverify_every": self.reverify_every}

    def dump(self) -> str:
        """The state as JSON, to go on from with ``state=RunState.loads(...)``; none may be taken during cutover."""
        if self.stage is Stage.CUTOVER and not self.on_error:
            raise RuntimeError("a run in cutover can't be interrupted")
        self.state.reverify_path = self.reverify.store.path
        few = self.reverify.entries().limit(SMALL + 1).collect()  # more than a few stay where they are
        self.state.reverify = [list(r) for r in few] if len(few) <= SMALL else []
        return self.state.dumps()

    def status(self) -> DataFrame:
        """table_name, state: the tables that wait, those that are copied, those that are done."""
        return self.progress().select("table_name", "state")

    def _share(self, table: Table) -> float | None:
        """How much of the tasks of a table's running jobs is done."""
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        jobs = [i.get() for j in tracker.getJobIdsForTag(f"{self.tag}-{table.name}") if (i := tracker.getJobInfo(j)).isDefined()]
        running = [i for job in jobs if job.status().toString() == "RUNNING" for s in job.stageIds() if (o := tracker.getStageInfo(s)).isDefined() for i in [o.get()]]
        tasks = sum(s.numTasks() for s in running)
        return sum(s.numCompletedTasks() for s in running) / tasks if tasks else None

    def progress(self) -> DataFrame:
        """table_name, state, last_key (text), rows_about, and of the copy rows, bytes, speed (rows/s), share (of the running job's tasks) and eta (s) of each table, in the order of a status list."""
        state = lambda t: "completed" if t.name in self.state.completed else "copying" if self.stage is Stage.COPYING else "waiting"
        rows = []
        for t in self.tables:
            with self._positions:
                got = dict(self.copied.get(t.name, {"rows": 0, "bytes": 0, "began": 0.0, "ended": 0.0}))
            speed = got["rows"] / took if (took := got["ended"] - got["began"]) > 0 else None
            done = state(t) == "completed"
            eta = 0.0 if done else max(0, t.rows_about - got["rows"]) / speed if speed and t.rows_about else None
            rows.append((t.name, state(t), self.state.last_keys.get(t.name), t.rows_about, got["rows"], got["bytes"], speed, None if done else self._share(t), eta))
        rows.sort(key=lambda r: (progress.STATES.index(r[1]), r[0]))
        return self.spark.createDataFrame(rows, "table_name string, state string, last_key string, rows_about bigint, copied_rows bigint, copied_bytes bigint, speed double, share double, eta double")

    def stop_on(self, *signals: int) -> None:
        """Let signals (by default SIGTERM) stop the run, so that its state is dumped; in cutover they wait for its end."""
        import signal

        def stopped(number: int, frame: object) -> None:
            if self.stage is not Stage.CUTOVER:
                self.stop()

        for number in signals or (signal.SIGTERM,):
            signal.signal(number, stopped)
