"""Ways to prove that a target is right, behind one interface.

| verifier | sees | when |
|-|-|-|
| ``InlineVerifier`` | rows as they are copied, and keys that change | during the copy, before and at cutover |
| ``IterativeVerifier`` | all rows once after the copy, and keys that change | before and at cutover |
| ``ChecksumVerifier`` | tables by checksums of ranges of keys, then the ranges that differ | at cutover |
| ``ColumnVerifier`` | values column by column, compressed ones by what they hold | at cutover |
| ``ProvenanceVerifier`` | the target's own log: who wrote there | before and at cutover |
"""

from __future__ import annotations

import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key_text, key_value
from ..scratch import written
from ..streaming.apply import ReverifyStore
from . import changes, diff, hash_tree


class VerificationFailed(RuntimeError):
    """Source and target differ; the text names the rows."""


@dataclass(frozen=True)
class Result:
    """Whether all is right; else what is said of it, and the tables concerned."""

    correct: bool
    message: str = ""
    tables: tuple[str, ...] = ()

    def raised(self) -> Result:
        if not self.correct:
            raise VerificationFailed(self.message)
        return self


#: Passes over the re-verify store before cutover, and the rows it may still hold after them.
PASSES, SMALL = 30, 1000


def named(found: DataFrame, table) -> DataFrame:
    """A table's differences as ``diff.message`` wants them."""
    text = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c)
    key = key_text(F.col(table.key), found.schema[table.key].dataType)
    return found.select(
        F.lit(table.db).alias("db"), F.lit(table.name).alias("table_name"), key.alias("pk"), F.col(table.key).alias("pk_order"),
        "mismatch_type", text("source_md5"), text("target_md5"), text("mismatch_column"),
    )


def told(found: Mapping[str, DataFrame], tables: Mapping[str, object]) -> Result:
    """The verdict on differences by table; at most ``diff.NAMED`` keys a table are written out."""
    bad = {n: df for n, df in found.items() if not df.isEmpty()}
    if not bad:
        return Result(True)
    texts = [diff.message(named(df, tables[n])).first() for n, df in sorted(bad.items())]
    head = diff.FAILED
    return Result(False, head + "".join(t["message"][len(head) :] for t in texts), tuple(x for t in texts for x in t["incorrect_tables"]))


class Verifier(ABC):
    """What a run asks of a verifier. ``run`` is set by the run that has it: its tables, store and state."""

    run = None

    def copied(self, table, span: tuple[str | None, str] | None, enforce: bool) -> None:
        """Rows of a table have been copied: those with keys after the one text up to the other, or all."""

    def changed(self, events: DataFrame, table, batch: tuple[str, int]) -> None:
        """Events have been applied to a table."""

    def before_cutover(self) -> Result:
        """As much as can be verified while the source still changes."""
        return Result(True)

    @abstractmethod
    def at_cutover(self) -> Result:
        """Strict: the source no longer changes."""

    def once(self) -> Result:
        """A pass asked for while the run goes on."""
        return Result(True)

    def start_in_background(self, seconds: float) -> Callable[[], None]:
        """Passes every so many seconds; returns what ends them and raises their error, if any."""
        over, failed = threading.Event(), []

        def passes() -> None:
            try:
                while not over.wait(seconds):
                    self.once()
            except Exception as error:  # told to the run when it ends the passes
                failed.append(error)

        thread = threading.Thread(target=passes, daemon=True)
        thread.start()

        def end() -> None:
            over.set()
            thread.join()
            if failed:
                raise failed[0]

        return end


class NoVerifier(Verifier):
    def at_cutover(self) -> Result:
        return Result(True)


class InlineVerifier(Verifier):
    """Compares rows as they are copied; what differs, and every key that changes, is verified again until it agrees."""

    def __init__(self, most_downtime: float = 0.0):
        self.most_downtime = most_downtime
        self._passing = threading.Lock()

    @property
    def store(self) -> ReverifyStore:
        return self.run.reverify

    def _differing(self, table, keys: DataFrame | None, span: tuple[str | None, str] | None = None) -> DataFrame:
        if keys is not None:
            return diff.lookup_diff(table.rows(), table.target.read(), table.key, keys, table.ignored)
        # of both sides only the span is read
        source, target = table.target.range_filter(table.rows(), *(span or (None, None))), table.target.read(*(span or (None, None)))
        # what the target has besides is no matter of the rows copied
        return diff.classified(source, target.join(source.select(table.key), table.key, "left_semi"), table.key, table.ignored)

    def again(self, found: DataFrame, table) -> None:
        keys = found.select(F.lit(table.db).alias("db"), F.lit(table.name).alias("table_name"), F.col(table.key).alias("key"))
        if not keys.isEmpty():
            self.store.add(keys)

    def copied(self, table, span: tuple[str | None, str] | None, enforce: bool) -> None:
        found = written(self._differing(table, None, span), "differences")
        if enforce:
            told({table.name: found}, self.run.by_name).raised()
        else:
            self.again(found, table)

    def changed(self, events: DataFrame, table, batch: tuple[str, int]) -> None:
        self.store.add(events.select(F.lit(table.db).alias("db"), F.lit(table.name).alias("table_name"), "key"), batch)

    def _pass(self) -> dict[str, DataFrame]:
        """Compare the keys of the store; those that differ are in it again."""
        with self._passing:
            entries = written(self.store.entries(), "entries")
            names = [r["table_name"] for r in entries.select("table_name").distinct().collect()]
            out = {}
            for n in names:
                table = self.run.by_name[n]
                kind = table.target.schema[table.key].dataType
                keys = entries.where(F.col("table_name") == n).select(key_value(F.col("key"), kind).alias(table.key))
                out[n] = written(self._differing(table, keys), "differences")
            self.store.take_off(entries)
            for n, found in out.items():
                self.again(found, self.run.by_name[n])
            return out

    def once(self) -> Result:
        return told(self._pass(), self.run.by_name)

    def before_cutover(self) -> Result:
        """Passes over the store until it is small or no longer shrinks; the last must be within the downtime allowed."""
        took = 0.0
        for _ in range(PASSES):
            before, began = self.store.rows(), time.monotonic()
            self._pass()
            took, after = time.monotonic() - began, self.store.rows()
            if after <= SMALL or after >= before:
                break
        if self.most_downtime and took > self.most_downtime:
            return Result(False, f"verification at cutover will not end within {self.most_downtime} s (took {took:.3f})")
        return Result(True)

    def at_cutover(self) -> Result:
        self.store.closed = False
        out = told(self._pass(), self.run.by_name)
        self.store.closed = True
        return out


class IterativeVerifier(InlineVerifier):
    """Compares whole tables once the copy is done, on both sides; then goes on like the inline verifier."""

    def copied(self, table, span: tuple[str | None, str] | None, enforce: bool) -> None:
        if enforce:
            super().copied(table, span, enforce)

    def before_cutover(self) -> Result:
        for table in self.run.tables:
            if table.when != "last":
                self.again(written(diff.classified(table.rows(), table.target.read(), table.key, table.ignored), "differences"), table)
        return super().before_cutover()


class ChecksumVerifier(Verifier):
    """Compares tables by checksums of ranges of their keys, and names the rows of the ranges that differ.

    Where all is right, sums are all that is shuffled; ``ranges`` says where a
    table differs, without its rows.
    """

    def at_cutover(self) -> Result:
        sides = {t.name: (t.rows(), t.target.read(), t.key, t.ignored) for t in self.run.tables if t.when != "last"}
        return told({n: written(hash_tree.differences(*side), "differences") for n, side in sides.items()}, self.run.by_name)

    def ranges(self, table) -> DataFrame:
        """level, low, high, source_rows and target_rows of the ranges of a table's keys that differ."""
        return hash_tree.ranges(table.rows(), table.target.read(), table.key, table.ignored)

    def once(self) -> Result:
        return self.at_cutover()


class ColumnVerifier(Verifier):
    """Compares values column by column; ``plain`` says how a compressed column of a table is read."""

    def __init__(self, plain: Mapping[str, Mapping[str, Callable]] | None = None):
        self.plain = plain or {}

    def at_cutover(self) -> Result:
        found = {}
        for t in self.run.tables:
            if t.when == "last":
                continue
            read = lambda df, t=t: df.withColumns({c: f(F.col(c)) for c, f in self.plain.get(t.name, {}).items()})
            columns = [c for c in t.target.schema.names if c not in t.ignored]
            found[t.name] = written(diff.by_column(read(t.rows()), read(t.target.read()), t.key, columns), "differences")
        return told(found, self.run.by_name)

    def once(self) -> Result:
        return self.at_cutover()


class ProvenanceVerifier(Verifier):
    """The target's own log (position, query, ...) may hold no change without the run's annotation."""

    def __init__(self, target_log: Callable[[], DataFrame], annotation: str):
        self.target_log, self.annotation = target_log, annotation

    def at_cutover(self) -> Result:
        state = self.run.state
        log = self.target_log().where(F.col("position") > state.target_position)
        if (wrong := changes.unannotated(log, self.annotation).orderBy("position").first()) is not None:
            return Result(False, f"change at position {wrong['position']} of the target is not annotated with {self.annotation}")
        state.target_position = max(state.target_position, log.agg(F.max("position")).first()[0] or 0)
        return Result(True)

    before_cutover = once = at_cutover


class AllOf(Verifier):
    """Several verifiers, in order."""

    def __init__(self, *parts: Verifier):
        self.parts: Sequence[Verifier] = parts

    @property
    def run(self):
        return self._run

    @run.setter
    def run(self, run) -> None:
        self._run = run
        for p in self.parts:
            p.run = run

    def copied(self, table, span: tuple[str | None, str] | None, enforce: bool) -> None:
        for p in self.parts:
            p.copied(table, span, enforce)

    def changed(self, events: DataFrame, table, batch: tuple[str, int]) -> None:
        for p in self.parts:
            p.changed(events, table, batch)

    def _first_wrong(self, what: str) -> Result:
        for p in self.parts:
            if not (said := getattr(p, what)()).correct:
                return said
        return Result(True)

    def before_cutover(self) -> Result:
        return self._first_wrong("before_cutover")

    def at_cutover(self) -> Result:
        return self._first_wrong("at_cutover")

    def once(self) -> Result:
        return self._first_wrong("once")
