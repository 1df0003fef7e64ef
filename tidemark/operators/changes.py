"""The change log: decoding, filtering, and applying events to a table.

An event row has position, op ('I', 'U' or 'D'), key, old and new (structs of
the table's columns, null where the op has none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Events of a key up to which they are folded as one array; longer histories are folded as a stream.
FOLD_AT_ONCE = 10_000


def decoded(raw: DataFrame) -> DataFrame:
    """Row events → one event per changed row.

    ``raw``: position, db, table_name, op and rows (array of row structs). An
    update's rows come in pairs, as it was and as it is. ``row_at`` orders the
    events of one position. What else the log says of an event, such as the end
    of its transaction and when it was made, stays with each of its rows.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("rows") / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get("rows", 2 * i).alias("old"), F.get("rows", 2 * i + 1).alias("new")))
    nothing = F.get(F.col("rows"), F.lit(-1))
    single = F.transform("rows", lambda r: F.struct(F.when(F.col("op") == "D", r).otherwise(nothing).alias("old"), F.when(F.col("op") == "I", r).otherwise(nothing).alias("new")))
    events = F.filter(F.when(F.col("op") == "U", pairs).otherwise(single), lambda x: x["old"].isNotNull() | x["new"].isNotNull())
    more = [c for c in raw.columns if c not in ("position", "db", "table_name", "op", "rows", "row_at", "event", "old", "new")]
    return raw.select("position", "db", "table_name", "op", *more, F.posexplode(events).alias("row_at", "event")).select("position", "row_at", "db", "table_name", "op", *more, "event.old", "event.new")


def with_key(events: DataFrame, key: str) -> DataFrame:
    """The key an event is about: of the new row, of a delete the old one."""
    return events.withColumn("key", F.coalesce(F.col(f"new.`{key}`"), F.col(f"old.`{key}`")))


def key_changes_split(events: DataFrame, key: str) -> DataFrame:
    """An update that changes the key as a delete of the old key and an insert of the new, at the same position.

    The insert no longer depends on whether the delete found its row.
    """
    moved = (F.col("op") == "U") & (F.col(f"old.`{key}`") != F.col(f"new.`{key}`"))
    nothing = F.when(F.lit(False), F.col("new"))
    delete = F.struct(F.lit("D").alias("op"), F.col("old").alias("old"), nothing.alias("new"))
    insert = F.struct(F.lit("I").alias("op"), nothing.alias("old"), F.col("new").alias("new"))
    same = F.struct(F.col("op").alias("op"), F.col("old").alias("old"), F.col("new").alias("new"))
    rest = [c for c in events.columns if c not in ("op", "old", "new")]
    return events.select(*rest, F.explode(F.when(moved, F.array(delete, insert)).otherwise(F.array(same))).alias("e")).select(*rest, "e.*")


def of_known_tables(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Events of tables that are copied; others are dropped. A catalog is a few rows per table."""
    return events.join(catalog.select("db", "table_name").distinct(), ["db", "table_name"], "left_semi")


def of_tenant(events: DataFrame, tenant: str, value: object, strict: bool = True) -> DataFrame:
    """Events of a tenant's rows. A row that moves in or out of the tenant fails the job if ``strict``.

    A missing tenant is no tenant's.
    """
    old, new = (F.coalesce(F.col(f"{x}.`{tenant}`") == F.lit(value), F.lit(False)) for x in ("old", "new"))
    kept = events.where(old | new)
    if strict:
        moved = (F.col("op") == "U") & (old != new)
        error = F.raise_error(F.concat(F.lit("sharding key changed from "), F.coalesce(F.col(f"old.`{tenant}`").cast("string"), F.lit("NULL")), F.lit(" to "), F.coalesce(F.col(f"new.`{tenant}`").cast("string"), F.lit("NULL"))))
        kept = kept.where(F.when(moved, error.cast("boolean")).otherwise(F.lit(True)))
    return kept


def tenant_changes(events: DataFrame, tenant: str) -> DataFrame:
    """Updates that move a row from one tenant to another."""
    return events.where((F.col("op") == "U") & ~F.col(f"old.`{tenant}`").eqNullSafe(F.col(f"new.`{tenant}`")))


def _step(state: Column, event: Column) -> Column:
    """The row after an event: kept unless the event finds it as it expects."""
    as_before = state["there"] & state["row"].eqNullSafe(event["old"])
    made = F.struct(F.lit(True).alias("there"), event["new"].alias("row"))
    gone = F.struct(F.lit(False).alias("there"), F.when(F.lit(False), event["new"]).alias("row"))
    return (
        F.when((event["op"] == "I") & ~state["there"], made)
        .when((event["op"] == "U") & as_before, made)
        .when((event["op"] == "D") & as_before, gone)
        .otherwise(state)
    )


def apply_changes(target: DataFrame, events: DataFrame, key: str, at_once: int = FOLD_AT_ONCE) -> DataFrame:
    """``target`` after the events, each key's in order of position: compare and set.

    Insert keeps a row that is there; update and delete act only on a row
    that equals their old row in all columns, nulls too. Keys without events
    pass by; of the target only the rows themselves are read.

    A key's events are folded as one array. Keys with more than ``at_once``
    go another way, sorted and streamed through a task with nothing but the
    current row in memory; the result is the same for every type. Whether there
    are any is counted first, in a log of more than ``at_once`` events.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in target.columns))
    base = target.select(F.col(key).alias("key"), row.alias("row"))
    order = ["position", "row_at"] if "row_at" in events.columns else ["position"]
    slim = events.select("key", *order, "op", "old", "new")
    start = F.struct(F.col("row").isNotNull().alias("there"), F.col("row").alias("row"))

    def folded(base: DataFrame, some: DataFrame) -> DataFrame:
        by_key = some.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*order, "op", "old", "new"))).alias("events"))
        state = F.when(F.col("events").isNull(), start).otherwise(F.aggregate("events", start, _step))
        return base.join(by_key, "key", "full_outer").select(state.alias("s")).where("s.there").select("s.row.*")

    if slim.limit(at_once + 1).count() <= at_once:
        return folded(base, slim)
    long = written(slim.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("key"), "long")
    if long.isEmpty():
        return folded(base, slim)
    rest = folded(base.join(long, "key", "left_anti"), slim.join(long, "key", "left_anti"))
    return rest.unionByName(_streamed(base.join(long, "key", "left_semi"), slim.join(long, "key", "left_semi"), order, target))


def _equal(a: object, b: object) -> bool:
    """As Spark's null-safe comparison: NaN equals NaN, minus zero zero."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(_equal(x, y) for x, y in zip(a.values(), b.values(), strict=True))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_equal(x, y) for x, y in zip(a, b, strict=True))
    return a is b or a == b or (a != a and b != b)


def _streamed(base: DataFrame, events: DataFrame, order: list[str], target: DataFrame) -> DataFrame:
    """The fold of keys with long histories, event after event; rows stay Arrow values of their own types."""
    kind = target.schema
    first = base.select("key", *(F.lit(None).cast("bigint").alias(c) for c in order), F.lit("0").alias("op"), F.lit(None).cast(kind).alias("old"), F.col("row").cast(kind).alias("new"))
    then = events.select("key", *(F.col(c).cast("bigint").alias(c) for c in order), "op", F.col("old").cast(kind).alias("old"), F.col("new").cast(kind).alias("new"))
    dealt = first.unionByName(then).repartition("key").sortWithinPartitions("key", *(F.col(c).asc_nulls_first() for c in order))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        key, row, held = nothing, None, None  # held: the row's Arrow array, of length one

        def flat(rows: list[pa.StructArray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(pa.concat_arrays(rows).flatten(), names=kind.names)

        for batch in batches:
            out = []
            keys, ops, olds, news = (batch.column(i) for i in (0, *range(len(order) + 1, len(order) + 4)))
            for i, (k, op, old, new) in enumerate(zip(keys.to_pylist(), ops.to_pylist(), olds.to_pylist(), news.to_pylist(), strict=True)):
                if key is nothing or k != key:
                    if row is not None:
                        out.append(held)
                    key, row, held = k, None, None
                if op == "0" or op == "I" and row is None or op == "U" and row is not None and _equal(row, old):
                    row, held = new, news.slice(i, 1)
                elif op == "D" and row is not None and _equal(row, old):
                    row, held = None, None
            if out:
                yield flat(out)
        if row is not None:
            yield flat([held])

    return dealt.mapInArrow(fold, kind)


def latest_images(events: DataFrame) -> DataFrame:
    """key and the last event's new row, deleted keys left out: the fold of a log whose old rows all match."""
    at = F.struct("position", "row_at") if "row_at" in events.columns else F.col("position")
    last = events.groupBy("key").agg(F.max_by(F.struct("op", "new"), at).alias("last"))
    return last.where("last.op <> 'D'").select("key", "last.new")


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of a load that are new: whose key the target lacks; of repeated keys in the load the least row."""
    new = rows.join(target.select(key), key, "left_anti")
    return new.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")


def changes_by_key(events: DataFrame) -> DataFrame:
    """db, table_name, key, changes: how often each key has changed and must be verified again."""
    return events.groupBy("db", "table_name", "key").agg(F.count("*").alias("changes"))


def after_verifying(store: DataFrame, verified: DataFrame) -> DataFrame:
    """The store less what was verified: a key that changed meanwhile stays with the rest of its count."""
    done = verified.select("db", "table_name", "key", F.col("changes").alias("done"))
    left = store.join(done, ["db", "table_name", "key"], "left").withColumn("changes", F.col("changes") - F.coalesce("done", F.lit(0)))
    return left.where("changes > 0").drop("done")


def store_size(store: DataFrame) -> DataFrame:
    """entries (keys) and row_count (changes) of a store."""
    return store.agg(F.count("*").alias("entries"), F.coalesce(F.sum("changes"), F.lit(0)).cast("bigint").alias("row_count"))


def with_query(raw: DataFrame) -> DataFrame:
    """Each event's statement: the last one logged before it in its transaction (xid)."""
    so_far = Window.partitionBy("xid").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("query", F.last("query", ignorenulls=True).over(so_far))


def unannotated(events: DataFrame, annotation: str) -> DataFrame:
    """Changes that do not begin with the annotation, so that someone else wrote them."""
    from ..functions.statements import annotation as leading

    return events.where((F.col("query").isNull()) | (leading(F.col("query")) != annotation))


def resume_position(*positions: Column) -> Column:
    """The least of several positions; zero and null mean that there is none."""
    return reduce(lambda a, b: F.least(a, b), (F.nullif(p, F.lit(0)) for p in positions)) if len(positions) > 1 else F.nullif(positions[0], F.lit(0))


def log_end(log: DataFrame) -> DataFrame:
    """The last position, and the last one at which a transaction ended."""
    return log.agg(F.max("position").alias("position"), F.max("resumable_position").alias("resumable_position"))
