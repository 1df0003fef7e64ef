"""Queries that are whole runs: a stream applied, a migration under writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import apply_changes
from ..operators.migration import Migration, Table, tenant_tables
from ..operators.selection import JoinTable
from ..scratch import scratch_path
from ..session import table
from ..sources import fixtures
from ..sources.change_log import append, log_stream
from ..sources.store import TableStore
from ..streaming.apply import ReverifyStore, applier, drain
from .register import BALANCES, query

#: Parts in which a log is delivered.
PARTS = 3


def sound_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose old rows are true: each user's events insert, update and delete its row in turn."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", fixtures.cents("value").alias("v"))
    e = e.withColumn("n", F.row_number().over(w) - 1).withColumn("before", F.lag("v").over(w)).withColumn("k", F.col("user_id") * 2 + 1)
    row = lambda v: F.struct("k", F.col(v).alias("v"))
    op = F.element_at(F.array(F.lit("I"), F.lit("U"), F.lit("D")), F.col("n") % 3 + 1)
    return e.select(F.col("event_id").alias("position"), op.alias("op"), F.col("k").alias("key"), F.when(F.col("n") % 3 > 0, row("before")).alias("old"), F.when(F.col("n") % 3 < 2, row("v")).alias("new"))


_FINAL = f"""SELECT k, v FROM {BALANCES} UNION ALL
SELECT user_id * 2 + 1, arg_max((value::DECIMAL(18,2) * 100)::BIGINT, event_id) FROM events GROUP BY user_id HAVING count(*) % 3 <> 0"""


def _parted(log: DataFrame, path: str) -> str:
    """The log written once, in parts by position."""
    last = log.agg(F.max("position")).first()[0]
    part = F.floor(F.col("position") * PARTS / (last + 1)).cast("int")
    log.withColumn("part", F.least(part, F.lit(PARTS - 1))).write.partitionBy("part").parquet(path)
    return path


def _part(log: DataFrame, parted: str, part: int) -> DataFrame:
    return log.sparkSession.read.schema(log.schema).parquet(f"{parted}/part={part}")


def _deliver(log: DataFrame, parted: str, path: str, part: int) -> None:
    """One part of a log, at its end."""
    append(_part(log, parted, part), path)


@query(_FINAL)
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log applied as a stream, in several batches, to a table in buckets."""
    path, log, base = scratch_path(spark, "stream"), sound_log(spark, sf_dir), fixtures.balances(spark, sf_dir)
    store = TableStore(spark, f"{path}/target", base.schema, "k", 4)
    store.replace(base)
    parted = _parted(log, f"{path}/parts")
    for part in range(PARTS):
        _deliver(log, parted, f"{path}/log", part)
        drain(log_stream(spark, f"{path}/log", log.schema, after=store.applied("log")), applier(store), f"{path}/checkpoint-{part}")
    return store.read()


@query("SELECT '' AS db, 't' AS table_name, user_id * 2 + 1 AS key, count(*) AS changes FROM events GROUP BY user_id")
def stream_reverify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by key, counted as a stream."""
    path, log = scratch_path(spark, "reverify"), sound_log(spark, sf_dir)
    store = ReverifyStore(spark, f"{path}/store", 4)
    named = lambda batch: batch.select(F.lit("").alias("db"), F.lit("t").alias("table_name"), "key")
    count = lambda batch, _: store.add(named(batch), ("log", batch.agg(F.max("position")).first()[0]))
    parted = _parted(log, f"{path}/parts")
    for part in range(PARTS):
        _deliver(log, parted, f"{path}/log", part)
        drain(log_stream(spark, f"{path}/log", log.schema, after=store.store.applied("log")), count, f"{path}/checkpoint-{part}")
    return store.entries().withColumn("key", F.col("key").cast("bigint"))


def _writer(log: DataFrame, path: str, source: TableStore):
    """Steps that write a part of the log to the source and to the log's folder."""
    parted = _parted(log, f"{path}/parts")

    def write(part: int):
        def step() -> None:
            events = _part(log, parted, part)
            source.update(events.select(F.col("key").alias(source.key)), lambda rows: apply_changes(rows, events, source.key))
            _deliver(log, parted, f"{path}/log", part)

        return step

    return write


@query(_FINAL)
def migration_under_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table copied while it changes; the target at the end, verified against the source."""
    path, log, base = scratch_path(spark, "migration"), sound_log(spark, sf_dir), fixtures.balances(spark, sf_dir)
    source, target = (TableStore(spark, f"{path}/{n}", base.schema, "k", 4) for n in ("source", "target"))
    source.replace(base)
    write = _writer(log, path, source)
    write(0)()  # these are in the log and in the copy
    moved = Migration(spark, [Table("balances", "k", source.read, target, log=f"{path}/log")], log.schema, f"{path}/checkpoint")
    moved.run([write(1), write(2)])
    return target.read()


def keyed_log(log: DataFrame, key) -> DataFrame:
    """The log with keys of another type: ``key`` makes one of a number."""
    row = lambda c: F.when(F.col(c).isNotNull(), F.struct(key(F.col(f"{c}.k")).alias("k"), F.col(f"{c}.v").alias("v"))).alias(c)
    return log.select("position", "op", key(F.col("key")).alias("key"), row("old"), row("new"))


def _migrated_with(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    """A run whose keys are what ``key`` makes of numbers, copied in batches."""
    path, log = scratch_path(spark, "keys"), keyed_log(sound_log(spark, sf_dir), key)
    base = fixtures.balances(spark, sf_dir).select(key(F.col("k")).alias("k"), "v")
    source, target = (TableStore(spark, f"{path}/{n}", base.schema, "k", 4) for n in ("source", "target"))
    source.replace(base)
    write = _writer(log, path, source)
    write(0)()
    moved = Migration(spark, [Table("balances", "k", source.read, target, log=f"{path}/log")], log.schema, f"{path}/checkpoint", batch_rows=400)
    moved.run([write(1), write(2)])
    return target.read()


@query(f"SELECT lower(hex((k * 7919 + 5)::VARCHAR)) AS k, v FROM ({_FINAL})")
def migration_of_binary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of ``migration_under_writes`` with binary keys, in batches."""
    done = _migrated_with(spark, sf_dir, lambda k: (k * 7919 + 5).cast("string").cast("binary"))
    return done.select(F.lower(F.hex("k")).alias("k"), "v")


@query(f"SELECT (18446744073709551615::UHUGEINT - k::UHUGEINT)::VARCHAR AS k, v FROM ({_FINAL})")
def migration_of_unsigned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with unsigned keys beyond the bigint range."""
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    done = _migrated_with(spark, sf_dir, lambda k: (top - k.cast("decimal(20,0)")).cast("decimal(20,0)"))
    return done.select(F.col("k").cast("string").alias("k"), "v")


#: The tenant of the tenant runs, of three.
TENANT = 1


def tenant_events(log: DataFrame) -> DataFrame:
    """The log as raw row events of several tables: ``k``, ``v`` and the tenant k modulo 3; every seventh event is another table's."""
    row = lambda c: F.struct(F.col(f"{c}.k").alias("k"), F.col(f"{c}.v").alias("v"), (F.col(f"{c}.k") % 3).alias("tenant"))
    rows = F.when(F.col("op") == "I", F.array(row("new"))).when(F.col("op") == "D", F.array(row("old"))).otherwise(F.array(row("old"), row("new")))
    name = F.when(F.col("key") % 7 == 0, F.lit("strangers")).otherwise(F.lit("accounts"))
    return log.select("position", F.lit("old_db").alias("db"), name.alias("table_name"), "op", rows.alias("rows"))


_TENANT_FINAL = f"""SELECT 'balances' AS table_name, k, v FROM (
  SELECT k, v FROM {BALANCES} UNION ALL
  SELECT user_id * 2 + 1, arg_max((value::DECIMAL(18,2) * 100)::BIGINT, event_id) FROM events WHERE (user_id * 2 + 1) % 7 <> 0 GROUP BY user_id HAVING count(*) % 3 <> 0)
  WHERE k % 3 = {TENANT}
UNION ALL
SELECT 'notes', p_partkey, (p_retailprice::DECIMAL(18,2) * 100)::BIGINT FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = {TENANT})
UNION ALL
SELECT 'tenants', s_suppkey, (s_acctbal::DECIMAL(18,2) * 100)::BIGINT FROM supplier WHERE s_suppkey = {TENANT}"""


@query(_TENANT_FINAL)
def tenant_migration_under_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant moved out of a database that changes: its rows and raw events, joined rows again at cutover, its own row last.

    The log holds all tenants' events and another table's; tables get new names.
    """
    path, base = scratch_path(spark, "tenant"), fixtures.balances(spark, sf_dir).withColumn("tenant", F.col("k") % 3)
    events = sound_log(spark, sf_dir)
    raw = tenant_events(events)
    source = TableStore(spark, f"{path}/source", base.schema, "k", 4)
    source.replace(base)
    parted, raw_parts = _parted(events, f"{path}/parts"), _parted(raw, f"{path}/raw")
    plain = lambda n, k, v: table(spark, sf_dir, n).select(F.col(k).alias("k"), fixtures.cents(v).alias("v"))
    notes, tenants = plain("part", "p_partkey", "p_retailprice"), plain("supplier", "s_suppkey", "s_acctbal")
    store = lambda n, schema: TableStore(spark, f"{path}/{n}", schema, "k", 4)
    links = lambda: [JoinTable(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")]
    tables = tenant_tables(
        "tenant", TENANT, [Table("balances", "k", source.read, store("balances", base.schema), log=f"{path}/log", log_schema=raw.schema, db="new_db", source_db="old_db", source_name="accounts")],
        [(Table("notes", "k", lambda: notes, store("notes", notes.schema), db="new_db"), links)], [Table("tenants", "k", lambda: tenants, store("tenants", tenants.schema), db="new_db")],
    )

    def write(part: int):
        def step() -> None:
            mine = _part(events, parted, part).where("key % 7 <> 0")
            full = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.k").alias("k"), F.col(f"{c}.v").alias("v"), (F.col(f"{c}.k") % 3).alias("tenant"))).alias(c)
            mine = mine.select("position", "op", "key", full("old"), full("new"))
            source.update(mine.select(F.col("key").alias("k")), lambda rows: apply_changes(rows, mine, "k"))
            _deliver(raw, raw_parts, f"{path}/log", part)

        return step

    write(0)()
    run = Migration(spark, tables, raw.schema, f"{path}/checkpoint")
    run.run([write(1), write(2)])
    out = [t.target.read().select(F.lit(t.name).alias("table_name"), "k", "v") for t in tables]
    return out[0].unionByName(out[1]).unionByName(out[2])
