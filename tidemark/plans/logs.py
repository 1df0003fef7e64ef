"""Queries over logs as streams: positions, whole transactions, several logs of a run, several tables of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import positions
from ..operators import hash_tree
from ..operators.changes import apply_changes
from ..operators.migration import Migration, Table
from ..operators.verifiers import NoVerifier
from ..scratch import scratch_path
from ..session import table
from ..sources import fixtures
from ..sources.change_log import append, log_stream
from ..sources.store import StoreGroup, TableStore
from ..state import RunState
from ..streaming.apply import applier, drain
from ..streaming.counts import counted_changes
from .register import BALANCES, ORDERS, SOURCE, TARGET, fingerprint_sql, query
from .register import ORDER_COLUMNS as COLUMNS
from .runs import PARTS, sound_log

#: Events of a transaction in the logs made here, and events of a batch: not a multiple, so that transactions cut across.
TRANSACTION, BATCH = 10, 96


def ended(log: DataFrame) -> DataFrame:
    """The log with the position of the last transaction's end: every tenth position is one, as is the log's last."""
    last = log.agg(F.max("position")).first()[0]
    end = F.when(F.col("position") == last, F.col("position")).otherwise(F.floor((F.col("position") + 1) / TRANSACTION) * TRANSACTION - 1)
    return log.withColumn("resumable_position", end.cast("bigint"))


def in_parts(log: DataFrame, path: str, parts: int = PARTS):
    """Steps that append a part of the log each; a part ends inside a transaction."""
    last = log.agg(F.max("position")).first()[0]
    share = -(-(last + 1) // parts)
    share += share % TRANSACTION == 0
    held = log.sparkSession.read.schema(log.schema).parquet(_held(log, path))
    return [lambda a=a: append(held.where((F.col("position") >= a) & (F.col("position") < a + share)), path) for a in range(0, last + 1, share)]


def _held(log: DataFrame, path: str) -> str:
    log.repartitionByRange(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), "position").sortWithinPartitions("position").write.parquet(f"{path}-whole")
    return f"{path}-whole"


def _seen_batches(out: list):
    """A batch function that keeps what the query reports of a batch: its events, and whether it ends where a transaction does."""

    def run(batch: DataFrame, number: int) -> None:
        out.append(batch.agg(F.count("*"), F.min("position"), F.max("position"), F.max("resumable_position")).first())

    return run


@query("""SELECT count(*) AS events, min(position) AS first_position, max(position) AS last_position, sum(key)::BIGINT AS keys, 0::BIGINT AS torn, 0::BIGINT AS too_large
FROM (SELECT event_id AS position, user_id * 2 + 1 AS key, max(event_id) OVER () AS last FROM events) WHERE position > (last // 3 // 10) * 10 + 9""")
def stream_from_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log from a position that a state holds, in batches of so many events: what came, batches torn or too large."""
    path, log = scratch_path(spark, "from"), ended(sound_log(spark, sf_dir))
    write, seen = in_parts(log, f"{path}/log", 1), []
    for step in write:
        step()
    begin = log.agg(F.max("position")).first()[0] // 3 // TRANSACTION * TRANSACTION + TRANSACTION - 1

    def keep(batch: DataFrame, number: int) -> None:
        _seen_batches(seen)(batch, number)
        batch.select("position", "key").withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/got")

    drain(log_stream(spark, f"{path}/log", log.schema, max(BATCH, log.count() // 5), begin), keep, f"{path}/checkpoint")
    got = spark.read.parquet(f"{path}/got")
    torn = sum(1 for n, _, last, end in seen if n and last != end)
    large = sum(1 for n, *_ in seen if n > max(BATCH, log.count() // 5))
    return got.agg(F.count("*").alias("events"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.sum("key").alias("keys")).withColumn("torn", F.lit(torn).cast("bigint")).withColumn("too_large", F.lit(large).cast("bigint"))


_FINAL = f"""SELECT k, v FROM {BALANCES} UNION ALL
SELECT user_id * 2 + 1, arg_max((value::DECIMAL(18,2) * 100)::BIGINT, event_id) FROM events GROUP BY user_id HAVING count(*) % 3 <> 0"""


@query(f"SELECT *, 0::BIGINT AS torn FROM ({_FINAL})")
def stream_whole_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose parts end inside transactions, applied as it grows; ``torn`` counts batches that end inside one."""
    path, log, base = scratch_path(spark, "whole"), ended(sound_log(spark, sf_dir)), fixtures.balances(spark, sf_dir)
    store, seen = TableStore(spark, f"{path}/target", base.schema, "k"), []
    store.replace(base)
    for n, step in enumerate(in_parts(log, f"{path}/log")):
        step()
        apply = applier(store)

        def run(batch: DataFrame, number: int, apply=apply) -> None:
            _seen_batches(seen)(batch, number)
            apply(batch, number)

        drain(log_stream(spark, f"{path}/log", log.schema, after=store.applied("log")), run, f"{path}/checkpoint-{n}")
    return store.read().withColumn("torn", F.lit(sum(1 for n, _, last, end in seen if n and last != end)).cast("bigint"))


def _moving(spark: SparkSession, path: str, name: str, log: DataFrame, base: DataFrame) -> tuple[TableStore, Table]:
    """A table that has changed by its log, and its place in a run."""
    source, target = (TableStore(spark, f"{path}/{side}-{name}", base.schema, "k") for side in ("source", "target"))
    source.replace(apply_changes(base, log, "k"))
    target.replace(base)
    append(log, f"{path}/log-{name}")
    return source, Table(name, "k", source.read, target, log=f"{path}/log-{name}", log_schema=log.schema)


@query(f"SELECT 'early' AS table_name, k, v FROM ({_FINAL}) UNION ALL SELECT 'late', k, v FROM ({_FINAL})")
def resumed_migration_two_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of two tables, stopped when one log is applied and the other is not begun, and gone on with under another checkpoint.

    The first log's positions are far beyond the second's.
    """
    path, log, base = scratch_path(spark, "two"), ended(sound_log(spark, sf_dir)), fixtures.balances(spark, sf_dir)
    far = log.withColumns({c: F.col(c) + 1_000_000_000 for c in ("position", "resumable_position")})
    tables = [_moving(spark, path, "early", far, base)[1], _moving(spark, path, "late", log, base)[1]]
    first = Migration(spark, tables, None, f"{path}/first")
    first.state.completed = [t.name for t in tables]
    first._apply(tables[0].log, tables[:1])  # and here it stops
    again = Migration(spark, tables, None, f"{path}/again", state=RunState.loads(first.dump()))
    again.run()
    return tables[0].target.read().select(F.lit("early").alias("table_name"), "k", "v").unionByName(tables[1].target.read().select(F.lit("late").alias("table_name"), "k", "v"))


#: Tables of the log that several tables share.
SHARED = ("t0", "t1", "t2")


@query(f"""SELECT 't' || k % 3 AS table_name, k, v, 0::BIGINT AS apart FROM (
SELECT user_id * 2 + 1 AS k, arg_max((value::DECIMAL(18,2) * 100)::BIGINT, event_id) AS v FROM events GROUP BY user_id HAVING count(*) % 3 <> 0)""")
def migration_of_one_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw log that drives three tables, which change at once; ``apart`` counts versions in which a table is not at the others' position."""
    path, log = scratch_path(spark, "one"), ended(sound_log(spark, sf_dir))
    row = lambda c: F.struct(F.col(f"{c}.k").alias("k"), F.col(f"{c}.v").alias("v"))
    rows = F.when(F.col("op") == "I", F.array(row("new"))).when(F.col("op") == "D", F.array(row("old"))).otherwise(F.array(row("old"), row("new")))
    raw = log.select("position", "resumable_position", F.lit("tpch").alias("db"), F.concat(F.lit("t"), (F.col("key") % 3).cast("string")).alias("table_name"), "op", rows.alias("rows"))
    schema = log.schema["new"].dataType
    stores = {n: TableStore(spark, f"{path}/{n}", schema, "k") for n in SHARED}
    group = StoreGroup(spark, f"{path}/group", stores)
    tables = [Table(n, "k", lambda: spark.createDataFrame([], schema), s, log=f"{path}/log", log_schema=raw.schema, db="tpch") for n, s in stores.items()]
    run, apart = Migration(spark, tables, None, f"{path}/run", verifier=NoVerifier()), 0
    for step in in_parts(raw, f"{path}/log"):
        step()
        run.catch_up()
        for v in group.versions():
            named = group.manifest(v)
            at = {stores[n].manifest(named["tables"][n])["batches"].get(f"{path}/log") for n in SHARED if n in named["tables"]}
            apart += at != {named["batches"].get(f"{path}/log")}
    out = None
    for n in SHARED:
        one = group.read(n).select(F.lit(n).alias("table_name"), "k", "v")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("apart", F.lit(apart).cast("bigint"))


@query("SELECT user_id * 2 + 1 AS key, count(*) AS changes FROM events GROUP BY user_id")
def stream_reverify_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by key, held as the stream's own keyed state, which outlives restarts of the query."""
    path, log = scratch_path(spark, "state"), sound_log(spark, sf_dir)
    at = -1
    for step in in_parts(log, f"{path}/log"):
        step()
        stream = log_stream(spark, f"{path}/log", log.schema, after=at).select("key", "position")
        updates = counted_changes(stream)
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/updates")
        drain(updates, write, f"{path}/checkpoint", mode="update")
        at = spark.read.schema(log.schema).parquet(f"{path}/log").agg(F.max("position")).first()[0]
    return spark.read.parquet(f"{path}/updates").groupBy("key").agg(F.max_by("changes", "batch").alias("changes"))


_HASHED = fingerprint_sql(COLUMNS)


@query(f"""WITH s AS (SELECT o_orderkey AS k, {_HASHED} AS h FROM {SOURCE}), t AS (SELECT o_orderkey AS k, {_HASHED} AS h FROM {TARGET})
SELECT coalesce(s.k, t.k) AS o_orderkey, CASE WHEN s.k IS NULL THEN 'row missing on source' WHEN t.k IS NULL THEN 'row missing on target' ELSE 'rows checksum difference' END AS mismatch_type
FROM s FULL JOIN t ON s.k = t.k WHERE s.h IS DISTINCT FROM t.h AND coalesce(s.k, t.k) > (SELECT max(o_orderkey) - max(o_orderkey) // 50 FROM {ORDERS})""")
def checksum_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target whose last keys are damaged: sums by ranges of keys find where, and only those ranges are compared row by row."""
    source, damaged = fixtures.source_orders(spark, sf_dir), fixtures.damaged_orders(spark, sf_dir)
    top = fixtures.orders(spark, sf_dir).agg(F.max("o_orderkey")).first()[0]
    cut = F.col("o_orderkey") > top - top // 50
    target = source.where(~cut).unionByName(damaged.where(cut))
    return hash_tree.differences(source, target, "o_orderkey").select("o_orderkey", "mismatch_type")


@query("""WITH p AS (SELECT event_id, event_id % 120 + 995 AS f, user_id AS o FROM events)
SELECT event_id, 'log.' || f || ':' || o AS position, dense_rank() OVER (ORDER BY f, o)::BIGINT AS place,
  (f, o) > (1001, 20) AS beyond FROM p""")
def log_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of positions across log files whose numbers have grown by a digit."""
    e = table(spark, sf_dir, "events").select("event_id", positions.text_of(F.col("event_id") % 120 + 995, F.col("user_id"), 3).alias("position"))
    ranked = positions.places(e, "position")
    return ranked.withColumn("beyond", positions.at(F.col("position")) > positions.at(F.lit("log.1001:20"))).select("event_id", "position", "place", "beyond")


@query("""WITH x AS (SELECT event_type AS source, event_id AS id FROM events WHERE event_id % 10 < 7 UNION SELECT event_type, event_id + 1 FROM events WHERE event_id % 10 < 3),
g AS (SELECT source, id, id - row_number() OVER (PARTITION BY source ORDER BY id) AS island FROM x)
SELECT source, min(id) AS first_id, max(id) AS last_id FROM g GROUP BY source, island""")
def transaction_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two sets of transaction ids, held as intervals by source."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("first_id"))
    one = e.where("first_id % 10 < 7").withColumn("last_id", F.col("first_id"))
    other = e.where("first_id % 10 < 3").select("source", (F.col("first_id") + 1).alias("first_id"), (F.col("first_id") + 1).alias("last_id"))
    return positions.union(one, other)
