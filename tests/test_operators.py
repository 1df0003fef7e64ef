"""Scans, selection, differences, changes, state."""

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import changes, diff, progress, scan, selection
from tidemark.operators.migration import Migration, Table, Throttler, VerificationFailed, retried, wait_until
from tidemark.plans.register import ORACLES, QUERIES
from tidemark.sources.store import TableStore
from tidemark.state import RunState
from tidemark.streaming.apply import ReverifyStore, applier, drain, log_stream

ROW = "struct<k: bigint, v: string>"
EVENTS = f"position bigint, op string, key bigint, old {ROW}, new {ROW}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pages_reach_the_scan_and_cover_key_zero(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    page = scan.keyset_page(df, "id", 10, 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,10)" in plan and "TakeOrderedAndProject" in plan
    assert [r[0] for r in scan.keyset_page(df, "id", None, 3).collect()] == [0, 1, 2]


def test_batches_cover_every_row_once(spark):
    df = spark.range(0, 3000, 3).repartition(7)
    got = sorted(scan.key_batches(df, "id", 64).collect())
    assert [r["row_count"] for r in got] == [64] * 15 + [40]
    assert got[0]["first_key"] == 0 and got[-1]["last_key"] == 2997
    assert scan.not_advancing(scan.key_batches(df, "id", 64)).isEmpty()


def test_batches_of_an_empty_table(spark):
    assert scan.key_batches(spark.range(0), "id", 10).isEmpty()


def test_table_filters():
    with pytest.raises(ValueError):
        selection.StaticTableFilter(tables=("a",), not_tables=("b",))
    with pytest.raises(ValueError):
        selection.ShardedTableFilter("d", "t", included=("a",), ignored=("b",))
    with pytest.raises(ValueError):
        selection.inverse({"a": "x", "b": "x"})
    assert selection.inverse({"a": "x"}) == {"x": "a"}


def test_system_databases_are_never_listed(spark):
    df = spark.createDataFrame([("mysql", "user"), ("app", "t")], "db string, table_name string")
    assert rows(selection.StaticTableFilter().apply(df)) == [("app", "t")]


def test_lookup_of_missing_and_repeated_keys(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    keys = spark.createDataFrame([(1,), (1,), (9,)], "k bigint")
    assert rows(scan.with_keys(t, "k", keys)) == [(1, "a")]
    assert diff.lookup_diff(t, t, "k", keys).isEmpty()


def test_mismatch_kinds_and_message(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, v string")
    t = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k bigint, v string")
    assert sorted((r["k"], r["mismatch_type"]) for r in diff.classified(s, t, "k").collect()) == [(2, diff.CHECKSUM_DIFFERS), (3, diff.MISSING_ON_TARGET), (4, diff.MISSING_ON_SOURCE)]
    got = spark.createDataFrame(
        [("default", "users", "1", 1, "row missing on source", "", "", ""), ("default", "users", "5", 5, "row missing on target", "", "", ""),
         ("default", "posts", "9", 9, "column value difference", "boo", "aaa", "title"), ("default", "attachments", "7", 7, "column value difference", "boo", "aaa", "name")],
        "db string, table_name string, pk string, pk_order bigint, mismatch_type string, source_md5 string, target_md5 string, mismatch_column string",
    )
    r = diff.message(got).first()
    assert r["message"] == (
        "cutover verification failed for: default.attachments [PKs: 7 (type: column value difference, source: boo, target: aaa, column: name) ] "
        "default.posts [PKs: 9 (type: column value difference, source: boo, target: aaa, column: title) ] "
        "default.users [PKs: 1 (type: row missing on source) 5 (type: row missing on target) ] "
    )
    assert r["incorrect_tables"] == ["default.attachments", "default.posts", "default.users"]


@pytest.mark.parametrize("orders", [80_000, 3])
def test_a_message_of_all_keys_is_that_of_the_sql(spark, tmp_path, monkeypatch, orders):
    from tidemark import catalog

    monkeypatch.setattr(scan, "TEXTS_AT_ONCE", 100)
    columns = "id AS o_orderkey, id % 97 AS o_custkey, 'O' AS o_orderstatus, id / 100.0D AS o_totalprice, '1-URGENT' AS o_orderpriority"
    spark.range(orders).selectExpr(*columns.split(", ")).write.parquet(f"file://{tmp_path}/orders.parquet")
    want = duckdb.connect()
    want.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [r["message"] for r in catalog.QUERIES["mismatch_message"](spark, f"file://{tmp_path}").collect()]
    assert got == [r[0] for r in want.execute(catalog.ORACLES["mismatch_message"]).fetchall()]
    assert (got[0] or "").count("type: ") > 2 * diff.NAMED if orders > 3 else got == [None]


def test_a_column_that_one_side_lacks(spark):
    s = spark.createDataFrame([(1, "a", "b")], "k bigint, v string, w string")
    got = diff.by_column(s, s.drop("w"), "k", ["v", "w"]).first()
    assert (got["mismatch_type"], got["mismatch_column"]) == (diff.COLUMN_MISSING_ON_TARGET, "w")


def fold(spark, base, events, **kw):
    t = spark.createDataFrame(base, "k bigint, v string")
    e = spark.createDataFrame(events, EVENTS)
    return rows(changes.apply_changes(t, e, "k", **kw))


CASES = [
    ([(1, "a")], [(1, "I", 1, None, (1, "z"))], [(1, "a")]),  # insert keeps what is there
    ([(1, "a")], [(1, "U", 1, (1, "a"), (1, "b"))], [(1, "b")]),
    ([(1, "a")], [(1, "U", 1, (1, "x"), (1, "b"))], [(1, "a")]),  # as it is not
    ([(1, None)], [(1, "U", 1, (1, None), (1, "b"))], [(1, "b")]),  # nulls are equal here
    ([(1, "a")], [(1, "D", 1, (1, "x"), None)], [(1, "a")]),
    ([(1, "a")], [(1, "D", 1, (1, "a"), None)], []),
    ([], [(1, "U", 1, (1, "a"), (1, "b"))], []),
    ([], [(2, "U", 1, (1, "a"), (1, "b")), (1, "I", 1, None, (1, "a")), (3, "D", 1, (1, "b"), None), (4, "I", 1, None, (1, "c"))], [(1, "c")]),
    ([(5, "q")], [], [(5, "q")]),
]


@pytest.mark.parametrize(("base", "events", "want"), CASES)
@pytest.mark.parametrize("at_once", [10_000, 0])
def test_compare_and_set(spark, base, events, want, at_once):
    assert fold(spark, base, events, at_once=at_once) == want


def test_applying_twice_does_no_harm(spark):
    events = [(1, "I", 1, None, (1, "a")), (2, "U", 1, (1, "a"), (1, "b")), (3, "U", 1, (1, "b"), (1, "c"))]
    assert fold(spark, fold(spark, [], events), events) == [(1, "c")]


def test_updates_pair_their_rows(spark):
    raw = spark.createDataFrame([(7, "d", "t", "U", [(1, "a"), (1, "b"), (2, "c"), (3, "d")])], f"position bigint, db string, table_name string, op string, rows array<{ROW}>")
    got = changes.decoded(raw)
    assert [(r["row_at"], tuple(r["old"]), tuple(r["new"])) for r in got.orderBy("row_at").collect()] == [(0, (1, "a"), (1, "b")), (1, (2, "c"), (3, "d"))]
    split = changes.key_changes_split(got, "k")
    assert sorted((r["op"], (r["old"] or r["new"])["k"]) for r in split.collect()) == [("D", 2), ("I", 3), ("U", 1)]


def test_a_row_that_changes_tenant_fails_the_job(spark):
    e = spark.createDataFrame([(1, "U", 1, (2, "a"), (1, "a"))], EVENTS)
    with pytest.raises(PySparkException, match="sharding key changed from 2 to 1"):
        changes.of_tenant(e, "k", 1).collect()
    assert changes.of_tenant(e, "k", 5).isEmpty()


def test_a_missing_tenant_is_no_tenants(spark):
    e = spark.createDataFrame([(1, "I", 1, None, (None, "a"))], EVENTS)
    assert changes.of_tenant(e, "k", 1).isEmpty()


def test_a_store_keeps_what_changed_while_it_was_verified(spark):
    store = spark.createDataFrame([("d", "t", 1, 3), ("d", "t", 2, 1)], "db string, table_name string, key bigint, changes bigint")
    done = spark.createDataFrame([("d", "t", 1, 2), ("d", "t", 2, 1)], "db string, table_name string, key bigint, changes bigint")
    assert rows(changes.after_verifying(store, done)) == [("d", "t", 1, 1)]


def test_insert_ignore_first_row_wins_and_target_stays(spark):
    t = spark.createDataFrame([(1, "old")], "k bigint, v string")
    load = spark.createDataFrame([(1, "new"), (2, "a"), (2, "b")], "k bigint, v string")
    assert rows(changes.insert_ignore(t, load, "k")) == [(2, "a")]


@pytest.mark.parametrize(("written", "verified", "want"), [(0, 0, -1), (5, 0, 5), (0, 7, 7), (5, 7, 5)])
def test_resume_positions(written, verified, want):
    assert RunState(written={"a": written}, verified={"a": verified}).resume_from("a") == want


def test_state_round_trip_and_version():
    state = RunState({"t": 5}, ["u"], {"a": 3}, {"a": 2}, 0, [["d", "t", 1, 2]])
    assert RunState.loads(state.dumps()) == state
    with pytest.raises(ValueError):
        RunState.loads(state.dumps().replace('"version": "2"', '"version": "0"'))


def test_eta_is_never_negative_and_needs_a_speed(spark):
    df = spark.createDataFrame([(5, 10, 2.0), (20, 10, 2.0), (5, 10, 0.0)], "d bigint, t bigint, s double")
    assert [r[0] for r in df.select(progress.seconds_left(F.col("d"), F.col("t"), F.col("s"))).collect()] == [3, 0, None]


def test_throttler_and_waiting():
    t = Throttler(lag=lambda: 9.0, most=5.0)
    assert t.blocked()
    t.disabled = True
    assert not t.blocked()
    assert not Throttler(lag=lambda: None, most=1.0).blocked()
    with pytest.raises(TimeoutError):
        wait_until(lambda: 1, 2, 0.1)
    wait_until(lambda: 2, 2, 0.1)


def test_retries():
    tries = []
    with pytest.raises(ZeroDivisionError):
        retried(lambda: tries.append(1) or 1 / 0, 3)
    assert len(tries) == 3


def test_store_batches_are_applied_once(spark, tmp_path):
    log = spark.createDataFrame([(1, "I", 1, None, (1, "a")), (2, "U", 1, (1, "a"), (1, "b"))], EVENTS)
    store = TableStore(spark, f"file://{tmp_path}/s", spark.createDataFrame([], "k bigint, v string").schema, "k", 3)
    run = applier(store)
    run(log, 0)
    version = store.manifest()["version"]
    run(log, 0)
    assert store.manifest()["version"] == version and rows(store.read()) == [(1, "b")]


def test_a_stopped_stream_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}"
    store = TableStore(spark, f"{path}/s", spark.createDataFrame([], "k bigint, v string").schema, "k", 3)
    schema = spark.createDataFrame([], EVENTS).schema
    want = {}
    for part in range(3):
        events = [(part * 10 + i, "I", part * 10 + i, None, (part * 10 + i, "x")) for i in range(5)]
        want |= {e[2]: "x" for e in events}
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(f"{path}/log")
        drain(log_stream(spark, f"{path}/log", schema, after=store.applied("log")), applier(store), f"{path}/cp{part}")
    assert dict(rows(store.read())) == want


def test_threads_take_turns(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = ReverifyStore(spark, f"file://{tmp_path}/r", 2)
    one = lambda i: store.add(spark.createDataFrame([("d", "t", i)], "db string, table_name string, key bigint"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(one, range(6)))
    assert rows(store.entries()) == [("d", "t", str(i), 1) for i in range(6)]


def test_events_after_cutover_are_an_error(spark, tmp_path):
    store = ReverifyStore(spark, f"file://{tmp_path}/r", 2)
    e = spark.createDataFrame([("d", "t", 1)], "db string, table_name string, key bigint")
    store.add(e)
    store.add(e)
    assert rows(store.entries()) == [("d", "t", "1", 2)]
    store.closed = True
    with pytest.raises(RuntimeError):
        store.add(e)


def _migration(spark, tmp_path, source, target_rows=(), **kw):
    schema = spark.createDataFrame([], "k bigint, v string").schema
    target = TableStore(spark, f"file://{tmp_path}/target", schema, "k", 2)
    if target_rows:
        held = spark.createDataFrame(list(target_rows), schema)
        target.update(held.select("k"), lambda _: held)
    m = Migration(spark, [Table("t", "k", lambda: spark.createDataFrame(source, schema), target)], spark.createDataFrame([], EVENTS).schema, f"file://{tmp_path}/cp", **kw)
    return m, target


def test_a_copy_ends_equal(spark, tmp_path):
    m, target = _migration(spark, tmp_path, [(0, "a"), (1, None)])
    m.run()
    assert rows(target.read()) == [(0, "a"), (1, None)] and m.stage.value == "done"


def test_a_damaged_target_fails_the_cutover(spark, tmp_path):
    unlocked = []
    m, _ = _migration(spark, tmp_path, [(1, "a"), (2, "b")], [(2, "damaged")], unlock=lambda: unlocked.append(1))
    with pytest.raises(VerificationFailed, match=r"t \[PKs: 2 \(type: rows checksum difference"):
        m.run()
    assert unlocked


def test_a_row_repaired_before_cutover_passes(spark, tmp_path):
    m, target = _migration(spark, tmp_path, [(1, "a"), (2, "b")], [(2, "damaged")])

    def repair():
        target.update(spark.createDataFrame([(2,)], "k bigint"), lambda rows_: rows_.withColumn("v", F.when(F.col("k") == 2, "b").otherwise(F.col("v"))))

    m.run([repair])
    assert rows(target.read()) == [(1, "a"), (2, "b")]


def test_an_enforced_copy_fails_at_once(spark, tmp_path):
    m, _ = _migration(spark, tmp_path, [(1, "a")], [(1, "damaged")], enforce=True)
    with pytest.raises(VerificationFailed):
        m.copy()


def test_completed_tables_are_not_copied_again(spark, tmp_path):
    m, target = _migration(spark, tmp_path, [(1, "a")], state=RunState(completed=["t"]))
    m.copy()
    assert target.read().isEmpty()


def test_every_query_but_sampling_ones_has_sql():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) == len(QUERIES)
