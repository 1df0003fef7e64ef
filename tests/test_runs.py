"""Stores, verifiers and whole runs: keys of any type, tenants, batches, resuming, control."""

import http.server
import json
import random
import socket
import threading
import time
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import key_text, key_value
from tidemark.metrics import Metrics, StatsD, reporter
from tidemark.operators import changes, diff, scan
from tidemark.operators.filters import AllRows, CopyFilter, JoinedRows, TableFilter, TenantRows
from tidemark.operators.migration import Migration, Stage, Stopped, Table, Throttler, VerificationFailed, tenant_tables
from tidemark.operators.selection import JoinTable, ShardedTableFilter, StaticTableFilter
from tidemark.operators.verifiers import AllOf, ChecksumVerifier, ColumnVerifier, InlineVerifier, IterativeVerifier, NoVerifier, ProvenanceVerifier
from tidemark.session import check_settings
from tidemark.sources import catalog
from tidemark.sources.change_log import log_stream, read_log
from tidemark.sources.store import StoreGroup, TableStore
from tidemark.state import RunState
from tidemark.streaming.apply import drain

ROW = "k bigint, v string"
EVENTS = f"position bigint, op string, key bigint, old struct<{ROW}>, new struct<{ROW}>"


def rows(df):
    return sorted(map(tuple, df.collect()))


def schema(spark, text=ROW):
    return spark.createDataFrame([], text).schema


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store", schema(spark), "k", 3)


# --- the store ---


def test_a_store_takes_changes_as_deltas_and_folds_them(spark, store, monkeypatch):
    from tidemark.sources import store as module

    monkeypatch.setattr(module, "FAN", 2)
    monkeypatch.setattr(module, "ROWS_A_BUCKET", 60)
    rng, want = random.Random(1), {i: "a" for i in range(50)}
    store.replace(spark.createDataFrame(list(want.items()), ROW))
    bases, levels = set(), set()
    for n in range(12):
        keys = rng.sample(range(80), 9)
        after = {k: f"{n}" for k in keys if rng.random() < 0.7}
        for k in keys:
            want.pop(k, None)
        want |= after
        store.update(spark.createDataFrame([(k,) for k in keys], "k bigint"), lambda _, after=after: spark.createDataFrame(list(after.items()), ROW))
        assert dict(rows(store.read())) == want
        bases.add(store.manifest()["base"])
        levels |= {d["level"] for d in store.manifest()["deltas"]}
        assert len({d["level"] for d in store.manifest()["deltas"]}) == len(store.manifest()["deltas"])
    assert len(bases) > 1 and levels >= {0, 1, 2}
    assert store.vacuum(keep=1) > 0 and dict(rows(store.read())) == want


def test_small_changes_write_a_row_again_a_logarithm_of_times(spark, tmp_path, monkeypatch):
    from tidemark.sources import store as module

    monkeypatch.setattr(module, "FAN", 3)
    store, n = TableStore(spark, f"file://{tmp_path}/s", schema(spark), "k"), 27
    store.replace(spark.range(5000).selectExpr("id AS k", "'a' AS v"))
    before = store.rows_written
    for i in range(n):
        store.update(spark.createDataFrame([(i,)], "k bigint"), lambda now: now.withColumn("v", F.lit("b")))
    assert store.rows_written - before <= n * 4  # once, and at each of the levels of 3, 9 and 27
    assert len(store.manifest()["deltas"]) == 1 and store.read().where("v = 'b'").count() == n


def test_a_batched_copy_reads_and_writes_in_proportion(spark, tmp_path, monkeypatch):
    from tidemark.sources import store as module

    monkeypatch.setattr(module, "FAN", 4)
    for size, times in ((2000, 2), (4000, 3)):  # 8 files are merged once, 16 twice
        opened = []
        source = spark.range(size).selectExpr("id AS k", "'a' AS v")
        m, target = migration(spark, tmp_path / str(size), lambda source=source: source, batch_rows=250, name=f"t{size}")
        m.on_batch = (lambda t, part: opened.append(len(t.target.files_of(str(part.agg(F.min("k")).first()[0] - 1), str(part.agg(F.max("k")).first()[0])))),)
        m.copy()
        assert target.read().count() == size and max(opened) == 1 and len(opened) >= size // 1000
        assert not target.manifest()["deltas"]
        assert target.rows_written <= times * size


@pytest.mark.parametrize("kind", ["bigint", "string", "binary", "decimal(20,0)", "date"])
def test_ranges_and_sets_of_keys_open_their_files_only(spark, tmp_path, monkeypatch, kind):
    from tidemark.sources import store as module

    monkeypatch.setattr(module, "PRUNED_FROM", 2)
    key = {"bigint": "id - 40", "string": "concat('ä', id)", "binary": "unhex(lpad(hex(id), 4, '0'))", "decimal(20,0)": "cast(id as decimal(20,0))", "date": "date_add(date'2024-01-01', cast(id as int))"}[kind]
    data = spark.range(100).selectExpr(f"{key} AS k", "cast(id as string) AS v")
    s = TableStore(spark, f"file://{tmp_path}/s", data.schema, "k", 10)
    s.replace(data)
    texts = [r[0] for r in data.orderBy("k").select(key_text(F.col("k"), s.kind)).collect()]
    part = data.orderBy("k").limit(30).subtract(data.orderBy("k").limit(20))
    assert rows(s.read(texts[19], texts[29]).select("v")) == rows(part.select("v"))
    pruned = kind != "date"
    assert len(s.files_of(texts[19], texts[29])) == 10 or pruned and len(s.files_of(texts[19], texts[29])) < 4
    touched = s._touched(s.manifest(), part.select("k"))
    assert (touched is None) != pruned and (not pruned or len(touched) < 4)
    s.update(part.select("k"), lambda now: now.withColumn("v", F.lit("new")))
    assert s.read().where("v = 'new'").count() == 10 and s.read().count() == 100


def test_stores_of_a_group_change_at_once(spark, tmp_path):
    stores = {n: TableStore(spark, f"file://{tmp_path}/{n}", schema(spark), "k") for n in "ab"}
    group = StoreGroup(spark, f"file://{tmp_path}/group", stores)
    for n, s in stores.items():
        s.replace(spark.createDataFrame([(1, n)], ROW))
    before = group.versions()[-1]
    change = lambda s, v: s.update(spark.createDataFrame([(1,)], "k bigint"), lambda now: now.withColumn("v", F.lit(v)))
    with pytest.raises(ZeroDivisionError), group.transaction(log=5):
        change(stores["a"], "lost")
        assert rows(stores["a"].read()) == [(1, "lost")]  # the writer sees what it has prepared
        assert rows(group.read("a")) == [(1, "a")]  # others do not
        1 / 0  # noqa: B018
    assert rows(stores["a"].read()) == [(1, "a")] and group.applied("log") == -1
    with group.transaction(log=7):
        change(stores["a"], "new a")
        assert group.versions()[-1] == before
        change(stores["b"], "new b")
    assert (rows(stores["a"].read()), rows(stores["b"].read()), group.applied("log")) == ([(1, "new a")], [(1, "new b")], 7)
    assert rows(group.read("a", before)) == [(1, "a")] and rows(group.read("b", before)) == [(1, "b")]
    assert stores["a"].vacuum(keep=1) > 0 and rows(stores["a"].read()) == [(1, "new a")]
    fresh = StoreGroup(spark, group.path, {n: TableStore(spark, s.path, s.schema, "k") for n, s in stores.items()})
    assert rows(fresh.stores["a"].read()) == [(1, "new a")]


def test_a_store_sees_only_the_rows_of_the_keys_it_changes(spark, store):
    store.replace(spark.createDataFrame([(i, "a") for i in range(10)], ROW))
    seen = []
    store.update(spark.createDataFrame([(3,), (3,), (99,)], "k bigint"), lambda now: seen.append(rows(now)) or now.withColumn("v", F.lit("b")))
    assert seen == [[(3, "a")]] and dict(rows(store.read()))[3] == "b" and store.read().count() == 10


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    from tidemark.sources import store as module

    monkeypatch.setattr(module, "ROWS_A_BUCKET", 10)
    monkeypatch.setattr(module, "PRUNED_FROM", 2)
    s = TableStore(spark, f"file://{tmp_path}/s", schema(spark), "k")
    s.replace(spark.createDataFrame([(i, "a") for i in range(95)], ROW))
    assert s.manifest()["buckets"] == 10 and s.manifest()["rows"] == 95
    s.insert(spark.createDataFrame([(i, "b") for i in range(90, 200)], ROW))
    s.update(spark.createDataFrame([(150,), (4,)], "k bigint"), lambda now: now.where("k <> 4"))
    want = {i: "a" if i < 95 else "b" for i in range(200) if i != 4}
    assert dict(rows(s.read())) == want
    s.compact()
    assert s.manifest()["buckets"] >= 19 and dict(rows(s.read())) == want


def test_an_empty_store(spark, store):
    assert store.read().isEmpty()
    store.update(spark.createDataFrame([(1,)], "k bigint"), lambda now: now)
    store.insert(spark.createDataFrame([], ROW))
    assert store.read().isEmpty()
    store.compact()
    assert store.vacuum() == 0 and store.read().isEmpty()


def test_batches_are_told_apart_by_log(spark, store):
    one = lambda k: (spark.createDataFrame([(k,)], "k bigint"), lambda now: now.unionByName(spark.createDataFrame([(k, "x")], ROW)))
    assert store.update(*one(1), ("a", 0)) and store.update(*one(2), ("b", 0)) and not store.update(*one(3), ("a", 0))
    assert [k for k, _ in rows(store.read())] == [1, 2]


def test_two_writers_of_one_version_collide(spark, store):
    store.replace(spark.createDataFrame([(1, "a")], ROW))
    now = store.manifest()
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(now)


@pytest.mark.parametrize(("kind", "values"), [("binary", [b"\x00", b"", b"\xff\x10", b"a"]), ("decimal(20,0)", [Decimal(2**64 - 1), Decimal(0)]), ("string", ["", "ä", "0"]), ("int", [1, -5])])
def test_keys_as_text_and_back(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    back = df.select("k", key_text(F.col("k"), df.schema["k"].dataType).alias("t")).select("k", key_value(F.col("t"), df.schema["k"].dataType).alias("b"))
    assert all(r["k"] == r["b"] for r in back.collect())


# --- the fold ---

TYPED = "k bigint, at timestamp, day date, d double, f float, amount decimal(20,6), raw binary, list array<double>, inner struct<a: double, b: string>"


def test_long_histories_fold_alike_for_every_type(spark):
    rng = random.Random(2)

    def value(n):
        zero = rng.choice([0.0, -0.0]) if n % 3 == 0 else float("nan") if n % 3 == 1 else n / 7
        return (datetime(2024, 1, 1, 3, 4, n % 60, 123456), datetime(2024, 2, 1 + n % 28).date(), zero, zero, Decimal(n) / 8, bytes([n % 256, 0]), [zero, None], (zero, None if n % 2 else "x"))

    events, there = [], {}
    for n in range(300):
        k = rng.randrange(5)
        old, new = there.get(k), (k, *value(rng.randrange(40)))
        if old is None:
            events.append((n, "I", k, None, new))
            there[k] = new
        elif rng.random() < 0.2:
            events.append((n, "D", k, old, None))
            del there[k]
        else:
            wrong = rng.random() < 0.2
            events.append((n, "U", k, (k, *value(99)) if wrong else old, new))
            if not wrong:
                there[k] = new
    log = spark.createDataFrame(events, f"position bigint, op string, key bigint, old struct<{TYPED}>, new struct<{TYPED}>")
    base = spark.createDataFrame([(7, *value(1)), (8, *value(2))], TYPED)
    one, other = (sorted(repr(r) for r in changes.apply_changes(base, log, "k", at_once=n).collect()) for n in (10_000, 20))
    assert one == other and len(one) == len(there) + 2


def test_the_last_of_several_rows_at_one_position(spark):
    log = spark.createDataFrame([(5, i, "U", 1, (1, "x"), (1, str(i))) for i in (2, 0, 1)], f"position bigint, row_at int, op string, key bigint, old struct<{ROW}>, new struct<{ROW}>")
    assert changes.latest_images(log).first()["new"]["v"] == "2"


# --- scans ---


def test_running_sums_and_batches_of_many_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.randint(1, 9)) for i in range(700)]
    got = {r["i"]: r["s"] for r in scan.running_sum(spark.createDataFrame(data, "g string, i int, n int").repartition(5), "g", "i", "n", "s").collect()}
    so_far: dict = {}
    for g, i, n in data:
        so_far[g] = so_far.get(g, 0) + n
        assert got[i] == so_far[g]
    keys = spark.createDataFrame([("d", g or "n", i % 300) for g, i, _ in data], "db string, t string, k int")
    out = scan.set_batches(keys, ["db", "t"], "k", 40).collect()
    assert len(out) == keys.distinct().count()
    for t in {r["t"] for r in out}:
        mine = sorted((r["k"], r["batch"]) for r in out if r["t"] == t)
        assert [b for _, b in mine] == [n // 40 for n in range(len(mine))]


def test_a_message_names_the_first_and_counts_the_rest(spark):
    found = spark.createDataFrame([("d", "t", str(i), i, "row missing on target", "x", None, None) for i in range(30)], "db string, table_name string, pk string, pk_order int, mismatch_type string, source_md5 string, target_md5 string, mismatch_column string")
    text = diff.message(found, most=2).first()["message"]
    assert text == "cutover verification failed for: d.t [PKs: 0 (type: row missing on target, source: x) 1 (type: row missing on target, source: x) and 28 more ] "


# --- runs ---


def migration(spark, tmp_path, source, target_rows=(), log=None, name="t", **kw):
    target = TableStore(spark, f"file://{tmp_path}/target-{name}", schema(spark), "k", 2)
    if target_rows:
        target.replace(spark.createDataFrame(list(target_rows), ROW))
    read = source if callable(source) else lambda: spark.createDataFrame(source, ROW)
    return Migration(spark, [Table(name, "k", read, target, log=log)], schema(spark, EVENTS), f"file://{tmp_path}/cp", **kw), target


def test_a_copy_in_batches_tells_its_listeners_and_can_change_size(spark, tmp_path):
    sizes, seen = iter([3] + [5] * 50), []
    m, target = migration(spark, tmp_path, [(i, str(i)) for i in range(23)], batch_rows=lambda: next(sizes), on_batch=(lambda t, part: seen.append(sorted(r["k"] for r in part.collect())),))
    m.run()
    assert [k for part in seen for k in part] == list(range(23)) and len(seen) > 3
    assert rows(target.read()) == sorted((i, str(i)) for i in range(23)) and m.state.last_keys == {"t": "22"}


def test_a_stopped_copy_goes_on_after_its_last_batch(spark, tmp_path):
    source = [(i, str(i)) for i in range(30)]
    dumps, done = [], []

    def listen(table, part):
        done.append(part.agg(F.max("k")).first()[0])
        if len(done) == 2:
            m.stop()

    m, target = migration(spark, tmp_path, source, batch_rows=10, on_batch=(listen,), on_error=lambda state, error: dumps.append((state, error)))
    with pytest.raises(Stopped):
        m.run()
    state = RunState.loads(dumps[0][0])
    assert isinstance(dumps[0][1], Stopped) and state.last_keys == {"t": "19"} and not state.completed
    again = []
    m, target = migration(spark, tmp_path, source, batch_rows=10, on_batch=(lambda t, part: again.append(part.count()),), state=state)
    m.run()
    assert again == [10] and rows(target.read()) == sorted(source)


def test_small_batches_that_nobody_looks_at_are_loaded_several_a_job(spark, tmp_path):
    class Told(InlineVerifier):
        def copied(self, table, span, enforce):
            super().copied(table, span, enforce)
            spans.append(span)
            if len(spans) == 2:
                self.run.stop()

    source, spans, dumps = [(i, str(i)) for i in range(400)], [], []
    m, target = migration(spark, tmp_path, source, batch_rows=10, verifier=Told(), on_error=lambda state, error: dumps.append(state))
    with pytest.raises(Stopped):
        m.run()
    state = RunState.loads(dumps[0])
    assert spans == [(None, "9"), ("9", "49")] and state.last_keys == {"t": "49"} and target.read().count() == 50
    m, target = migration(spark, tmp_path, source, batch_rows=10, state=state)
    m.run()
    assert rows(target.read()) == sorted(source) and m.copied["t"]["rows"] == 350
    assert m.state.last_keys == {"t": "399"} and target.manifest()["version"] <= 6  # 40 batches in as many jobs before


def test_small_batches_of_unsigned_keys_are_loaded_several_a_job(spark, tmp_path):
    source = spark.range(400).selectExpr("cast(cast('18446744073709551615' as decimal(20,0)) - id as decimal(20,0)) AS k", "cast(id as string) AS v")
    target = TableStore(spark, f"file://{tmp_path}/target", source.schema, "k", 2)
    m = Migration(spark, [Table("t", "k", lambda: source, target)], None, f"file://{tmp_path}/cp", batch_rows=10, enforce=True)
    m.copy()
    assert rows(target.read()) == rows(source) and m.state.last_keys == {"t": "18446744073709551615"}
    assert target.manifest()["version"] <= 5


def test_an_interrupt_dumps_the_state(spark, tmp_path):
    def interrupted(table):
        raise KeyboardInterrupt

    dumps = []
    m, _ = migration(spark, tmp_path, [(1, "a")], on_copied=(interrupted,), on_error=lambda state, error: dumps.append(RunState.loads(state)))
    with pytest.raises(KeyboardInterrupt):
        m.run()
    assert dumps[0].completed == ["t"]
    m.stage = Stage.CUTOVER
    with pytest.raises(RuntimeError, match="can't be interrupted"):
        m.stop()


def test_keys_to_verify_survive_a_dump(spark, tmp_path):
    m, target = migration(spark, tmp_path, [(1, "a"), (2, "b")])
    m.copy()
    m.reverify.add(spark.createDataFrame([("", "t", 2)], "db string, table_name string, key bigint"))
    state = RunState.loads(m.dump())
    assert state.reverify == [["", "t", "2", 1]]
    target.update(spark.createDataFrame([(2,)], "k bigint"), lambda now: now.withColumn("v", F.lit("corrupted")))
    m, _ = migration(spark, tmp_path / "other", [(1, "a"), (2, "b")], state=state)
    m.tables[0].target = m.by_name["t"].target = target
    with pytest.raises(VerificationFailed, match=r"t \[PKs: 2 "):
        m.run()


def _log(spark, path, events):
    spark.createDataFrame(events, EVENTS).write.mode("append").parquet(path)


def test_a_run_that_goes_on_skips_what_was_applied(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    _log(spark, log, [(1, "I", 5, None, (5, "x"))])
    m, target = migration(spark, tmp_path, [(5, "x")], log=log)
    m.run()
    assert (m.state.written_position, m.state.verified_position) == (1, 1)
    _log(spark, log, [(2, "U", 5, (5, "x"), (5, "y"))])
    m, other = migration(spark, tmp_path / "again", [(5, "y")], log=log, state=RunState(written={log: 1}, verified={log: 1}))
    m.catch_up()
    assert m.state.written_position == 2 and rows(other.read()) == []  # the insert at 1 was not read again


def _two_logs(spark, tmp_path, **kw):
    """Two tables with a log each; the logs' positions have nothing to do with each other."""
    tables = []
    for name, position in (("a", 100), ("b", 50)):
        log = f"file://{tmp_path}/log-{name}"
        _log(spark, log, [(position, "U", 1, (1, "old"), (1, "new"))])
        target = TableStore(spark, f"file://{tmp_path}/target-{name}", schema(spark), "k")
        if not target.manifest()["version"]:
            target.replace(spark.createDataFrame([(1, "old")], ROW))
        tables.append(Table(name, "k", lambda: spark.createDataFrame([(1, "new")], ROW), target, log=log))
    return Migration(spark, tables, schema(spark, EVENTS), **kw), tables


@pytest.mark.parametrize("checkpoint", ["same", "other"])
def test_a_run_stopped_between_two_logs_ends_right_from_any_checkpoint(spark, tmp_path, checkpoint):
    first, tables = _two_logs(spark, tmp_path, checkpoint=f"file://{tmp_path}/same")
    first.state.completed = ["a", "b"]
    first._apply(tables[0].log, tables[:1])
    state = RunState.loads(first.dump())
    assert state.written == {tables[0].log: 100} and rows(tables[0].target.read()) == [(1, "new")]
    again = Migration(spark, tables, schema(spark, EVENTS), f"file://{tmp_path}/{checkpoint}", state=state)
    again.run()
    assert [rows(t.target.read()) for t in tables] == [[(1, "new")]] * 2
    assert again.state.written == {tables[0].log: 100, tables[1].log: 50}


def test_a_later_update_is_not_skipped_under_a_new_checkpoint(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    _log(spark, log, [(1, "U", 1, (1, "a"), (1, "b"))])
    m, target = migration(spark, tmp_path, [(1, "b")], [(1, "a")], log=log)
    m.run()
    _log(spark, log, [(2, "U", 1, (1, "b"), (1, "c"))])
    again = Migration(spark, [Table("t", "k", lambda: spark.createDataFrame([(1, "c")], ROW), target, log=log)], schema(spark, EVENTS), f"file://{tmp_path}/other", state=RunState.loads(m.dump() if m.stage is not Stage.CUTOVER else m.state.dumps()), verifier=NoVerifier())
    again.run()
    assert rows(target.read()) == [(1, "c")]


def test_a_state_of_the_version_before_begins_its_logs_again(spark):
    old = json.dumps({"last_keys": {"t": "5"}, "completed": ["u"], "written_position": 9, "verified_position": 9, "target_position": 3, "reverify": [], "reverify_path": "", "version": "1"})
    state = RunState.loads(old)
    assert (state.last_keys, state.target_position, state.resume_from("any")) == ({"t": "5"}, 3, -1)


RAW = f"position bigint, resumable_position bigint, ts timestamp, db string, table_name string, op string, rows array<struct<{ROW}>>"


def _raw_log(spark, path, transactions, names=("x", "y", "z"), per_file=2):
    """A log in files that cut through transactions: each puts one value into a row of every table."""
    events, position, ended = [], 0, 0
    for t in transactions:
        for i, n in enumerate(names):
            position += 1
            ended = position if i == len(names) - 1 else ended
            events.append((position, ended, datetime(2024, 1, 1), "d", n, "I", [(t, str(t))]))
    for a in range(0, len(events), per_file):
        spark.createDataFrame(events[a : a + per_file], RAW).coalesce(1).write.mode("append").parquet(path)
    return events


def test_one_log_changes_several_tables_transaction_by_transaction(spark, tmp_path):
    log, names = f"file://{tmp_path}/log", ("x", "y", "z")
    events = _raw_log(spark, log, range(6))
    _raw = spark.createDataFrame([(events[-1][0] + 1, events[-1][1], datetime(2024, 1, 1), "d", "x", "I", [(99, "open")])], RAW)
    _raw.coalesce(1).write.mode("append").parquet(log)  # of a transaction that has not ended
    stores = {n: TableStore(spark, f"file://{tmp_path}/{n}", schema(spark), "k") for n in names}
    group = StoreGroup(spark, f"file://{tmp_path}/group", stores)
    tables = [Table(n, "k", lambda: spark.createDataFrame([(i, str(i)) for i in range(6)], ROW), s, log=log, log_schema=schema(spark, RAW), db="d") for n, s in stores.items()]
    m = Migration(spark, tables, None, f"file://{tmp_path}/cp", events_per_batch=7, verifier=NoVerifier())
    m.catch_up()
    assert [b["rows"] for b in m.batches] == [6, 6, 6] and group.applied(log) == m.state.written[log] == 18
    for v in group.versions():
        seen = [rows(group.read(n, v)) for n in names]
        assert seen[0] == seen[1] == seen[2] and len(seen[0]) in (0, 2, 4, 6)
    assert m.age(log) > 0 and rows(stores["x"].read()) == [(i, str(i)) for i in range(6)]
    quiet = len(m.batches)
    m.wait_until_almost_caught_up()  # its last event is old, but the log is quiet
    assert len(m.batches) == quiet


@pytest.mark.parametrize(("events", "want"), [(1, [3, 3, 3]), (3, [3, 3, 3]), (5, [3, 3, 3]), (8, [6, 3]), (100, [9])])
def test_batches_are_whole_transactions_of_so_many_events(spark, tmp_path, events, want):
    log, got = f"file://{tmp_path}/log", []
    _raw_log(spark, log, range(3), per_file=4)
    told = drain(log_stream(spark, log, schema(spark, RAW), events), lambda b, n: got.append(sorted(r["position"] for r in b.select("position").collect())), f"file://{tmp_path}/cp")
    assert [len(g) for g in got if g] == want == [b["rows"] for b in told] and sum(got, []) == list(range(1, 10))


def test_a_transaction_over_two_files_waits_for_its_end(spark, tmp_path):
    log, got = f"file://{tmp_path}/log", []
    write = lambda *rows: spark.createDataFrame([(p, e, None, "d", "x", "I", [(p, "v")]) for p, e in rows], RAW).coalesce(1).write.mode("append").parquet(log)
    read = lambda after: drain(log_stream(spark, log, schema(spark, RAW), after=after), lambda b, n: got.append([r["position"] for r in b.select("position").orderBy("position").collect()]), f"file://{tmp_path}/{random.random()}")
    write((1, 1), (2, 1))
    read(-1)
    write((3, 1), (4, 4), (5, 4))
    read(1)
    read(4)
    write((6, 6))
    read(4)
    assert [g for g in got if g] == [[1], [2, 3, 4], [5, 6]]
    assert sorted(r["position"] for r in read_log(spark, log, schema(spark, RAW), 1).collect()) == [2, 3, 4, 5, 6]


def test_the_command_line_moves_changes_of_several_tables(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    for n in ("x", "y"):
        spark.createDataFrame([(0, "0"), (1, "1")], ROW).write.parquet(f"{tmp_path}/source/{n}.parquet")
    _raw_log(spark, f"file://{tmp_path}/log", range(2), names=("x", "y"))
    args = ["copy", "--source", f"file://{tmp_path}/source", "--target", f"file://{tmp_path}/target", "--table", "x:k", "--table", "y:k:z", "--log", f"file://{tmp_path}/log", "--db", "d", "--group", "all"]
    assert main(args) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["written"] == {f"file://{tmp_path}/log": 4}
    stores = {n: TableStore(spark, f"file://{tmp_path}/target/{n}", schema(spark), "k") for n in ("x", "z")}
    group = StoreGroup(spark, f"file://{tmp_path}/target/all", stores)
    assert all(rows(group.read(n)) == [(0, "0"), (1, "1")] for n in stores) and group.applied(f"file://{tmp_path}/log") == 4


def test_a_query_goes_on_from_its_own_checkpoint(spark, tmp_path):
    log, got = f"file://{tmp_path}/log", []
    for part in range(3):
        _log(spark, log, [(part * 10 + i, "I", i, None, (i, "x")) for i in range(4)])
        drain(log_stream(spark, log, schema(spark, EVENTS), after=part * 10 - 1), lambda b, n: got.extend(r["position"] for r in b.select("position").collect()), f"file://{tmp_path}/cp")
    assert sorted(got) == [p * 10 + i for p in range(3) for i in range(4)]


def test_several_logs_are_one_stream_with_an_offset_each(spark, tmp_path):
    logs, got = {n: f"file://{tmp_path}/{n}" for n in "ab"}, []
    _log(spark, logs["a"], [(i, "I", i, None, (i, "x")) for i in range(5)])
    _log(spark, logs["b"], [(i, "I", i, None, (i, "x")) for i in range(100, 103)])
    told = drain(log_stream(spark, logs, schema(spark, EVENTS + ", log string"), 2, {"a": 1, "b": 100}), lambda b, n: got.extend((r["log"], r["position"]) for r in b.select("log", "position").collect()), f"file://{tmp_path}/cp")
    assert sorted(got) == [("a", 2), ("a", 3), ("a", 4), ("b", 101), ("b", 102)] and max(b["rows"] for b in told) <= 4


def test_the_first_error_cancels_what_other_tables_do(spark, tmp_path):
    from pyspark.sql.functions import udf

    @udf("string")
    def slowly(k):
        time.sleep(3)
        return "x"

    def fails():
        time.sleep(2)
        raise ValueError("no source")

    slow = lambda: spark.range(0, 200, 1, 4).select(F.col("id").alias("k"), slowly("id").alias("v"))
    tables = [Table(n, "k", read, TableStore(spark, f"file://{tmp_path}/{n}", schema(spark), "k")) for n, read in (("slow", slow), ("bad", fails))]
    began = time.monotonic()
    with pytest.raises(ValueError, match="no source"):
        Migration(spark, tables, schema(spark, EVENTS), f"file://{tmp_path}/cp").run()
    assert time.monotonic() - began < 60  # the slow table alone takes 150


def test_a_stop_cancels_a_running_copy_and_its_progress_is_told(spark, tmp_path):
    from pyspark.sql.functions import udf

    @udf("string")
    def slowly(k):
        time.sleep(0.5)
        return "x"

    slow = lambda: spark.range(0, 400, 1, 100).select(F.col("id").alias("k"), slowly("id").alias("v"))
    target = TableStore(spark, f"file://{tmp_path}/slow", schema(spark), "k", 2)
    m = Migration(spark, [Table("slow", "k", slow, target, rows_about=400)], schema(spark, EVENTS), f"file://{tmp_path}/cp")
    shares = []

    def look():
        end = time.monotonic() + 90
        while time.monotonic() < end and not any(shares):
            shares.append(m._share(m.tables[0]))  # the status list itself is a job, which would wait for the slow one
            time.sleep(0.2)
        m.stop()

    threading.Thread(target=look).start()
    with pytest.raises(Stopped):
        m.run()
    assert any(shares) and target.read().isEmpty()


def test_progress_tells_rows_bytes_and_speed(spark, tmp_path):
    m, target = migration(spark, tmp_path, [(i, "x" * i) for i in range(50)])
    m.copy()
    told = m.progress().first()
    assert told["copied_rows"] == 50 and told["copied_bytes"] > 500 and told["speed"] > 0 and told["eta"] == 0.0
    counts = []
    m.metrics.drain(counts.append)
    assert {c.name: c.value for c in counts if c.name == "copied_rows"} == {"copied_rows": 50}


def test_rows_that_change_around_the_copy_end_with_the_new_value(spark, tmp_path):
    log, now = f"file://{tmp_path}/log", {1: "old", 2: "gone", 3: "kept"}
    m, target = migration(spark, tmp_path, lambda: spark.createDataFrame(list(now.items()), ROW), log=log)

    def write():
        now.update({1: "new", 4: "made"})
        del now[2]
        _log(spark, log, [(1, "U", 1, (1, "old"), (1, "new")), (2, "D", 2, (2, "gone"), None), (3, "I", 4, None, (4, "made"))])

    m.run([write])
    assert dict(rows(target.read())) == now


def test_a_held_cutover_waits_and_goes_on(spark, tmp_path):
    m, target = migration(spark, tmp_path, [(1, "a")], hold_cutover=True)
    thread = threading.Thread(target=m.run)
    thread.start()
    end = time.monotonic() + 60
    while m.stage is not Stage.WAITING and time.monotonic() < end:
        time.sleep(0.05)
    time.sleep(0.3)
    assert m.stage is Stage.WAITING and m.verify() == ""
    assert m.settings(max_lag=7.0)["max_lag"] == 7.0
    with pytest.raises(ValueError):
        m.settings(nothing=1)
    m.allow_cutover()
    thread.join(60)
    assert m.stage is Stage.DONE and rows(target.read()) == [(1, "a")]
    assert rows(m.progress().select("table_name", "state")) == [("t", "completed")]


def test_passes_in_the_background_find_and_forgive(spark, tmp_path):
    m, target = migration(spark, tmp_path, [(1, "a"), (2, "b")], [(2, "damaged")], hold_cutover=True, reverify_every=0.2)
    thread = threading.Thread(target=m.run)
    thread.start()
    end = time.monotonic() + 60
    while m.stage is not Stage.WAITING and time.monotonic() < end:
        time.sleep(0.05)
    assert "2 (type: rows checksum difference" in m.verify()
    target.update(spark.createDataFrame([(2,)], "k bigint"), lambda now: now.withColumn("v", F.lit("b")))
    m.allow_cutover()
    thread.join(120)
    assert m.stage is Stage.DONE


@pytest.mark.parametrize("verifier", [InlineVerifier, IterativeVerifier, ChecksumVerifier, ColumnVerifier])
def test_verifiers_find_damage(spark, tmp_path, verifier):
    m, _ = migration(spark, tmp_path, [(1, "a"), (2, "b")], [(2, "damaged")], verifier=verifier())
    with pytest.raises(VerificationFailed, match="cutover verification failed for: "):
        m.run()
    m, target = migration(spark, tmp_path / "right", [(1, "a"), (2, "b")], verifier=verifier())
    m.run()
    assert rows(target.read()) == [(1, "a"), (2, "b")]


def test_without_a_verifier_damage_stays(spark, tmp_path):
    m, target = migration(spark, tmp_path, [(1, "a"), (2, "b")], [(2, "damaged")], verifier=NoVerifier())
    m.run()
    assert rows(target.read()) == [(1, "a"), (2, "damaged")]


def test_ignored_columns_and_compressed_ones(spark, tmp_path):
    m, _ = migration(spark, tmp_path, [(1, "a")], [(1, "other")], ignored=("v",))
    m.run()
    plain = {"t": {"v": lambda c: F.lower(c)}}
    m, _ = migration(spark, tmp_path / "c", [(1, "A")], [(1, "a")], verifier=ColumnVerifier(plain))
    m.run()


def test_writes_of_others_on_the_target_are_found(spark, tmp_path):
    target_log = [(1, "/*run*/ INSERT"), (2, "/*run*/ UPDATE")]
    read = lambda: spark.createDataFrame(target_log, "position bigint, query string")
    m, _ = migration(spark, tmp_path, [(1, "a")], verifier=AllOf(InlineVerifier(), ProvenanceVerifier(read, "run")))
    m.run()
    assert m.state.target_position == 2
    target_log.append((3, "UPDATE /*run*/"))
    m, _ = migration(spark, tmp_path / "b", [(1, "a")], verifier=AllOf(InlineVerifier(), ProvenanceVerifier(read, "run")))
    with pytest.raises(VerificationFailed, match="position 3"):
        m.run()


def test_the_downtime_that_verification_would_take(spark, tmp_path):
    m, _ = migration(spark, tmp_path, [(1, "a")], most_downtime=1e-9)
    with pytest.raises(VerificationFailed, match="will not end within"):
        m.run()


# --- tenants ---

TENANT_ROW = "k bigint, v string, tenant bigint"


def _tenant_run(spark, tmp_path, log_rows, keyed_target=()):
    def table(name, data, text, key="k"):
        store = TableStore(spark, f"file://{tmp_path}/{name}", schema(spark, text), key, 2)
        return Table(name, key, lambda: spark.createDataFrame(data, text), store, db="new", source_db="old")

    raw = f"position bigint, db string, table_name string, op string, rows array<struct<{TENANT_ROW}>>"
    log = f"file://{tmp_path}/log"
    spark.createDataFrame(log_rows, raw).write.parquet(log)
    own = table("own", [(1, "a", 2), (2, "b", 1), (3, "c", 2)], TENANT_ROW)
    own.log, own.log_schema = log, schema(spark, raw)
    joined = table("notes", [(10, "x"), (11, "y"), (12, "z")], ROW)
    keyed = table("tenants", [(1, "one"), (2, "two")], ROW)
    if keyed_target:
        keyed.target.replace(spark.createDataFrame(list(keyed_target), ROW))
    links = lambda: [JoinTable(spark.createDataFrame([(2, 10), (2, 10), (1, 11)], "tenant bigint, note bigint"), "tenant", "note")]
    return Migration(spark, tenant_tables("tenant", 2, [own], [(joined, links)], [keyed]), schema(spark, raw), f"file://{tmp_path}/cp"), own, joined, keyed


def test_a_tenant_is_moved_and_no_other(spark, tmp_path):
    # the source of these tests stands still, so the log says again what it holds
    log = [(1, "old", "own", "I", [(1, "a", 2)]), (2, "old", "own", "I", [(2, "b", 1)]), (3, "old", "strangers", "I", [(77, "no", 2)]), (4, "elsewhere", "own", "I", [(78, "no", 2)])]
    m, own, joined, keyed = _tenant_run(spark, tmp_path, log)
    keyed_before = []
    m.on_copied = (lambda t: keyed_before.append((t.name, keyed.target.read().count())),)
    m.run()
    assert rows(own.target.read()) == [(1, "a", 2), (3, "c", 2)] and rows(joined.target.read()) == [(10, "x")] and rows(keyed.target.read()) == [(2, "two")]
    assert all(n == 0 for name, n in keyed_before if name != "tenants") and [n for n, _ in keyed_before].count("notes") == 2


def test_a_row_that_changes_its_tenant_ends_the_run(spark, tmp_path):
    m, *_ = _tenant_run(spark, tmp_path, [(1, "old", "own", "U", [(3, "c", 2), (3, "c", 1)])])
    with pytest.raises(Exception, match="sharding key changed from 2 to 1"):
        m.run()


def test_a_tenants_own_row_that_differs_ends_the_run(spark, tmp_path):
    m, *_ = _tenant_run(spark, tmp_path, [], keyed_target=[(2, "damaged")])
    with pytest.raises(VerificationFailed, match=r"new.tenants \[PKs: 2 "):
        m.run()


def test_an_update_that_changes_the_key_moves_the_row(spark, tmp_path):
    table = Table("t", "k", lambda: spark.createDataFrame([], ROW), TableStore(spark, f"file://{tmp_path}/t", schema(spark), "k", 1), db="d", source_name="before")
    raw = spark.createDataFrame([(1, "d", "before", "I", [(1, "a")]), (2, "d", "before", "U", [(1, "a"), (9, "a")])], f"position bigint, db string, table_name string, op string, rows array<struct<{ROW}>>")
    events = table.prepared(raw)
    assert rows(changes.apply_changes(spark.createDataFrame([], ROW), events, "k")) == [(9, "a")]
    wider = spark.createDataFrame([(1, "d", "before", "I", [(1, "a", 5)])], f"position bigint, db string, table_name string, op string, rows array<struct<{ROW}, more: int>>")
    with pytest.raises(catalog.SchemaError):
        table.prepared(wider)


def test_handlers_make_events_of_a_raw_log(spark, tmp_path):
    raw = spark.createDataFrame([(1, "rows", "I", 1), (2, "commit", "", 0)], "position bigint, event_type string, op string, k bigint")
    handlers = {"commit": lambda df: None, "rows": lambda df: df.select("position", "op", F.col("k").alias("key"), F.expr(f"cast(null as struct<{ROW}>)").alias("old"), F.struct("k", F.lit("x").alias("v")).alias("new"))}
    table = Table("t", "k", lambda: None, TableStore(spark, f"file://{tmp_path}/t", schema(spark), "k", 1), handlers=handlers)
    assert rows(changes.apply_changes(spark.createDataFrame([], ROW), table.prepared(raw), "k")) == [(1, "x")]
    table.handlers = {"nothing": lambda df: df}
    with pytest.raises(catalog.SchemaError, match="unknown event type"):
        table.prepared(raw)


def test_filters_are_what_they_say():
    assert isinstance(AllRows(), CopyFilter) and isinstance(TenantRows("t", 1), CopyFilter) and isinstance(JoinedRows("k", list, 1), CopyFilter)
    assert isinstance(StaticTableFilter(), TableFilter) and isinstance(ShardedTableFilter("d", "t"), TableFilter)


# --- catalog, metrics, errors ---


def test_foreign_keys_and_wide_primary_keys_are_refused(spark):
    listed = spark.createDataFrame([("d", "a", "c1", "FOREIGN KEY"), ("d", "a", "c1", "FOREIGN KEY"), ("d", "b", "p", "PRIMARY KEY"), ("e", "a", "c", "FOREIGN KEY")], "db string, table_name string, constraint_name string, constraint_type string")
    with pytest.raises(catalog.SchemaError, match=r"d\.a \(1\)$"):
        catalog.check_no_foreign_keys(listed, ["d"])
    catalog.check_no_foreign_keys(listed, ["other"])
    tables = spark.createDataFrame([("d", "a", "primary_key"), ("d", "b", "tenant")], "db string, table_name string, kind string")
    columns = lambda *names: spark.createDataFrame([("d", "a", n) for n in names], "db string, table_name string, column_name string")
    catalog.check_single_keys(columns("x"), tables)
    for bad in (columns("x", "y"), columns("x").where("false")):
        with pytest.raises(catalog.SchemaError, match=r"d\.a"):
            catalog.check_single_keys(bad, tables)


def test_bytes_of_a_table(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"file://{tmp_path}/t")
    want = sum(p.stat().st_size for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert catalog.sizes(spark, {"t": f"file://{tmp_path}/t"}).first()["bytes"] == want


def test_metrics_go_out_as_datagrams():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as listening:
        listening.bind(("127.0.0.1", 0))
        listening.settimeout(5)
        metrics = Metrics("run.", {"host": "a"})
        metrics.count("copied", 3, {"table": "t"})
        metrics.gauge("lag", 1.5)
        assert metrics.drain(StatsD(*listening.getsockname())) == 2
        assert [listening.recv(200).decode() for _ in range(2)] == ["run.copied:3|c|#host:a,table:t", "run.lag:1.5|g|#host:a"]


def test_errors_are_posted_once_with_the_state(spark, tmp_path):
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["Payload"]))
            self.send_response(200 if len(got) < 2 else 500)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    report = reporter(f"http://127.0.0.1:{server.server_port}/", {"run": "r"})
    m, _ = migration(spark, tmp_path, [(1, "a")], [(1, "damaged")], enforce=True, on_error=report)
    with pytest.raises(VerificationFailed):
        m.run()
    report("{}", ValueError())
    assert len(got) == 1 and got[0]["run"] == "r" and got[0]["error"].startswith("VerificationFailed") and got[0]["state"]["version"] == "2"
    with pytest.raises(Exception, match="500"):
        reporter(f"http://127.0.0.1:{server.server_port}/")("{}", ValueError())
    server.shutdown()


def test_a_lag_that_is_told(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    with_time = EVENTS + ", ts timestamp"
    spark.createDataFrame([(1, "I", 1, None, (1, "a"), datetime(2020, 1, 1))], with_time).write.parquet(log)
    m, _ = migration(spark, tmp_path, [(1, "a")], log=log, throttler=Throttler(lag=lambda: 0.0, most=1.0))
    m.log_schema = schema(spark, with_time)
    m.run()
    told = []
    m.metrics.drain(told.append)
    assert any(x.name == "lag" and x.value > 10**8 for x in told)


def test_settings_that_change_results_are_refused(spark):
    check_settings(spark)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            check_settings(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_standalone_copy_is_strict_and_needs_no_state(spark, tmp_path):
    m, target = migration(spark, tmp_path, [(1, "a"), (2, "b")], state=RunState(completed=["t"]))
    m.copy_standalone(["t"])
    assert rows(target.read()) == [(1, "a"), (2, "b")]
    target.update(spark.createDataFrame([(2,)], "k bigint"), lambda now: now.withColumn("v", F.lit("x")))
    with pytest.raises(VerificationFailed):
        m.copy_standalone(["t"])
