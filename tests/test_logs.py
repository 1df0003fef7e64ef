"""Composite positions, sets of transaction ids, checksums by ranges of keys, keyed state."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions import positions
from tidemark.operators import diff, hash_tree
from tidemark.sources import change_log
from tidemark.sources.change_log import log_stream
from tidemark.streaming.apply import drain
from tidemark.streaming.counts import counted_changes


def rows(df):
    return sorted(map(tuple, df.collect()))


# --- positions ---


def test_positions_compare_by_file_number_and_offset(spark):
    texts = ["log.000009:500", "log.000010:4", "log.999999:8", "log.1000000:4", "log.1000000:77"]
    df = spark.createDataFrame([(t,) for t in random.Random(1).sample(texts, 5)], "t string")
    assert [r["t"] for r in df.orderBy(positions.at(F.col("t"))).collect()] == texts
    assert [r["t"] for r in df.orderBy(positions.scalar(positions.at(F.col("t")))).collect()] == texts
    back = df.select("t", positions.text_of(positions.at(F.col("t"))["file"], positions.at(F.col("t"))["offset"]).alias("b")).collect()
    assert all(r["t"] == r["b"] for r in back)
    assert {r["t"]: r["place"] for r in positions.places(df.unionAll(df), "t").collect()} == {t: i + 1 for i, t in enumerate(texts)}


def test_what_is_no_position_is_null_and_a_large_offset_an_error(spark):
    df = spark.createDataFrame([("nothing",), ("log.1",), (None,), (":4",)], "t string")
    assert all(r[0] is None for r in df.select(positions.at(F.col("t"))).collect())
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([("log.1:99999999999999",)], "t string").select(positions.scalar(positions.at(F.col("t")))).collect()


INTERVALS = "source string, first_id bigint, last_id bigint"


def ids_of(intervals):
    return {(s, i) for s, a, b in intervals for i in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(3))
def test_unions_of_transaction_sets_against_sets_of_ids(spark, monkeypatch, seed):
    monkeypatch.setattr(positions, "SPAN", 7)
    rng = random.Random(seed)
    some = lambda n: [(rng.choice("ab"), a := rng.randrange(60), a + rng.randrange(9)) for _ in range(n)]
    one, other = some(12), some(12)
    frames = [spark.createDataFrame(x, INTERVALS) for x in (one, other)]
    got = rows(positions.union(*frames))
    assert ids_of(got) == ids_of(one) | ids_of(other)
    assert all(not (s == t and b + 1 >= c > a) for s, a, b in got for t, c, _ in got if (s, a, b) != (t, c, _))  # as few as can be
    part = [(s, a, a) for s, a, _ in one]
    assert positions.contains(frames[0], spark.createDataFrame(part, INTERVALS))
    assert positions.contains(*frames) == (ids_of(other) <= ids_of(one))
    lacking = ids_of(rows(positions.missing(*frames)))
    assert (ids_of(other) - ids_of(one)) <= lacking <= ids_of(other)


def test_empty_sets(spark):
    none, one = spark.createDataFrame([], INTERVALS), spark.createDataFrame([("a", 1, 2)], INTERVALS)
    assert positions.union(none).isEmpty() and positions.contains(one, none) and not positions.contains(none, one)


# --- checksums by ranges ---


@pytest.mark.parametrize(("kind", "make"), [("bigint", lambda i: i * 3 - 50), ("string", lambda i: f"k{i:05d}"), ("binary", lambda i: i.to_bytes(4, "big")), ("double", lambda i: i / 7), ("date", None)])
def test_differences_by_ranges_are_those_of_whole_tables(spark, monkeypatch, kind, make):
    from datetime import date, timedelta

    monkeypatch.setattr(hash_tree, "FEW_ROWS", 5)
    monkeypatch.setattr(hash_tree, "FANOUT", 8)
    make = make or (lambda i: date(2024, 1, 1) + timedelta(i))
    source = [(make(i), f"v{i}") for i in range(600)]
    target = [(k, "changed" if i in (17, 18, 599) else v) for i, (k, v) in enumerate(source) if i not in (30, 31)] + [(make(1000), "more")]
    a, b = (spark.createDataFrame(x, f"k {kind}, v string").repartition(5) for x in (source, target))
    got, want = hash_tree.differences(a, b, "k"), diff.classified(a, b, "k")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 6
    assert hash_tree.differences(a, a, "k").isEmpty() and hash_tree.ranges(a, a, "k").isEmpty()
    found = hash_tree.ranges(a, b, "k").collect()
    if kind in ("bigint", "double"):
        assert found[0]["level"] > 1 and sum(r["source_rows"] for r in found) < 60


def test_ranges_of_empty_and_one_sided_tables(spark):
    none, one = spark.createDataFrame([], "k bigint, v string"), spark.createDataFrame([(7, "a")], "k bigint, v string")
    assert hash_tree.differences(none, none, "k").isEmpty()
    assert rows(hash_tree.differences(one, none, "k").select("k", "mismatch_type")) == [(7, diff.MISSING_ON_TARGET)]
    assert rows(hash_tree.differences(none, one, "k").select("k", "mismatch_type")) == [(7, diff.MISSING_ON_SOURCE)]


def test_ignored_columns_do_not_differ(spark):
    a, b = (spark.createDataFrame([(i, v, i) for i in range(50)], "k bigint, v string, w bigint") for v in "xy")
    assert hash_tree.differences(a, b, "k", ["v"]).isEmpty() and hash_tree.differences(a, b, "k").count() == 50


# --- ends of batches ---


def _files(path, events, files, rng):
    """A log of (position, resumable_position) in files that overlap."""
    dealt = [[] for _ in range(files)]
    for e in events:
        dealt[rng.randrange(files)].append(e)
    for i, some in enumerate(d for d in dealt if d):
        columns = [pa.array(c, pa.int64()) for c in zip(*some, strict=True)]
        pq.write_table(pa.table(columns, names=["position", "resumable_position"]), path / f"{i}.parquet", row_group_size=rng.randrange(1, 9))


@pytest.mark.parametrize("seed", range(40))
def test_ends_of_batches_are_those_of_all_positions_sorted(tmp_path, monkeypatch, seed):
    monkeypatch.setattr(change_log, "EVENTS_A_TASK", 3)
    rng = random.Random(seed)
    positions, end, events = sorted(rng.choices(range(60), k=rng.randrange(1, 50))), -1, []
    for p in dict.fromkeys(positions):
        end = p if rng.random() < rng.choice([0.1, 0.5, 1]) else end
        events += [(p, end)] * positions.count(p)
    rng.shuffle(events)
    _files(tmp_path, events, rng.choice([1, 3]), rng)
    folder = change_log.LogFolder(f"file://{tmp_path}")
    for last in range(-1, 60, 7):
        for most in (1, 2, 5, 17, 60):
            after = [e for e in events if e[0] > last]
            ends = sorted({p for p, r in after if p == r})
            fit = [p for p in ends if sum(q <= p for q, _ in after) <= most]
            position, file = folder.next_end(last, most)
            assert position == (fit[-1] if fit else ends[0] if ends else last)
            assert not ends or position in pq.read_table(tmp_path / file)["position"].to_pylist()


def test_a_batch_is_planned_in_memory_for_its_events_however_files_overlap(tmp_path, monkeypatch):
    monkeypatch.setattr(change_log, "EVENTS_A_TASK", 10_000)
    for i in range(20):
        position = pa.array(np.arange(100_000) * 20 + i)
        pq.write_table(pa.table([position, position], names=["position", "resumable_position"]), tmp_path / f"{'x' * 60}{i}.parquet")
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    before = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        assert change_log.LogFolder(f"file://{tmp_path}").next_end(999, 1000)[0] == 1999
        held = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
    assert held < 20e6  # all positions are 16 MB, with their files' names 150


def test_delivered_logs_lie_in_the_order_of_positions(spark, tmp_path):
    from tidemark.plans import runs

    log = spark.range(3000).selectExpr("id AS position", "id % 7 AS key").repartition(4, "key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parted = runs._parted(log, f"file://{tmp_path}/parts")
        for part in range(runs.PARTS):
            runs._deliver(log, parted, f"file://{tmp_path}/log", part)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    units = change_log.LogFolder(f"file://{tmp_path}/log").units()
    assert sum(u.rows for u in units) == 3000 and len(units) > runs.PARTS
    assert all(a.high < b.low for a, b in zip(units, units[1:], strict=False))  # so a batch reads its own row groups only


# --- keyed state ---

EVENTS = "position bigint, key string"


def _log(spark, path, first, keys):
    spark.createDataFrame([(first + i, k) for i, k in enumerate(keys)], EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_counts_by_key_survive_a_restart(spark, tmp_path):
    path, got = f"file://{tmp_path}/log", {}
    keep = lambda batch, n: got.update({r["key"]: r["changes"] for r in batch.collect()})
    schema = spark.createDataFrame([], EVENTS).schema
    for first, keys in ((0, "aab"), (10, "acc")):
        _log(spark, path, first, keys)
        drain(counted_changes(log_stream(spark, path, schema, after=first - 1)), keep, f"file://{tmp_path}/cp", mode="update")
    assert got == {"a": 3, "b": 1, "c": 2}


def test_a_quiet_key_is_told_again_and_forgotten(spark, tmp_path):
    path, told = f"file://{tmp_path}/log", []
    _log(spark, path, 0, "aa")
    schema = spark.createDataFrame([], EVENTS).schema
    stream = counted_changes(log_stream(spark, path, schema), again_ms=1000)
    query = stream.writeStream.foreachBatch(lambda batch, n: told.extend((r["key"], r["changes"]) for r in batch.collect())).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    end = time.monotonic() + 60
    while len(told) < 2 and time.monotonic() < end:
        time.sleep(0.2)
    query.stop()
    assert told == [("a", 2), ("a", 2)]
