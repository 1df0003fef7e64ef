"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up code and files, then three times, of which the
median counts; ``calibration`` is that of a fixed job. The copy runs
are also given as rows a second, which is how the published speeds are given;
those were taken between two database servers, these between Parquet files.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "scan_keyset_page", "scan_batches", "max_keys", "tenant_select", "joined_table_select", "row_fingerprint", "table_checksum",
    "hash_diff_classified", "column_diff", "mismatch_message", "cdc_decode", "cdc_fold", "cdc_apply_to_table", "cdc_latest_image",
    "insert_ignore", "reverify_counts", "provenance_check", "batch_size_interpolation", "speed_window", "stream_apply", "migration_under_writes",
)


def copy_and_verify(spark, sf_dir: str, name: str, key: str) -> tuple[float, int]:
    """Seconds and rows of a copy of one table with verification of every row."""
    from pyspark.sql import types as T

    from tidemark.operators.migration import Migration, Table
    from tidemark.sources.store import TableStore

    source = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows, out = source.count(), f"file://{tempfile.mkdtemp(prefix='bench-')}"
    table = Table(name, key, lambda: source, TableStore(spark, f"{out}/{name}", source.schema, key))
    began = time.time()
    Migration(spark, [table], T.StructType(), f"{out}/run", enforce=True).copy()
    return time.time() - began, rows


def timed(run) -> float:
    began = time.time()
    run()
    return time.time() - began


def main() -> int:
    from tidemark import catalog
    from tidemark.session import build_session

    spark = build_session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    # a fixed job, of which rounds on unlike machines can be told apart
    fixed = lambda: spark.range(0, 20_000_000, 1, int(CPUS)).selectExpr("xxhash64(id) % 1000 AS k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    fixed()
    calibration = round(median(timed(fixed) for _ in range(3)), 3)
    for name in HEADLINE:
        run = lambda n=name: catalog.QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()
        took[name] = round(median(timed(run) for _ in range(3)), 3)
        print(name, took[name], file=sys.stderr)
    speed = {}
    for name, key in (("orders", "o_orderkey"), ("events", "event_id")):
        copy_and_verify(spark, SF_DIR, name, key)
        s, rows = sorted(copy_and_verify(spark, SF_DIR, name, key) for _ in range(3))[1]
        took[f"copy_verify_{name}"], speed[name] = round(s, 3), round(rows / s)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_s": speed, "calibration": calibration, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
