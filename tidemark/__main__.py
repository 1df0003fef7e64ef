"""``python -m tidemark``: copy the tables of one folder of Parquet files into stores, move one tenant, or compare.

    python -m tidemark copy --source DIR --target DIR --table name:key [...] [--dry-run] [--state FILE] [--batch-rows N]
    python -m tidemark move --source DIR --target DIR --tenant COLUMN=VALUE --table name:key [...]
                            [--joined name:key:link_table:join_column] [--keyed name:key]
    python -m tidemark diff --source DIR --target DIR --table name:key [...]

``name:key:new_name`` copies a table under another name. A run that fails or is
interrupted writes its state to ``--dump FILE`` (or prints it); ``--state`` goes on from there.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import types as T

from .operators import diff
from .operators.migration import Migration, Table, tenant_tables
from .operators.selection import JoinTable
from .operators.verifiers import ChecksumVerifier, ColumnVerifier, InlineVerifier, IterativeVerifier, NoVerifier
from .session import build_session, check_settings
from .sources.catalog import bytes_of
from .sources.store import StoreGroup, TableStore
from .state import RunState

VERIFIERS = {"inline": InlineVerifier, "iterative": IterativeVerifier, "checksum": ChecksumVerifier, "columns": ColumnVerifier, "none": NoVerifier}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("what", choices=["copy", "move", "diff"])
    parser.add_argument("--source", required=True)
    parser.add_argument("--target", required=True)
    parser.add_argument("--table", action="append", default=[], help="name:key or name:key:new_name")
    parser.add_argument("--tenant", help="column=value, of a move")
    parser.add_argument("--joined", action="append", default=[], help="name:key:link_table:join_column")
    parser.add_argument("--keyed", action="append", default=[], help="name:key of a table that the tenant keys")
    parser.add_argument("--log", help="a folder with the raw row events (position, db, table_name, op, rows) of all tables; their targets then change together")
    parser.add_argument("--db", default="", help="the database of the log whose events are the tables'")
    parser.add_argument("--group", help="a name: tables change at once, and are read through the group of that name")
    parser.add_argument("--buckets", type=int, help="a fixed number of buckets; else by size")
    parser.add_argument("--batch-rows", type=int)
    parser.add_argument("--verifier", choices=sorted(VERIFIERS), default="inline")
    parser.add_argument("--enforce", action="store_true", help="fail as soon as a copied row differs")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--state", help="a file with the state to resume from")
    parser.add_argument("--dump", help="a file for the state of a run that fails")
    return parser


def main(args: list[str]) -> int:
    options = _parser().parse_args(args)
    spark = build_session()
    check_settings(spark)

    def made(named: str) -> Table:
        name, key, new_name = (*named.split(":"), None)[:3]
        path = f"{options.source}/{name}.parquet"
        schema, new_name = spark.read.parquet(path).schema, new_name or name
        store = TableStore(spark, f"{options.target}/{new_name}", schema, key, options.buckets)
        schema_of_log = spark.read.parquet(options.log).schema if options.log else None
        return Table(new_name, key, lambda: spark.read.parquet(path), store, rows_about=bytes_of(spark, path), source_name=name, source_db=options.db, log=options.log, log_schema=schema_of_log)

    tables = [made(x) for x in options.table]
    if options.what == "move":
        column, text = options.tenant.split("=", 1)
        value = int(text) if text.lstrip("-").isdigit() else text

        def linked(named: str):
            name, key, link, join_column = named.split(":")
            return made(f"{name}:{key}"), lambda: [JoinTable(spark.read.parquet(f"{options.source}/{link}.parquet"), column, join_column)]

        tables = tenant_tables(column, value, tables, [linked(x) for x in options.joined], [made(x) for x in options.keyed])
    if options.group:
        StoreGroup(spark, f"{options.target}/{options.group}", {t.name: t.target for t in tables})
    if options.dry_run:
        for t in tables:
            print(f"{t.name}: key {t.key}, {t.rows().count()} rows")
        return 0
    if options.what in ("copy", "move"):
        state = RunState.loads(open(options.state).read()) if options.state else RunState()

        def dump(text: str, error: BaseException) -> None:
            if options.dump:
                with open(options.dump, "w") as f:
                    f.write(text)
            else:
                print(text)

        run = Migration(
            spark, tables, T.StructType(), f"{options.target}/_run", state=state, on_error=dump, enforce=options.enforce,
            batch_rows=options.batch_rows, verifier=VERIFIERS[options.verifier](),
        )
        run.stop_on()
        print(run.run().dumps())
        return 0
    bad = 0
    for t in tables:
        found = diff.classified(t.source(), t.target.read(), t.key)
        n = found.count()
        print(f"{t.name}: {n} rows differ")
        found.show(20, truncate=False)
        bad += n
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
