"""A table of Parquet files that is changed by key.

The rows lie in a base: files of neighbouring keys, sorted, each with the range
of its keys in the manifest, so that a read of a range of keys or of a set of
keys opens only the files that may hold them. Rows whose range the table does
not touch yet become files of the base. Any other change writes what it makes of
its keys beside the base, as a delta: the rows that are there now and the keys
that are gone. Readers take the newest of each key.

Deltas have levels: as many as ``FAN`` of one level are merged into one of the
next, and neighbouring small files of the base likewise, so that a row is
written again as often as the logarithm of the number of changes. Only when
deltas have grown to a share of the base is all written anew as a base.

A manifest names the files; it appears by a rename, so readers see all of a
change or nothing. It also holds how far each log has been applied, so that what
is delivered again is not applied again. Stores of a ``StoreGroup`` change
together: their manifests count only once the group's names them.
"""

from __future__ import annotations

import json
import threading
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_text, key_value
from ..scratch import release

#: Rows of a file of the base, deltas or small files of one level that are merged, and the share of the base's rows that deltas may hold.
ROWS_A_BUCKET, FAN, DELTA_SHARE = 1_000_000, 8, 0.25
#: Versions whose files stay when others are deleted, for those who still read them.
KEPT_VERSIONS = 20
#: Files from which on a change looks up which of them its keys fall into.
PRUNED_FROM = 16

EMPTY = {"version": 0, "base": None, "buckets": 0, "rows": 0, "files": [], "deltas": [], "batches": {}}


def orderly(kind: T.DataType) -> Callable[[str], object] | None:
    """What makes a key's text a value that Python orders as Spark orders the keys; None for types without one."""
    if isinstance(kind, T.IntegralType | T.DecimalType):
        return Decimal
    if isinstance(kind, T.StringType):
        return str.encode
    return bytes.fromhex if isinstance(kind, T.BinaryType) else None


class Files:
    """Small files on whatever Spark writes to: listed, read, made by a rename, deleted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        folder, fs = self.at(path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def load(self, path: str) -> dict:
        at, fs = self.at(path)
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def make(self, path: str, what: dict) -> bool:
        """The file with all that is in it, or False if there is one."""
        tmp, fs = self.at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()
        final, _ = self.at(path)
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            return False
        return True

    def delete(self, path: str) -> None:
        at, fs = self.at(path)
        fs.delete(at, True)


class TableStore:
    """``path`` holds the data and the manifests; works on any file system Spark writes to.

    ``buckets``: a fixed number of the base's files, or None for one by size.
    Keys may have any type that Spark orders; a null key is a key like any
    other in a base, and can't be changed. Ranges of keys are kept for numbers,
    text and bytes; files of other keys are always read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int | None = None):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self.kind, self._order, self.files = schema[key].dataType, orderly(schema[key].dataType), Files(spark)
        self.group: StoreGroup | None = None
        self.member = ""
        self.rows_written, self._loaded = 0, None
        self._writing = threading.RLock()  # threads of one run take turns; another run's change is an error

    # --- manifests ---

    def _manifests(self) -> list[str]:
        names = sorted(n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json"))
        return names if self.group is None else self.group.published(self.member, names)

    def manifest(self, name: str | None = None) -> dict:
        """The newest manifest: version, base, its files (path, rows, low, high, level) and rows, deltas (level, rows, files), how far each log is applied."""
        name = name or (next(iter(self._manifests()[::-1]), None) if self.group is None else self.group.current(self.member))
        return dict(EMPTY) if name is None else self.files.load(f"{self.path}/manifests/{name}")

    def _publish(self, manifest: dict) -> None:
        manifest |= {"buckets": len(manifest["files"]), "rows": sum(f[1] for f in manifest["files"])}
        mark = "" if self.group is None else f"-{uuid.uuid4().hex}"
        name = f"{manifest['version']:012d}{mark}.json"
        if not self.files.make(f"{self.path}/manifests/{name}", manifest):
            raise RuntimeError(f"another writer has published version {manifest['version']} of {self.path}")
        if self.group is not None:
            self.group.changed(self.member, name)
        if manifest["version"] % KEPT_VERSIONS == 0:
            self.vacuum()
        release(self.spark)  # a run makes change after change in one driver

    # --- reading ---

    def _delta_schema(self) -> T.StructType:
        return T.StructType([T.StructField(self.key, self.kind), T.StructField("__gone", T.BooleanType()), T.StructField("__version", T.LongType()), T.StructField("__row", self.schema)])

    def _within(self, files: list, low: str | None, high: str | None) -> list:
        """The files that may hold keys after ``low`` up to ``high``."""
        if self._order is None:
            return files
        after, upto = (None if x is None else self._order(x) for x in (low, high))
        out = []
        for f in files:
            first, last = (None if x is None else self._order(x) for x in f[2:4])
            if first is None or not ((after is not None and last <= after) or (upto is not None and first > upto)):
                out.append(f)
        return out

    def range_filter(self, df: DataFrame, low: str | None, high: str | None) -> DataFrame:
        """Rows whose key lies after ``low`` up to ``high`` (texts of keys; None: no bound)."""
        if low is not None:
            df = df.where(F.col(self.key) > key_value(F.lit(low), self.kind))
        return df if high is None else df.where(F.col(self.key) <= key_value(F.lit(high), self.kind))

    def _full(self, paths: list) -> list[str]:
        return [f"{self.path}/{f[0]}" for f in paths]

    def _newest(self, files: list) -> DataFrame:
        """Key, __gone, __version and __row of every key that some deltas hold."""
        deltas = self.spark.read.schema(self._delta_schema()).parquet(*self._full(files))
        last = F.max_by(F.struct("__gone", "__row"), "__version").alias("last")
        return deltas.groupBy(self.key).agg(last, F.max("__version").alias("__version")).select(self.key, "last.__gone", "__version", "last.__row")

    def _read(self, now: dict, files: list | None = None, keys: DataFrame | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
        """The table of a manifest: of some of the base's files, of some keys, of a range of keys."""
        of = (lambda df: df) if keys is None else (lambda df: df.join(keys, self.key, "left_semi"))
        found = self._within(now["files"] if files is None else files, low, high)
        base = self.spark.read.schema(self.schema).parquet(*self._full(found)) if found else self.spark.createDataFrame([], self.schema)
        base = of(self.range_filter(base, low, high))
        over = self._within([f for d in now["deltas"] for f in d["files"]], low, high)
        if not over:
            return base
        newest = of(self.range_filter(self._newest(over), low, high))
        return base.join(newest.select(self.key), self.key, "left_anti").unionByName(newest.where("NOT __gone").select("__row.*"))

    def read(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """The table as it is now; of keys after ``low`` up to ``high`` only, if they are given as text."""
        return self._read(self.manifest(), low=low, high=high)

    def files_of(self, low: str | None = None, high: str | None = None) -> list[str]:
        """The files that a read of a range of keys opens."""
        now = self.manifest()
        return self._full(self._within([*now["files"], *(f for d in now["deltas"] for f in d["files"])], low, high))

    def applied(self, log: str) -> int:
        """How far a log has been applied; -1 if not at all."""
        return self.manifest()["batches"].get(log, -1)

    # --- writing ---

    def _written(self, rows: DataFrame, name: str, level: int) -> list:
        """Files of ``rows``, just written: path below the store's, rows, least and largest key as text, level."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        key = F.col(self.key)
        bounds = [key_text(f(key), self.kind) if self._order else F.lit(None).cast("string") for f in (F.min, F.max)]
        of = self.spark.read.schema(T.StructType([T.StructField(self.key, self.kind)])).parquet(f"{self.path}/{folder}").select(key, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
        found = of.groupBy("file").agg(F.count("*").alias("rows"), F.max("size").alias("size"), bounds[0].alias("low"), bounds[1].alias("high")).collect()  # a row for each file
        count = sum(r["rows"] for r in found)
        self.rows_written += count
        self._loaded = self._loaded or (count, sum(r["size"] for r in found))  # what a change writes first; merging comes after
        return [[f"{folder}/{r['file']}", r["rows"], r["low"], r["high"], level] for r in found]

    def _base_files(self, rows: DataFrame, count: int, version: int, level: int = 0) -> list:
        """Files of neighbouring keys, as many as ``count`` rows ask for."""
        n = self.buckets or max(1, -(-count // ROWS_A_BUCKET))
        dealt = rows.select(*self.schema.names)
        dealt = dealt.repartitionByRange(n, self.key) if n > 1 else dealt.coalesce(1)
        return self._written(dealt.sortWithinPartitions(self.key), f"base-{version}", level)

    def _ordered(self, files: list) -> list:
        return sorted(files, key=lambda f: (f[2] is not None, self._order(f[2]) if f[2] is not None else f[0])) if self._order else files

    def replace(self, rows: DataFrame, batches: dict[str, int] | None = None) -> None:
        """Put ``rows`` in the place of all that is there."""
        with self._writing:
            now = self.manifest()
            count = now["rows"] + sum(d["rows"] for d in now["deltas"])
            if not (self.buckets or count):
                count = rows.count()
            self._replaced(now, rows, count, batches or {})

    def _replaced(self, now: dict, rows: DataFrame, count: int, batches: dict[str, int]) -> None:
        version = now["version"] + 1
        files = self._ordered(self._base_files(rows, count, version))
        self._publish({"version": version, "base": f"base-{version}", "files": files, "deltas": [], "batches": now["batches"] | batches})

    def compact(self) -> None:
        """Write base and deltas anew as one base; files that no kept version names are deleted."""
        with self._writing:
            if self.manifest()["deltas"]:
                self.replace(self.read())
            self.vacuum()

    def vacuum(self, keep: int = KEPT_VERSIONS) -> int:
        """Delete the manifests before the last ``keep``, and the files that only those name, or none."""
        with self._writing:
            names = self._manifests()
            kept = names[-max(1, keep) :]
            held = [self.manifest(n) for n in kept]
            needed = {f[0].split("/", 1)[0] for m in held for f in [*m["files"], *(f for d in m["deltas"] for f in d["files"])]}
            for n in (n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json") and n not in kept and not (self.group and self.group.is_open(n))):
                self.files.delete(f"{self.path}/manifests/{n}")
            gone = [n for n in self.files.names(self.path) if n.startswith(("base-", "delta-")) and n not in needed]
            for n in gone:
                self.files.delete(f"{self.path}/{n}")
            return len(gone)

    def _delta(self, now: dict, rows: DataFrame, batches: dict[str, int]) -> None:
        """Publish a change; deltas of a level that are many become one of the next."""
        version = now["version"] + 1
        files = self._written(rows.withColumn("__version", F.lit(version).cast("bigint")).select(*self._delta_schema().names), f"delta-{version}", 0)
        count = sum(f[1] for f in files)
        deltas = [*now["deltas"], {"level": 0, "rows": count, "files": files}] if count else list(now["deltas"])
        if sum(d["rows"] for d in deltas) > max(ROWS_A_BUCKET, DELTA_SHARE * now["rows"]):
            whole = now | {"deltas": deltas}
            self._replaced(whole, self._read(whole), now["rows"] + sum(d["rows"] for d in deltas), batches)
            return
        level = 0
        while len(full := [d for d in deltas if d["level"] == level]) >= FAN:
            merged = self._newest([f for d in full for f in d["files"]]).select(*self._delta_schema().names)
            rows_in = sum(d["rows"] for d in full)
            n = max(1, -(-rows_in // ROWS_A_BUCKET))
            files = self._written((merged.repartitionByRange(n, self.key) if n > 1 else merged.coalesce(1)).sortWithinPartitions(self.key), f"delta-{version}", level + 1)
            level += 1
            deltas = [*(d for d in deltas if d["level"] != level - 1), {"level": level, "rows": sum(f[1] for f in files), "files": files}]
        self._publish(now | {"version": version, "deltas": deltas, "batches": now["batches"] | batches})

    def _appended(self, now: dict, rows: DataFrame, batches: dict[str, int]) -> None:
        """Publish rows of a range that nothing touches as files of the base; small neighbours of one level become one."""
        version = now["version"] + 1
        new = [f for f in self._written(rows.select(*self.schema.names).coalesce(1).sortWithinPartitions(self.key), f"base-{version}", 0) if f[1]]
        files = self._ordered([*now["files"], *new])
        k = 0
        while k + FAN <= len(files):
            some = files[k : k + FAN]
            if len({f[4] for f in some}) == 1 and sum(f[1] for f in some) <= ROWS_A_BUCKET:
                one = self._base_files(self.spark.read.schema(self.schema).parquet(*self._full(some)), 1, version, some[0][4] + 1) if not self.buckets else self._one_file(some, version)
                files[k : k + FAN], k = one, 0
            else:
                k += 1
        self._publish(now | {"version": version, "base": now["base"] or f"base-{version}", "files": files, "batches": now["batches"] | batches})

    def _one_file(self, some: list, version: int) -> list:
        rows = self.spark.read.schema(self.schema).parquet(*self._full(some)).coalesce(1).sortWithinPartitions(self.key)
        return self._written(rows, f"base-{version}", some[0][4] + 1)

    def insert(self, rows: DataFrame, low: str | None = None, high: str | None = None) -> tuple[int, int]:
        """Add the rows whose key is not there; of several with one key the least. Returns the rows added and their files' bytes.

        ``low``, ``high``: texts of keys, if all rows lie after the one up to
        the other; then only files of that range are read.
        """
        from ..operators.changes import insert_ignore

        with self._writing:
            now, self._loaded = self.manifest(), None
            held = [*now["files"], *(f for d in now["deltas"] for f in d["files"])]
            new = insert_ignore(self._read(now, low=low, high=high), rows.select(*self.schema.names), self.key)
            if not held and low is high is None:
                self.replace(new)
            elif self._order and high is not None and not self._within(held, low, high):
                self._appended(now, new, {})
            else:
                self._delta(now, new.select(self.key, F.lit(False).alias("__gone"), F.struct(*(f"`{c}`" for c in self.schema.names)).alias("__row")), {})
            return self._loaded

    def _touched(self, now: dict, keys: DataFrame) -> list | None:
        """The files of the base that may hold some keys; None: all. As many numbers come back as there are files, at most."""
        if self._order is None or len(now["files"]) < PRUNED_FROM:
            return None
        firsts = [self._order(f[2]) for f in now["files"] if f[2] is not None]
        loose = [f for f in now["files"] if f[2] is None]
        order, kind = self._order, self.kind

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                seen |= {bisect_right(firsts, order(t)) - 1 for t in batch.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["n"])

        found = {r["n"] for r in keys.select(key_text(F.col(self.key), kind).alias("t")).mapInArrow(find, "n int").distinct().collect()}
        ranged = [f for f in now["files"] if f[2] is not None]
        return [*loose, *(ranged[n] for n in sorted(found) if n >= 0)]

    def update(self, keys: DataFrame, fold: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Change the rows of ``keys``: ``fold`` gets those that are there and returns those that shall be there.

        Keys that it returns no row of are deleted. ``batch``: a log and how far
        it is applied with this; False if that was applied before.
        """
        with self._writing:
            now = self.manifest()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return False
            batches = {batch[0]: batch[1]} if batch else {}
            if not now["files"] and not now["deltas"]:
                self.replace(fold(self._read(now)), batches)
                return True
            wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
            after = fold(self._read(now, self._touched(now, wanted), wanted)).select(F.col(self.key), F.struct(*(f"`{c}`" for c in self.schema.names)).alias("__row"))
            self._delta(now, wanted.join(after, self.key, "left").select(self.key, F.col("__row").isNull().alias("__gone"), "__row"), batches)
            return True


class StoreGroup:
    """Several stores whose changes appear at once.

    What ``transaction`` encloses is prepared store by store - data and a
    manifest that no reader looks at - and published by one rename of the
    group's manifest, which names each store's. A writer that is lost in
    between leaves files that none names. A store's change outside of a
    transaction is one of its own. Stores of a group are read through it: each
    at the version that the group's newest manifest names.
    """

    def __init__(self, spark: SparkSession, path: str, stores: Mapping[str, TableStore]):
        self.path, self.stores, self.files = path, dict(stores), Files(spark)
        self._lock, self._open = threading.RLock(), None
        for name, store in self.stores.items():
            store.group, store.member, store._writing = self, name, self._lock

    def _names(self) -> list[str]:
        return sorted(n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, tables (the name of each store's manifest), batches (how far each log is applied): the newest, or that of a version."""
        names = self._names()
        if version is not None:
            names = [n for n in names if int(n[:12]) == version]
        return self.files.load(f"{self.path}/manifests/{names[-1]}") if names else {"version": 0, "tables": {}, "batches": {}}

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self._names()]

    def current(self, member: str) -> str | None:
        """A store's manifest: what an open transaction of this writer has prepared, or what is published."""
        with self._lock:
            if self._open is not None and member in self._open:
                return self._open[member]
        return self.manifest()["tables"].get(member)

    def published(self, member: str, names: list[str]) -> list[str]:
        """Those of a store's manifests up to the current one that the group's have named; others were left by lost writers."""
        known = {self.files.load(f"{self.path}/manifests/{n}")["tables"].get(member) for n in self._names()[-KEPT_VERSIONS:]} | {self.current(member)}
        return [n for n in names if n in known]

    def is_open(self, name: str) -> bool:
        return self._open is not None and name in self._open.values()

    def changed(self, member: str, name: str) -> None:
        with self._lock:
            if self._open is not None:
                self._open[member] = name
                return
            with self.transaction():
                self._open[member] = name

    @contextmanager
    def transaction(self, **positions: int):
        """Publish the changes made inside at once, with how far they apply each log; after an error none."""
        with self._lock:
            if self._open is not None:
                raise RuntimeError("a transaction is open already")
            self._open = {}
            try:
                yield self
                now = self.manifest()
                after = {"version": now["version"] + 1, "tables": now["tables"] | self._open, "batches": now["batches"] | positions}
                if not self.files.make(f"{self.path}/manifests/{after['version']:012d}.json", after):
                    raise RuntimeError(f"another writer has published version {after['version']} of {self.path}")
            finally:
                self._open = None

    def applied(self, log: str) -> int:
        return self.manifest()["batches"].get(log, -1)

    def read(self, member: str, version: int | None = None) -> DataFrame:
        """A store as it is, or as it was in a version that is still kept."""
        store, name = self.stores[member], self.manifest(version)["tables"].get(member)
        return store._read(store.manifest(name) if name else dict(EMPTY))
