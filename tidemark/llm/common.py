"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Rows of a file of a staged table whose size is known.
ROWS_A_FILE = 250_000


def staged(df: DataFrame, name: str = "stage", rows: int | None = None) -> DataFrame:
    """Cut ``df``'s lineage: write it as Parquet in the shared folder and read it back.

    ``rows``: about how many there are at most, if that is known, so that a few
    rows are not written as many files. The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(-(-rows // ROWS_A_FILE) or 1)
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more, and the shuffle files of finished jobs."""
    for df in tables:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that no table needs: Spark deletes them when the driver's JVM has collected what refers to them."""
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


#: Keys that are broadcast at most, as they each have this share of all rows or more.
HOT_KEYS = 10_000


def joined_by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key, ``size``: its rows, ``total``: of all) on ``key``, however many rows a key has.

    Keys with a ten-thousandth of all rows or more, of which there are at most
    HOT_KEYS, are broadcast; only the rest of the rows is shuffled by key.
    ``groups`` is read twice, or three times without ``total``: give a staged table.
    """
    least = F.lit((groups.agg(F.sum(size)).first()[0] or 0 if total is None else total) / HOT_KEYS)
    hot = groups.where(F.col(size) >= least).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(groups.where(F.col(size) < least), key)
    return marked.where("__hot").drop("__hot").unionByName(rest)


#: Keys of rows to leave out that are broadcast at most; of more, the rows are shuffled to them.
FEW_KEYS = 1_000_000


def kept_rows(marked: DataFrame, keys: list[str], gone: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of ``marked`` whose ``keys`` (nulls too) are not in ``gone``, and one of those with the same keys in ``again``.

    ``gone`` and ``again``, staged tables of the keys, are told from the rest
    by a broadcast as long as they are few, so that texts are not shuffled.
    """
    n, repeated = gone.count(), again.count()
    known = lambda df: F.broadcast(df.toDF(*(f"__of_{k}" for k in keys))) if n + repeated <= FEW_KEYS else df.toDF(*(f"__of_{k}" for k in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    rest = marked.join(known(gone.unionByName(again)), same, "left_anti") if n + repeated else marked
    if not repeated:
        return rest
    return rest.unionByName(marked.join(known(again), same, "left_semi").dropDuplicates(keys))


#: The columns of documents that operators read by name.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def own_names(stage: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A stage that returns the columns of what it gets: while it runs, those it does not read have names that clash with none of its own."""

    @wraps(stage)
    def run(docs: DataFrame) -> DataFrame:
        plain = docs.toDF(*(c if c in READ else f"other_{i}" for i, c in enumerate(docs.columns)))
        return stage(plain).select(*plain.columns).toDF(*docs.columns)

    return run


#: Texts in an Arrow batch at most.
TEXTS_A_BATCH = 1000


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts go to Python in small batches: ten thousand long texts at once would be much memory."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXTS_A_BATCH:
        conf.set(name, str(TEXTS_A_BATCH))
    return docs


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` holds pairs of bigint nodes. Returns one row per node that has
    an edge to another: ``node``, ``label`` (the smallest node it reaches).
    Each round is a minimum by node and a join on the node, written to the
    shared folder; stars shrink paths by at least half, so the rounds grow
    with the logarithm of the longest chain. Empty edges give an empty table.
    """
    now = staged(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while True:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u (larger) and its smaller neighbours go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = staged(small, "edges", 2 * mark[0])  # stars have no more edges than there were
        seen = _mark(after)
        discard(now)
        now = after
        if seen == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        mark = seen


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of edges that does not depend on their order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
