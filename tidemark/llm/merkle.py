"""Merkle manifest of a dataset: a root that stands for every row, and a proof for each.

Each row is a leaf. The leaves of a language form a tree in the order of ids,
its root is the language's subroot, and the subroots form the tree of the whole
dataset. A node is the SHA-256 of its children's digests, ``FANOUT`` of them at
most, as hex text one after another.

Levels are DataFrames: nodes are numbered within their tree, the number divided
by the fanout names the parent, and a parent's children are one sorted array of
at most ``FANOUT`` digests. So no task sees more of a tree than one run, however
many rows a language has. Proofs go down the same levels: a run meets the path
of its parent once and hands it, with the siblings, to each of its children.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, staged

FANOUT = 8
#: Fixed value: the columns of a row that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a tree of one tree's roots has as its name.
_ALL = "all"


def framed(value: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that neighbours can't run together; a null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*(framed(v) for v in values)), 256)


def _numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` (tree, digest, item) with ``i``, each one's number in its tree, and ``n``, the tree's nodes.

    Rows are sorted in ranges of tree and order; a number is the place in the
    range, less the tree's first there, plus what the tree has in ranges before.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartitionByRange(parts, F.col("tree"), *order).sortWithinPartitions(F.col("tree"), *order)
    at = dealt.withColumn("at", F.monotonically_increasing_id())  # the partition's number in the upper bits, the place in it below
    at = staged(at.withColumn("part", F.shiftright("at", 33)), "ranges")
    spans = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("tree", "part", "first", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return at.join(spans, ["tree", "part"]).select("tree", "n", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "digest", "item")


def _digest(kids: Column) -> Column:
    return F.sha2(F.concat_ws("", kids), 256)


class Trees:
    """Trees over ``nodes``: ``tree`` (its name), ``digest`` and ``item`` (any struct), in ``order``.

    ``runs[k]`` holds the runs of level k: tree, n, number of the parent, and the
    children's digests in order; those of level 0 their items too. ``roots`` has
    tree and root. A tree of one node has no run.
    """

    def __init__(self, nodes: DataFrame, order: list[Column], fanout: int = FANOUT):
        self.fanout, self.leaves = fanout, staged(_numbered(nodes, order), "nodes")
        most = self.leaves.agg(F.max("n")).first()[0] or 0
        level, width, self.runs = self.leaves, 1, []
        done = [level.where("n = 1").select("tree", F.col("digest").alias("root"))]
        while width < most:  # a level holds ceil(n / width) nodes of a tree of n
            kid = F.struct("i", "digest", *(["item"] if width == 1 else []))
            grouped = level.where(F.col("n") > width).groupBy("tree", "n", F.floor(F.col("i") / fanout).cast("bigint").alias("parent"))
            self.runs.append(staged(grouped.agg(F.array_sort(F.collect_list(kid)).alias("kids")), "runs"))
            level = self.runs[-1].select("tree", "n", F.col("parent").alias("i"), _digest(F.col("kids.digest")).alias("digest"))
            width *= fanout
            done.append(level.where((F.col("n") <= width) & (F.col("n") > width // fanout)).select("tree", F.col("digest").alias("root")))
        self.roots = done[0]
        for more in done[1:]:
            self.roots = self.roots.unionByName(more)

    def proofs(self, above: DataFrame) -> DataFrame:
        """digest, item, path and given of each leaf; path: (left, right) siblings as text, from its run up to the last root.

        ``above``: tree, the path from its root on, and ``given``, which each of its leaves gets.
        """
        tops = self.leaves.where("i = 0").select("tree", "n").join(above, "tree")
        width = self.fanout ** len(self.runs)
        first = F.lit(0).cast("bigint").alias("i")
        down = tops.where(F.col("n") > width // self.fanout).select("tree", first, "path", "given")
        for k in range(len(self.runs) - 1, -1, -1):
            width //= self.fanout
            met = self.runs[k].join(down.withColumnRenamed("i", "parent"), ["tree", "parent"])
            kid = met.select("tree", "path", "given", F.col("kids.digest").alias("digests"), F.posexplode("kids").alias("at", "kid"))
            left = F.concat_ws("", F.slice("digests", F.lit(1), F.col("at")))
            right = F.concat_ws("", F.slice("digests", F.col("at") + 2, F.lit(self.fanout)))
            longer = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path")).alias("path")
            if k == 0:
                return self._alone(above).unionByName(kid.select("kid.digest", "kid.item", longer, "given"))
            # trees whose root is of this level begin their way down here
            ended = tops.where((F.col("n") <= width) & (F.col("n") > width // self.fanout)).select("tree", first, "path", "given")
            down = kid.select("tree", "kid.i", longer, "given").unionByName(ended)
        return self._alone(above)

    def _alone(self, above: DataFrame) -> DataFrame:
        return self.leaves.where("n = 1").join(above, "tree").select("digest", "item", "path", "given")


def _no_path() -> Column:
    return F.array().cast("array<struct<left: string, right: string>>")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def manifest(docs: DataFrame, tampered: Callable[[], Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``proof_sha256`` is the digest of all siblings from leaf to root, left to
    right. ``tampered`` is the text as someone else shows it (default: as it
    is); ``folded_root`` is what that row and the siblings of the untampered
    one give, and ``verified`` says whether it is the root.

    Nulls are values of their own; rows without a language are a tree, the
    first; rows without an id come first in theirs. Repeated rows are leaves of
    their own, next to each other: rows of one id are ordered by their leaves.
    A lone leaf is its subroot, a lone subroot the root, and without siblings
    the proof is the digest of nothing. An empty table gives no rows; other
    columns are not read.
    """
    own = docs.select(*FIELDS)
    shown = tampered() if tampered else F.col("text")
    cells = [F.col(c) for c in FIELDS]
    # 'n' for no language sorts before 'v' and the language itself
    tree = F.when(F.col("lang").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("lang").cast("string")))
    leaves = own.select(tree.alias("tree"), leaf_of(*cells).alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"), "lang", leaf_of(*cells[:-1], shown).alias("shown"), F.monotonically_increasing_id().alias("row"))
    leaves = staged(leaves.select("tree", "digest", F.struct("doc_id", "lang", "shown", "row").alias("item")), "leaves")
    langs = Trees(leaves, [F.col("item.doc_id").asc_nulls_first(), F.col("digest"), F.col("item.row")], fanout)
    subroots = staged(langs.roots, "subroots")
    whole = Trees(subroots.select(F.lit(_ALL).alias("tree"), F.col("root").alias("digest"), F.struct(F.col("tree").alias("name")).alias("item")), [F.col("item.name")], fanout)
    upper = whole.proofs(whole.roots.select("tree", _no_path().alias("path"), F.struct("root").alias("given")))
    above = staged(upper.select(F.col("item.name").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), "given.root").alias("given")), "above")
    found = langs.proofs(above)
    siblings = F.concat_ws("", F.transform("path", lambda p: F.concat(p["left"], p["right"])))
    out = found.select(
        "item.doc_id", "item.lang", F.col("digest").alias("leaf"), "given.subroot", "given.root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("item.shown"), F.col("path")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def third_lowered() -> Column:
    """The text with A-Z lower-cased in rows whose id's CRC-32 three divides; a null id's is as it was."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), third_lowered)
