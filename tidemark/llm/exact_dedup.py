"""Exact dedup with a minimal perfect hash over the historical distinct digests.

History (rows delivered before) is reduced to its distinct text digests. They
are dealt into buckets by their first bytes, and every bucket gets a minimal
perfect hash: level by level, a digest takes the bit that its level hash names
if no other digest of the bucket wants it, else it moves on to the next level;
its slot is the rank of its bit. A slot holds the full 32-byte digest and the
locator of the winner. A fresh digest goes to its bucket's slot; only if all
32 bytes there are equal is it a repeat of history, otherwise it is a
nonmember, and nonmembers are grouped among themselves.

Only digests, ids and counts are shuffled, pre-aggregated by (digest, id) and
then by digest; what is found returns to the rows by way of ``joined_by_size``,
so a text that a third of all rows hold is no single task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joined_by_size, kept_rows, own_names, staged

#: Digests a bucket holds on average; a bucket's table takes about 60 bytes a digest.
BUCKET_KEYS = 20_000
#: Bits a level has for each digest that still looks for its slot.
GAMMA = 2.0
#: The sums of the level hashes differ in these odd multipliers.
_ODD = 0x9E3779B97F4A7C15
#: Stands for a null id inside the tasks; it loses to every id.
NO_ID = -(2**63)

INDEX_SCHEMA = "bucket int, sizes array<int>, bits binary, digests binary, winners array<bigint>, counts array<bigint>"


def normalised(text: Column) -> Column:
    """A-Z lower-cased; null counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Positions of the keys (n x 4 unsigned words of the digest) at a level."""
    x = keys[:, 1] ^ (keys[:, 2] * np.uint64((2 * level + 1) * _ODD % 2**64))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, the levels' bits, and every key's slot. Keys are distinct."""
    sizes, levels = [], []
    place = np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    while len(left):
        size = max(64, math.ceil(GAMMA * len(left)))
        at = _level_hash(keys[left], len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=bool)
        bits[at[alone]] = True
        place[left[alone]] = base + at[alone]
        sizes.append(size)
        levels.append(bits)
        left, base = left[~alone], base + size
    bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    rank = np.cumsum(bits) - 1
    return sizes, bits, rank[place] if len(keys) else place


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of every key, or -1. A key that was not built in may get any slot."""
    rank, slot = np.cumsum(bits) - 1, np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _level_hash(keys[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slot


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4) if len(digests) else np.zeros((0, 4), dtype="<u8")


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _words(pdf["digest"])
    sizes, bits, slot = build_mph(keys)
    order = np.argsort(slot)
    return pd.DataFrame({
        "bucket": [int(pdf["bucket"].iloc[0])], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
        "digests": [keys[order].tobytes()], "winners": [pdf["winner"].to_numpy()[order]], "counts": [pdf["n"].to_numpy()[order]],
    })


def _lookup_bucket(fresh: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"digest": fresh["digest"], "winner": fresh["winner"], "n": fresh["n"], "member": False})
    if len(fresh) and len(index):
        row, keys = index.iloc[0], _words(fresh["digest"])
        sizes = list(row["sizes"])
        slot = find_slots(keys, sizes, np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8))[: sum(sizes)].astype(bool))
        held = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
        member = (slot >= 0) & (held[np.maximum(slot, 0)] == keys).all(axis=1)
        out["member"] = member
    return out


def _deal(groups: DataFrame, buckets: int) -> DataFrame:
    """Buckets by the digest's first 28 bits."""
    return groups.withColumn("bucket", (F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("bigint") % buckets).cast("int"))


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of ``groups`` (digest, winner, n): the perfect hash, slots and locators."""
    return _deal(groups, buckets).groupBy("bucket").applyInPandas(_build_bucket, INDEX_SCHEMA)


def lookup(fresh: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """``fresh`` (digest, winner, n) with ``member``: its digest is in the index, byte for byte."""
    return (
        _deal(fresh, buckets).groupBy("bucket").cogroup(index.groupBy("bucket"))
        .applyInPandas(_lookup_bucket, "digest binary, winner bigint, n bigint, member boolean")
    )


def unpacked(index: DataFrame) -> DataFrame:
    """The slots of an index as rows: digest, winner, n."""

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                n = len(row.counts)
                yield pd.DataFrame({
                    "digest": [row.digests[32 * i : 32 * i + 32] for i in range(n)],
                    "winner": row.winners, "n": row.counts,
                })

    return index.select("digests", "winners", "counts").mapInPandas(slots, "digest binary, winner bigint, n bigint")


def exact_groups(copies: DataFrame, is_history: Column, buckets: int) -> DataFrame:
    """Groups of equal texts: digest, keep_id, group_size, ``repeats_history``.

    ``copies`` has digest, doc_id and n, a row for each (digest, doc_id). The
    largest id of history and fresh rows wins; nulls lose to every id.
    """
    by = lambda rows: rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("winner"), F.sum("n").alias("n"))
    index = build_index(by(copies.where(is_history)), buckets)
    found = lookup(by(copies.where(~is_history)), index, buckets)
    repeats = found.where("member").select("digest", "winner", "n", F.lit(0).alias("old"))
    held = unpacked(index).select("digest", "winner", "n", F.lit(1).alias("old"))
    known = held.unionByName(repeats).groupBy("digest").agg(
        F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"), (F.count("*") > 1).alias("repeats_history")
    )
    new = found.where("NOT member").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.lit(False).alias("repeats_history"))
    return known.unionByName(new).withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))


def exact_dedup(docs: DataFrame, history_to: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    ``history_to``: rows up to this id are history, the rest a fresh delivery;
    by default the middle of the id range. Null text counts as empty; a null
    doc_id loses to any other and is history. Of repeated rows (same id, same
    text) exactly one is kept. Very long texts are digests from the first step
    on. An empty table gives no rows. Other columns of
    ``docs`` are not read, whatever their names.
    """
    return decided(docs, history_to).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("same_id").cast("int")))).select(
        "doc_id", "digest", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")
    )


def decided(docs: DataFrame, history_to: int | None = None) -> DataFrame:
    """doc_id, digest, same_id (rows with both), keep_id and group_size."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text").cast("string")).alias("digest"))
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if history_to is None:
        history_to = (low + high) // 2 if low is not None else 0
    copies = staged(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "copies")  # texts are read once
    history = F.coalesce(F.col("doc_id") <= F.lit(history_to), F.lit(True))
    groups = staged(exact_groups(copies, history, max(1, n // BUCKET_KEYS)), "groups")
    return joined_by_size(copies.withColumnRenamed("n", "same_id"), groups, "digest", "group_size", n)


@own_names
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps; of a repeated row one."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    told = staged(decided(docs).select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id"), kept.alias("kept"), "same_id"), "decided")
    marked = docs.withColumn("__digest", digest(F.col("text").cast("string"))).withColumn("__id", F.col("doc_id").cast("bigint"))
    gone, again = told.where("NOT kept").select("__digest", "__id"), told.where("kept AND same_id > 1").select("__digest", "__id")
    return kept_rows(marked, ["__digest", "__id"], gone, again).drop("__digest", "__id")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
