"""Suffix-array dedup: bytes covered by a 400-byte string that starts elsewhere too.

Equal strings must meet before a suffix array can see them. Each 400-byte
string is named by the smallest hash of its 32-byte substrings; equal strings
have equal names. Neighbouring starts mostly share a name, so a text falls
into runs of starts, one row each, and a run's *segment* is the bytes its
strings cover.

- A segment that occurs twice is repeated as a whole, by its hash alone.
- A name with one segment, once, is not repeated; nor are most runs.
- Two places that share 400 bytes around a substring share at least 184 on one
  side of it. So a segment whose bytes beside the substring, left and right, no
  other segment of its name has is not repeated either.
- The rest - names with several such segments, and segments in which the name's
  substring occurs twice - goes to shards by name. A shard sorts all
  suffixes of its segments by Larsson-Sadakane refinement, takes common
  prefixes by Kasai's method, and marks starts with a neighbour of 400 equal
  bytes.
- A name with more bytes than a shard holds is refined: its segments are grouped
  by those bytes beside the substring, left and right, and what only shares a
  frequent short passage falls apart here.
- A group that still is larger than a shard is split over several. Each of its
  shards hands on its different strings as sorted digests, one row a range of
  them, however often a string occurs; ranges are merged across shards by binary
  search, and what repeats goes back to the shards that hold it.

Texts are shuffled by (id, hash), so copies of one text spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_batches

#: Bytes of a repeated string, and of the substrings whose smallest hash names it.
LENGTH, GRAM = 400, 32
#: Segment bytes a shard holds on average.
SHARD_BYTES = 1 << 21
#: Digests merged in one range.
MERGE_ROWS = 200_000
NO_ID = -(2**63)
_BASE, _ODD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of every 32-byte substring: a polynomial built up by doubling, then mixed."""
    h = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    n, base = 1, _BASE
    while n < GRAM:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % 2**64, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(_ODD)
    h ^= h >> np.uint64(32)
    return h


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


#: Bytes that two equal strings share beside the substring that names them, on one side at least.
SIDE = (LENGTH - GRAM) // 2


def runs(data: bytes) -> list[tuple[int, int, int, int, bool, list[int]]]:
    """(first start, last start, name, segment hash, name occurs again in the segment, hashes of its sides) by run of starts."""
    if len(data) < LENGTH:
        return []
    h = gram_hashes(data)
    width = LENGTH - GRAM + 1
    names = window_min(h, width)
    cut = np.flatnonzero(names[1:] != names[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut - 1, len(names) - 1]
    view, signed = memoryview(data), names.view(np.int64)
    out = []
    for s, e in zip(first.tolist(), last.tolist(), strict=True):
        seg = xxhash.xxh3_64_intdigest(view[s : e + LENGTH])
        places = (np.flatnonzero(h[s : e + width] == names[s]) + s).tolist()
        sides = {xxhash.xxh3_64_intdigest(view[a - SIDE : a + GRAM], 1) for a in places if a >= SIDE}
        sides |= {xxhash.xxh3_64_intdigest(view[a : a + GRAM + SIDE], 2) for a in places if a + GRAM + SIDE <= len(data)}
        out.append((s, e, int(signed[s]), seg - (seg >> 63 << 64), len(places) > 1, [x - (x >> 63 << 64) for x in sides]))
    return out


# --- one shard -------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (small non-negative numbers under 512) sorted by their suffixes.

    Suffixes are grouped by 7 packed symbols, then groups of several are split
    by the ranks of the suffixes that follow, the known length doubling each
    time, until all stand alone; those that do are not touched again. The order
    must be whole: common prefixes rest on it.
    """
    n = len(text)
    padded = np.r_[text.astype(np.int64), np.zeros(8, dtype=np.int64)]
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = key << 9 | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    new = np.r_[True, key[sa][1:] != key[sa][:-1]] if n else np.zeros(0, dtype=bool)
    slots = np.arange(n)
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, slots, 0)) + 1 if n else 0
    known = 7
    while True:
        alone = new & np.r_[new[1:], True]
        keep = ~alone
        if not keep.any():
            return sa
        slots, pos = slots[keep], sa[slots[keep]]
        second = rank[np.minimum(pos + known, n)]
        both = rank[pos] * (n + 2) + second
        order = np.argsort(both, kind="stable")
        pos, both = pos[order], both[order]
        sa[slots] = pos
        new = np.r_[True, both[1:] != both[:-1]]
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        known *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For each position, its common prefix with its predecessor in ``sa``, up to ``most``.

    Kasai: in text order a prefix is shorter than the one before by one at
    most. Segments are independent, so all take their steps at once: step j
    is position starts + j of each segment with more than j starts.
    """
    before = np.full(len(text), -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.r_[text, np.full(most + 1, -1, dtype=text.dtype)]
    other = np.r_[text, np.full(most + 1, -2, dtype=text.dtype)]
    out = np.zeros(len(text), dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    length = np.zeros(len(starts), dtype=np.int64)
    live = len(starts)
    for j in range(int(counts.max(initial=0))):
        while counts[live - 1] <= j:
            live -= 1
        pos = starts[:live] + j
        prev = before[pos]
        now = np.where(prev < 0, 0, np.maximum(length[:live] - 1, 0))
        at = np.flatnonzero((prev >= 0) & (now < most))
        while len(at):
            at = at[padded[pos[at] + now[at]] == other[prev[at] + now[at]]]
            now[at] += 1
            at = at[now[at] < most]
        length[:live] = now
        out[pos] = now
    return out


def repeated_starts(segments: list[bytes]) -> list[np.ndarray]:
    """For each of several different segments, which of its 400-byte strings start elsewhere in them too."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    text = np.zeros(int(sizes.sum()) + len(segments), dtype=np.int16)
    for at, s in zip(starts.tolist(), segments, strict=True):
        text[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8).astype(np.int16) + 1
    counts = sizes - LENGTH + 1
    sa = suffix_array(text)
    prefix = common_prefixes(text, sa, starts, counts, LENGTH)
    # a prefix is known where a start is valid; a start's successor with 400 equal bytes is valid too
    long = prefix >= LENGTH
    marked = long.copy()
    hit = np.flatnonzero(long[sa])
    marked[sa[hit - 1]] = True
    return [marked[a : a + c] for a, c in zip(starts.tolist(), counts.tolist(), strict=True)]


#: Rows without ``did`` are a range's different digests, with the least and the greatest place of each.
_MARK = "shard int, did bigint, key bigint, firsts array<int>, lasts array<int>, range int, digests array<bigint>, more array<bigint>, least array<bigint>, most array<bigint>"
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _places(did: int, key: int, starts: np.ndarray) -> np.ndarray:
    """A number for every place; a place that two shards hold has one number."""
    row = np.uint64(xxhash.xxh64_intdigest(f"{did},{key}"))
    return (row + starts.astype(np.uint64) * _PLACE).view(np.int64)


def _different(pairs: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of ``pairs``, sorted, with the least and greatest place of each."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, least, most = pairs[order], least[order], most[order]
    first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)])
    return pairs[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)


def _shard(ranges: int):
    """A shard's work: ranges of repeated starts, a row a segment; of split groups also every string's digest.

    Digests fall into ``ranges`` ranges; a segment's go out as an array a range.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a segment may be in two groups of one shard; its strings are one place each
        pdf = pdf.sort_values("split", ascending=False).drop_duplicates("segment")
        rows, held = [], {}
        for row, own in zip(pdf.itertuples(index=False), repeated_starts(pdf["segment"].tolist()), strict=True):
            first, last = _spans(own)
            if len(first):
                rows.append((row.shard, row.did, row.key, row.first + first, row.first + last, -1, None, None, None, None))
            if row.split:
                view = memoryview(row.segment)
                pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[p : p + LENGTH]) for p in range(len(own))), dtype="<i8").reshape(-1, 2)
                at = (pair[:, 0].view(np.uint64) % np.uint64(ranges)).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
                for r in np.unique(at).tolist():
                    some = np.flatnonzero(at == r)
                    starts = row.first + some
                    rows.append((row.shard, row.did, row.key, starts, None, r, pair[some, 0], pair[some, 1], None, None))
                    held.setdefault(r, []).append((pair[some], _places(row.did, row.key, starts)))
        for r, parts in held.items():
            places = np.concatenate([p for _, p in parts])
            pairs, least, most = _different(np.concatenate([x for x, _ in parts]), places, places)
            rows.append((pdf["shard"].iloc[0], None, None, None, None, r, pairs[:, 0], pairs[:, 1], least, most))
        names = ["shard", "did", "key", "firsts", "lasts", "range", "digests", "more", "least", "most"]
        # as objects first: numbers beside nulls would become floats
        return pd.DataFrame(rows, columns=names, dtype=object).astype({"shard": "int32", "did": "Int64", "key": "Int64", "range": "int32"})

    return run


def _pairs(row) -> np.ndarray:
    return np.stack([np.asarray(row.digests, dtype=np.int64), np.asarray(row.more, dtype=np.int64)], axis=1)


def _in(pairs: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which rows of ``pairs`` are in ``found``, which is sorted: by binary search."""
    as_rows = lambda x: np.rec.fromarrays([x[:, 0], x[:, 1]], names="digest,more")
    at = np.searchsorted(as_rows(found), as_rows(pairs))
    return (at < len(found)) & (found[np.minimum(at, len(found) - 1)] == pairs).all(axis=1) if len(found) else np.zeros(len(pairs), dtype=bool)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings of a range that start at two places or more, for each shard that holds them."""
    own = [_pairs(r) for r in pdf.itertuples(index=False)]
    pairs, least, most = _different(np.concatenate(own), np.concatenate(pdf["least"].tolist()), np.concatenate(pdf["most"].tolist()))
    repeated, rows = pairs[least != most], []
    for row, mine in zip(pdf.itertuples(index=False), own, strict=True):
        held = mine[_in(mine, repeated)]
        if len(held):
            rows.append((row.shard, row.range, held[:, 0], held[:, 1]))
    return pd.DataFrame(rows, columns=["shard", "range", "digests", "more"])


def _return(places: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The starts of a shard and range whose strings repeat."""
    rows = []
    if len(found):
        repeated = _pairs(found.iloc[0])
        for row in places.itertuples(index=False):
            starts = np.asarray(row.firsts)[_in(_pairs(row), repeated)]
            if len(starts):
                rows.append((row.did, row.key, starts, starts))
    return pd.DataFrame(rows, columns=["did", "key", "firsts", "lasts"])


# --- the whole table -------------------------------------------------------


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(did, key, firsts, lasts): ranges of starts whose 400-byte strings start elsewhere too.

    ``docs``: did, key, data (bytes).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for did, key, data in zip(*(c for c in batch.columns), strict=True):
                for row in runs(data.as_py()):
                    for c, v in zip(cols, (did.as_py(), key.as_py(), *row), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["did", "key", "first", "last", "name", "seg", "again", "sides"])

    long = docs.where(F.octet_length("data") >= LENGTH)
    found = staged(long.mapInArrow(find, "did bigint, key bigint, first int, last int, name bigint, seg bigint, again boolean, sides array<bigint>"), "runs")
    groups = found.groupBy("name", "seg").agg(F.count("*").alias("n"), F.min(F.struct("did", "key", "first", "last")).alias("one"), F.max("again").alias("again"), F.min("sides").alias("sides"))
    own = (F.col("one.last") - F.col("one.first") + LENGTH).cast("bigint")
    names = groups.groupBy("name").agg(F.count("*").alias("segments"), F.sum(own).alias("bytes")).where("segments > 1")
    whole = found.join(groups.where("n > 1").select("name", "seg"), ["name", "seg"]).select("did", "key", "first", "last")

    several = staged(groups.join(names, "name"), "several")
    cols = ["name", "seg", "bytes", "one.*"]
    sided = several.select("name", "seg", "one", own.alias("own"), F.col("bytes").alias("all"), F.explode("sides").alias("side"))
    alike = sided.groupBy("name", "side").agg(F.count("*").alias("segments"), F.sum("own").alias("bytes")).where("segments > 1")
    shared = sided.join(alike, ["name", "side"])
    refined = shared.where(F.col("all") > SHARD_BYTES).withColumn("name", F.xxhash64("name", "side"))
    small = several.where(F.col("bytes") <= SHARD_BYTES)
    whole_names = small.where("again").unionByName(small.where("NOT again").join(shared.select("name", "seg").distinct(), ["name", "seg"], "left_semi"))
    # a segment that may repeat within itself is looked at alone, unless its whole name is
    alone = groups.where("again AND n = 1").join(names.where(F.col("bytes") <= SHARD_BYTES).select("name"), "name", "left_anti")
    alone = alone.withColumn("bytes", own).withColumn("name", F.xxhash64("name", "seg"))
    wanted = staged(whole_names.select(*cols).unionByName(refined.select(*cols)).unionByName(alone.select(*cols)), "wanted")
    total = wanted.agg(F.sum(F.col("last") - F.col("first") + LENGTH)).first()[0] or 0
    shards = max(1, total // SHARD_BYTES)
    parts = F.ceil(F.col("bytes") / SHARD_BYTES)
    dealt = wanted.withColumn("split", parts > 1).withColumn(
        "shard", F.pmod(F.xxhash64("name", F.when(parts > 1, F.pmod("seg", parts)).otherwise(F.lit(0))), F.lit(shards)).cast("int")
    )
    asked = dealt.groupBy("did", "key").agg(F.collect_list(F.struct("first", "last", "name", "shard", "split")).alias("wanted"))
    cut = docs.join(asked, ["did", "key"]).select("did", "key", "data", F.explode("wanted").alias("w")).select(
        "did", "key", "w.*", F.expr(f"substring(data, w.first + 1, w.last - w.first + {LENGTH})").alias("segment")
    )
    handed = dealt.where("split").agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    marks = staged(cut.groupBy("shard").applyInPandas(_shard(max(1, handed // MERGE_ROWS)), _MARK), "marks")
    ranges = "did bigint, key bigint, firsts array<int>, lasts array<int>"
    inside = marks.where("range < 0").select("did", "key", "firsts", "lasts")
    repeated = marks.where("did IS NULL").select("shard", "range", "digests", "more", "least", "most").groupBy("range").applyInPandas(_merge, "shard int, range int, digests array<bigint>, more array<bigint>")
    places = marks.where("range >= 0 AND did IS NOT NULL").select("shard", "range", "did", "key", "firsts", "digests", "more")
    across = places.groupBy("shard", "range").cogroup(repeated.groupBy("shard", "range")).applyInPandas(_return, ranges)
    return whole.select("did", "key", F.array("first").alias("firsts"), F.array("last").alias("lasts")).unionByName(inside).unionByName(across)


def removed(length: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings starting in ``ranges`` cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, min(b, length)) for a, b in out]


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the bytes left) of every row.

    A removed run may begin or end within a character; ``kept`` is bytes therefore.

    Null counts as empty. Texts under 400 bytes keep all. Of repeated rows
    each is a place of its own, so both lose what they share; matches never
    cross rows. Null ids pass through; an empty table gives no rows. Other
    columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = text_batches(docs).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("key"), text.cast("binary").alias("data"))
    ranges = repeated_ranges(rows).groupBy("did", "key").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("firsts", "lasts")))).alias("ranges"))
    joined = rows.join(ranges, ["did", "key"], "left").select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "data", "ranges")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for data, found in zip(batch.column(1), batch.column(2), strict=True):
                data = data.as_py()
                gone = removed(len(data), [(r["firsts"], r["lasts"]) for r in found.as_py() or []])
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                ends = [0, *(x for g in gone for x in g), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return done.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


