"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint sums the bits of its shingles' hashes; two fingerprints link if
few bits differ. Instead of comparing all, every distinct fingerprint emits
all variants within half the radius, the variants are shuffled, and
fingerprints that share one are verified.

Half of an odd radius is not whole, and variants within two bits of 64 are
2,081 to a fingerprint. So the radius is made even first: a *table* leaves out
one of four blocks of 16 bits. Fingerprints that differ in 1 to 3 bits differ
in at most 2 outside the block of some differing bit, and so their balls of
radius 1 over the other 48 bits meet in that block's table. That is 4 x 49
variants, and no pair within 3 bits is missed.

For looser likeness the fingerprint is wider (512 bits or more) and the tables
are bands of its bits, each with radius 2 by balls of radius 1; in larger tables
bands are wider and more, so that chance does not fill their buckets.
Fingerprints only say which pairs may be alike; the sets of shingles decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, joined_by_size, kept_rows, own_names, staged, text_batches

#: Members of a bucket up to which all its pairs are compared at once.
PAIRWISE = 64
#: Pairs of a bucket looked at at once; bounds the memory of a large bucket.
PAIRS = 1 << 22
#: Hashes whose bits are summed at once; bounds the memory of a long text.
BLOCK = 1 << 15
_ODD = 0x9E3779B97F4A7C15
#: Words of the map of a set of shingles; sets of more than a few thousand shingles fill it, and it then rules out nothing.
MAP_WORDS = 16


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words of the A-Z-lowered text.

    Words are runs of anything but ASCII white space. A text with fewer words
    has one shingle, the whole sequence; one without words has none.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(split)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(split)
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, n)
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n - k + 1)


def _majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3, width: int = 1) -> list[int]:
    """``width`` unsigned words of 64 bits; all zero for a text without words.

    The first word comes from the XXH64 values themselves, the others from
    values mixed from them.
    """
    return _wide(shingle_hashes(text, words), width)


def _wide(h: np.ndarray, width: int) -> list[int]:
    out = [_majority(h)]
    for j in range(1, width):
        x = h + np.uint64(j * _ODD % 2**64)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(odd)
        x ^= x >> np.uint64(31)
        out.append(_majority(x))
    return out


def with_fingerprints(docs: DataFrame, words: int = 3, width: int = 1) -> DataFrame:
    """doc_id, th (hash of the text), fp0, fp1, ... (64 bits each, as bigint) of every row."""
    schema = "doc_id bigint, th bigint, " + ", ".join(f"fp{j} bigint" for j in range(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words, width) for t in batch.column(2)], dtype=np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(prints[:, j])) for j in range(width))],
                names=["doc_id", "th", *(f"fp{j}" for j in range(width))],
            )

    rows = text_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def text_hash():
    """A hash of the whole text; with the id it names a row."""
    return F.xxhash64(F.col("text").cast("string")).alias("th")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of words differ; the words of a row are the last axis."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _set_map(h: np.ndarray) -> np.ndarray:
    """``MAP_WORDS`` words with a bit for each place that the upper bits of a set's hashes name."""
    marked = np.zeros(64 * MAP_WORDS, dtype=bool)
    marked[(h >> np.uint64(32)) * np.uint64(64 * MAP_WORDS) >> np.uint64(32)] = True
    return np.packbits(marked, bitorder="little").view("<u8").astype(np.uint64)


def _may_be_alike(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets (size, map) can have the Jaccard likeness; never false of sets that have it.

    Each bit of a map that the other lacks is an element at least that the other
    set lacks, which bounds what both share.
    """
    (n, m), (x, y) = ((side[..., 0].astype(np.int64) for side in (x, y)), (x[..., 1:], y[..., 1:]))
    shared = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))
    return shared / np.maximum(n + m - shared, 1) >= similarity


def _near(x: np.ndarray, y: np.ndarray, bits: int, similarity: float | None = None) -> np.ndarray:
    """Whether rows of words differ in at most ``bits`` bits and, with ``similarity``, whose last words are size and map of a set, can be alike."""
    if similarity is None:
        return _differing(x, y) <= bits
    width = x.shape[-1] - 1 - MAP_WORDS
    near = _differing(x[..., :width], y[..., :width]) <= bits
    at, shape = np.nonzero(near), (*near.shape, 1 + MAP_WORDS)
    near[at] = _may_be_alike(np.broadcast_to(x[..., width:], shape)[at], np.broadcast_to(y[..., width:], shape)[at], similarity)
    return near


def _spanning(ids: np.ndarray, words: np.ndarray, bits: int, similarity: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect all members of a bucket that links connect.

    Breadth first: each member is compared with those not reached yet, so
    members take at most one edge each, however many links they have.
    """
    out, left = [], np.arange(len(ids))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _near(words[left], words[x], bits, similarity)
            hit = left[near]
            if len(hit):
                out.append((np.full(len(hit), ids[x]), ids[hit]))
                queue.extend(hit.tolist())
                left = left[~near]
    return out


def _across(ids: np.ndarray, words: np.ndarray, labels: np.ndarray, bits: int, similarity: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a bucket that differ in label and are near."""
    order = np.argsort(labels, kind="stable")
    ids, words, labels = ids[order], words[order], labels[order]
    # rows are sorted by label: each is compared with those behind its own label's last
    behind = np.searchsorted(labels, labels, side="right")
    block = max(1, PAIRS // words.size)
    for at in range(0, len(ids), block):
        near = _near(words[at : at + block, None], words[None, :], bits, similarity)
        near &= np.arange(len(ids)) >= behind[at : at + block, None]
        x, y = np.nonzero(near)
        if len(x):
            yield ids[at + x], ids[y]


def _linked(keys: np.ndarray, ids: np.ndarray, words: np.ndarray, bits: int, pairwise: int = 0, similarity: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows sorted by key: pairs with equal keys that are near.

    In a bucket of more than ``pairwise`` members edges that span what is linked.
    """
    pairwise = pairwise or PAIRWISE
    a, b = [], []
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[cut, len(keys)])
    for s, n in zip(cut[size > pairwise].tolist(), size[size > pairwise].tolist(), strict=True):
        for x, y in _spanning(ids[s : s + n], words[s : s + n], bits, similarity):
            a.append(x)
            b.append(y)
    small = np.repeat(size <= pairwise, size)
    keys, ids, words = keys[small], ids[small], words[small]
    at, lag = np.arange(len(keys) - 1), 1
    while len(at):
        at = at[keys[at] == keys[at + lag]]
        near = at[_near(words[at], words[at + lag], bits, similarity)]
        a.append(ids[near])
        b.append(ids[near + lag])
        lag += 1
        at = at[at + lag < len(keys)]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows that come sorted by the first; a key's rows are never parted.

    The last key of a batch is carried into the next.
    """
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(c.to_numpy() for c in batch.columns)
        if held and held[0][0][0] == now[0][-1]:
            held.append(now)
            continue
        now = tuple(np.concatenate(x) for x in zip(*held, now, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield tuple(x[:cut] for x in now)
        held = [tuple(x[cut:] for x in now)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _wordy(columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """Columns of words as one array, a row's words beside each other."""
    return np.stack([np.ascontiguousarray(c).view(np.uint64) for c in columns], axis=1)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def colliding(variants: DataFrame, bits: int) -> DataFrame:
    """Verified edges (a, b) among rows (key, id, word) that share a key.

    A key's rows come together sorted. A bucket holds distinct fingerprints of
    one small ball only, since copies were merged before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, *words in _buckets(batches):
            a, b = _linked(keys, ids, _wordy(words), bits)
            if len(a):
                yield _pairs(a, b)

    spread = variants.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def bucket_members(variants: DataFrame, bits: int, similarity: float | None = None) -> DataFrame:
    """key, id, least, near: rows (key, id, words ...) that are near another of their bucket (``_near``).

    Rows that meet by chance are left out here, before anything is written.
    ``least`` is the least id of the rows left of a bucket, ``near`` whether
    the row is near that. Buckets of the same rows, which neighbouring
    variants make, are one: their key is a hash of their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, *columns in _buckets(batches):
            words, met = _wordy(columns), np.zeros(len(keys), dtype=bool)
            for side in _linked(keys, np.arange(len(keys)), words, bits, similarity=similarity):
                met[side] = True
            if not met.any():
                continue
            keys, ids, words = keys[met], ids[met], words[met]
            order = np.lexsort((ids, keys))
            ids, words = np.ascontiguousarray(ids[order]), words[order]
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[cut, len(keys)])
            first = np.repeat(cut, size)
            near = _near(words, words[first], bits, similarity)
            view = memoryview(ids).cast("B")
            named = np.array([xxhash.xxh64_intdigest(view[8 * c : 8 * (c + n)]) for c, n in zip(cut.tolist(), size.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(named, size), ids, ids[first], near)], names=["key", "id", "least", "near"])

    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, id bigint, least bigint, near boolean").distinct()


def unlinked(members: DataFrame, bits: int, similarity: float | None = None) -> DataFrame:
    """Pairs (a, b) of rows (key, id, label, words ...) that share a key, differ in label and are near (``_near``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, labels, *columns in _buckets(batches):
            words = _wordy(columns)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            mixed = np.flatnonzero(np.minimum.reduceat(labels, cut) != np.maximum.reduceat(labels, cut))
            end = np.r_[cut[1:], len(keys)]
            found, held = [], 0
            for s, e in zip(cut[mixed].tolist(), end[mixed].tolist(), strict=True):
                for pair in _across(ids[s:e], words[s:e], labels[s:e], bits, similarity):
                    found.append(pair)
                    held += len(pair[0])
                    if held > PAIRS // 4:
                        yield _pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
                        found, held = [], 0
            if found:
                yield _pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def ball_variants(prints: DataFrame) -> DataFrame:
    """(key, id, word) for radius 3: 4 tables of 48 bits, each with its ball of radius 1."""
    v = prints.select(F.col("fp0").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(4 * 49 - 1))).alias("v"))
    v = v.select("id", F.expr("cast(v div 49 as int)").alias("t"), F.expr("cast(v % 49 as int) - 1").alias("j"))
    hidden = F.expr("shiftleft(65535L, 16 * t)")
    flip = F.expr("CASE WHEN j < 0 THEN 0L WHEN j < 16 * t THEN shiftleft(1L, j) ELSE shiftleft(1L, j + 16) END")
    # the hidden block names the table, so that one number is the whole key
    tag = F.expr("shiftleft(cast(t + 1 as bigint), 16 * t)")
    return v.select(F.xxhash64(((F.col("id").bitwiseAND(F.bitwise_not(hidden))).bitwiseXOR(flip)).bitwiseOR(tag), "t").alias("key"), "id", F.col("id").alias("word"))


def near_groups(prints: DataFrame) -> DataFrame:
    """fp0 → component_id, the smallest doc_id that links of at most 3 bits reach, and n, the rows with this fingerprint.

    ``prints``: doc_id and fp0 of every row. Equal fingerprints are merged
    first. Null ids lose to any other.
    """
    distinct = staged(prints.groupBy("fp0").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    links = colliding(ball_variants(distinct), 3)
    return _spread(distinct, components(links), "fp0")


def _spread(distinct: DataFrame, labels: DataFrame, node: str, *more: str) -> DataFrame:
    """Smallest id of each component, for each of its nodes (``distinct``: node, least, n); with ``label`` as one of ``more`` its name."""
    labelled = distinct.join(labels.withColumnRenamed("node", node), node, "left").withColumn("label", F.coalesce("label", node))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return staged(labelled.select(node, "label", "n").join(least, "label").select(node, *more, "component_id", "n"), "groups")


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp0 and component_id of every row; links at 3 or fewer bits of 64.

    Null and empty texts, and texts without words, have the fingerprint zero
    and link like any other. Repeated rows have a row each. A null doc_id is
    returned and does not name a component unless all its members have none.
    Very long texts are read whole, their bits summed in blocks. An empty table gives no rows. Other columns are not read.
    """
    prints = staged(with_fingerprints(docs, words).select("doc_id", "fp0"), "docs")
    return joined_by_size(prints, near_groups(prints), "fp0", "n").select("doc_id", "fp0", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


# --- the pipeline's stage: 5-word shingles, similarity 0.8 -----------------

#: Rows of a table up to which bands have so many bits, and how many bands then find a pair at 0.8 with probability 0.96.
WIDTHS = ((1 << 20, 24, 10), (1 << 26, 28, 16), (None, 32, 26))


def bands_for(rows: int) -> tuple[int, int]:
    """Bits of a band and number of bands for a table of so many rows."""
    return next((bits, bands) for most, bits, bands in WIDTHS if most is None or rows <= most)


def words_for(bands: int) -> int:
    """Words of the fingerprint: two bands in each of the first, and one at least that no band is cut from."""
    return max(8, bands // 2 + 1)


def bits_at(jaccard: float, width: int) -> int:
    """Differing bits, of 64 x width, expected at a Jaccard likeness of shingle sets of equal size."""
    cosine = 2 * jaccard / (1 + jaccard)
    return round(64 * width * math.acos(cosine) / math.pi)


def band_variants(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    """(key, id, word): every band's ball of radius 1; ``word`` is one that no band is cut from. A key's upper bits name the band."""
    words = F.array(*(F.col(f"fp{j}") for j in range(bands // 2)))
    v = nodes.select("node", F.col(f"fp{words_for(bands) - 1}").alias("word"), words.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bands * (bits + 1) - 1))).alias("v"))
    v = v.select("node", "word", "w", F.expr(f"cast(v div {bits + 1} as int)").alias("t"), F.expr(f"cast(v % {bits + 1} as int) - 1").alias("j"))
    band = F.expr(f"shiftrightunsigned(element_at(w, cast(t div 2 as int) + 1), {bits} * (t % 2)) & {(1 << bits) - 1}L")
    flip = F.expr("CASE WHEN j < 0 THEN 0L ELSE shiftleft(1L, j) END")
    return v.select(F.expr(f"shiftleft(cast(t as bigint), {bits})").bitwiseOR(band.bitwiseXOR(flip)).alias("key"), F.col("node").alias("id"), "word")


#: Size and map of a set of shingles.
SET_COLUMNS = ["size", *(f"m{j}" for j in range(MAP_WORDS))]


def with_sets(docs: DataFrame, words: int, width: int) -> DataFrame:
    """doc_id, th, node (hash of the set of shingles), fp0, fp1, ..., size and map (m0, m1, ...) of the set, of every row."""
    names = ["node", *(f"fp{j}" for j in range(width)), *SET_COLUMNS]
    schema = "doc_id bigint, th bigint, " + ", ".join(f"{c} bigint" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(names)), dtype=np.uint64)
            for i, t in enumerate(batch.column(2)):
                h = np.unique(shingle_hashes(t.as_py(), words))
                rows[i] = [xxhash.xxh64_intdigest(h.tobytes()), *_wide(h, width), len(h), *_set_map(h)]
            rows = rows.view(np.int64)
            columns = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", *names])

    rows = text_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node → shingles, the set of hashes, of the nodes (node, th) given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(text_hash(), F.col("text").cast("string").alias("text")).join(nodes, "th").dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard likeness of ``similarity`` or more, as a staged table."""
    may = staged(pairs, "pairs")
    wanted = may.select(F.col("a").alias("node")).unionByName(may.select(F.col("b").alias("node"))).distinct()
    sets = staged(shingle_sets(docs, nodes.join(wanted, "node", "left_semi").select("node", "th"), words), "sets")
    own = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}"))
    counted = may.join(own("a"), "a").join(own("b"), "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("both"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    found = staged(counted.where(F.col("n") / (F.col("both") - F.col("n")) >= similarity).select("a", "b"), "links")
    discard(may, sets)
    return found


def above(limit: int, bits: int, of: int) -> int:
    """Differing bits, of ``bits`` drawn from ``of``, three deviations above a mean of ``limit`` in ``of``."""
    share = limit / of
    return math.ceil(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, th, component_id, ``kept`` and ``rows`` of every (doc_id, text): near duplicates by exact Jaccard likeness.

    Two texts link if their sets of ``words``-word shingles have the given
    Jaccard likeness or more, which is counted on the sets. Candidates share a
    variant of a band of a SimHash of the set, and differ in no more bits than
    three deviations above the mean at that likeness, unless size and map of
    their sets prove them less alike: at 0.8 a pair becomes one
    with probability 0.96, at 0.85 with 0.99. A bucket's members meet its least
    one first; then members of a bucket that are not connected by that meet
    each other. So no link between candidates is lost and a large group does
    not become all its pairs. Texts with equal sets, the empty
    ones among them, are one group. Very long texts are read whole. One row of
    each component is kept: its smallest doc_id (nulls last), of several the
    one with the smallest text hash.
    """
    width, bands = bands_for(docs.count())
    names = [f"fp{j}" for j in range(words_for(bands))]
    prints = staged(with_sets(docs, words, len(names)), "docs")
    nodes = staged(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in [*names, *SET_COLUMNS])), "nodes")
    bits = 64 * len(names)
    mean = bits_at(similarity, len(names))
    # one word of 64 bits stands for all at first
    loose = above(mean, 64, bits)
    limit = above(mean, bits, bits)
    check = lambda pairs: alike(pairs, nodes, docs, words, similarity)
    told = [*names, *SET_COLUMNS]
    prints_of = nodes.select(F.col("node").alias("id"), *told)
    # a node's buckets are a list, of at most as many as it has variants, so that it meets its words and label once
    listed = lambda df: df.groupBy("id").agg(F.collect_list("key").alias("keys"))
    met = staged(listed(bucket_members(band_variants(nodes, width, bands), loose)), "buckets")
    members = staged(bucket_members(met.join(prints_of, "id").select(F.explode("keys").alias("key"), "id", *told), limit, similarity), "members")
    links = check(members.where("near AND id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    label = components(links).withColumnRenamed("node", "id")
    rest = listed(members.where("id <> least")).join(label, "id", "left").join(prints_of, "id")
    pairs = unlinked(rest.select(F.explode("keys").alias("key"), "id", F.coalesce("label", "id").alias("label"), *told), limit, similarity)
    groups = _spread(nodes.select("node", "least", "n"), components(links.unionByName(check(pairs))), "node", "label")
    discard(met, members, nodes)
    rows = joined_by_size(prints.groupBy("doc_id", "th", "node").agg(F.count("*").alias("rows")), groups, "node", "n")
    # by the component's own name: its smallest id may be another's too, or none
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("th").eqNullSafe(F.col("first.th"))
    return rows.join(first, "label").select("doc_id", "th", "component_id", same.alias("kept"), "rows")


@own_names
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each near-duplicate group, also of those whose rows have no id."""
    decided = staged(near_duplicates(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "kept", "rows"), "decided")
    marked = docs.withColumn("__id", F.col("doc_id").cast("bigint")).withColumn("__th", text_hash())
    gone, again = decided.where("NOT kept").select("__id", "__th"), decided.where("kept AND rows > 1").select("__id", "__th")
    return kept_rows(marked, ["__id", "__th"], gone, again).drop("__id", "__th")
