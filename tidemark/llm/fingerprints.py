"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors, lane by lane, modulo a power of two. So it does not
depend on the paragraphs' order, and a paragraph is inserted or deleted by
adding or subtracting its vector.

A vector has two parts. ``EQUAL`` lanes modulo 2^64 are drawn from the digest
of the paragraph's bytes: they tell multisets apart. ``SKETCH`` lanes modulo
2^32 are a count sketch of the paragraph's three-word shingles: the sum over
paragraphs is the sketch of all of them, and the cosine of two sums estimates
how much of their shingles two documents share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .simhash import shingle_hashes

#: Lanes modulo 2^64 that tell multisets apart, and lanes modulo 2^32 of the sketch.
EQUAL, SKETCH = 16, 256
SHINGLE = 3


def paragraphs(text: str) -> list[str]:
    """The lines of a text; a text without line ends, the empty one too, is one paragraph."""
    return text.split("\n")


def vector(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    """The wide vector of one paragraph."""
    stream = hashlib.shake_128(paragraph.encode("utf-8", "surrogatepass")).digest(8 * EQUAL)
    return np.frombuffer(stream, dtype="<u8"), sketch(shingle_hashes(paragraph, SHINGLE))


def sketch(h: np.ndarray) -> np.ndarray:
    lane = (h % np.uint64(SKETCH)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    return np.bincount(lane, weights=sign, minlength=SKETCH).astype(np.int64).astype(np.uint32)


class Fingerprint:
    """A sum of paragraph vectors."""

    def __init__(self, equal: np.ndarray | None = None, shared: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL, dtype="<u8") if equal is None else equal
        self.shared = np.zeros(SKETCH, dtype="<u4") if shared is None else shared

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        """Of a whole text. Paragraphs' shingles are sketched together, which is the sum of their sketches."""
        parts = paragraphs(text)
        digests = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * EQUAL) for p in parts)
        equal = np.frombuffer(digests, dtype="<u8").reshape(-1, EQUAL).sum(axis=0, dtype=np.uint64)
        return cls(equal, sketch(np.concatenate([shingle_hashes(p, SHINGLE) for p in parts])))

    def insert(self, paragraph: str) -> Fingerprint:
        equal, shared = vector(paragraph)
        return Fingerprint(self.equal + equal, self.shared + shared)

    def delete(self, paragraph: str) -> Fingerprint:
        equal, shared = vector(paragraph)
        return Fingerprint(self.equal - equal, self.shared - shared)

    def text(self) -> str:
        """All lanes, little-endian, in base 64."""
        return base64.b64encode(self.equal.astype("<u8").tobytes() + self.shared.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 8 * EQUAL], dtype="<u8"), np.frombuffer(raw[8 * EQUAL :], dtype="<u4"))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the sketches' cosine, at least 0 and under 1."""
        if (self.equal == other.equal).all() and (self.shared == other.shared).all():
            return 1.0
        a, b = (x.shared.astype(np.uint32).view(np.int32).astype(np.float64) for x in (self, other))
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(max(a @ b / size, 0.0), 1 - 2**-20)) if size else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row. Null counts as empty; repeated rows have a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [Fingerprint.of(t.as_py() or "").text() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


#: Ranges of documents into which ``edited_fingerprints`` cuts the table: one for each so many rows, of at most
#: MOST_RANGES, whose first keys every task holds. A range is sorted and streamed, so it may be larger than memory.
ROWS_A_RANGE, MOST_RANGES = 4000, 50_000


def range_starts(rows: DataFrame, ranges: int) -> np.ndarray:
    """The first keys (none, falling id, th) of ranges of about as many rows, in the order in which documents follow.

    Rows without an id have no id to part them, so the hash of the text does.
    """
    keys = rows.select(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("bigint")).alias("id"), "th")
    dealt = keys.repartitionByRange(ranges, "none", "id", "th").withColumn("part", F.spark_partition_id())
    firsts = dealt.groupBy("part").agg(F.min(F.struct("none", "id", "th")).alias("first")).select("first.*").collect()
    return np.array(sorted(tuple(r) for r in firsts), dtype=_KEY)


_KEY = [("none", "<i4"), ("id", "<i8"), ("th", "<i8")]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and of the next document.

    The next document is the one with the next smaller id, after the smallest
    the one with the largest; rows with equal ids follow each other by a hash
    of the text, and rows without an id come last. Null counts as empty. A
    table of one row is its own next. An empty table gives no rows. A very long
    text is one row of its task like any other. Other columns are not read.

    The order is cut into ranges by their first keys; each text goes to its
    range once, compressed before the shuffle, and the first document of each
    range once more, as the one that follows the range before.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = text_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    ranges = max(1, min(MOST_RANGES, rows.count() // ROWS_A_RANGE))
    starts = range_starts(rows, ranges)
    packed = rows.mapInArrow(_packed(starts), "part int, head int, doc_id bigint, th bigint, packed binary")
    together = packed.repartitionByRange(max(1, len(starts)), "part").sortWithinPartitions("part", "head", F.col("doc_id").desc_nulls_last(), "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        held: tuple | None = None  # the row before: part, head, doc_id, text, fingerprint
        out: list[tuple] = []

        def pair(a: tuple, b: tuple) -> tuple:
            changed = edited(a[3], b[3])
            mark = Fingerprint.of(changed)
            return (a[2], len(a[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), a[4].text(), mark.text(), a[4].likeness(mark), a[4].likeness(b[4]))

        for batch in batches:
            for part, head, doc_id, _, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[1] and held[0] == part:
                    continue  # only the first of the range that follows is wanted
                text = unpack.decompress(raw).decode()
                now = (part, head, doc_id, text, Fingerprint.of(text))
                if held and not held[1]:
                    out.append(pair(held, now))
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
                out = []

    return together.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_NAMES, ("bigint", "bigint", "string", "string", "string", "double", "double"), strict=True)))


def _packed(starts: np.ndarray):
    """Rows with the number of their range, and those that begin one a second time as the head that follows the range before.

    Texts are compressed each by itself: half of what the shuffle's own compression leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            ids = batch.column(0)
            keys = np.zeros(batch.num_rows, dtype=_KEY)
            keys["none"] = ids.is_null().to_numpy(zero_copy_only=False)
            keys["id"] = np.where(keys["none"] == 1, 0, ~ids.fill_null(0).to_numpy())
            keys["th"] = batch.column(1).to_numpy()
            part = np.maximum(np.searchsorted(starts, keys, side="right") - 1, 0).astype(np.int32)
            heads = np.flatnonzero(starts[part] == keys)
            rows = np.r_[np.arange(len(keys)), heads]
            where = np.r_[part, (part[heads] - 1) % len(starts)].astype(np.int32)
            head = np.r_[np.zeros(len(keys), np.int32), np.ones(len(heads), np.int32)]
            packed = pa.array([pack.compress(t.as_py().encode()) for t in batch.column(2)], pa.binary())
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(head), ids.take(at), batch.column(1).take(at), packed.take(at)], names=["part", "head", "doc_id", "th", "packed"])

    return run


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
