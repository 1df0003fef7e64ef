"""Groups of spelling variants: words one edit apart, each led to the form it is a variant of.

Words within one inserted, deleted or replaced character are found by an
even-partition pigeonhole join: a word is cut into two segments, and one edit
leaves one of them as it was. A word is indexed by its length and each segment;
words of the same length look there with their own segments, words longer by one
with the segments shifted past the edit. Where many words share a segment they
are not compared with each other: the other segment is cut in two again, so
that three quarters must agree, then seven eighths, until few share a key or
the part that may differ is one character, when all that meet are near.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_size, staged, text_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many runs loses a character; the least length and number of a word; how much commoner a form is.
NOISE, LENGTH, OFTEN, TIMES = 199, 6, 5, 5
#: Distinct words of a task's count before it is handed on.
HELD = 300_000
#: Words that share a key and are compared; more are cut again.
MET = 48


def counted(docs: DataFrame, noise: int = NOISE, length: int = LENGTH) -> DataFrame:
    """word and n: how often each run of letters of at least ``length`` characters occurs, A-Z lower-cased.

    A run loses its character h mod length, if ``noise`` divides h, the CRC-32
    of ``<doc_id>:<run>``; 0: none does. A null id is written ``null``, a null
    text has no runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                begin = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                lowered = text.as_buffer().to_pybytes().lower().decode()  # of bytes, only A-Z are lower-cased
                for word, n in Counter(RUN.findall(lowered)).items():
                    if len(word) < length:
                        continue
                    if noise and (h := zlib.crc32(word.encode(), begin)) % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    rows = text_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(words: DataFrame) -> DataFrame:
    """Each word with the lengths at which it looks, and the gap that may differ, all of it to begin with: level 0, one gap."""
    size = F.char_length("word")
    roles = F.array(F.struct(size.alias("len"), F.lit(False).alias("longer")), F.struct((size - 1).alias("len"), F.lit(True).alias("longer")))
    return words.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.len", "role.longer", F.lit(0).cast("bigint").alias("gap"))


def _halved(entries: DataFrame, level: int) -> DataFrame:
    """Entries with the gap cut in two: one for either half that may differ, and what is outside of it as the key.

    At level k an indexed word of length L has 2^k segments, whose borders are
    floor(i L / 2^k); a word longer by one has one character more in the gap.
    """
    both = entries.drop("key").withColumn("gap", F.explode(F.array(F.col("gap") * 2, F.col("gap") * 2 + 1)))
    border = lambda i: F.floor(i * F.col("len") / F.lit(2**level)).cast("int")
    cut = both.withColumn("from", border(F.col("gap"))).withColumn("to", border(F.col("gap") + 1))
    end = F.col("to") + F.col("longer").cast("int")
    # a gap without characters may only take the longer word's one more
    outside = F.struct(F.substring("word", F.lit(1), F.col("from")).alias("left"), F.substring("word", end + 1, F.char_length("word")).alias("right"))
    return cut.withColumn("key", outside).withColumn("wide", F.col("to") - F.col("from")).drop("from", "to")


def near_pairs(words: DataFrame, met: int = MET) -> DataFrame:
    """a, a_n, b, b_n: every two words (word, n; each word once) that are one edit apart, a pair once."""
    entries, level, found = _keys(words), 0, []
    on = ["len", "gap", "key"]
    while True:
        level += 1
        entries = staged(_halved(entries, level), "keys")
        sizes = entries.groupBy(*on).agg(F.count("*").alias("there"), F.max("wide").alias("wide"))
        crowded = staged(sizes.where((F.col("there") > met) & (F.col("wide") > 1)).select(*on), "crowded")
        more = not crowded.isEmpty()
        calm = entries.join(crowded, on, "left_anti") if more else entries
        a = calm.where("NOT longer").select(*on, F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = calm.select(*on, "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
        one = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
        pairs = a.alias("l").join(b.alias("r"), [*(F.col(f"l.{c}") == F.col(f"r.{c}") for c in on), one])
        found.append(pairs.select("a", "a_n", "b", "b_n"))
        if not more:
            break
        entries = entries.join(crowded, on, "left_semi")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of ``words`` (word, n; each word once).

    A word's form is the commonest of the words one edit apart (of equals the
    smallest), if it is at least ``times`` as common; the root is where forms
    lead in the end. Empty tables give no rows.
    """
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_pairs(words), "pairs")
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best"))
    leads = F.coalesce(-F.col("best.neg") >= times * F.col("n"), F.lit(False))
    of = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.neg")).alias("form_n"))
    of = staged(of, "forms")
    return of.join(_roots(of.where("form IS NOT NULL").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form; each round doubles how far a word sees.

    A form is ``TIMES`` as common as its word, so chains are short, and have no rings.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # words by what they lead to: many may share it
        on_the_way = now.groupBy("root").agg(F.count("*").alias("words")).join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        on_the_way = staged(on_the_way, "leading")
        if on_the_way.isEmpty():
            return now
        moved = joined_by_size(now, on_the_way, "root", "words").select("word", F.col("next").alias("root"))
        rest = now.join(moved.select("word"), "word", "left_anti")
        now = staged(rest.unionByName(moved), "roots")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(counted(docs).where(F.col("n") >= OFTEN))
