"""Line dedup by MinHash, in DataFrame functions only: one line per component of like lines.

- Equal lines are merged first, on their whole text; different lines get numbers.
- Character shingles of every different line are hashed. 32 minima make its
  signature: XXH64 of the shingle's hash and each of 16 numbers gives two, one
  of either half. Two shingles are one row, and Spark pre-aggregates the rows
  where the lines are read.
- Eight bands of four minima: a pair of Jaccard likeness 0.8 shares one with
  probability 0.985, a pair of 0.1 with 0.0008.
- Four bits of every minimum stand for the signature where lines meet: a pair
  that differs in more of them than three deviations above the mean at 0.8 is no
  candidate (of pairs at 0.8 that leaves out one in a thousand).
- Likeness is verified exactly on the shingle sets. In STARS rounds a centre of
  each band meets the band's lines that are not connected with it, a line that
  was no centre yet each time; lines of a band that are not connected by then
  meet each other in the first band they share. Before such a pair is made, those
  bits, the sizes of its shingle sets and maps of them decide: a map of 2,048 bits
  bounds what two sets have in common, so no pair at 0.8 is left out. So no link
  between candidates is lost, and a group of near copies does not become all its
  pairs.
- Union-find by alternating stars; the first line of a component stays.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, joined_by_size, release, staged

#: Characters of a shingle, likeness of a link.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 4
MINIMA = BANDS * ROWS
#: Rounds in which a band's lines meet one of it.
STARS = 4
#: Lines, or bands, whose numbers are broadcast at most, to pick texts or members.
FEW = 1_000_000
#: Longs of 64 bits in the map of a shingle set.
MAP = 32
#: Pairs that a task verifies, and such tasks at most.
PAIRS_A_TASK, TASKS = 500, 2000


def differing_at(jaccard: float, deviations: float = 3.0) -> int:
    """Minima, of all, whose four bits differ at that likeness: the mean and so many deviations."""
    share = (1 - jaccard) * 15 / 16
    return math.ceil(MINIMA * share + deviations * math.sqrt(MINIMA * share * (1 - share)))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _is_line(line: Column) -> Column:
    return line.rlike(r"\S")


def _digest(line: Column) -> Column:
    """128 bits of a line: two hashes that do not depend on each other."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def different_lines(docs: DataFrame) -> DataFrame:
    """lid (a number), line, h (digest), n (how often) of every different line that is not blank."""
    found = docs.select(F.explode(_lines_of(F.col("text"))).alias("line")).where(_is_line(F.col("line")))
    return found.groupBy("line").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("lid"), "line", _digest(F.col("line")).alias("h"), "n")


def _shingle(line16: Column, at: Column) -> Column:
    """The hashed shingle at a place of a line in UTF-16; characters beyond it count as two here."""
    return F.xxhash64(F.substring(line16, 2 * at + 1, F.lit(2 * SHINGLE)))


def shingle_set(line: Column) -> Column:
    """The distinct shingles of a line; all at once by a pattern, which takes a fifth of the time of a function by position."""
    all_ = F.regexp_extract_all(line, F.lit(f"(?s)(?=({'.' * SHINGLE}))"), F.lit(1))
    return F.array_distinct(F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(all_))


def _number(j: int) -> int:
    """The j-th of the numbers that shingles are hashed with."""
    x = (j + 1) * 0x9E3779B97F4A7C15 % 2**64
    return x - (x >> 63 << 64)


def signatures(of: DataFrame) -> DataFrame:
    """lid → keys (of the bands), low and high (two bits each of every minimum) of every different line."""
    wide = of.select("lid", F.encode("line", "UTF-16BE").alias("w")).withColumn("last", F.greatest((F.octet_length("w") / 2).cast("int") - SHINGLE, F.lit(0)))
    # two shingles a row; more would be more code than the JVM compiles
    starts = wide.select("lid", "w", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(2))).alias("i"))
    shingles = starts.select("lid", _shingle(F.col("w"), F.col("i")).alias("h0"), _shingle(F.col("w"), F.least(F.col("i") + 1, F.col("last"))).alias("h1"))
    hashed = shingles.select("lid", *(F.xxhash64(F.col(f"h{k}").bitwiseXOR(F.lit(_number(j)))).alias(f"x{j}_{k}") for j in range(MINIMA // 2) for k in range(2)))
    halves = (lambda x: F.shiftrightunsigned(x, 32), lambda x: F.col(x).bitwiseAND(0xFFFFFFFF))
    pairs = hashed.select("lid", *(F.least(half(f"x{j}_0"), half(f"x{j}_1")).alias(f"m{2 * j + k}") for j in range(MINIMA // 2) for k, half in enumerate(halves)))
    least = pairs.groupBy("lid").agg(*(F.min(f"m{j}").alias(f"m{j}") for j in range(MINIMA)))
    # an array from here on: with 32 columns the generated method is longer than the JVM compiles
    minima = least.select("lid", F.array(*(f"m{j}" for j in range(MINIMA))).alias("m"))
    keys = F.array(*(F.xxhash64(F.lit(b), *(F.col("m")[b * ROWS + r] for r in range(ROWS))) for b in range(BANDS)))

    def bits(k: int) -> Column:
        """A bit of all minima in the lower half, another in the upper."""
        bit = lambda x, at: x.bitwiseAND(F.lit(1 << at).cast("bigint"))
        both = lambda x: F.shiftright(bit(x, k), k).bitwiseOR(F.shiftleft(bit(x, k + 1), MINIMA - 1 - k))
        return F.aggregate("m", F.lit(0).cast("bigint"), lambda out, x: F.shiftleft(out, 1).bitwiseOR(both(x)))

    return minima.select("lid", keys.alias("keys"), bits(0).alias("low"), bits(2).alias("high"))


def band_members(signed: DataFrame) -> DataFrame:
    """key, lid: lines of every band that more than one line has.

    Bands are counted before lines meet them, so that one task never holds a band.
    """
    rows = signed.select("lid", F.explode("keys").alias("key"))
    shared = staged(rows.groupBy("key").agg(F.min("lid").alias("least"), F.max("lid").alias("most")).where("least <> most").select("key"), "shared")
    return rows.join(F.broadcast(shared) if shared.count() <= FEW else shared, "key").select("key", "lid")


def _differing(a: str, b: str) -> Column:
    """Minima any of whose four bits differ."""
    both = F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low")).bitwiseOR(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high")))
    return F.bit_count(both.bitwiseOR(F.shiftrightunsigned(both, MINIMA)).bitwiseAND(F.lit((1 << MINIMA) - 1)))


def _near(a: str, b: str) -> Column:
    return _differing(a, b) <= differing_at(SIMILARITY)


def maps(lines: DataFrame) -> DataFrame:
    """lid → n (different shingles), spare (n without the bits that are set) and map (a bit for each shingle by its hash) of every line."""
    hashed = lines.select("lid", F.explode(shingle_set(F.col("line"))).alias("x")).select("lid", F.xxhash64("x").alias("h"))
    word, bit = F.col("h").bitwiseAND(MAP - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("h", 58).cast("int"))
    made = hashed.select("lid", word.alias("w"), bit.alias("bit")).groupBy("lid").agg(
        F.count("*").alias("n"), *(F.bit_or(F.when(F.col("w") == k, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}") for k in range(MAP))
    )
    ones = reduce(Column.__add__, (F.bit_count(f"m{k}") for k in range(MAP)))
    return made.select("lid", "n", (F.col("n") - ones).alias("spare"), F.array(*(f"m{k}" for k in range(MAP))).alias("map"))


def _may_be_like(a: str, b: str) -> Column:
    """Whether the sets can be SIMILARITY alike: they have no more in common than their maps, and what either has beyond its bits.

    In integers, as a sum rounded down would lose a pair at the very bound: I >= 0.8 (A + B - I) is 9 I >= 4 (A + B).
    """
    # over arrays: generated code with all longs of two rows is more than the JVM compiles
    in_both = F.aggregate(F.zip_with(f"{a}.map", f"{b}.map", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    return 9 * (F.least(f"{a}.spare", f"{b}.spare") + in_both) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def pairs_within(members: DataFrame, signed: DataFrame, of: DataFrame) -> DataFrame:
    """A staged table of the pairs (a, b) of lines of a band (key, lid, label) that are not connected and may be alike, each once.

    A pair meets in the first band that its lines share. Where they are no
    members of that one any more, one has met the other or both have a label.
    """
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label"))
    bits = members.join(signed.select("lid", "low", "high"), "lid")
    # most lines have none near them, and need no map
    some = staged(bits.alias("a").join(bits.alias("b"), met & (F.col("a.lid") != F.col("b.lid")) & _near("a", "b"), "left_semi"), "near")
    release(of.sparkSession)
    mapped = staged(maps(of.join(some.select("lid").distinct(), "lid", "left_semi")), "maps")
    release(of.sparkSession)
    keys = signed.select("lid", *(F.col("keys")[j].alias(f"k{j}") for j in range(BANDS)))
    a, b = (some.join(keys, "lid").join(mapped, "lid").alias(x) for x in "ab")
    first = F.coalesce(*(F.when(F.col(f"a.k{j}") == F.col(f"b.k{j}"), F.col(f"a.k{j}")) for j in range(BANDS)))
    pairs = a.join(b, met & (F.col("a.lid") < F.col("b.lid")) & (first == F.col("a.key")) & _near("a", "b") & _may_be_like("a", "b"))
    pairs = staged(pairs.select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b")), "pairs")
    discard(some, mapped)
    return pairs


def verified(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b), a staged table, whose shingle sets have a Jaccard likeness of SIMILARITY or more. ``of``: lid, line."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    n = pairs.count()
    wanted = F.broadcast(wanted) if 2 * n <= FEW else wanted
    texts = of.join(wanted, "lid", "left_semi").select("lid", "line")
    side = lambda k: texts.select(F.col("lid").alias(k), F.col("line").alias(f"w{k}"))
    # dealt by their number: a few MB of pairs are seconds of work
    both = pairs.join(side("a"), "a").repartition(min(max(1, n // PAIRS_A_TASK), TASKS), "b").join(side("b"), "b")
    # variables of lambdas hold the sets and their common part: columns would be worked out anew wherever the condition names them
    like = lambda p, n: n >= SIMILARITY * (F.size(p["sa"]) + F.size(p["sb"]) - n)
    sets = F.array(F.struct(shingle_set(F.col("wa")).alias("sa"), shingle_set(F.col("wb")).alias("sb")))
    return both.where(F.exists(sets, lambda p: F.exists(F.array(F.size(F.array_intersect(p["sa"], p["sb"]))), lambda n: like(p, n)))).select("a", "b")


def relabelled(known: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after more links (a, b); ``known``, a staged table, has those before. Only labels that the links connect are walked again."""
    at = lambda k: known.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = components(ends)
    moved = known.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(new.join(known.select("node"), "node", "left_anti"))


def line_components(of: DataFrame) -> DataFrame:
    """node, label of lines (lid) that are like another; ``of``: lid, line, as from ``different_lines``."""
    signed = staged(signatures(of), "signatures")
    release(of.sparkSession)
    members = staged(band_members(signed).select("key", "lid", F.col("lid").alias("label")), "bands")
    release(of.sparkSession)
    bits = lambda k: signed.select(F.col("lid").alias(k), F.struct("low", "high").alias(f"s{k}"))
    known, all_lines = None, of
    for _ in range(STARS):
        own = members.groupBy("key").agg(F.min(F.struct("lid", "label")).alias("centre")).select("key", F.col("centre.lid").alias("a"), F.col("centre.label").alias("own"))
        met = members.join(own, "key")
        pairs = met.where("label <> own").select("a", F.col("lid").alias("b")).distinct()
        near = staged(pairs.join(bits("a"), "a").join(bits("b"), "b").where(_near("sa", "sb")).select("a", "b"), "stars")
        found = staged(verified(near, of), "links")
        earlier, known = known, staged(components(found) if known is None else relabelled(known, found), "labels")
        discard(near, found, *([earlier] if earlier else []))
        label = known.withColumnsRenamed({"node": "lid", "label": "to"})
        # a centre has met all of its band; bands whose lines are all connected are done
        rest = met.where("lid <> a").select("key", "lid").join(label, "lid", "left").select("key", "lid", F.coalesce("to", "lid").alias("label"))
        rest = staged(rest, "rest")
        mixed = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        before, members = members, staged(rest.join(mixed, "key", "left_semi"), "bands")
        discard(before, rest)
        if of is all_lines:  # what later rounds read
            of = staged(of.join(members.select("lid").distinct(), "lid", "left_semi").select("lid", "line"), "unconnected")
    return relabelled(known, verified(pairs_within(members, signed, of), of))


def line_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_lines and dropped (positions of the lines that go) of every row; with ``texts`` also ``text``, the lines left.

    Of a component the line of the smallest doc_id stays (nulls last); of
    several rows with that id, the one with the smallest hash of its text, and
    of equal rows one. In a row the first stays. Null text counts as empty.
    Blank lines are neither compared nor dropped. Lines shorter than a shingle
    are one shingle; a very long line is a line like any other. An empty table
    gives no rows. Other columns are not read.
    """
    text = F.col("text").cast("string")
    digests = F.transform(_lines_of(text), lambda x: F.when(_is_line(x), _digest(x)))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"),
        digests.alias("lines"), *([F.coalesce(text, F.lit("")).alias("text")] if texts else []),
    )
    rows = staged(rows, "rows")
    of = staged(different_lines(docs), "lines")
    release(docs.sparkSession)
    labels = line_components(of.select("lid", "line")).withColumnRenamed("node", "lid")
    group = F.coalesce("label", "lid")
    known = staged(of.select("lid", "h", "n").join(labels, "lid", "left").where("n > 1 OR label IS NOT NULL").select("h", "n", group.alias("label")), "known")
    places = rows.select("uid", "doc_id", "th", F.posexplode("lines").alias("at", "h")).where("h IS NOT NULL")
    placed = staged(joined_by_size(places, known, "h", "n").select("uid", "doc_id", "th", "at", "label"), "placed")
    first = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "at", "uid")).alias("first"))
    stays = first.select(F.col("first.uid").alias("uid"), F.col("first.at").alias("at"))
    gone = placed.select("uid", "at").join(stays, ["uid", "at"], "left_anti").groupBy("uid").agg(F.array_sort(F.collect_list("at")).alias("gone"))
    dropped = F.coalesce("gone", F.array().cast("array<int>"))
    out = rows.join(gone, "uid", "left").select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), dropped.alias("dropped"), *(["text"] if texts else []))
    return out.withColumn("text", apply_drops(F.col("text"), F.col("dropped"))) if texts else out


def apply_drops(text: Column, dropped: Column) -> Column:
    """A text without the dropped lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(dropped, i)), "\n")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")
