"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over the run, piecewise linear in training
time: a table of (source, time, weight) that the caller gives, or a rule. Its
integral, scaled to the source's target, is the source's cumulative token
demand; a source's documents, in a keyed random order, fill that demand one
after another, and the time at which the demand reaches a document's first word
is the document's training position. Documents are then sorted by range of
position.

Cumulative sums are taken in two levels, so that a source with a third of all
rows is no single task's: sums by slice of the keyed order, prefix sums over
the slices' totals, then sums within a slice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_names, staged

#: Weights that sources take in turn, by code point of their names.
WEIGHTS = (5, 2, 1)
#: No source is repeated more than this often.
EPOCHS = 3
#: Rows of a source's slice at most, on average, were all rows one source's.
ROWS_A_SLICE = 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target by source of ``sized`` (source, size).

    Sources, sorted by code point with null last, take the weights in turn
    and share the total of all sizes. No target exceeds ``epochs`` times its
    source's size; the excess is shared out again by weight until none does.
    That end state is a water level: with sources sorted by how soon they
    fill, a source is full if its limit is under the level that the rest
    would get.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    weighed = by.withColumn("weight", ratio.cast("bigint")).withColumn("limit", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy()
    levelled = weighed.select(
        "source", "source_size", "weight", "limit",
        ((F.sum("source_size").over(total) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double")).alias("level"),
    )
    full = F.col("limit").cast("double") <= F.col("weight").cast("double") * F.col("level")
    # the levels rise to the first source that is not full and fall after it
    level = F.max(F.when(~full, F.col("level"))).over(total)
    share = F.when(full, F.col("limit").cast("double")).otherwise(F.col("weight").cast("double") * level)
    return levelled.select("source", "source_size", share.alias("target"), (F.row_number().over(order) - 1).alias("rank"))


def _slope(rank: Column) -> Column:
    """The rule where no schedule is given: weights rise, fall or stay, in turn by rank, from 1 + s to 1 - s."""
    return F.when(rank % 3 == 0, F.lit(0.5)).when(rank % 3 == 1, F.lit(-0.5)).otherwise(F.lit(0.0))


_PIECES = "array<struct<t0: double, t1: double, w0: double, w1: double, a0: double, a1: double>>"


def pieces_of(points: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(t0, t1, w0, w1, a0, a1) of each linear piece of a schedule's (time, weight) points.

    Times run from 0 to 1; before the first and after the last point the weight
    stays. a0 and a1 are the integral up to the piece's ends, scaled to 1 at
    time 1; pieces without an integral are left out, as nothing is due there.
    """
    points = sorted(points)
    if not points or points[0][0] < 0 or points[-1][0] > 1 or any(w < 0 for _, w in points):
        raise ValueError("a schedule needs times from 0 to 1 and weights of 0 or more")
    points = [(0.0, points[0][1]), *points, (1.0, points[-1][1])]
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False):
        more = (t1 - t0) * (w0 + w1) / 2
        if more:
            out.append([t0, t1, w0, w1, area, area := area + more])
    if not area:
        raise ValueError("a schedule without weight")
    return [(t0, t1, w0 / area, w1 / area, a0 / area, a1 / area) for t0, t1, w0, w1, a0, a1 in out]


def with_pieces(by: DataFrame, schedule: Iterable[tuple[str | None, float, float]] | None) -> DataFrame:
    """``by`` (source, rank, ...) with the pieces of each source's schedule; sources without points keep one weight."""
    if schedule is None:
        slope, double = _slope(F.col("rank")), lambda x: F.lit(float(x))
        return by.withColumn("pieces", F.array(F.struct(double(0).alias("t0"), double(1).alias("t1"), (1 + slope).alias("w0"), (1 - slope).alias("w1"), double(0).alias("a0"), double(1).alias("a1"))))
    points: dict[str | None, list[tuple[float, float]]] = {}
    for source, time, weight in schedule:
        points.setdefault(source, []).append((float(time), float(weight)))
    rows = [(source, pieces_of(p)) for source, p in points.items()]
    given = by.sparkSession.createDataFrame(rows, f"__of string, pieces {_PIECES}")
    joined = by.join(F.broadcast(given), F.col("source").cast("string").eqNullSafe(F.col("__of")), "left").drop("__of")
    constant = F.array(F.struct(*(F.lit(x).alias(n) for n, x in zip(("t0", "t1", "w0", "w1", "a0", "a1"), pieces_of([(0.0, 1.0)])[0], strict=True))))
    return joined.withColumn("pieces", F.coalesce("pieces", constant))


def invert_demand(share: Column, pieces: Column) -> Column:
    """The time by which ``share`` of a source's target is due: where the integral of its schedule reaches it."""
    piece = F.try_element_at(F.filter(pieces, lambda p: p["a1"] >= share), F.lit(1))
    p = F.coalesce(piece, F.element_at(pieces, -1))
    slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
    rest = F.greatest(share - p["a0"], F.lit(0.0))
    root = F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * rest, F.lit(0.0)))
    return p["t0"] + F.when(slope == 0, rest / p["w0"]).otherwise((root - p["w0"]) / slope)


def assign(docs: DataFrame, key: Column | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, schedule: Iterable[tuple[str | None, float, float]] | None = None) -> DataFrame:
    """Every row of ``docs``, but its text, with size, source_size, target, copies, taken and positions.

    ``schedule``: (source, time, weight) points, linear between them; by
    default a rule's. A source's documents stand in the order of ``key`` (by
    default an MD5 of the id; of rows with one key the smaller first, then by a
    hash of the text); ``target`` words are
    laid along that order again and again, and a copy is taken if the mix
    reaches its middle. ``positions`` has the training time (0 to 1) of each
    copy's first word. Null text has size 0 and is not taken; null sources are
    one source; a null id is ordered as the text ``null``. Repeated rows count
    as rows of their own. An empty table gives no rows. Other columns pass
    through; names that begin with two underscores are the operator's. Sources
    are ranked in one task, a row each.
    """
    # texts are read once, for their sizes
    text = F.col("text").cast("string")
    sized = staged(docs.withColumn("size", word_count(text)).withColumn("__tie", F.xxhash64(text)).drop("text"), "sizes")
    digits, n = 2, sized.count()
    while 16**digits * ROWS_A_SLICE < n and digits < 8:
        digits += 1
    by = with_pieces(targets(sized.select("source", "size"), weights, epochs), schedule).withColumnsRenamed({"source": "__source", "pieces": "__pieces"})
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) if key is None else key
    keyed = sized.withColumn("__key", key).withColumn("__slice", F.substring("__key", 1, digits))
    slices = keyed.groupBy("source", "__slice").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("source").alias("__s"), F.col("__slice").alias("__sl"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"))
    starts = starts.join(by, F.col("__s").eqNullSafe(F.col("__source"))).drop("__source")
    inside = Window.partitionBy("source", "__slice").orderBy("__key", "size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__sl")))
    first = (F.col("__start") + F.col("__in")).cast("double")
    begins = [first + e * F.col("source_size") for e in range(epochs)]
    taken = [(F.col("size") > 0) & (b + F.col("size") / 2 <= F.col("target")) for b in begins]
    placed = placed.withColumn("copies", sum((t.cast("int") for t in taken), F.lit(0)))
    at = [invert_demand(F.least(b / F.col("target"), F.lit(1.0)), F.col("__pieces")) for b in begins]
    return placed.select(
        *(c for c in docs.columns if c not in ("text", "size")), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.array_compact(F.array(*(F.when(t, p) for t, p in zip(taken, at, strict=True)))).alias("positions"),
    )


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per taken copy with its ``position``, sorted by range of position."""
    copies = assigned.withColumn("position", F.explode("positions")).drop("positions")
    parts = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionByRange(parts, "position").sortWithinPartitions("position", "doc_id")


@own_names
def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, once for each copy the mix takes, sorted by range of position.

    The mix is worked out on ids, sources and sizes; the texts meet their
    positions on (id, hash of the text), and repeated rows there are told
    apart by number.
    """
    key = [F.col("doc_id").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("__th")]
    light = docs.select(*key, F.col("source"), F.col("text"))
    copies = assign(light).where("copies > 0").select("doc_id", "__th", "source", "positions")
    row = F.row_number().over(Window.partitionBy("doc_id", "__th", "source").orderBy("__th"))
    chosen = copies.withColumn("__row", row).select(F.col("doc_id").alias("__i"), F.col("__th").alias("__t"), F.col("source").alias("__s"), F.col("__row").alias("__r"), "positions")
    texts = docs.withColumn("__th", key[1]).withColumn("__row", row)
    same = F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__t")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__row") == F.col("__r"))
    taken = texts.join(chosen.withColumnRenamed("positions", "__positions"), same).withColumn("__position", F.explode("__positions"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartitionByRange(parts, "__position").sortWithinPartitions("__position", "doc_id").select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = assign(docs.select("doc_id", "source", "text"))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.try_element_at("positions", F.lit(1)).alias("first_position"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the order in which training meets them; those not taken come last
    return rows.repartitionByRange(parts, F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS lim,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT
             - coalesce((sum(lim) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM w),
t AS (
  SELECT source, source_size, rnk,
         CASE WHEN lim::DOUBLE <= weight::DOUBLE * lvl THEN lim::DOUBLE
              ELSE weight::DOUBLE * max(CASE WHEN lim::DOUBLE > weight::DOUBLE * lvl THEN lvl END) OVER () END AS target
  FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk,
         coalesce((sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0)::DOUBLE AS beg
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
         (beg + size::DOUBLE / 2 <= target)::INT + (beg + source_size + size::DOUBLE / 2 <= target)::INT + (beg + 2 * source_size + size::DOUBLE / 2 <= target)::INT END AS copies,
         CASE rnk % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS slope
  FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies,
       CASE WHEN copies = 0 THEN NULL WHEN slope = 0 THEN least(beg / target, 1.0::DOUBLE)
            ELSE (1 + slope - sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * least(beg / target, 1.0::DOUBLE), 0.0::DOUBLE))) / (2 * slope) END AS first_position
FROM n
"""
