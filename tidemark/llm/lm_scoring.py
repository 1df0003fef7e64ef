"""Scores of texts by a log-bilinear language model, beside a unigram one.

The tokens of a text are its words, A-Z lower-cased, and one end. A token's
probability has up to three factors. Ids - the end, the ``MODEL_WORDS``
commonest words, and ``BUCKETS`` classes of all other words by their first and
last bytes - are dealt into classes of about twice the root of their number; the
log-bilinear model gives the class after the words before, and the id within its
class. A word that has no id of its own then counts as in the unigram model,
within its bucket. Each factor sums to one, so the whole is normalised.

The model predicts a vector from the vectors of the ``CONTEXT`` ids before
(each weighed by its place) and scores an id by the product with its own vector
and a bias. It is trained by noise-contrastive estimation on all training
documents: every task trains on its share in numpy from the same start, the
results are averaged, row by row as often as a row was used, and a larger share
goes on from there (``ROUNDS``). Scoring takes batched matrix products.

Counts of all words stay a DataFrame. A task holds the ``KNOWN`` commonest
words, of at most ``KNOWN_BYTES`` bytes; the rest of a text's words meet their
counts in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_batches

MODEL_WORDS, BUCKETS, KNOWN, KNOWN_BYTES = 8192, 256, 200_000, 64
#: Ids before the one that is predicted, and numbers in a vector.
CONTEXT, WIDE = 3, 16
#: Noise ids for a batch of classes and for each class's ids, and how far a step goes.
NOISE_CLASSES, NOISE_IDS, RATE = 24, 8, 0.06
#: Tokens of a task's first steps; later a share of what it has seen (one in so many), STEP at most.
FIRST_STEP, SEEN_A_STEP, STEP = 256, 24, 32_768
#: Upper ends of the shares of the training documents, of 64, on which the rounds train: each document is in one.
ROUNDS = (1, 8, 64)
#: Tokens that are scored at once.
CHUNK = 16_384
#: Distinct words of a task's count before it is handed on.
HELD = 300_000
#: The end of a text, as no word is written; before a text's first word stand ends too.
END = b"\n"
#: Models that a task adds up.
FAN_IN = 8
SEED = 12


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2. A row without id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all (binary), A-Z lower-cased; Arrow's ASCII functions know no other letters and white space."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    to = split.offsets.to_numpy()
    return np.diff(before[to - to[0]]), words.filter(real)


def counted(docs: DataFrame) -> DataFrame:
    """word (binary) and n: how often each token occurs in the texts, their ends too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _words(pa.array([], pa.binary()), pa.array([], pa.int64()))
        for batch in batches:
            found = tokens(batch.column(0))[1].value_counts()
            ends = _words(pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64()))
            both = pa.concat_tables([held, _words(*found.flatten()), ends])
            held = both.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
            if held.num_rows >= HELD:
                yield from held.to_batches()
                held = held.slice(0, 0)
        yield from held.to_batches()

    return text_batches(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _words(word: pa.Array, n: pa.Array) -> pa.Table:
    return pa.table({"word": word, "n": n})


def bucket(word: bytes) -> int:
    return zlib.crc32(word[:2] + word[-2:]) % BUCKETS


def _bucket(word: Column) -> Column:
    return F.crc32(F.concat(F.substring(word, 1, 2), F.substring(word, -2, 2))) % BUCKETS


@dataclass
class Vocabulary:
    """What tasks know of the words: the commonest, their counts and ids, and the sums over buckets."""

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray  # of ``words``
    ids: np.ndarray  # of ``words``, that of the bucket for those without one of their own
    own: np.ndarray  # whether a word has one
    end_id: int
    end_count: int
    bucket_ids: np.ndarray
    bucket_log: np.ndarray  # log10 of a bucket's denominator
    id_counts: np.ndarray  # by id, falling

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        """From a staged table of word and n. To the driver come some hundred sums, and ``KNOWN`` words at most."""
        sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
        common = counts.where((F.octet_length("word") <= KNOWN_BYTES) & (F.col("word") != F.lit(END))).withColumn("bin", F.floor(F.log2("n") * 8).cast("int"))
        least, room = None, KNOWN
        for r in sorted(common.groupBy("bin").agg(F.count("*").alias("words")).collect(), reverse=True):
            if r["words"] > room:
                break
            least, room = r["bin"], room - r["words"]
        found = [] if least is None else [(r["word"], r["n"]) for r in common.where(F.col("bin") >= least).select("word", "n").collect()]
        found.sort(key=lambda x: (-x[1], x[0]))
        words, n = [bytes(w) for w, _ in found], np.array([n for _, n in found], dtype=np.int64)
        total_n, total_v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for r in counts.where(F.col("word") != F.lit(END)).groupBy(_bucket(F.col("word")).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            total_n[r["b"]], total_v[r["b"]] = r["n"], r["v"]
        own = np.arange(len(words)) < MODEL_WORDS
        of_bucket = np.array([bucket(w) for w in words], dtype=np.int64)
        np.subtract.at(total_n, of_bucket[own], n[own])
        np.subtract.at(total_v, of_bucket[own], 1)
        raw = np.concatenate([[sums[2]], n[own], total_n])  # the end, the words with an id, the buckets
        order = np.argsort(-raw, kind="stable")
        place = np.empty(len(raw), np.int64)
        place[order] = np.arange(len(raw))
        bucket_ids = place[1 + own.sum() :]
        ids = bucket_ids[of_bucket] if len(words) else np.zeros(0, np.int64)
        ids[own] = place[1 : 1 + own.sum()]
        return cls(int(sums[0]), int(sums[1]), words, n, ids.astype(np.int16), own, int(place[0]), int(sums[2]), bucket_ids.astype(np.int16), np.log10(total_n + total_v + 1.0), raw[order])


_ENCODED = "row bigint, doc_id bigint, held_out boolean, share int, ids binary, n_known bigint, seen double, within double, rest array<struct<word: binary, n: int>>"


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text, held_out): its ids and what is known of its words' counts.

    ``seen`` sums log10(c + 1) over the words that tasks know, ``within`` what
    the words of buckets add; ``rest`` has the other words, whose counts are
    not in yet. ``share`` says in which round a document is trained on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(known.words, pa.binary())
        log = np.log10(known.counts + 1.0)
        of_bucket = np.array([bucket(w) for w in known.words], dtype=np.int64)
        inside = np.where(known.own, 0.0, log - known.bucket_log[of_bucket]) if len(log) else log
        # after the known words' values stands the end's
        ids, log, inside = np.append(known.ids, np.int16(known.end_id)), np.append(log, np.log10(known.end_count + 1.0)), np.append(inside, 0.0)
        for batch in batches:
            sizes, found = tokens(batch.column(4))
            ends = np.cumsum(sizes + 1) - 1
            at = np.full(len(found) + len(sizes), len(words), np.int32)
            real = np.ones(len(at), bool)
            real[ends] = False
            at[real] = pc.fill_null(pc.index_in(found, value_set=words), -1).to_numpy(zero_copy_only=False)
            strange = np.flatnonzero(at < 0)
            coded = found.filter(pa.array(at[real] < 0)).dictionary_encode()
            code, other = coded.indices.to_numpy(), coded.dictionary
            buckets = np.array([bucket(w) for w in other.to_pylist()], dtype=np.int64)[code]
            of, seen, within, there = ids[at], log[at], inside[at], (at >= 0).astype(np.int64)
            of[strange], seen[strange], within[strange] = known.bucket_ids[buckets], 0.0, -known.bucket_log[buckets]
            there[ends] = known.end_count > 0
            starts = ends - sizes
            pairs, n = np.unique(np.searchsorted(ends, strange) * len(other) + code, return_counts=True)
            text = pairs // max(len(other), 1)
            rest = pa.StructArray.from_arrays([other.take(pa.array(pairs - text * len(other))), pa.array(n, pa.int32())], names=["word", "n"])
            rest_to = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (there, seen, within)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array([of[a : b + 1].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), *map(pa.array, sums), pa.ListArray.from_arrays(rest_to, rest)],
                names=["row", "doc_id", "held_out", "share", "ids", "n_known", "seen", "within", "rest"],
            )

    share = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS[-1])).cast("int").alias("share")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", share, F.col("text").cast("string").alias("text"))
    return staged(text_batches(rows).mapInArrow(run, _ENCODED), "encoded")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``."""
    np.negative(x, out=x)
    np.minimum(x, np.float32(60), out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


class LogBilinear:
    """The model's matrices; ``state`` has all of them with what their training has gathered, as one vector a name."""

    MATRICES = ("before", "place", "ids", "bias", "classes", "class_bias")

    def __init__(self, id_counts: np.ndarray):
        n = len(id_counts)
        self.size = int(np.ceil(2 * np.sqrt(n)))  # ids of a class: neighbours by count
        share = (id_counts + 1.0) / (id_counts + 1.0).sum()
        starts = np.arange(0, n, self.size)
        in_class = np.add.reduceat(share, starts)
        of = np.arange(n) // self.size
        self.noise, self.class_noise = (share / in_class[of]).astype(np.float32), in_class.astype(np.float32)
        self.cumulated = [np.cumsum(self.noise[s : s + self.size], dtype=np.float64) for s in starts]
        self.class_cumulated = np.cumsum(self.class_noise, dtype=np.float64)
        self.log_noise, self.class_log_noise = np.log(NOISE_IDS * self.noise), np.log(NOISE_CLASSES * self.class_noise)
        rng = np.random.default_rng(SEED)
        random = lambda rows: (rng.standard_normal((rows, WIDE)) * 0.1).astype(np.float32)
        self.before, self.place = random(n), np.ones((CONTEXT, WIDE), np.float32)
        self.ids, self.bias = random(n), np.log(self.noise)
        self.classes, self.class_bias = random(len(starts)), np.log(self.class_noise)
        self.grown = {k: np.ones(len(getattr(self, k)), np.float32) for k in self.MATRICES}  # squared steps so far, by row
        self.seen = 0  # tokens that a task has trained on, on average
        self.used = {k: np.zeros(len(getattr(self, k)), np.float32) for k in self.MATRICES}

    def _move(self, name: str, some: slice | np.ndarray, step: np.ndarray, times: np.ndarray | float = 1.0) -> None:
        """Go along the gradient ``step`` of some rows, each once, shorter the further they have gone."""
        at, grown = getattr(self, name), self.grown[name]
        grown[some] += np.einsum("rd,rd->r", step, step) / np.float32(step.shape[1]) if step.ndim == 2 else step * step
        rate = RATE / np.sqrt(grown[some])
        at[some] += step * (rate[:, None] if step.ndim == 2 else rate)
        self.used[name][some] += times

    def _contrast(self, q: np.ndarray, rows: np.ndarray, noise: np.ndarray, some: slice, table: str, bias: str, log_noise: np.ndarray, parts: list[tuple[int, int]] | None = None) -> np.ndarray:
        """Tell the data's ``rows`` (sorted) from ``noise`` rows that the whole batch shares, or each of its ``parts`` has of its own; what this asks of q.

        All are rows of the slice ``some`` of a table. ``log_noise``: the log of how often noise has each, of as many draws.
        """
        parts, noise = parts or [(0, len(q))], np.atleast_2d(noise)
        values, offset = getattr(self, table)[some], getattr(self, bias)[some] - log_noise[some]
        own, others, offsets = values[rows], values[noise], offset[noise]
        up = np.einsum("bd,bd->b", q, own)
        up += offset[rows]
        up = _sigmoid(np.negative(up, out=up))
        down = np.empty((len(q), noise.shape[1]), q.dtype)
        for k, (a, b) in enumerate(parts):
            np.matmul(q[a:b], others[k].T, out=down[a:b])
            down[a:b] += offsets[k]
        down = _sigmoid(down)
        own *= up[:, None]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        firsts = rows[starts]
        dv, db, n = np.zeros_like(values), np.zeros_like(offset), np.zeros_like(offset)
        dv[firsts], db[firsts] = np.add.reduceat(up[:, None] * q, starts, axis=0), np.add.reduceat(up, starts)
        n[firsts] = np.diff(starts, append=len(rows))
        asked, total = np.empty(others.shape, q.dtype), np.empty(offsets.shape, q.dtype)
        for k, (a, b) in enumerate(parts):
            mine = down[a:b]
            own[a:b] -= mine @ others[k]
            np.matmul(mine.T, q[a:b], out=asked[k])
            mine.sum(axis=0, out=total[k])
        np.subtract.at(dv, noise.ravel(), asked.reshape(-1, asked.shape[2]))
        np.subtract.at(db, noise.ravel(), total.ravel())
        n[noise] += 1
        # rows without a step stay as they are
        moved = np.flatnonzero(n)
        at = moved + (some.start or 0)
        self._move(table, at, dv[moved], n[moved])
        self._move(bias, at, db[moved], n[moved])
        return own

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The vectors that the ids before (a row each, the nearest first) predict."""
        q = (self.before * self.place[0])[before[:, 0]]
        for c in range(1, CONTEXT):
            q += (self.before * self.place[c])[before[:, c]]
        return q

    def step(self, ids: np.ndarray, before: np.ndarray, rng: np.random.Generator) -> None:
        """One step on a batch of ids and the ids before each."""
        order = np.argsort(ids, kind="stable")
        ids, before = ids[order].astype(np.int64), before[order]
        q = self.predicted(before)
        of = ids // self.size
        drawn = np.searchsorted(self.class_cumulated, rng.random(NOISE_CLASSES) * self.class_cumulated[-1], side="right")
        noise = np.minimum(drawn, len(self.class_noise) - 1)
        dq = self._contrast(q, of, noise, slice(0, len(self.class_noise)), "classes", "class_bias", self.class_log_noise)
        ends = np.flatnonzero(np.concatenate((of[1:] != of[:-1], [True]))) + 1
        drawn = rng.random((len(ends), NOISE_IDS))
        parts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        noise = np.empty(drawn.shape, np.int64)
        for k, (a, _) in enumerate(parts):
            chances = self.cumulated[of[a]]
            noise[k] = np.minimum(np.searchsorted(chances, drawn[k] * chances[-1], side="right"), len(chances) - 1) + of[a] * self.size
        dq += self._contrast(q, ids, noise, slice(0, len(self.ids)), "ids", "bias", self.log_noise, parts)
        asked, times, places = np.zeros_like(self.before), np.zeros(len(self.before), np.float32), np.zeros_like(self.place)
        for c in range(CONTEXT):  # what an id is asked for at a place is the sum over where it stands there
            by = np.argsort(before[:, c], kind="stable")
            there = before[by, c]
            starts = np.flatnonzero(np.concatenate(([True], there[1:] != there[:-1])))
            which, sums = there[starts], np.add.reduceat(dq[by], starts, axis=0)
            places[c] = np.einsum("bd,bd->d", sums, self.before[which])
            asked[which] += sums * self.place[c]
            times[which] += np.diff(np.append(starts, len(there)))
        rows = np.flatnonzero(times)
        self._move("place", np.arange(CONTEXT), places)
        self._move("before", rows, asked[rows], times[rows])

    def log10(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of ids after the ids before each."""
        if not len(ids):
            return np.zeros(0)
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order].astype(np.int64)
        q = self.predicted(before[order])
        of = sorted_ids // self.size
        out = _log_share(_scores(q, self.classes, self.class_bias), of).astype(np.float64)
        ends = np.flatnonzero(np.concatenate((of[1:] != of[:-1], [True]))) + 1
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            low = of[a] * self.size
            out[a:b] += _log_share(_scores(q[a:b], self.ids[low : low + self.size], self.bias[low : low + self.size]), sorted_ids[a:b] - low)
        back = np.empty(len(ids), np.float64)
        back[order] = out / np.log(10)
        return back

    # --- averaging ---

    def state(self) -> np.ndarray:
        """Every matrix times how often its rows were used, and those numbers: vectors of several models add up."""
        out = []
        for k in self.MATRICES:
            at, n = getattr(self, k), self.used[k].astype(np.float64)
            out += [(at * (n[:, None] if at.ndim == 2 else n)).ravel(), self.grown[k] * n, n]
        return np.concatenate(out)

    def take(self, total: np.ndarray) -> None:
        """Become the mean of the models whose states add up to ``total``; rows that none used stay."""
        at = 0
        for k in self.MATRICES:
            own = getattr(self, k)
            v, g, n = (total[at + a : at + b] for a, b in ((0, own.size), (own.size, own.size + len(own)), (own.size + len(own), own.size + 2 * len(own))))
            at += own.size + 2 * len(own)
            used = n > 0
            own[used] = (v.reshape(own.shape)[used] / (n[used][:, None] if own.ndim == 2 else n[used])).astype(np.float32)
            self.grown[k][used] = (g[used] / n[used]).astype(np.float32)
            self.used[k][:] = 0


def _scores(q: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = q @ table.T
    out += bias
    return out


def _log_share(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log of the chosen column's share of each row's exponentials; ``scores`` is used up."""
    own = scores[np.arange(len(chosen)), chosen]
    if np.abs(own).max() > 40 or scores.max() > 40:  # where exponentials might not fit, each row by its largest
        most = scores.max(axis=1)
        return own - most - np.log(np.exp(scores - most[:, None]).sum(axis=1))
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _with_before(texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of several texts, one after another, the ids before each, and where the texts begin."""
    parts = [np.frombuffer(t, np.int16) for t in texts]
    starts = np.cumsum([0, *(len(p) + CONTEXT for p in parts)])
    padded = np.full(starts[-1], end, np.int16)
    real = np.zeros(starts[-1], bool)
    for s, p in zip(starts, parts, strict=False):
        padded[s + CONTEXT : s + CONTEXT + len(p)] = p
        real[s + CONTEXT : s + CONTEXT + len(p)] = True
    at = np.flatnonzero(real)
    return padded[at], np.stack([padded[at - k] for k in range(1, CONTEXT + 1)], axis=1), np.cumsum([0, *(len(p) for p in parts)])


def trained(rows: DataFrame, known: Vocabulary) -> LogBilinear:
    """The model, from the rows of ``encoded`` that are not held out. To the driver comes one model a round."""
    model, low = LogBilinear(known.id_counts), 0
    end = known.end_id

    for high in ROUNDS:

        def train(batches: Iterator[pa.RecordBatch], start: LogBilinear = model) -> Iterator[pa.RecordBatch]:
            rng, ids, before, seen = np.random.default_rng(SEED), np.zeros(0, np.int16), np.zeros((0, CONTEXT), np.int16), start.seen
            for batch in batches:
                more, context, _ = _with_before(batch.column(0).to_pylist(), end)
                ids, before, a = np.concatenate([ids, more]), np.concatenate([before, context]), 0
                while len(ids) - a >= (n := min(STEP, max(FIRST_STEP, seen // SEEN_A_STEP))):
                    start.step(ids[a : a + n], before[a : a + n], rng)
                    a, seen = a + n, seen + n
                ids, before = ids[a:], before[a:]
            if len(ids):
                start.step(ids, before, rng)
                seen += len(ids)
            if seen > start.seen:
                yield pa.RecordBatch.from_arrays([pa.array([np.append(start.state(), (seen, 1.0)).tobytes()], pa.binary())], names=["state"])

        mine = text_batches(rows.where(~F.col("held_out") & (F.col("share") >= low) & (F.col("share") < high)).select("ids"))
        low = high
        states = staged(mine.mapInArrow(train, "state binary"), "models")
        while (n := states.count()) > 1:
            states = staged(states.repartition(-(-n // FAN_IN)).mapInArrow(_added, "state binary"), "models")
        if (total := states.first()) is not None:
            *_, seen, tasks = total = np.frombuffer(total["state"])
            model.take(total[:-2])
            model.seen = int(seen / tasks)
    return model


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for state in batch.column(0):
            one = np.frombuffer(state.as_py())
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["state"])


def scored(rows: DataFrame, counts: DataFrame, known: Vocabulary, model: LogBilinear) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``encoded``."""
    end = known.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, before, starts = _with_before(batch.column(0).to_pylist(), end)
            each = np.concatenate([np.zeros(0), *(model.log10(ids[a : a + CHUNK], before[a : a + CHUNK]) for a in range(0, len(ids), CHUNK))])
            sums = np.add.reduceat(each, starts[:-1])  # no text is without its end
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.float64())], names=[*light, "n_tokens", "by_model"])

    light = ["row", "doc_id", "held_out", "n_known", "seen", "within"]
    out = "row bigint, doc_id bigint, held_out boolean, n_known bigint, seen double, within double, n_tokens bigint, by_model double"
    by_model = text_batches(rows.select("ids", *light)).mapInArrow(run, out)
    words = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))
    rest = words.join(counts, "word", "left").groupBy("row").agg(F.sum(log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    both = by_model.join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    whole = float(np.log10(known.total + known.distinct + 1.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("seen") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("by_model") + F.col("within") + more).alias("score"),
    )


def score(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs``: see ``scored``; learnt from the rows that are not ``held_out``.

    A null text is empty and has one token, its end; rows without an id are
    held out; repeated rows count as often as they occur. Without a row to
    learn from, every token is unknown and has a base score of 0. An empty
    table gives no rows; other columns are not read. Averages depend on how
    rows are dealt to tasks, so scores differ a little where that differs.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = staged(counted(own.where("NOT held_out")), "counts")
    known = Vocabulary.of(counts)
    rows = encoded(own, known)
    return scored(rows, counts, known, trained(rows, known))


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
