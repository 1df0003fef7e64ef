"""Language ID by error-correcting output codes.

Every language has a codeword; for each bit a binary n-gram classifier tells
the languages with a 1 from those with a 0. A text's bits are predicted
together, and decoding picks the language whose codeword has the smallest
loss over all bits, each weighed by how sure its classifier is. Where the two
best codewords are nearly as good, the text is flagged as ambiguous.

The classifiers are naive Bayes over hashed byte n-grams (1 to 3 bytes of the
lower-cased text), so that training is a sum of counts by language that Spark
adds up. They are fitted on at most ``PER_LANGUAGE`` labelled rows of each
language, drawn by a hash of the id; predictions read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

UNDETERMINED = "und"
#: Labelled rows a language is learned from at most (in expectation).
PER_LANGUAGE = 3000
#: Hashed n-grams.
FEATURES = 1 << 13
#: n-grams that count as independent evidence at most; keeps scores of long texts below certainty.
EVIDENCE = 60
#: Gap between the best two scores under which a text is ambiguous.
AMBIGUOUS = 0.02
#: n-grams that a training text counts as at most, so that no long text outweighs the others; its shares are of all it has.
WEIGHT = 3000
#: Tasks that count the training rows.
TRAIN_TASKS = 16
#: Bytes whose n-grams are hashed at once.
BLOCK = 1 << 20
_SMOOTH = 0.5


def features(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the lower-cased text's UTF-8 bytes."""
    data = text.lower().encode("utf-8", "replace")
    out = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data[max(0, at - 2) : at + BLOCK], dtype=np.uint8).astype(np.uint32)
        skip = min(at, 2)  # the bytes before are there for the n-grams that end in this block
        for n, mult in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
            if len(b) >= n:
                g = np.zeros(len(b) - n + 1, dtype=np.uint32)
                for j in range(n):
                    g = (g << np.uint32(8)) | b[j : len(b) - n + 1 + j]
                g = g[max(0, skip - n + 1) :]
                out += np.bincount(((g + np.uint32(n)) * np.uint32(mult)) >> np.uint32(19), minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def codewords(languages: int) -> np.ndarray:
    """Codewords of +1 and -1, one row a language.

    Up to 7 languages: the exhaustive code, every split of the languages once.
    More: bits drawn by a fixed generator, 15 for each doubling of the number.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 7:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.where(splits[None, :] >> np.arange(languages)[:, None] & 1, 1.0, -1.0)
    rng, bits = np.random.default_rng(7), 15 * int(np.ceil(np.log2(languages)))
    code = rng.choice([-1.0, 1.0], size=(languages, bits))
    code[0], code[1] = np.abs(code[0]), -np.abs(code[1])  # both values in every column
    return code[rng.permutation(languages)]


@dataclass
class Model:
    """Languages, their codewords and the bits' weights by feature."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        known = np.array([has_letter(t) for t in texts], dtype=bool) if self.languages else np.zeros(len(texts), dtype=bool)
        names = np.full(len(texts), UNDETERMINED, dtype=object)
        score, gap = np.zeros(len(texts)), np.ones(len(texts))
        at = np.flatnonzero(known)
        if len(at):
            counts = np.stack([features(texts[i]) for i in at])
            total = counts.sum(axis=1, keepdims=True)
            margin = (counts @ self.weights) / total * np.minimum(total, EVIDENCE)
            # logistic loss of every bit of every codeword, weighed by the margin it comes from
            loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).mean(axis=2)
            chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
            chance /= chance.sum(axis=1, keepdims=True)
            best = chance.argmax(axis=1)
            names[at] = np.array(self.languages, dtype=object)[best]
            score[at] = chance[np.arange(len(at)), best]
            gap[at] = score[at] - (np.sort(chance, axis=1)[:, -2] if len(self.languages) > 1 else 0)
        return names.tolist(), score, gap < AMBIGUOUS


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A row without id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of the relative n-gram counts by language, one row a language and task."""
    sums: dict[str, np.ndarray] = {}
    for pdf in frames:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            c = features(text)
            if c.any():
                sums[lang] = sums.get(lang, 0) + c * (min(c.sum(), WEIGHT) / c.sum())
    if sums:
        yield pd.DataFrame({"lang": list(sums), "counts": [v.astype("<f8").tobytes() for v in sums.values()]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype="<f8") for x in pdf["counts"])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.tobytes()]})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows with a language and a text that are not held out.

    To the driver come one row of counts a language, FEATURES numbers each, so
    ``lang`` must hold languages, some hundreds at most. Repeated rows are as
    many rows; an empty table gives a model that tells nothing.
    """
    rows = text_batches(docs).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return Model([], codewords(0), np.zeros((FEATURES, 1)))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*(x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    sample = rows.where(drawn < F.element_at(share, F.col("lang"))).select("lang", "text").repartition(TRAIN_TASKS)
    counted = sample.mapInPandas(_count, "lang string, counts binary").groupBy("lang").applyInPandas(_add, "lang string, counts binary")
    found = {r["lang"]: np.frombuffer(r["counts"], dtype="<f8") for r in counted.collect()}
    languages = sorted(found)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((FEATURES, 1)))
    counts = np.stack([found[k] for k in languages])
    log_odds = []
    for bit in code.T:
        sides = [counts[bit == v].sum(axis=0) + _SMOOTH for v in (1.0, -1.0)]
        log_odds.append(np.log(sides[0] / sides[0].sum()) - np.log(sides[1] / sides[1].sum()))
    return Model(languages, code, np.stack(log_odds, axis=1))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and ambiguous.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text where nothing was learned. Very long texts are read whole, in
    blocks; of languages with equal scores the first by name is given, and the
    text is flagged. Columns of those names are replaced. Repeated rows have a
    row each, an empty table gives none.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *added])
    at = keep.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                texts = [None if t is None else str(t) for t in part.column(at).to_pylist()]
                names, score, ambiguous = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
                    names=[*keep, "lang_pred", "score", "ambiguous"],
                )

    return text_batches(docs).select(*keep).mapInArrow(run, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told.

    Rejected are texts without a letter or null, and ambiguous ones, in which
    the two best languages score the same within ``AMBIGUOUS``. Where there
    are no labelled rows nothing can be told, and only texts without a letter
    are rejected.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns may be called as the operator's own
    plain = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")
    rows = predict(plain, model).where(f"lang_pred <> '{UNDETERMINED}' AND NOT ambiguous").drop("lang_pred", "score", "ambiguous")
    return rows.toDF(*docs.columns)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
