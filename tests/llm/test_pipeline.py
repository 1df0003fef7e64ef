"""The pipeline's rows against a plain version of its stages."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import bpe, language_id, mixing

DATA = Path("/root/testdata/sf0.001")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = lowered(text).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def keep_of_near(docs):
    """The smallest id of each component of texts whose five-word shingles have a likeness of 0.8."""
    ids, sets = list(docs), {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i for i in ids if root(i) == i}


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_the_pipelines_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    table = docs.toPandas()
    told = {r["doc_id"] for r in language_id.keep_identified(docs).select("doc_id").collect()}
    letters = {i for i, t in zip(table["doc_id"], table["text"], strict=True) if t and any(c.isalpha() for c in t)}
    assert told <= letters and len(letters - told) <= 0.02 * len(letters)
    texts = {i: t for i, t in zip(table["doc_id"], table["text"], strict=True) if i in told}
    last = {lowered(texts[i]): i for i in sorted(texts)}
    one = {i: texts[i] for i in last.values()}
    near = keep_of_near(one)
    documents = table[table["doc_id"].isin(near)]  # noqa: F841 - read by name below
    mixed = duckdb.sql(mixing.OP5_SQL).df()
    tok = bpe.load(bpe.default_path())
    want = Counter()
    for row in mixed.itertuples():
        ids = tok.encode(texts[row.doc_id], add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += row.copies
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(DATA)).collect()))
    assert got == +want


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": ["one two three four five six", "sieben acht neun"], "lang": ["en", "de"], "source": ["a", None], "n_chars": [5, 6]}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs, "").columns) == set(docs.columns), name


ODD_COLUMNS = ["__id", "__th", "__digest", "__row", "__position", "kept", "rows", "digest", "node", "label", "position", "c0", "positions"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_that_clash_come_back_as_they_were(spark, name):
    texts = [f"these are some words of an ordinary text of which there are several, number {i} and {i * 7}" for i in range(12)]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(12), "text": texts, "lang": ["en"] * 12, "source": ["a", "b"] * 6, "n_chars": [5] * 12} | {c: [f"{c}{i}" for i in range(12)] for c in ODD_COLUMNS}))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    got = {tuple(r) for r in out.collect()}
    assert got and got <= {tuple(r) for r in docs.collect()}


def test_near_duplicates_without_ids_leave_one(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    words = base.split()
    near = lambda i: " ".join(words[:-1] + [f"end{i}"])
    other = " ".join(f"word{i}" for i in range(60))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    out = stage(spark, spark.createDataFrame([(None, near(1), "en", "a", 1), (None, near(2), "en", "a", 1), (None, near(2), "en", "a", 1), (None, other, "en", "a", 1)], schema), "")
    assert sorted(r["text"][:5] for r in out.collect()) == ["alpha", "word0"]
    # one id in two components: each keeps its own
    out = stage(spark, spark.createDataFrame([(1, near(1), "en", "a", 1), (2, near(2), "en", "a", 1), (1, other, "en", "a", 1)], schema), "")
    assert sorted(r["text"][:5] for r in out.collect()) == ["alpha", "word0"]
