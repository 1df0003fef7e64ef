"""Merkle manifest, language-model scores and spelling variants: against brute force, and on rows that are odd."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm_scoring, merkle, spelling

from test_llm import ODD, frame

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def lowered(text):
    return text.encode().lower().decode()


# --- the manifest ---


def leaf(row):
    return sha("".join("-" if (v := row[c]) is None else f"{len(str(v).encode())}:{v}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(nodes):
    """Root, and each node's path of (left, right) siblings."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for k, i in enumerate(at):
            run = now[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
            at[k] = i // 8
        now = [sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)]
    return now[0], paths


def brute_manifest(rows):
    by, out = defaultdict(list), []
    for r in rows:
        by[r["lang"]].append(r)
    names = sorted(by, key=lambda n: (n is not None, (n or "").encode()))
    found = {}
    for n in names:
        by[n].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        found[n] = tree([leaf(r) for r in by[n]])
    root, upper = tree([found[n][0] for n in names])
    for n, above in zip(names, upper, strict=True):
        for r, path in zip(by[n], found[n][1], strict=True):
            path = path + above
            shown = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                shown["text"] = lowered(r["text"])
            now = leaf(shown)
            for left, right in path:
                now = sha("".join(left) + now + "".join(right))
            out.append((r["doc_id"], leaf(r), found[n][0], root, sha("".join("".join(a + b) for a, b in path)), now, now == root))
    return out


def manifest_rows(docs):
    return [tuple(r) for r in merkle.manifest(docs, merkle.third_lowered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def some_documents(n, seed=5):
    rng = random.Random(seed)
    lang = lambda i: rng.choice(["en", "en", "en", "en", "de", "é", "", None]) if i % 70 else f"one{i}"
    return [(rng.randrange(n), rng.choice(["A Text", "lower", "", None, "Ünï " * 9]), lang(i), rng.choice(["s", None]), rng.choice([3, None])) for i in range(n)]


@pytest.mark.parametrize("rows", [some_documents(700), some_documents(9), ODD, ODD[:1], [(i, "T", "en", "s", 1) for i in range(65)]], ids=["many", "few", "odd", "one", "hot"])
def test_a_manifest_is_that_of_brute_force(spark, rows):
    same(manifest_rows(frame(spark, rows)), brute_manifest([dict(zip(COLUMNS, r, strict=True)) for r in rows]))


def test_an_empty_manifest(spark):
    assert manifest_rows(frame(spark, [])) == []


def test_a_manifest_finds_any_change_and_nothing_else(spark):
    rows = some_documents(80)
    first = merkle.manifest(frame(spark, rows))
    assert first.where("NOT verified").isEmpty()
    changed = [*rows[:40], (*rows[40][:4], 99), *rows[41:]]
    assert merkle.manifest(frame(spark, changed)).first()["root"] != first.first()["root"]
    shuffled = random.Random(1).sample(rows, len(rows))
    assert merkle.manifest(frame(spark, shuffled).repartition(7)).first()["root"] == first.first()["root"]


# --- spelling variants ---


def brute_counts(rows, noise=199):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", lowered(text or "")):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 6})


def edits(a, b):
    """Levenshtein distance."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def brute_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in counts}
    form = {w: b for w in counts if near[w] and counts[b := min(near[w], key=lambda v: (-counts[v], v))] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()]


def some_words(seed, n, letters="abé", shared=""):
    rng = random.Random(seed)
    return {shared + "".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))): 5 ** rng.randrange(1, 6) + rng.randrange(3) for _ in range(n)}


@pytest.mark.parametrize(("words", "met"), [(some_words(1, 150), 48), (some_words(2, 150), 2), (some_words(3, 120, shared="x" * 40), 4), (some_words(4, 60, "a"), 1), ({"solely": 7}, 48), ({}, 48)], ids=["few", "crowded", "one half", "one letter", "alone", "none"])
def test_variants_are_those_of_brute_force(spark, monkeypatch, words, met):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (met,))
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    same([tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()], brute_variants(words))


def test_forms_lead_on_to_a_root(spark):
    chain = {"aaaaaaab"[:7] + "b": 5, "aaaaaabb": 25, "aaaaabbb": 125, "aaaabbbb": 625, "aaabbbbb": 3125}
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n bigint")).collect()}
    assert set(got.values()) == {"aaabbbbb"}


def test_counts_lose_a_letter_where_the_checksum_says(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(50)]), " ".join(rng.choice(["Ölpreis", "ÖLPREIS", "Éclairs", "streets", "ab×÷cd", "w3ird", "short", "a" * 3000]) for _ in range(40)), "en", "s", 1) for _ in range(60)]
    got = spelling.counted(frame(spark, [*rows, *ODD]), noise=7).collect()
    assert {r["word"]: r["n"] for r in got} == brute_counts([(r[0], r[1]) for r in [*rows, *ODD]], 7)


def test_variants_of_odd_and_no_documents(spark):
    assert spelling.counted(frame(spark, [])).isEmpty() and spelling.variants(spelling.counted(frame(spark, []))).isEmpty()
    got = spelling.variants(spelling.counted(frame(spark, ODD)))
    same([tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()], brute_variants(brute_counts([r[:2] for r in ODD])))


# --- language-model scores ---


def brute_base(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lowered(t or "")) + ["\n"]
    out_of = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out_of(i) for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    return [(i, out_of(i), len(w := split(t)), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 6)) for i, t in rows]


def base_rows(df):
    return [(*r[:5], round(r[5], 6)) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]


PROSE = {"a": "the cat sat on the mat and the dog ran after it".split(), "b": "le chat est sur la table et un chien court bien".split()}


def prose(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(PROSE[k]) + (str(rng.randrange(400)) if rng.random() < 0.2 else "") for _ in range(60)), None, k, 1) for i in range(n) for k in [rng.choice("ab")]]


@pytest.mark.parametrize("known", [100_000, 6, 0])
def test_base_scores_are_exact_whatever_tasks_know(spark, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    rows = [*prose(40), *ODD]
    same(base_rows(lm_scoring.score(frame(spark, rows))), brute_base([r[:2] for r in rows]))


def test_scores_beat_the_base_on_what_is_held_out(spark):
    out = lm_scoring.score(frame(spark, prose(400))).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (out["s"] - out["b"]) / out["n"] > 0.1  # log10 a token; the two languages alone are worth 0.3 at most


def test_probabilities_sum_to_one():
    model, rng = lm_scoring.LogBilinear(np.array([50, 30, 9, 5, 5, 1, 0, 0, 0, 0, 0])), np.random.default_rng(1)
    for _ in range(5):
        ids = rng.integers(0, 11, 64).astype(np.int16)
        model.step(ids, rng.integers(0, 11, (64, lm_scoring.CONTEXT)).astype(np.int16), rng)
    before = np.repeat(rng.integers(0, 11, (1, lm_scoring.CONTEXT)).astype(np.int16), 11, axis=0)
    assert abs((10 ** model.log10(np.arange(11, dtype=np.int16), before)).sum() - 1) < 1e-5


def test_words_of_a_bucket_sum_to_one(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}x".encode()), 1 + i % 4) for i in range(3000)] + [(bytearray(b"\n"), 9)], "word binary, n bigint")
    lm_scoring.MODEL_WORDS, kept = 100, lm_scoring.MODEL_WORDS
    try:
        known = lm_scoring.Vocabulary.of(counts)
    finally:
        lm_scoring.MODEL_WORDS = kept
    mass = Counter()
    for w, n, own in zip(known.words, known.counts, known.own, strict=True):
        if not own:
            mass[b := lm_scoring.bucket(w)] += (n + 1) / 10 ** known.bucket_log[b]
    for b, seen in mass.items():
        assert abs(seen + 1 / 10 ** known.bucket_log[b] - 1) < 1e-9  # and one for all words that were never seen


def test_models_of_several_tasks_average_by_use():
    a, b = (lm_scoring.LogBilinear(np.array([5, 3, 1, 1])) for _ in range(2))
    start = a.ids.copy()
    a.ids[0], a.used["ids"][0] = 1.0, 3
    b.ids[0], b.used["ids"][0] = 5.0, 1
    mean = lm_scoring.LogBilinear(np.array([5, 3, 1, 1]))
    mean.take(a.state() + b.state())
    assert np.allclose(mean.ids[0], 2.0) and np.allclose(mean.ids[1:], start[1:])


def test_the_gradient_of_the_contrast():
    """The step on q is the derivative of the contrastive objective, by differences."""
    m = lm_scoring.LogBilinear(np.array([40, 20, 10, 5, 3, 2, 1, 1, 1]))
    m._move = lambda *a: None  # hold still
    rng = np.random.default_rng(2)
    q, rows, noise = rng.standard_normal((1, lm_scoring.WIDE)), np.array([2]), np.array([0, 1, 2])
    def gain(q):
        s = lambda r: q @ m.ids[r].T.astype(float) + m.bias[r] - m.log_noise[r]
        return float(np.log(1 / (1 + np.exp(-s(rows)))).sum() + np.log(1 - 1 / (1 + np.exp(-s(noise)))).sum())
    dq, e = m._contrast(q, rows, noise, slice(0, 9), "ids", "bias", m.log_noise)[0], 1e-5
    for d in range(0, lm_scoring.WIDE, 5):
        step = np.zeros_like(q)
        step[0, d] = e
        assert abs((gain(q + step) - gain(q - step)) / (2 * e) - dq[d]) < 1e-4


@pytest.mark.parametrize("rows", [ODD, ODD[:1], [(None, "only words without an id", None, None, None)], []])
def test_odd_tables_have_a_score_a_row(spark, rows):
    same(base_rows(lm_scoring.score(frame(spark, rows))), brute_base([r[:2] for r in rows]))
    assert lm_scoring.score(frame(spark, rows)).where("score IS NULL OR score > 0 OR isnan(score)").isEmpty()


def test_words_by_arrow_are_those_of_bytes():
    texts = ["", None, " \t\n", "A b", "  \x0b\x0cÀ\u00a0É\u2003x \r", "\x1cq\x85 Ǆ", "İ\x00 z" * 3, "ends\n", "K K"]
    sizes, words = lm_scoring.tokens(pa.array(texts, pa.string()))
    want = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
    sizes, words = lm_scoring.tokens(pa.array(texts, pa.string()).slice(3, 4))
    assert sizes.tolist() == [len(w) for w in want[3:7]] and words.to_pylist() == [x for w in want[3:7] for x in w]


def test_a_step_moves_each_matrix_once_however_many_classes(monkeypatch):
    counts, rng, moved = np.arange(900, 0, -1), np.random.default_rng(2), []
    model, move = lm_scoring.LogBilinear(counts), lm_scoring.LogBilinear._move
    assert len(model.classes) > 10
    monkeypatch.setattr(lm_scoring.LogBilinear, "_move", lambda self, name, *a: moved.append(name) or move(self, name, *a))
    model.step(rng.integers(0, 900, 5000).astype(np.int16), rng.integers(0, 900, (5000, lm_scoring.CONTEXT)).astype(np.int16), rng)
    assert sorted(moved) == sorted(model.MATRICES)
