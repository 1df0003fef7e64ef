"""The training-data operators: against brute force, and on rows that are odd."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, exact_dedup, fingerprints, language_id, licenses, line_dedup, mixing, pii, simhash, suffix_dedup
from tidemark.llm.registry import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the cat sat on a mat and looked at other cats " * 3000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "no id here", "en", None, 10), (3, "Same Text of ten words and so on and on", "en", "a", 5),
    (9, "same text of ten words and so on and on", "de", "b", 5), (9, "same text of ten words and so on and on", "de", "b", 5), (4, LONG, "en", "a", len(LONG)), (5, " \t\n ", "fr", "b", 4), (6, "123 !!", None, "c", 6),
    (7, "ça va? é🙂 ño", "fr", "é", 13), (None, None, None, None, None),
]


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", F.lit("x").alias("digest"), F.lit(7).alias("size"), F.lit(1.5).alias("score"), F.lit("n").alias("node"), F.lit("k").alias("key"), F.lit("l").alias("label"))


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


OPERATORS = {
    "simhash": simhash.simhash_components, "suffix": suffix_dedup.suffix_dedup, "licenses": licenses.scan, "pii": lambda d: pii.replace_entities(d, "k"),
    "mixing": lambda d: mixing.assign(d.select("doc_id", "source", "text")), "bpe": bpe.encode, "fingerprints": fingerprints.edited_fingerprints,
    "lines": line_dedup.line_dedup, "language": lambda d: language_id.predict(d, language_id.train(d)), "exact": exact_dedup.exact_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_have_a_row_each(odd, name):
    assert OPERATORS[name](odd).count() == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(none, name):
    assert OPERATORS[name](none).count() == 0


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = common.staged(stage(spark, now, ""))
            if name != "bpe":
                assert now.columns == docs.columns
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_rows_meet_their_groups_however_many_they_are(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rng = random.Random(hot)
    data = [(i, rng.choice([0] * 50 + list(range(1, 40)))) for i in range(900)]
    rows = spark.createDataFrame(data, "id int, key int")
    groups = spark.createDataFrame([(k, sum(x == k for _, x in data), f"g{k}") for k in range(1, 60)] + [(0, sum(x == 0 for _, x in data), "g0")], "key int, n bigint, name string")
    for total in (None, 900):
        got = common.joined_by_size(rows, groups, "key", "n", total)
        assert sorted((r["id"], r["name"]) for r in got.collect()) == [(i, f"g{k}") for i, k in data]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_rows_that_stay_are_whole_and_single(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_KEYS", few)
    keys = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None), (3, "x")]
    marked = spark.createDataFrame([(i, k, v, {"m": i}) for i, (k, v) in enumerate(keys)], "i int, k bigint, v string, more map<string,int>")
    of = lambda rows: common.staged(spark.createDataFrame(rows, "k bigint, v string"))
    got = common.kept_rows(marked, ["k", "v"], of([(2, None), (1, "b"), (9, "z")]), of([(1, "a"), (None, "a")]))
    assert sorted((r["k"] or 0, r["v"]) for r in got.collect()) == [(0, "a"), (1, "a"), (3, "x")] and got.columns == marked.columns
    assert common.kept_rows(marked, ["k", "v"], of([]), of([])).count() == len(keys)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_folder(far)


# --- 1 ---


def brute_print(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="ab CÉé\t\n\x1c", max_size=60))
@settings(max_examples=200, deadline=None)
def test_simhash_of_a_text(text):
    assert simhash.fingerprint(text)[0] == brute_print(text)


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_balls_find_every_pair_within_three_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {}
    for i in range(300):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        prints[i] = x
    signed = lambda x: x - (x >> 63 << 64)
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints.items()], "doc_id bigint, fp0 bigint")
    got = dict(df.join(simhash.near_groups(df), "fp0").select("doc_id", "component_id").collect())
    assert got == brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_large_buckets_span_what_is_linked():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 1 << 9, 300)).astype(np.int64) << 20
    ids = np.arange(len(words))
    a, b = simhash._linked(np.zeros(len(words), dtype=np.int64), ids, words[:, None], 1, 0)
    assert len(a) < len(words)
    want = brute_components(ids.tolist(), lambda x, y: int(words[x] ^ words[y]).bit_count() <= 1)
    edges = set(zip(a.tolist(), b.tolist(), strict=True))
    assert brute_components(ids.tolist(), lambda x, y: (x, y) in edges or (y, x) in edges) == want


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002)], "a bigint, b bigint")
    got = dict(common.components(edges).collect())
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_near_duplicate_stage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(400)]
    near = list(base)
    near[200] = "other"
    rows = [(5, " ".join(base)), (8, " ".join(near)), (3, " ".join(word() for _ in range(400))), (9, " ".join(base)), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [3, 5, 11]


def word_set(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def likeness(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def templates():
    """Texts on one template each: pairs of 0.70 to 0.86, and groups whose members are at about 0.7 of each other."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    out = []
    for i in range(160):
        base = [word() for _ in range(404)]
        edited = list(base)
        cut = 28 + i % 40
        edited[-cut:] = [word() for _ in range(cut)]
        out += [" ".join(base), " ".join(edited)]
    shared = [word() for _ in range(330)]
    for _ in range(60):
        own = shared + [word() for _ in range(74)]
        out += [" ".join(own), " ".join([*own[:-30], *(word() for _ in range(30))])]
    return out


def test_near_duplicates_are_decided_by_jaccard(spark, templates):
    sets = [word_set(t) for t in templates]
    docs = spark.createDataFrame(list(enumerate(templates)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    want = brute_components(list(range(len(sets))), lambda a, b: likeness(sets[a], sets[b]) >= 0.8)
    assert all(want[i] == want[c] for i, c in got.items())  # no false link
    linked = [(i, w) for i, w in want.items() if i != w]
    assert sum(got[i] == w for i, w in linked) >= 0.95 * len(linked)


@pytest.mark.parametrize("rows", [1 << 20, 1 << 26, 1 << 40])
def test_pairs_at_the_limit_become_candidates_at_every_size(spark, rows):
    bits, bands = simhash.bands_for(rows)
    rng = np.random.default_rng(bits)
    made = []
    for i in range(300):  # 900 shingles each, 800 in both: 0.8
        same = rng.integers(0, 2**63, 800, dtype=np.uint64)
        for k in range(2):
            own = np.r_[same, rng.integers(0, 2**63, 100, dtype=np.uint64)]
            made.append((2 * i + k, *np.array(simhash._wide(own, simhash.words_for(bands)), dtype=np.uint64).view(np.int64).tolist()))
    nodes = spark.createDataFrame(made, "node bigint, " + ", ".join(f"fp{j} bigint" for j in range(simhash.words_for(bands))))
    loose = simhash.above(simhash.bits_at(0.8, simhash.words_for(bands)), 64, 64 * simhash.words_for(bands))
    met = {(r["id"], r["key"]) for r in simhash.bucket_members(simhash.band_variants(nodes, bits, bands), loose).select("id", "key").collect()}
    keys = {}
    for i, k in met:
        keys.setdefault(i, set()).add(k)
    found = sum(bool(keys.get(2 * i, set()) & keys.get(2 * i + 1, set())) for i in range(300))
    assert found >= 0.92 * 300 and len(met) < 40 * 600


@pytest.mark.parametrize("pairs", [1, 1 << 22])
def test_members_of_a_bucket_meet_all_that_are_not_connected(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    words = [int(w) for w in rng.integers(0, 1 << 20, 400)]
    rows = [(i % 7 // 3, i, words[i], i // 5 * 5) for i in range(400)]
    df = spark.createDataFrame([(k, i, m, w >> 9, w & 511) for k, i, w, m in rows], "key bigint, id bigint, label bigint, upper bigint, lower bigint")
    got = {(r["a"], r["b"]) for r in simhash.unlinked(df, 6).collect()}
    assert got == {(a, b) for k, a, x, m in rows for q, b, y, n in rows if a < b and k == q and m != n and (x ^ y).bit_count() <= 6}


@pytest.mark.parametrize("n", [0, 1, 30, 300, 3000, 30_000])
def test_maps_of_sets_never_rule_out_a_pair_that_is_alike(n):
    rng = np.random.default_rng(n)
    described = lambda h: np.array([len(h), *simhash._set_map(h)], dtype=np.uint64)
    refused = {}
    for share in (0.2, 0.5, 0.7, 0.8, 0.9, 1.0):  # of a set's elements that the other has too
        both = rng.integers(0, 2**64, round(n * share), dtype=np.uint64)
        a, b = (np.unique(np.r_[both, rng.integers(0, 2**64, n - len(both), dtype=np.uint64)]) for _ in range(2))
        a = np.r_[a, rng.integers(0, 2**64, rng.integers(0, 3), dtype=np.uint64)]
        x, y = set(a.tolist()), set(b.tolist())
        alike = len(x & y) / max(1, len(x | y))
        for limit in (0.5, 0.8, alike):
            told = bool(simhash._may_be_alike(described(a), described(b), limit))
            assert told or alike < limit
            refused[share, limit] = not told
    if n in (30, 300):  # of small sets it says more than their sizes do
        assert refused[0.5, 0.8] and refused[0.7, 0.8]


def test_members_that_sets_rule_out_do_not_meet(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(140, 200)], rng.integers(0, 2**64, rng.integers(0, 20), dtype=np.uint64)]) for _ in range(90)]
    signed = lambda x: np.asarray(x, dtype=np.uint64).view(np.int64).tolist()
    rows = [(i % 2, i, i // 10, 0, *signed([len(h), *simhash._set_map(h)])) for i, h in enumerate(sets)]
    df = spark.createDataFrame(rows, "key bigint, id bigint, label bigint, word bigint, " + ", ".join(f"{c} bigint" for c in simhash.SET_COLUMNS))
    as_sets = [set(h.tolist()) for h in sets]
    pairs = {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and a // 10 != b // 10}
    alike = {(a, b) for a, b in pairs if likeness(as_sets[a], as_sets[b]) >= 0.8}
    got = {(r["a"], r["b"]) for r in simhash.unlinked(df, 0, 0.8).collect()}
    assert alike and alike <= got < pairs
    met = {r["id"] for r in simhash.bucket_members(df.drop("label"), 0, 0.8).collect()}
    assert met >= {i for pair in alike for i in pair}


def test_no_member_of_a_crowded_bucket_is_lost(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(330)]
    texts = []
    for _ in range(80):
        own = shared + [word() for _ in range(74)]
        texts += [" ".join(own), " ".join([*own[:-30], *(word() for _ in range(30))])]
    # one bucket for all, whose words rank the true partner last
    words = lambda n, *_: n.select(F.lit(1).cast("bigint").alias("key"), F.col("node").alias("id"), (F.col("node").bitwiseAND(F.lit(7))).alias("word"))
    monkeypatch.setattr(simhash, "band_variants", words)
    sets = [word_set(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(list(range(len(sets))), lambda a, b: likeness(sets[a], sets[b]) >= 0.8)


# --- 2 ---


def brute_removed(texts):
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for b in data:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    out = []
    for b in data:
        covered = np.zeros(len(b) + 1, dtype=np.int8)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                covered[p : p + 400] = 1
        starts = np.diff(np.r_[0, covered]) == 1
        out.append((len(b), int(covered.sum()), int(starts.sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[covered[:-1] == 0].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 21, 3000])
def test_suffix_dedup(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", 500)
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    p, q = words(100), words(150)
    texts = [None, "", "a" * 399, "a" * 400, "a" * 401, "ab" * 900, "abc" * 200 + words(50), p, p, p + words(30), words(20) + p, words(50) + p + words(5) + q, q + p, q[:410] + words(10) + q[100:], "é" * 300]
    texts += [words(60) + p + words(60) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = suffix_dedup.suffix_dedup(docs).withColumn("h", F.sha2("kept", 256)).orderBy("doc_id").collect()
    assert [(r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["h"]) for r in got] == brute_removed(texts)


@pytest.mark.parametrize("seed", range(60))
def test_repeats_longer_than_a_string_mark_nothing_else(seed):
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh") for _ in range(n))
    shared = [word(rng.randint(400, 900)) for _ in range(3)]
    segments = list({word(rng.randint(0, 300)) + rng.choice(shared)[rng.randint(0, 60) :] + word(rng.randint(100, 300)) for _ in range(rng.randint(2, 9))})
    segments = [s for s in segments if len(s) >= 400]
    count: dict = {}
    for s in segments:
        for p in range(len(s) - 399):
            count[s[p : p + 400]] = count.get(s[p : p + 400], 0) + 1
    got = suffix_dedup.repeated_starts(segments) if segments else []
    assert [x.tolist() for x in got] == [[count[s[p : p + 400]] > 1 for p in range(len(s) - 399)] for s in segments]


@given(st.binary(min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_suffix_array(data):
    text = np.r_[np.frombuffer(data, dtype=np.uint8).astype(np.int16) + 1, 0]
    sa = suffix_dedup.suffix_array(text)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    got = suffix_dedup.common_prefixes(text, sa, np.array([0]), np.array([len(data)]), 50)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        if b < len(data):
            n = 0
            while n < 50 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert got[b] == n


# --- 3 ---


@given(st.lists(st.sampled_from(["MIT", "License", "mit", "cc", "by", "apache", "GNU", "general", "public", "-", ",", "x", "é"]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_license_phrases(parts):
    text = " ".join(parts)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    want = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    assert licenses.base_scan(text) == (len(w), want)


def distance(a, b):
    """Levenshtein."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def ends_within(notice, text, k):
    """Ends of substrings within k edits of a notice, with the least edits and the latest start: a sliding edit distance."""
    col = [(i, 0) for i in range(len(notice) + 1)]
    out = []
    for j, y in enumerate(text, 1):
        now = [(0, j)]
        for i, x in enumerate(notice, 1):
            now.append(min((col[i - 1][0] + (x != y), -col[i - 1][1]), (col[i][0] + 1, -col[i][1]), (now[-1][0] + 1, -now[-1][1])))
            now[-1] = (now[-1][0], -now[-1][1])
        col = now
        if col[-1][0] <= k:
            out.append((j, col[-1][0], col[-1][1]))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_fuzzy_places_against_a_sliding_edit_distance(seed):
    rng = random.Random(seed)

    def edit(x, n):
        for _ in range(n):
            at, how = rng.randrange(len(x)), rng.randrange(3)
            x = x[:at] + ("" if how == 0 else rng.choice("aexz ,")) + x[at + (how != 1) :]
        return x

    notices = list(licenses.NOTICES)
    parts = []
    for _ in range(rng.randint(1, 6)):
        notice = rng.choice(notices[:6]) if seed % 2 else rng.choice(notices)
        parts += [edit(notice, rng.randint(0, licenses.edits_allowed(notice) + 1)), rng.choice([". ", "", " ", "and so on "])]
    text = "".join(parts)
    got = licenses.fuzzy_scan(text)
    low = licenses.ascii_lower(text)
    assert all(x[2] <= y[1] for x, y in zip(got, got[1:], strict=False))
    for label, a, b, edits, _ in got:
        assert edits == min(distance(n, low[a:b]) for n, x in licenses.NOTICES.items() if x == label and edits <= licenses.edits_allowed(n))
    for n in notices:
        for end, edits, start in ends_within(n, low, licenses.edits_allowed(n)):
            assert any(a < end and start < b and (a < b) for _, a, b, _, _ in got), (n, low[start:end], edits, got)


def test_every_fuzzy_place_is_reported():
    for text in ("relesed undr the mit license. released under the mit license", "released undr the mit licence released under the mit license"):
        assert [x[0] for x in licenses.fuzzy_scan(text)] == ["mit", "mit"]
    assert [x[0] for x in licenses.fuzzy_scan("SPDX-License-Identifier: EPL-2.0")] == ["epl-2.0"]
    many = "relesed undr the mit license " * 300
    assert len(licenses.fuzzy_scan(many)) == 300


def test_fuzzy_notices_report_spans_and_edits():
    notice = "Licensed under the Apache License, Version 2.0"
    for text, edits in ((notice, 0), (notice.replace("Apache", "Apche"), 1), (notice.replace("under", "undr").replace("Version", "Versoin"), 3)):
        found = licenses.fuzzy_scan(f"é words {text}. more")
        assert [(f[0], f[3]) for f in found] == [("apache-2.0", edits)]
        assert f"é words {text}. more"[found[0][1] : found[0][2]].startswith("Licensed")
    assert not licenses.fuzzy_scan("the license of an apache version")


# --- 4 ---


def test_surrogates_keep_type_and_coreference(spark):
    texts = ["Mr. John Smith met Mrs Anna Smith. Mail A.b@Mail.example.com or a.b@mail.example.com.", "call +1 (437) 555-1234 or +1 437 555 1234, card 4111111111111111; not 4111111111111112", 'ip 10.2.3.4. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "г-н Иванов и г-жа Анна Иванова", "clean text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["text"] for r in pii.replace_entities(docs, "k").orderBy("doc_id").collect()]
    people = re.match(r"Mr\. (\w+n) (\w+) met Mrs (\w+na) (\w+)\. Mail (\S+) or (\S+)\.$", got[0])
    assert people and people[2] == people[4] and people[5] == people[6] and people[5].endswith(".example.com")
    phones = re.match(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}), card (4\d{15}); not 4111111111111112$", got[1])
    assert phones and phones.groups()[:3] == phones.groups()[3:6] and phones[7] != "4111111111111111"
    digits = [int(c) for c in phones[7]]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert re.match(r'ip \d+\.\d+\.\d+\.\d+\. token = "[0-9a-f]{40}"$', got[2]) and "10.2.3.4" not in got[2]
    assert all("CYRILLIC" in unicodedata.name(c) for c in got[3] if c.isalpha()) and "Иванов" not in got[3]
    assert got[4] == texts[4]


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"mail u{i}@x.org from 10.0.{i // 250}.{i % 250}") for i in range(600)]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").toPandas()["text"]
    mails, ips = got.str.extract(r"mail (\S+) ")[0], got.str.extract(r"from (\S+)$")[0]
    assert mails.nunique() == 600 and ips.nunique() == 600 and not set(ips) & {f"10.0.{i // 250}.{i % 250}" for i in range(600)}


def test_names_keep_their_words_where_surrogates_collide(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", "ba be bo da de do fa fe fi fo".split())
    word = lambda i, by: "".join("abcdefghij"[int(c)] for c in str(i * by + 1000))
    rows = [(i, f"Mr X{word(i, 7)} Y{word(i, 13)} and Mr Y{word(i, 13)}, Mrs Y{word(i, 13)}.") for i in range(500)]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").toPandas()["text"]
    parts = got.str.extract(r"^Mr (\w+) (\w+) and Mr (\w+), Mrs (\w+)\.$")
    assert (parts[1] == parts[2]).all() and (parts[1] == parts[3]).all() and parts[1].nunique() == 500 and parts[0].nunique() == 500


def mod97(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_surrogates_against_a_plain_mapping(spark):
    """Each entity has one surrogate wherever it stands, each surrogate one entity, of its type and form."""
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(body):
        odd = [sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(body)]
        return body + str(-sum(odd) % 10)

    def iban(country, rest):
        return f"{country}{98 - mod97(country + '00' + rest):02d}{rest}"

    group = lambda x, n, by: by.join(x[i : i + n] for i in range(0, len(x), n))
    made = {
        "email": [(x, x.upper(), x) for x in {f"{rng.choice('abcdefghij')}@{rng.choice(['p', 'q'])}.org" for _ in range(60)}],
        "card": [(x, group(x, 4, " "), group(x, 4, "-")) for x in (card("4" + digits(14)) for _ in range(40))],
        "iban": [(x, group(x, 4, " "), x) for x in [iban("GB", "WEST" + digits(14)) for _ in range(30)] + [iban("DE", digits(18)) for _ in range(30)]],
        "phone": [(f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}") for a, b, c in ((digits(3), digits(3), digits(4)) for _ in range(40))] + [(f"+49 30 {x}", f"+49-30-{x}", f"+49 30 {x}") for x in (digits(7) for _ in range(20))],
        "ssn": [(x, x, x) for x in (f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(40))],
        "ip": [(x, x, x) for x in {f"10.{rng.randrange(3)}.0.{rng.randrange(9)}" for _ in range(40)}],
    }
    surfaces = [(kind, k, form) for kind, entities in made.items() for k, forms in enumerate(entities) for form in forms]
    rng.shuffle(surfaces)
    rows = [(i // 5, f"{i}:<{x[2]}>") for i, x in enumerate(surfaces)]
    docs = spark.createDataFrame([(d, " and ".join(t for e, t in rows if e == d)) for d in {d for d, _ in rows}], "doc_id bigint, text string")
    out = dict(re.findall(r"(\d+):<(.*?)>", " ".join(r["text"] for r in pii.replace_entities(docs, "k").collect())))
    plain = lambda kind, x: re.sub("[^0-9a-z@]", "", x.lower())[-10 if kind == "phone" else 0 :]
    there = {(kind, plain(kind, form)) for kind, _, form in surfaces}
    of: dict = {}
    for i, (kind, k, form) in enumerate(surfaces):
        new = out[str(i)]
        of.setdefault((kind, k), set()).add(plain(kind, new))
        assert (kind, plain(kind, new)) not in there, (kind, form, new)
        if kind in ("card", "iban", "phone", "ssn"):  # the same punctuation, letters and digits in the same places
            assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", new)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", form)), (form, new)
        if kind == "iban":
            assert mod97(new) == 1 and new[:2] == form[:2]
        if kind == "email":
            assert new.lower().endswith(".example.org") and (new == new.upper()) == (form == form.upper())
    assert all(len(x) == 1 for x in of.values())
    for kind in made:
        mine = [next(iter(x)) for (k, _), x in of.items() if k == kind]
        assert len(set(mine)) == len(mine), kind


def test_it_says_so_where_surrogates_run_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "PATIENCE", 2)
    real = pii.canonical
    monkeypatch.setattr(pii, "canonical", lambda *a: F.when(a[1] == "ssn", F.concat(F.lit("9"), F.substring(real(*a), 2, 1), F.lit("0000000"))).otherwise(real(*a)))
    rows = [(i, f"number 123-45-{6000 + i}") for i in range(30)]
    with pytest.raises(ValueError, match="no surrogates left"):
        pii.replace_entities(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").count()


@pytest.mark.parametrize("n", [1, 1521, 1522, 10_000, 10**6, 10**9])
def test_there_are_names_enough(n):
    assert 39 ** pii._syllables(n) >= 39 * n and pii._syllables(1521) == 3


# --- 5 ---


def test_targets_stop_at_three_times_the_source(spark):
    rows = [("a", 10), ("b", 1000), ("c", 500), (None, 200), ("e", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    left, want, sizes = 1710.0, {}, dict(rows)
    weights = dict(zip(["a", "b", "c", "e", None], [5, 2, 1, 5, 2], strict=True))
    while True:
        open_ = [s for s in weights if s not in want]
        full = [s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 3 * sizes[s]]
        if not full:
            want |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
        left = 1710.0 - sum(want.values())
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1710)


def test_mix_comes_near_its_targets_and_positions_follow_the_schedule(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), None, f"s{rng.randint(0, 2)}", 0) for i in range(3000)]
    mixed = mixing.assign(spark.createDataFrame(rows, DOCS)).toPandas()
    by = mixed.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by["taken"] - by["target"]).abs() <= 30).all() and (mixed["taken"] <= 3 * mixed["size"]).all()
    order = mixing.training_order(mixing.assign(spark.createDataFrame(rows, DOCS))).toPandas()
    assert (order["position"].diff().dropna() >= 0).all()
    rising = order[order["source"] == "s0"]["position"]
    assert (rising < 0.5).mean() > 0.55  # its weight falls over the run


def test_a_given_schedule_is_followed(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 9), None, rng.choice(["a", "b", None]), 0) for i in range(4000)]
    schedule = [("a", 0.0, 0.0), ("a", 0.25, 4.0), ("a", 0.5, 0.0), ("a", 0.75, 0.0), ("a", 1.0, 2.0), (None, 0.3, 1.0), (None, 0.6, 3.0)]
    points = {"a": [(0, 0), (0.25, 4), (0.5, 0), (0.75, 0), (1, 2)], "b": [(0, 1), (1, 1)], "none": [(0, 1), (0.3, 1), (0.6, 3), (1, 3)]}
    out = mixing.assign(spark.createDataFrame(rows, DOCS), schedule=schedule).select(F.coalesce("source", F.lit("none")).alias("source"), "target", "source_size", "size", F.explode("positions").alias("position")).toPandas()
    time = np.linspace(0, 1, 20001)
    for source, mine in out.groupby("source"):
        weight = np.interp(time, *zip(*points[source], strict=True))
        due = np.r_[0, np.cumsum((weight[1:] + weight[:-1]) / 2)]
        due /= due[-1]
        mine = mine.sort_values("position")
        before = np.r_[0, np.cumsum(mine["size"])[:-1]] / mine["target"].iloc[0]
        # what stands before a document is what is due by its time
        assert np.abs(np.interp(mine["position"], time, due) - before).max() < 2e-3
        assert not ((mine["position"] > 0.51) & (mine["position"] < 0.74)).any() or source != "a"
    for bad in ([], [("a", 0.0, 0.0)], [("a", -0.1, 1.0)], [("a", 0.5, -1.0)]):
        if bad:
            with pytest.raises(ValueError):
                mixing.assign(spark.createDataFrame(rows[:3], DOCS), schedule=bad)


# --- 6 ---


@pytest.fixture(scope="module")
def tok():
    return bpe.load(bpe.default_path())


@given(st.lists(st.sampled_from(["a", "aa", "the", "'s", "'re", "'ll", "ing", " ", "\n", "é", "é", "ß", "İ", "Σ", "日本", "1", "42", "!!", "<|endoftext|>", "x", "🙂", "\x1c", "²"]), min_size=1, max_size=300), st.sampled_from([40, 97, 150]))
@settings(max_examples=150, deadline=None)
def test_tree_concatenation_is_exact(parts, piece):
    tok, text = bpe.load(bpe.default_path()), "".join(parts)
    want = tok.encode(text, add_special_tokens=False).ids
    encoder = bpe.Encoder(bpe.default_path())
    ids = encoder.ids([text, "", text])
    assert [np.frombuffer(x, dtype="<i4").tolist() for x in ids] == [want, [], want]
    assert encoder.decode(ids).to_pylist() == [tok.decode(x, skip_special_tokens=False) for x in (want, [], want)]
    for spans in (lambda t, at: bpe._spans(tok, t, at), encoder.spans):
        nodes = [(b, text[b : b + piece], spans(text[b : b + piece], b)) for b in range(0, len(text), piece)]
        while len(nodes) > 1:
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [p[0] if len(p) == 1 else (p[0][0], p[0][1] + p[1][1], bpe.join_tokens(tok, p[0][1] + p[1][1], p[0][0], p[1][0], p[0][2], p[1][2])) for p in pairs]
        assert nodes[0][2][0].tolist() == want


def test_known_places_are_the_librarys(tok):
    text = "It's 42 words, é ß or so...  and\tmore\n don't " * 5
    ids, starts = bpe.Encoder(bpe.default_path()).spans(text, 100)
    want, places = bpe._spans(tok, text, 100)
    assert ids.tolist() == want.tolist()
    assert [(i, a) for i, a in enumerate(starts.tolist()) if a >= 0] == [(i, a) for i, a in enumerate(places.tolist()) if a == 100 or text[a - 101].isspace()]


@pytest.mark.parametrize("forget", [None, 0])
def test_other_files_go_to_the_library(spark, monkeypatch, forget):
    import public_tokenizers
    from tokenizers import Tokenizer

    if forget is not None:
        monkeypatch.setattr(bpe, "REMEMBERED", forget)
    texts = ["It's GOOD, isn't it?\n\n  Yes 日本", None, "the cat sat on the mat " * 200, "ß" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        other = Tokenizer.from_file(public_tokenizers.path(name))
        assert bpe.splits_at_white_space(public_tokenizers.path(name)) == name.startswith("word")
        for r in bpe.encode(docs, public_tokenizers.path(name), piece=300).collect():
            want = other.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["decoded"] == other.decode(want, skip_special_tokens=False)


def test_long_unsplit_texts(spark, tok):
    texts = ["a" * 5000, "ab" * 3000, "xyz é " * 1500, "'re" * 1500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in bpe.encode(docs, piece=700).collect():
        want = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == tok.decode(want, skip_special_tokens=False)


# --- 7 ---


@given(st.lists(st.text(alphabet="ab c", max_size=12), min_size=1, max_size=8), st.randoms())
@settings(max_examples=100, deadline=None)
def test_paragraph_sums(parts, rng):
    of = fingerprints.Fingerprint.of
    mixed = list(parts)
    rng.shuffle(mixed)
    assert of("\n".join(parts)).text() == of("\n".join(mixed)).text()
    more = of("\n".join(parts)).insert("new one here")
    assert more.text() == of("\n".join([*parts, "new one here"])).text()
    assert more.delete("new one here").text() == of("\n".join(parts)).text()
    assert fingerprints.Fingerprint.parse(more.text()).likeness(more) == 1.0


@pytest.mark.parametrize("rows_a_range", [4000, 7])
def test_edited_texts_follow_descending_ids(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", rows_a_range)
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 60)))
    rows = [(i * 3, text()) for i in range(120)] + [(None, text()) for _ in range(40)] + [(30, text()) for _ in range(5)] + [(-(2**63), "least"), (2**63 - 1, "most")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashes = dict(docs.select("text", F.xxhash64("text")).distinct().collect())
    got = {(r["doc_id"], r["fingerprint"], r["n_chars"]): r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    of = lambda t: fingerprints.Fingerprint.of(t).text()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        row = got[i, of(text), len(text)]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() or rows.count((i, text)) > 1
        assert row["edited_fingerprint"] == of(changed) or rows.count((i, text)) > 1


# --- 8 ---


def test_like_lines_keep_their_first(spark):
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(120))
    base = [line() for _ in range(30)]
    near = [b[:60] + "ZZ" + b[62:] for b in base]
    docs = spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join([*near[:15], "", line(), "hi"])), (3, "\n".join([*base[20:], "hi", ""]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: [], 2: list(range(15)), 3: list(range(11))}
    text = docs.where("doc_id = 2").select(line_dedup.apply_drops(F.col("text"), F.array(*(F.lit(i) for i in range(15)))).alias("t")).first()["t"]
    assert text.split("\n")[0] == "" and text.endswith("hi")


def brute_dropped(rows):
    """Positions of lines that an earlier like or equal line stands for, by row of (doc_id, text)."""
    shingles = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    places = [(d is None, d or 0, t, at, k, x) for k, (d, t) in enumerate(rows) for at, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [shingles(p[-1]) for p in places]
    label = list(range(len(places)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(places)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    out = [[] for _ in rows]
    for i, p in enumerate(places):
        if p[:5] != min(q[:5] for j, q in enumerate(places) if root(j) == root(i)):
            out[p[4]].append(p[3])
    return out


def test_line_components_against_brute_force(spark):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    base = [line(rng.randint(3, 300)) for _ in range(40)]
    close = lambda x: x[: len(x) // 2] + "Q" + x[len(x) // 2 + 1 :] if len(x) > 120 else x
    chain = [line(200)]
    for k in range(6):  # each is like the next, the first unlike the last
        chain.append(chain[-1][:-8] + line(8) if k % 2 else line(8) + chain[-1][8:])
    far = lambda x: x[: len(x) // 2] + line(len(x) - len(x) // 2)
    pool = [*base, *(close(x) for x in base), *(far(x) for x in base), *chain, "", "  ", "x", "ab\r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    # one id for two texts, equal rows, no id, no text, and a line that is one row's alone
    rows += [(7, "shared line of some length\nabc"), (7, "a unique line of some length\ndef"), (None, rows[3][1]), (None, rows[3][1]), (None, None), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = line_dedup.line_dedup(docs, texts=True).collect()
    # of equal rows either may lose its lines; of one id's different texts that of the smaller hash keeps them
    lists = lambda x: sorted((d is not None, d or 0, g) for d, g in x)
    hashes = dict(docs.select("text", F.xxhash64("text").alias("h")).distinct().collect())
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashes[rows[k][1]]))
    want = brute_dropped([rows[k] if rows[k][0] != 7 else (7, rows[k][1]) for k in order])
    shape = lambda t, d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in d)
    same = [k for k, i in enumerate(order) if rows[i][0] not in (7,)]
    assert lists((r["doc_id"], list(r["dropped"])) for r in got if r["doc_id"] != 7) == lists((rows[order[k]][0], want[k]) for k in same)
    assert any(r["doc_id"] == 7 and "a unique line of some length" in r["text"] and r["text"].endswith("def") for r in got)
    assert {r["text"] for r in got if r["doc_id"] == 0} == {shape(rows[0][1], want[order.index(0)])}


def test_line_dedup_has_no_python_in_its_plan(spark, odd):
    for df in (line_dedup.signatures(line_dedup.different_lines(odd)), line_dedup.line_dedup(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("k", [1, 2, 5])
def test_like_lines_of_any_length_meet(spark, k):
    rng = random.Random(k)
    line = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(1500):  # 9k shingles each, 8k of them in both: 0.8
        same = line(8 * k + 4)
        rows += [(2 * i, same + "X" + line(k - 1)), (2 * i + 1, same + "Y" + line(k - 1))]
    signed = line_dedup.signatures(spark.createDataFrame(rows, "lid bigint, line string"))
    keys = {}
    for r in line_dedup.band_members(signed).select("key", "lid").collect():
        keys.setdefault(r["lid"], set()).add(r["key"])
    bits = {r["lid"]: (r["low"], r["high"]) for r in signed.collect()}
    halves = lambda x: (x | x >> 32) & (2**32 - 1)
    near = lambda a, b: halves((a[0] ^ b[0] | a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= line_dedup.differing_at(0.8)
    met = sum(bool(keys.get(2 * i, set()) & keys.get(2 * i + 1, set())) and near(bits[2 * i], bits[2 * i + 1]) for i in range(1500))
    assert met >= 0.97 * 1500


# --- 9 ---


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(9)
    syllables = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "ein", "ich"], "fr": ["eau", "ment", "que", "ou"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(rng.randint(3, 40))), k, None, 0) for i in range(600) for k in [rng.choice(list(syllables))]]
    docs = spark.createDataFrame([*rows, (9001, "12 !!", "en", None, 0), (9002, None, "en", None, 0)], DOCS)
    got = language_id.predict(docs.drop("lang", "source"), language_id.train(docs)).withColumn("held", language_id.held_out(F.col("doc_id"))).toPandas().set_index("doc_id")
    truth = pd.Series({r[0]: r[2] for r in rows})
    held = got.loc[truth.index][got.loc[truth.index]["held"]]
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.98 and got["score"].between(0, 1).all()
    assert set(got.loc[[9001, 9002], "lang_pred"]) == {"und"}


def test_held_out_rows_teach_nothing(spark):
    import zlib

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "words here", "xx", None, 0) for i in ids], DOCS)
    assert language_id.train(docs).languages == []


@pytest.mark.parametrize("n", [1, 2, 4, 7, 20])
def test_codewords_tell_languages_apart(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n


def test_decoding_against_a_plain_one():
    rng = np.random.default_rng(5)
    names = sorted(["aa", "bb", "cc", "dd", "ee"])
    model = language_id.Model(names, language_id.codewords(5), rng.normal(size=(language_id.FEATURES, 15)))
    texts = ["hello there", "x", "çà et là", "a" * 5000, None, "12", "zwei drei vier"]
    got = model.predict(texts)
    for text, name, score, flag in zip(texts, *got, strict=True):
        if text in (None, "12"):
            assert (name, score) == ("und", 0.0)
            continue
        counts = language_id.features(text)
        margin = [sum(c * w for c, w in zip(counts, model.weights[:, b], strict=True)) / counts.sum() * min(counts.sum(), language_id.EVIDENCE) for b in range(15)]
        loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margin, word, strict=True)) / 15 for word in model.code]
        chance = np.exp([-x for x in loss]) / sum(np.exp([-x for x in loss]))
        first, second = sorted(chance)[::-1][:2]
        assert name == names[int(np.argmin(loss))] and score == pytest.approx(first) and flag == (first - second < language_id.AMBIGUOUS)


# --- 10 ---


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(10)
    keys = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    sizes, bits, slot = exact_dedup.build_mph(keys)
    assert sorted(slot) == list(range(5000))
    assert (exact_dedup.find_slots(keys, sizes, bits) == slot).all()


def test_exact_dedup_on_odd_rows(odd):
    got = exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").toPandas()
    same = got[got["doc_id"].isin([3, 9])]
    assert set(same["keep_id"]) == {9} and set(same["group_size"]) == {3} and same["kept"].sum() == 1
    empty = got[(got["doc_id"].isin([1, 2])) | (got["doc_id"].isna() & (got["group_size"] > 1))]
    assert set(empty["keep_id"]) == {2} and set(empty["group_size"]) == {4} and empty["kept"].sum() == 1


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_rows_of_one_id_and_size_change_places_in_no_rerun(spark):
    rows = [(1, f"word{i} other", "en", "ab"[i % 2], 1) for i in range(80)]
    first = {(r["text"]) for r in mixing.mixed(frame(spark, rows).repartition(3)).collect()}
    again = {(r["text"]) for r in mixing.mixed(frame(spark, rows[::-1]).repartition(7)).collect()}
    assert first == again and len(first) < 80  # source b is not taken whole


def test_an_address_in_many_documents_returns_to_each(spark):
    rows = [(i, f"write to common.name@shared.example now, {i}", "en", "a", 1) for i in range(300)] + [(1000 + i, f"write to rare{i}@own{i}.example", "en", "a", 1) for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in pii.replace_entities(frame(spark, rows), "k").collect()}
    assert len({out[i].split()[2] for i in range(300)}) == 1 and len({out[1000 + i].split()[2] for i in range(20)}) == 20
    assert all("@" in out[i] and "common.name" not in out[i] and "rare" not in out[i].split()[2][:4] for i in out)


def test_more_links_of_lines_give_the_components_of_all(spark):
    rng = random.Random(5)
    rounds = [[(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (60, 40, 1, 30)]
    frames = [spark.createDataFrame([(a, b) for a, b in r if a != b], "a bigint, b bigint") for r in rounds]
    known, all_ = common.staged(common.components(frames[0])), frames[0]
    for more in [*frames[1:], frames[0].limit(0)]:
        known, all_ = common.staged(line_dedup.relabelled(known, more)), all_.unionByName(more)
        want = sorted(tuple(r) for r in common.components(all_).select("node", "label").collect())
        assert sorted(tuple(r) for r in known.select("node", "label").collect()) == want


def test_pairs_of_lines_are_verified_in_tasks_by_their_number(spark, monkeypatch):
    lines = spark.createDataFrame([(i, f"the same line but for its number {i // 2}") for i in range(400)], "lid bigint, line string")
    pairs = common.staged(spark.createDataFrame([(i, i + 1) for i in range(0, 399)], "a bigint, b bigint"))
    monkeypatch.setattr(line_dedup, "PAIRS_A_TASK", 20)
    got = line_dedup.verified(pairs, lines)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"RepartitionByExpression \[b#\d+L?\], {399 // 20}\b", plan)
    assert plan.count("regexp_extract_all") == 2  # the sets of a pair are built once
    sets = {i: {s[k : k + 5] for k in range(len(s) - 4)} for i, s in ((r["lid"], r["line"]) for r in lines.collect())}
    assert {tuple(r) for r in got.collect()} == {(i, i + 1) for i in range(399) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}


def test_unlike_lines_of_a_band_are_no_pairs_and_no_link_is_lost(spark):
    rng = random.Random(11)
    line = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    long, words = line(420), [line(9) for _ in range(40)]

    def changed(k):
        at = sorted(rng.sample(range(0, 410, 10), k))
        out = long
        for i in at:
            out = out[:i] + rng.choice(words) + out[i + 9 :]
        return out

    texts = list({changed(rng.choice([2, 8, 10, 12, 14])) for _ in range(150)}) + ["\U0001f600" * 3 + long, "-" * 300, "-" * 7, "abc"]
    lines = spark.createDataFrame(list(enumerate(texts)), "lid bigint, line string")
    # all lines in two bands that they share, with the same bits: only sets and maps tell them apart
    signed = lines.select("lid", F.array(*(F.lit(j) if j in (3, 5) else F.col("lid") * 8 + 100 + j for j in range(line_dedup.BANDS))).cast("array<bigint>").alias("keys"), F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    members = lines.select(F.explode(F.array(F.lit(3).cast("bigint"), F.lit(5).cast("bigint"))).alias("key"), "lid", F.col("lid").alias("label"))
    got = [tuple(r) for r in line_dedup.pairs_within(common.staged(members), common.staged(signed), lines).collect()]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in texts]
    n = len(texts)
    links = {(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4}
    assert len(got) == len(set(got)) and links <= set(got)  # each pair once, and no link is missing
    assert 50 < len(links) and len(got) < n * (n - 1) // 4  # of all pairs most are told apart before they are made
    # lines with a label in common are not paired
    one = common.staged(members.withColumn("label", F.lit(0).cast("bigint")))
    assert line_dedup.pairs_within(one, common.staged(signed), lines).count() == 0
