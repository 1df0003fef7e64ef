"""License scan: exact phrases by words, short notices with a few edits.

The fuzzy search is pigeonhole first: a notice that may differ in k edits is
split into k + 1 pieces, and any place within k edits holds one of them
unchanged. One Aho-Corasick pass finds all pieces of all notices; each hit
names the window in which its notice would stand, and the ``regex`` library's
bounded-error matching verifies the window and reports span and edits. Of places
of one notice that overlap, the one with the fewest edits counts; what is left
of the others' windows is searched again, so no place beside it is lost. Of
different notices at one place, the likeliest counts.

Everything happens within a row; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

#: Phrase → label, found where the words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice (A-Z lower-cased) → label.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy": "bsl-1.0",
    "distributed under the boost software license": "bsl-1.0",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "licensed under the gnu general public license, version": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu library general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "either version 2 of the license, or (at your option) any later version": "gpl-2.0-or-later",
    "either version 3 of the license, or (at your option) any later version": "gpl-3.0-or-later",
    "either version 2.1 of the license, or (at your option) any later version": "lgpl-2.1-or-later",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "under the terms of the eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the person who associated cc0 with this work": "cc0-1.0",
    "provided 'as-is', without any express or implied warranty": "zlib",
    "licensed under cc by-nc": "cc-by-nc",
    "licensed under cc by-sa": "cc-by-sa",
    "licensed under cc by-nd": "cc-by-nd",
    "licensed under cc by-nc-sa": "cc-by-nc-sa",
    "licensed under cc by-nc-nd": "cc-by-nc-nd",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under a creative commons attribution-sharealike": "cc-by-sa",
    "licensed under a creative commons attribution-noncommercial": "cc-by-nc",
    "licensed under a creative commons attribution-noderivatives": "cc-by-nd",
}
#: Identifiers that follow a tag.
TAG = "spdx-license-identifier: "
TAGGED = "mit apache-2.0 bsd-2-clause bsd-3-clause isc mpl-2.0 epl-2.0 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 unlicense cc0-1.0 bsl-1.0 zlib".split()
NOTICES |= {TAG + x: x for x in TAGGED}
#: A notice may differ in one edit for each so many characters.
CHARS_PER_EDIT = 12

_NOT_WORD = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TO_WORDS = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))


def base_scan(text: str) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (word position, label) of every exact phrase."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES.items():
        needle, at = b" " + phrase.encode() + b" ", line.find(b" " + phrase.encode() + b" ")
        while at >= 0:
            found.append((line.count(b" ", 0, at), label))
            at = line.find(needle, at + 1)
    return len(words), sorted(found)


@lru_cache(maxsize=1)
def _machine():
    """The automaton over all pieces, and each notice's fuzzy pattern. One per worker."""
    pieces: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for n, notice in enumerate(NOTICES):
        k = edits_allowed(notice)
        for i in range(k + 1):
            a, b = len(notice) * i // (k + 1), len(notice) * (i + 1) // (k + 1)
            pieces.setdefault(notice[a:b], []).append((n, a))
        patterns.append(regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}"))
    auto = ahocorasick.Automaton()
    for piece, where in pieces.items():
        auto.add_word(piece, (len(piece), where))
    auto.make_automaton()
    return auto, patterns


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _places(pattern, low: str, windows: set[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of a notice's places in ``windows``: none overlaps another, and each was the best left.

    A window is as long as a notice with its edits, so its best match is the
    place that named it, or one that overlaps it. What the chosen places leave
    of a window is searched again while a notice could stand there.
    """
    chosen: list[tuple[int, int, int]] = []
    while windows:
        found = {}
        for a, b in windows:
            if m := pattern.search(low, a, b):
                found[a, b] = (sum(m.fuzzy_counts), m.start(), m.end())
        taken: list[tuple[int, int]] = []  # what earlier rounds chose lies outside these windows
        for place in sorted(set(found.values())):
            if _free(taken, *place[1:]):
                insort(taken, place[1:])
                chosen.append(place)
        left = set()
        for a, b in found:
            at, i = a, max(0, bisect(taken, (a, a)) - 1)
            while i < len(taken) and taken[i][0] < b:
                if taken[i][0] - at >= least:
                    left.add((at, taken[i][0]))
                at = max(at, taken[i][1])
                i += 1
            if b - at >= least:
                left.add((at, b))
        windows = left
    return chosen


def fuzzy_scan(text: str) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, edits, likeness) of every notice found; offsets in code points of the text.

    Where places of different notices overlap, the one with the greatest
    likeness is reported, of equal ones the longest notice's.
    """
    auto, patterns = _machine()
    low = ascii_lower(text)
    notices = list(NOTICES)
    windows: dict[int, set[tuple[int, int]]] = {}
    for end, (length, where) in auto.iter(low):
        start = end - length + 1
        for n, offset in where:
            k = edits_allowed(notices[n])
            windows.setdefault(n, set()).add((max(0, start - offset - k), min(len(low), start - offset + len(notices[n]) + k)))
    found = []
    for n, spans in windows.items():
        size = len(notices[n])
        found += [(1 - edits / size, size, -a, n, b, edits) for edits, a, b in _places(patterns[n], low, spans, size - edits_allowed(notices[n]))]
    best: list[tuple[int, int]] = []
    out = []
    for likeness, _, start, n, b, edits in sorted(found, reverse=True):
        if _free(best, -start, b):
            insort(best, (-start, b))
            out.append((NOTICES[notices[n]], -start, b, edits, likeness))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps none of the sorted spans, which don't overlap each other."""
    at = bisect(taken, (a, b))
    return not (at and taken[at - 1][1] > a) and not (at < len(taken) and taken[at][0] < b)


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("likeness", T.DoubleType())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (word positions and labels) and spans (fuzzy notices) of every row.

    Null counts as empty and has no words. Repeated rows have a row each, null
    ids pass through, an empty table gives no rows. Whole texts are read;
    other columns are not.
    """
    rows = text_batches(docs).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("base", base), T.StructField("spans", T.ArrayType(_SPAN))])
    base_pa = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_pa = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())]))
    keys = ("label", "start", "end", "edits", "likeness")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, phrases, spans = [], [], []
            for t in batch.column(1):
                text = t.as_py()
                count, found = base_scan(text)
                n.append(count)
                phrases.append([{"word": w, "label": x} for w, x in found])
                spans.append([dict(zip(keys, s, strict=True)) for s in fuzzy_scan(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(phrases, base_pa), pa.array(spans, span_pa)], names=["doc_id", "n_words", "base", "spans"])

    return rows.mapInArrow(run, schema)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, fuzzy = F.col("base.label"), F.col("spans.label")
    sure = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.likeness"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, fuzzy))), ",").alias("labels"),
        sure.alias("score"), F.size("spans").cast("bigint").alias("n_spans"),
    )
