"""BPE encoding and decoding with a public tokenizer file, long texts by tree concatenation.

Short texts are encoded where they are read. A long text is cut into pieces of
``PIECE`` code points, wherever that falls, also inside a word that nothing
splits; pieces are rows and are encoded in parallel. Neighbours are then
joined in a tree, two by two: around each join a window that starts and ends
at token bounds of the two sides is encoded again, and it grows until its
first tokens are the left side's and its last the right side's. Each pair of
neighbouring tokens then stands in the left side, the window or the right
side, so the joined tokens are those of the whole text. A task joins ``FAN``
neighbouring pieces, so texts are shuffled once for each power of that.

Where the file's own normalizer, pattern and word ends are the ones known here,
what stands between white space is encoded once and remembered as bytes; other
files' texts go to the library one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, text_batches

#: Code points of a piece; longer texts are cut. Pieces that a task joins, and that a task encodes.
PIECE, FAN, PIECES_A_TASK = 32_768, 16, 64
#: Code points of a window's sides at first, and tokens that must agree on either side.
WINDOW, AGREE = 64, 4
#: Bytes that a generation of remembered strings may take in a worker; of two generations the older is forgotten.
REMEMBERED = 24 << 20
#: What Python needs for an entry beside its characters and ids.
_ENTRY = 200
#: A piece with longer strings between white space is encoded with the place of every token.
UNSPLIT = 256
#: Texts encoded between two batches handed on.
ROWS = 128
#: Characters that lower-case and compose alike one by one, here and in the library; white space among them always splits.
_PLAIN = regex.compile(r"[\t-\r\x20-\x7E\xA1-įı-ɏ]*")
#: What a file must say of itself for its strings to be remembered.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ENDING = "</w>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, without truncation and padding. One per worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def splits_at_white_space(path: str) -> bool:
    """Whether the file lower-cases, splits and ends words as the fixed values above say, and has a token that splits alone."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    splitter = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model, added = said.get("model") or {}, said.get("added_tokens") or []
    return bool(
        (said.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and (splitter.get("pattern") or {}).get("Regex") == _PATTERN and splitter.get("invert") is True and splitter.get("behavior") == "Removed"
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == _ENDING and not model.get("dropout")
        and added and all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    )


class Memory:
    """String → ids as bytes. Beyond REMEMBERED bytes the strings not asked for since the last time are forgotten."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.taken = 0

    def add(self, key: str, ids: bytes) -> None:
        self.young[key] = ids
        self.taken += len(key) + len(ids) + _ENTRY

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not remembered; all others are in ``young`` afterwards."""
        if self.taken > REMEMBERED:
            self.young, self.old, self.taken = {}, self.young, 0
        out = []
        for key in keys.difference(self.young):
            if (ids := self.old.get(key)) is not None:
                self.add(key, ids)
            else:
                out.append(key)
        return out


class Encoder:
    """Encodes and decodes texts as the library does; remembers the ids of strings between white space.

    White space always splits, so such a string's ids don't depend on what is
    around it. New strings are encoded together, an added token between them
    that tells them apart again.
    """

    def __init__(self, path: str):
        self.tok, self.fast = load(path), splits_at_white_space(path)
        self.known = Memory()
        self.between = min(self.tok.get_added_tokens_decoder()) if self.fast else None
        tokens = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        # without a decoder the library puts blanks between tokens
        self.blank_after = pa.array([t + " " for t in tokens], pa.large_string()) if self.tok.decoder is None else None

    def plain(self, text: str) -> bool:
        """Whether the text's strings between white space can be encoded one by one."""
        return self.fast and "<|" not in text and _PLAIN.fullmatch(text) is not None

    def _learn(self, parts: list[str]) -> None:
        sign = self.tok.id_to_token(self.between)
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            ids = np.array(self.tok.encode_batch_fast([sign.join(some)], add_special_tokens=False)[0].ids, dtype="<i4")
            cut = np.flatnonzero(ids == self.between)
            if len(cut) != len(some) - 1:
                raise ValueError(f"{sign} does not split")
            flat = ids.tobytes()
            for p, begin, end in zip(some, [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(flat)], strict=True):
                self.known.add(p, flat[begin:end])

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def parts(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as lists of strings; what is new in any of them is learned at once."""
        if new := self.known.missing(set().union(*parts)):
            self._learn(new)
        get = self.known.young.__getitem__
        return [b"".join(map(get, own)) for own in parts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts, four bytes each."""
        plain = [self.plain(t) for t in texts]
        known = self.parts([t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)])
        return [k if p else self._library(t) for t, p, k in zip(texts, plain, known, strict=True)]

    def spans(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of ``text``, which begins at offset ``at``, and each token's start.

        A start is -1 where the text can't be cut, or where it isn't known:
        within strings between white space that are short anyway.
        """
        if not self.plain(text):
            return _spans(self.tok, text, at)
        parts = text.lower().split()
        if any(len(p) > UNSPLIT for p in parts):
            return _spans(self.tok, text, at)
        code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        white = (code == 32) | ((code >= 9) & (code <= 13))
        begins = np.flatnonzero(~white & np.r_[True, white[:-1]])
        self.parts([parts])
        ids = [self.known.young[p] for p in parts]
        first = np.cumsum([0, *map(len, ids)])[:-1] // 4
        flat = np.frombuffer(b"".join(ids), dtype="<i4").astype(np.int64)
        starts = np.full(len(flat), -1, dtype=np.int64)
        starts[first] = begins + at
        return flat, starts

    def decode(self, ids: list[bytes]) -> pa.Array:
        """What the library makes of some texts' ids."""
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        ends = np.cumsum(sizes)
        if self.blank_after is None:
            return pa.array([self.tok.decode(flat[e - n : e].tolist(), skip_special_tokens=False) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.string())
        tokens = self.blank_after.take(pa.array(flat))
        offsets = np.frombuffer(tokens.buffers()[1], dtype="<i8")[tokens.offset : tokens.offset + len(flat) + 1]
        joined = memoryview(tokens.buffers()[2] or b"")
        out = [bytes(joined[offsets[e - n] : offsets[e] - 1]) if n else b"" for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.array(out, pa.binary()).cast(pa.string())


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, with what it remembers."""
    return Encoder(path)


def _spans(tok, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and starts of ``text``, which begins at offset ``at``, as the library says.

    A start is -1 if a token before reaches beyond it: the text can't be cut there.
    """
    e = tok.encode(text, add_special_tokens=False)
    off = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(off[:, 1]) if len(off) else off[:, 1]
    clean = np.r_[True, reach[:-1] <= off[1:, 0]] if len(off) else np.zeros(0, dtype=bool)
    return np.array(e.ids, dtype=np.int64), np.where(clean, off[:, 0] + at, -1)


def join_tokens(tok, text: str, at: int, cut: int, left: tuple, right: tuple) -> tuple:
    """Tokens of ``text`` (from offset ``at``) out of those of its two sides, which meet at ``cut``.

    Where a window and a side begin (or end) at one offset and their next (or
    last) ids agree, so do those tokens' places.
    """
    side = WINDOW
    (li, ls), (ri, rs) = left, right
    while True:
        # the last clean start at or before the window's start, the first at or after its end
        a = np.flatnonzero((ls <= cut - side) & (ls >= 0))
        b = np.flatnonzero(rs >= cut + side)
        i = int(a[-1]) if len(a) else 0
        j = int(b[0]) if len(b) else len(ri)
        begin = int(ls[i]) if i else at
        end = int(rs[j]) if j < len(ri) else at + len(text)
        wi, ws = _spans(tok, text[begin - at : end - at], begin)
        g = AGREE
        same_left = i == 0 or (len(wi) >= g and len(li) >= i + g and (wi[:g] == li[i : i + g]).all())
        same_right = j == len(ri) or (len(wi) >= g and j >= g and (wi[-g:] == ri[j - g : j]).all())
        if same_left and same_right:
            return tuple(np.concatenate(x) for x in ((li[:i], wi, ri[j:]), (ls[:i], ws, rs[j:])))
        side *= 2


#: ``starts`` are offsets in the text, -1 where it can't be cut.
_NODE = "uid bigint, node bigint, begin bigint, text string, ids array<int>, starts array<int>"


def _stored(spans: tuple) -> dict:
    return {"ids": spans[0].astype(np.int32), "starts": spans[1].astype(np.int32)}


def _restored(row: dict) -> tuple:
    return np.asarray(row["ids"], dtype=np.int64), np.asarray(row["starts"], dtype=np.int64)


def _encode_pieces(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                node = {"uid": row.uid, "node": row.node, "begin": row.begin, "text": row.text, **_stored(encoder.spans(row.text, row.begin))}
                yield pd.DataFrame({k: [v] for k, v in node.items()})

    return run


def _join_nodes(path: str):
    """Joins neighbouring nodes two by two until one is left."""

    def two(left: dict, right: dict) -> dict:
        text = left["text"] + right["text"]
        return left | {"text": text, **_stored(join_tokens(load(path), text, left["begin"], right["begin"], _restored(left), _restored(right)))}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("begin").to_dict("records")
        while len(rows) > 1:
            rows = [two(*rows[k : k + 2]) if k + 1 < len(rows) else rows[k] for k in range(0, len(rows), 2)]
        out = rows[0] | {"node": rows[0]["node"] // FAN}
        return pd.DataFrame({k: [v] for k, v in out.items()})

    return run


def encode(docs: DataFrame, path: str | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, ids and decoded of every row of ``docs``.

    ``ids`` are those of the library with add_special_tokens=False, ``decoded``
    what it makes of them with skip_special_tokens=False. Null counts as
    empty, which has no ids and decodes to the empty string. Repeated rows and
    null ids pass through. An empty table gives no rows. Other columns are
    not read.
    """
    path = path or default_path()
    rows = text_batches(docs).select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"]
    short = rows.where(F.length("text") <= piece)
    long = rows.where(F.length("text") > piece)
    schema = T.StructType([kind, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids = encoder.ids(part.column(1).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, encoder.decode(ids)], names=["doc_id", "ids", "decoded"])

    near = short.mapInArrow(run, schema)
    named = staged(long.withColumn("uid", F.monotonically_increasing_id()), "long")
    count = F.ceil(F.length("text") / piece).cast("int")
    most, total = named.agg(F.max(count), F.sum(count.cast("bigint"))).first()
    cut = named.select("uid", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("n")).select(
        "uid", F.col("n").cast("bigint").alias("node"), (F.col("n").cast("bigint") * piece).alias("begin"),
        F.col("text").substr(F.col("n") * piece + 1, F.lit(piece)).alias("text"),
    )
    # so many tasks as there is work for; by bytes there would be few
    nodes = cut.repartition(-(-(total or 1) // PIECES_A_TASK), "uid", "node").mapInPandas(_encode_pieces(path), _NODE)
    left = most or 1
    while left > 1:
        nodes = nodes.groupBy("uid", F.expr(f"node div {FAN}").alias("group")).applyInPandas(_join_nodes(path), _NODE)
        left = -(-left // FAN)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids = [np.asarray(x.values, dtype="<i4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), encoder.decode(ids)], names=["uid", "ids", "decoded"])

    done = nodes.select("uid", "ids").mapInArrow(finish, "uid bigint, ids array<int>, decoded string")
    far = named.select("uid", "doc_id").join(done, "uid").select(F.col("doc_id").cast(kind.dataType), "ids", "decoded")
    return near.unionByName(far)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded rows."""
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
