"""Byte-level BPE with a contiguous rank array: encoding and decoding of whole texts.

Each short word holds the boundaries of its parts and the rank of each adjacent pair in plain
arrays. The smallest rank is found by a scan, the boundary between its two parts goes, and the
ranks of the two neighbouring pairs are refreshed, until no adjacent pair can merge. Words longer
than ``SCAN_PARTS`` take the same merges from a heap, so a very long word costs n log n.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows are each
encoded; an empty table gives no rows; other columns are kept, and the operator's own column
replaces one of the same name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import lean, slices

SCAN_PARTS = 100
CACHED_WORDS = 150_000
CACHED_CHARS = 48
NO_RANK = 1 << 60

# The split of the byte-level pre-tokenizer, with white space as Unicode defines it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


class _Irregular(Exception):
    """A blank before white space: the text must be split as a whole."""


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Words(dict):
    """Encoded words of one kind, in two generations so that memory stays bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class RankBpe:
    """A byte-level BPE vocabulary file (JSON with ``vocab``, ``merges`` and ``added_tokens``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_ids = [vocab[s] for s in symbols]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        back = {s: b for b, s in enumerate(symbols)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for word, i in vocab.items():
            self.token[i] = bytes(back[c] for c in word)
        for word, i in added.items():
            self.token[i] = word.encode()
        self.added = {word: np.int32(i).tobytes() for word, i in added.items()}
        listed = "|".join(re.escape(w) for w in sorted(added, key=len, reverse=True))
        self.added_words = re.compile(f"({listed})") if added else None
        self.split = regex.compile(PIECES)
        self.piece = _Words(self._piece)
        self.first = _Words(self._first)
        self.later = _Words(self._later)

    def forget(self) -> None:
        """Drop the encoded words kept so far."""
        for words in (self.piece, self.first, self.later):
            words.older = {}
            words.clear()

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word of the pre-tokenizer."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > SCAN_PARTS:
            return self._merge_long(ids)
        rank, merged = self.rank, self.merged
        # entry i of ids is the part behind boundary i, entry i of ranks the pair around boundary i + 1
        ranks = [rank.get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            ids[at] = made = merged[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank.get(ids[at - 1] << 32 | made, NO_RANK)
            if at < len(ranks):
                ranks[at] = rank.get(made << 32 | ids[at + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [
            (r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank.get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := rank.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (s, a))
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode()), "<i4").tobytes()

    def _first(self, word: str) -> bytes:
        return b"".join([self.piece[p] for p in self.split.findall(word)])

    def _later(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Irregular
        return self._first(" " + word)

    def _plain(self, text: str) -> bytes:
        # a blank in front of a non-blank always begins a piece, so such words are encoded by themselves
        first, *later = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.later.__getitem__, later))
        except _Irregular:
            return self._first(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if self.added_words is None or not self.added_words.search(text):
            return self._plain(text) if text else b""
        parts = self.added_words.split(text)
        return b"".join(self.added[p] if i % 2 else self._plain(p) for i, p in enumerate(parts) if p)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> RankBpe:
    """The vocabulary, read once in each Python worker."""
    return RankBpe(path)


def _replaced(df: DataFrame, vocabulary: str, source: str, name: str, kind: T.DataType, function) -> DataFrame:
    """``df`` with the column ``name`` (in its place, if there is one) made batch by batch from ``source``."""
    names = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(name, kind)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, function(batch.column(len(names)))], [*names, name])
        load(vocabulary).forget()

    given = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source}`").alias("__source"))
    return given.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array column."""

    def encoded(texts: pa.Array) -> pa.Array:
        bpe = load(vocabulary)
        parts = [bpe.encode(t) if t else b"" for t in texts.to_pylist()]
        ends = np.cumsum([0, *[len(p) // 4 for p in parts]], dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return _replaced(df, vocabulary, text, ids, T.ArrayType(T.IntegerType()), encoded)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``ids``; null ids give an empty text."""
    names = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(text, T.StringType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                listed = batch.column(len(names))
                values, ends = listed.values.to_numpy(zero_copy_only=False), listed.offsets.to_numpy()
                valid = listed.is_valid().to_numpy(zero_copy_only=False)
                texts = [
                    bpe.decode(values[a:b].tolist()) if v else ""
                    for a, b, v in zip(ends, ends[1:], valid)
                ]
                columns = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, text])

    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias("__source")).mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass, so that a task has one Python worker and one vocabulary.

    ``df`` with the ids of ``text`` and the text of those ids, each in place of a column of its name.
    """
    names = [c for c in df.columns if c not in (ids, decoded)]
    made = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    schema = T.StructType([df.schema[c] for c in names] + made)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in slices(batches):
            parts = [bpe.encode(t) if t else b"" for t in batch.column(len(names)).to_pylist()]
            ends = np.cumsum([0, *[len(p) // 4 for p in parts]], dtype=np.int64).astype(np.int32)
            listed = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(parts), "<i4")))
            texts = pa.array([bpe.decode(np.frombuffer(p, "<i4").tolist()) for p in parts], pa.string())
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, listed, texts], schema.names)
        bpe.forget()

    given = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__source"))
    return given.mapInArrow(run, schema)
