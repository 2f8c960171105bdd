"""Benchmark contamination: one Aho-Corasick automaton over normalised benchmark windows.

A normalised text is its words (ASCII letters lowered, digits, everything beyond ASCII) with single
blanks around them, so a window of words is one string and an occurrence begins and ends at words.
Every text is scanned once; an occurrence's place gives word numbers, and word numbers give places
in the text as it was.

The benchmark goes to every task, so its size is checked: more than ``MOST_BYTES`` of it is refused
with an error and must be given in parts. Nothing that grows with the documents is sent.

Defined cases: a null or empty text has no words and no hits; an item whose id or text is null, or
that has no words, has no windows; items of equal text all occur where one does; rows with one item id
count as one item; repeated documents are each judged; an empty benchmark hits nothing; other columns
of the documents are kept, the operator's own replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import lean, slices

WINDOW = 13
MOST_BYTES = 64 << 20
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = re.compile(f"[^{NOT_WORD}]+")
_TABLE = bytes(
    b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

COLUMNS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField(
        "spans",
        T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
    ),
]


def words(text: str) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode().translate(_TABLE).split()


def joined(listed: list[bytes]) -> str:
    """Words with a blank at each side, one character a byte."""
    return f" {b' '.join(listed).decode('latin-1')} "


def windows(items: list[tuple[str, str]], size: int = WINDOW) -> dict[str, tuple[int, set[str]]]:
    """Each window's string with its number of words and the items it belongs to."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        listed = words(text)
        for i in range(max(1, len(listed) - size + 1) if listed else 0):
            part = listed[i : i + size]
            found.setdefault(joined(part), (len(part), set()))[1].add(item)
    return found


class Scanner:
    """The automaton and what its matches mean for a text."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.automaton = ahocorasick.Automaton()
        for window, meaning in windows(items, size).items():
            self.automaton.add_word(window, meaning)
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[dict[str, int]]]:
        """Words, hit words, items with an occurring window, and hit runs as places in the text."""
        listed = words(text) if text else []
        normal = joined(listed)
        matches = list(self.automaton.iter(normal)) if len(self.automaton) and listed else []
        if not matches:
            return len(listed), 0, [], []
        blanks = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
        ends = np.searchsorted(blanks, [end for end, _ in matches])
        marks = np.zeros(len(listed) + 1, np.int64)
        np.add.at(marks, ends - [size for _, (size, _) in matches], 1)
        np.add.at(marks, ends, -1)
        hit = np.cumsum(marks[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        # a word here holds the same characters as a word of the normalised text, so their numbers agree
        places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
        return len(listed), int(hit.sum()), sorted(set().union(*(i for _, (_, i) in matches))), spans


_LOWER = {c: c + 32 for c in range(65, 91)}


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> list[tuple[str, str]]:
    """The items as strings, after a check that they fit into every task."""
    given = benchmark.select(F.col(f"`{item}`").cast("string"), F.col(f"`{text}`")).dropna()
    size = given.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark holds {size} bytes, over {MOST_BYTES}: give it in parts")
    return sorted((r[0], r[1]) for r in given.collect())


def contamination(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW
) -> DataFrame:
    """``documents`` with n_words, n_hit, items (sorted as strings) and spans (hit runs, in characters)."""
    items = benchmark_items(benchmark, item)
    own = {c.name for c in COLUMNS}
    names = [c for c in documents.columns if c not in own]
    schema = T.StructType([documents.schema[c] for c in names] + COLUMNS)
    kinds = [
        pa.int64(),
        pa.int64(),
        pa.list_(pa.string()),
        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    ]

    @lean
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(items, size)
        for batch in slices(batches):
            found = [scanner.scan(t) for t in batch.column(len(names)).to_pylist()]
            columns = [batch.column(i) for i in range(len(names))]
            made = [pa.array(values, kind) for values, kind in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema.names)

    given = documents.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__source"))
    return given.mapInArrow(scanned, schema)


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> F.Column:
    """Whether at least a twentieth of a document's words, and one at least, are hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
