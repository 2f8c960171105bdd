"""Quality by co-training: two views of a document teach each other, then judge together.

The content view sees the shapes and endings of a text's words; the metadata view sees the row's
other fields (source, language, length) and layout counts. Both start from the same labelled sample.
In each round a view labels the unlabelled documents it is surest of for the *other* view, and both
are fitted again. On labelled rows kept out of the fitting each view is calibrated (Platt) and a
small logistic model combines the two calibrated views; it then scores every document.

The fit uses at most ``LABELLED`` labelled and ``POOL`` unlabelled documents, those whose id has the
least hash; everything else reads all rows. The model sent to the tasks has at most ``FEATURES``
weights and does not grow with the data.

Defined cases: a null text counts as empty; null source, language or length count as a value of their
own; rows with null id or label are not learned from; without rows of both classes every document
scores 1; repeated rows score the same; other columns of the documents are kept, those named like the
scores are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm import linear
from tagloom.llm.common import lean, slices

LABELLED = 8000
POOL = 6000
FEATURES = 512
ROUNDS = 4
TAUGHT = 150
HELD_OUT = 4
REJECT_BELOW = 0.5
CACHED_WORDS = 200_000

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 4
_CLASSES[[9, 10, 11, 12, 13, 32]] = 5
_LETTERS = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
SCORES = ["content_score", "metadata_score", "score"]


class _Shapes(dict):
    """A word's shape: letters and digits by class, runs of one character as one."""

    def __missing__(self, word: bytes) -> tuple[bytes, bytes]:
        kinds = word.translate(_LETTERS)
        shape = bytes(b for i, b in enumerate(kinds[:64]) if i == 0 or b != kinds[i - 1])
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 48:
            self[word] = (shape, kinds[-3:])
        return shape, kinds[-3:]


_shapes = _Shapes()


def content(text: str | None) -> np.ndarray:
    """Hashed features: shapes and endings that occur, and those that a tenth of the words have."""
    words = text.encode().split() if text else []
    found = Counter(map(_shapes.__getitem__, words))
    marks = set()
    for place in (0, 1):
        held: Counter = Counter()
        for key, n in found.items():
            held[key[place]] += n
        for key, n in held.items():
            marks.add(zlib.crc32(b"%d%s" % (place, key)))
            if n * 10 >= len(words):
                marks.add(zlib.crc32(b"%d#%s" % (place, key)))
    return np.array(sorted(marks), np.uint32)


def metadata(text: str | None, source: object, lang: object, n_chars: int | None) -> np.ndarray:
    """The fields of a row and the layout of its text as numbers."""
    raw = text.encode() if text else b""
    counts = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=6) / max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    row = np.zeros(14 + 48)
    row[:6] = counts
    row[6:14] = (
        np.log1p(len(text or "") if n_chars is None else max(0, n_chars)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(len(raw) / len(lines)) / 5,
        len(set(words)) / max(1, len(words)),
        sum(map(eq, words, words[1:])) / max(1, len(words)),
        len(set(lines)) / len(lines),
        len(raw) / max(1, len(words)) / 10,
        max(map(len, words), default=0) > 40,
    )
    row[14 + zlib.crc32(str(source).encode()) % 32] = 1
    row[46 + zlib.crc32(str(lang).encode()) % 16] = 1
    return row


class CoTrained:
    """Two fitted views and their combination."""

    def __init__(self, contents: list[np.ndarray], rows: np.ndarray, y: np.ndarray):
        """``y`` is 1, 0 or -1 for documents without a label; their order decides nothing but ties."""
        known = np.flatnonzero(y >= 0)
        held = known[::HELD_OUT]
        train = np.setdiff1d(known, held)
        self.chooser = linear.Presence([contents[i] for i in train], y[train].astype(float), FEATURES)
        self.middle = rows[train].mean(0)
        self.spread = rows[train].std(0) + 1e-3
        views = [self.chooser.rows(contents), self.standard(rows)]
        taught = [(train, y[train].astype(float))] * 2
        pool = np.flatnonzero(y < 0)
        for turn in range(ROUNDS + 1):
            self.weights = [linear.fit_logistic(v[at], target) for v, (at, target) in zip(views, taught)]
            if turn == ROUNDS or not len(pool):
                break
            sure = [linear.decided(v[pool], w) for v, w in zip(views, self.weights)]
            share = np.clip(y[train].mean(), 0.1, 0.9)
            used = set()
            for own, other in ((0, 1), (1, 0)):
                order = np.argsort(sure[own], kind="stable")
                low = [i for i in order[: int(TAUGHT * (1 - share)) + 1] if sure[own][i] < -2]
                high = [i for i in order[::-1][: int(TAUGHT * share) + 1] if sure[own][i] > 2]
                at, target = taught[other]
                taught[other] = (
                    np.concatenate([at, pool[low + high].astype(np.int64)]),
                    np.concatenate([target, np.zeros(len(low)), np.ones(len(high))]),
                )
                used |= {*low, *high}
            pool = np.delete(pool, sorted(used))
        odds = [linear.decided(v[held], w) for v, w in zip(views, self.weights)]
        target = (y[held] * (len(held)) + 1) / (len(held) + 2)
        self.platt = [linear.fit_logistic(o[:, None] / 4, target, 1e-2) for o in odds]
        both = np.stack([linear.decided(o[:, None] / 4, p) for o, p in zip(odds, self.platt)], 1)
        self.together = linear.fit_logistic(both, target, 1e-2)

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.middle) / self.spread, -6, 6)

    def scores(self, contents: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Calibrated content and metadata scores and the combined one, a column each."""
        views = [self.chooser.rows(contents), self.standard(rows)]
        odds = [
            linear.decided(linear.decided(v, w)[:, None] / 4, p)
            for v, w, p in zip(views, self.weights, self.platt)
        ]
        return linear.sigmoid(np.stack([*odds, linear.decided(np.stack(odds, 1), self.together)], 1))


def _views(batch: pa.RecordBatch, at: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    text, source, lang, n_chars = (batch.column(i).to_pylist() for i in at)
    rows = np.array([metadata(*row) for row in zip(text, source, lang, n_chars)])
    return [content(t) for t in text], rows.reshape(len(text), 62)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality") -> CoTrained | None:
    """The model from bounded samples; None if they do not hold both classes."""
    chosen = linear.labelled_sample(labels, "doc_id", [label], LABELLED)
    chosen = chosen.withColumn(label, F.col(label).cast("int")).withColumnRenamed(label, "y")
    fields = documents.select("doc_id", "text", "source", "lang", "n_chars").where("doc_id IS NOT NULL")
    pool = fields.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POOL).distinct()
    pool = pool.join(chosen, "doc_id", "left_anti").withColumn("y", F.lit(-1))

    def featured(batch: pa.RecordBatch) -> list[pa.Array]:
        contents, rows = _views(batch, [2, 3, 4, 5])
        return [pa.array([c.tobytes() for c in contents], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())]

    frame = linear.sampled(fields, chosen.union(pool), featured, "content binary, fields binary")
    y = frame["y"].to_numpy(np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 2 * HELD_OUT:
        return None
    contents = [np.frombuffer(c, np.uint32) for c in frame["content"]]
    return CoTrained(contents, np.array([np.frombuffer(r) for r in frame["fields"]]), y)


def score(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``documents`` with content_score, metadata_score and score, probabilities of good quality."""
    return apply(documents, fit(documents, labels, label))


def apply(documents: DataFrame, model: CoTrained | None) -> DataFrame:
    """``documents`` with the scores of a fitted model."""
    names = [c for c in documents.columns if c not in SCORES]
    schema = T.StructType([documents.schema[c] for c in names] + [T.StructField(c, T.DoubleType()) for c in SCORES])
    given = documents.select(*[F.col(f"`{c}`") for c in names])
    if model is None:
        return given.select("*", *[F.lit(1.0).alias(c) for c in SCORES])
    at = [names.index(c) for c in ("text", "source", "lang", "n_chars")]

    @lean
    def scored(batches: Iterator[pa.RecordBatch], model: CoTrained) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at[0]):
            made = model.scores(*_views(batch, at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in made.T]], schema.names)
        _shapes.clear()

    return given.mapInArrow(partial(scored, model=model), schema)
