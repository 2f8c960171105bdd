"""Toxicity by a classifier chain: categories in order, each model also seeing the earlier ones' probabilities.

The features of a text are its words and their beginnings. The model of a category is linear; beside
the features it gets the probability of every earlier category. While fitting, those probabilities
are out-of-fold predictions, so a later model never learns from an earlier one's own training rows.

The fit uses at most ``LABELLED`` labelled documents, those whose id has the least hash; scoring
reads all rows. What is sent to the tasks has at most ``FEATURES`` weights a category.

Defined cases: a null or empty text has no features; rows with a null id or label are not learned
from; a category without rows of both classes scores 0 everywhere; repeated rows score the same; other
columns are kept, those named like the scores are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm import linear
from tagloom.llm.common import lean, slices

LABELLED = 8000
FEATURES = 768
FOLDS = 5
TOXIC_FROM = 0.5
CACHED_WORDS = 200_000
BEGINNING = 4
PENALTY = 0.05

_WORDS = bytes(
    b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> set[bytes]:
    """The distinct words of a text, ASCII letters lowered."""
    return set(text.encode().translate(_WORDS).split()) if text else set()


def marks(word: bytes) -> tuple[int, int]:
    """The hashed features of a word: itself and its beginning."""
    return zlib.crc32(word), zlib.crc32(word[:BEGINNING] + b"~")


def features(text: str | None) -> np.ndarray:
    """All hashed features of a text, sorted."""
    return np.array(sorted({m for w in words(text) for m in marks(w)}), np.uint32)


class Chain:
    """The fitted models of the categories, in their order."""

    def __init__(self, documents: list[np.ndarray], labels: np.ndarray):
        self.models: list[tuple[linear.Presence, np.ndarray] | None] = []
        earlier = np.empty((len(documents), 0))
        fold = np.arange(len(documents)) % FOLDS
        for y in labels.T.astype(float):
            if min(y.sum(), len(y) - y.sum()) < 2 * FOLDS:
                self.models.append(None)
                earlier = np.hstack([earlier, np.zeros((len(y), 1))])
                continue
            outside = np.zeros(len(y))
            for k in range(FOLDS):
                rest = np.flatnonzero(fold != k)
                model = self.fitted([documents[i] for i in rest], earlier[rest], y[rest])
                own = np.flatnonzero(fold == k)
                outside[own] = self.predicted(model, [documents[i] for i in own], earlier[own])
            self.models.append(self.fitted(documents, earlier, y))
            earlier = np.hstack([earlier, outside[:, None]])
        self.columns = {}
        for number, model in enumerate(self.models):
            for column, feature in enumerate(model[0].features.tolist() if model else []):
                self.columns.setdefault(feature, []).append((number, column))

    @staticmethod
    def fitted(documents: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> tuple[linear.Presence, np.ndarray]:
        chooser = linear.Presence(documents, y, FEATURES)
        return chooser, linear.fit_logistic(np.hstack([chooser.rows(documents), earlier]), y, PENALTY)

    @staticmethod
    def predicted(model: tuple, documents: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        chooser, w = model
        return linear.sigmoid(linear.decided(np.hstack([chooser.rows(documents), earlier]), w))

    def scores(self, texts: list[str | None], known: dict[bytes, tuple]) -> np.ndarray:
        """The probability of each category, a column each; ``known`` keeps words' weights between calls."""
        odds = np.zeros((len(texts), len(self.models)))
        for row, text in zip(odds, texts):
            found = set()
            for word in words(text):
                held = known.get(word)
                if held is None:
                    held = tuple(c for m in marks(word) for c in self.columns.get(m, ()))
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    if len(word) <= 48:
                        known[word] = held
                if held:
                    found.update(held)
            for number, column in found:
                row[number] += self.models[number][1][column]
        out = np.zeros_like(odds)
        for number, model in enumerate(self.models):
            if model:
                w = model[1][len(model[0].features) :]
                out[:, number] = linear.sigmoid(odds[:, number] + out[:, :number] @ w[:-1] + w[-1])
        return out


def fit(documents: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """A chain over the 0/1 columns ``categories`` of ``labels``, in that order."""
    chosen = linear.labelled_sample(labels, "doc_id", categories, LABELLED)

    def featured(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([features(t).tobytes() for t in batch.column(1 + len(categories)).to_pylist()], pa.binary())]

    frame = linear.sampled(documents.select("doc_id", "text"), chosen, featured, "marks binary")
    rows = [np.frombuffer(m, np.uint32) for m in frame["marks"]]
    return Chain(rows, frame[categories].to_numpy(np.int64).reshape(len(rows), len(categories)))


def score(documents: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """``documents`` with the probability ``p_<category>`` of each category."""
    model = fit(documents, labels, categories)
    own = [f"p_{c}" for c in categories]
    names = [c for c in documents.columns if c not in own]
    schema = T.StructType([documents.schema[c] for c in names] + [T.StructField(c, T.DoubleType()) for c in own])
    at = names.index("text")

    @lean
    def scored(batches: Iterator[pa.RecordBatch], model: Chain) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in slices(batches, at):
            made = model.scores(batch.column(at).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in made.T]], schema.names)

    return documents.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(partial(scored, model=model), schema)
