"""Linear models over sparse presence features, fitted on a bounded sample on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import slices


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last one the bias) of an L2-penalised logistic regression, by Newton steps.

    ``y`` may hold probabilities. The curvature is solved by conjugate gradients, so the cost is
    a few passes over ``x`` a step, and the result depends on the rows alone.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        if np.abs(slope).max() < 1e-4 * max(1, len(x)) ** 0.5:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        step, left = np.zeros_like(w), slope.copy()
        along, size = left.copy(), left @ left
        for _ in range(25):
            bent = x.T @ (curve * (x @ along)) + ridge * along
            reach = size / (along @ bent)
            step += reach * along
            left -= reach * bent
            size, old = left @ left, size
            if size < 1e-10:
                break
            along = left + size / old * along
        w -= step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
    return w


def decided(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log odds of the rows of ``x``."""
    return x @ w[:-1] + w[-1]


class Presence:
    """Which of the most telling of all hashed features a document has."""

    def __init__(self, documents: list[np.ndarray], y: np.ndarray, most: int):
        """Choose ``most`` features by how far their rates in the two classes lie apart, in standard errors."""
        found, at = np.unique(np.concatenate(documents) if documents else np.empty(0, np.uint32), return_inverse=True)
        heavy = np.repeat(y, [len(d) for d in documents])
        ones, held = np.bincount(at, heavy, len(found)), np.bincount(at, minlength=len(found))
        n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
        rate = (held + 1) / (len(y) + 2)
        apart = np.abs(ones / n1 - (held - ones) / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
        apart[held < 3] = 0
        chosen = np.argsort(-apart, kind="stable")[:most]
        self.features = np.sort(found[chosen[apart[chosen] > 0]])

    def rows(self, documents: list[np.ndarray]) -> np.ndarray:
        """A 0/1 row for each document."""
        out = np.zeros((len(documents), len(self.features)), np.float32)
        if len(self.features):
            for row, d in zip(out, documents):
                at = np.minimum(np.searchsorted(self.features, d), len(self.features) - 1)
                row[at[self.features[at] == d]] = 1
        return out


def labelled_sample(labels: DataFrame, doc: str, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` labelled ids, those with the least hash, without null labels; one row an id."""
    given = labels.select(F.col(f"`{doc}`").alias("doc_id"), *[F.col(f"`{c}`").alias(c) for c in columns])
    chosen = given.dropna().orderBy(F.xxhash64("doc_id"), "doc_id", *columns).limit(most)
    return chosen.dropDuplicates(["doc_id"])


def sampled(documents: DataFrame, chosen: DataFrame, featured: Callable[[pa.RecordBatch], list[pa.Array]], kind: str):
    """The chosen documents with their features as a pandas frame ordered by id; ``chosen`` is bounded."""
    kept = [c for c in chosen.columns if c != "doc_id"]
    given = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", *kept, *[c for c in documents.columns if c != "doc_id"])
    schema, text = chosen.select("doc_id", *kept).schema, given.columns.index("text")
    names = [*schema.names, *[part.split(" ")[0] for part in kind.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            own = [batch.column(i) for i in range(1 + len(kept))]
            yield pa.RecordBatch.from_arrays([*own, *featured(batch)], names)

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    frame = given.mapInArrow(run, f"{typed}, {kind}").toPandas()
    return frame.sort_values("doc_id", kind="stable").drop_duplicates("doc_id").reset_index(drop=True)

