"""Ranks of linked lists that no task holds whole: prefix sums of weights along the links.

A list is a table of elements with two key columns (a1, a2), the key of the next element (b1, b2,
null for the last) and weights. Keys that are near in order should tend to be neighbours in the list.
Elements are dealt by ranges of their key; each task joins the links whose both ends it holds into
segments by pointer doubling, and the segments' heads are a shorter list. While that list has more than
``ROWS`` elements, about a quarter of them is taken out a round, by coins: an element whose coin shows heads
takes in the next one if that one's shows tails. At most ``ROWS`` elements are ranked in one task;
then everything taken out gets its place again from what took it in.

Defined cases: an empty table gives no rows; a table may hold several lists, each ranked by itself; keys
are unique and links make no cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import lean, saved

ROWS = 250_000
KEY, NEXT = ["a1", "a2"], ["b1", "b2"]


def _found(keys: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Places of the wanted pairs among sorted unique pairs, -1 where there is none."""
    firsts, code = np.unique(keys[0], return_inverse=True)
    at = np.searchsorted(firsts, wanted[0]).clip(max=len(firsts) - 1)
    known = firsts[at] == wanted[0]
    seconds, rank = np.unique(keys[1], return_inverse=True)
    second = np.searchsorted(seconds, wanted[1]).clip(max=len(seconds) - 1)
    known &= seconds[second] == wanted[1]
    own, asked = code * len(seconds) + rank, at * len(seconds) + second
    place = np.searchsorted(own, asked).clip(max=len(own) - 1)
    return np.where(known & (own[place] == asked), place, -1)


def _segments(keys: list[np.ndarray], nexts: list[np.ndarray], ends: np.ndarray, weights: np.ndarray):
    """For each element: the place of its segment's head and the sums up to and with the element."""
    after = _found(keys, nexts)
    after[ends] = -1
    n = len(after)
    before = np.full(n, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    head, total = np.where(before < 0, np.arange(n), before), weights.copy()
    done = before < 0
    left = np.flatnonzero(~done)
    while len(left):
        # all pointers double at once; what points at a finished element takes its whole sum
        at = head[left]
        ends_here = done[at]
        total[left], head[left] = total[left] + total[at], head[at]
        done[left[ends_here]] = True
        left = left[~ends_here]
    return head, total, after < 0


def contracted(elements: DataFrame, weights: list[str], parts: int) -> DataFrame:
    """Each element with its segment's head (h1, h2), sums within the segment, and whether it is the tail."""
    kinds = "a1 long, a2 long, h1 long, h2 long, b1 long, b2 long, tail boolean"
    schema = ", ".join([kinds, *(f"`{w}` long" for w in weights)])
    names = ["a1", "a2", "h1", "h2", "b1", "b2", "tail", *weights]

    @lean
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        ends = rows.column("b1").is_null().to_numpy()
        keys = [rows.column(c).to_numpy() for c in KEY]
        nexts = [rows.column(c).fill_null(0).to_numpy() for c in NEXT]
        given = np.stack([rows.column(w).to_numpy() for w in weights], axis=1)
        head, total, tail = _segments(keys, nexts, ends, given)
        columns = [*(pa.array(k) for k in keys), *(pa.array(k[head]) for k in keys)]
        columns += [pa.array(c, mask=ends) for c in nexts]
        columns += [pa.array(tail), *(pa.array(total[:, i]) for i in range(len(weights)))]
        yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=10_000)

    given = elements.select(*KEY, *NEXT, *weights)
    ranged = given.repartition(1) if parts == 1 else given.repartitionByRange(parts, *KEY)
    return ranged.sortWithinPartitions(*KEY).mapInArrow(joined, schema)


def _thinned(elements: DataFrame, weights: list[str], turn: int) -> tuple[DataFrame, DataFrame]:
    """The list with some elements taken in by the one before, and those with their offset from it."""
    coin = (F.xxhash64(*KEY, F.lit(turn)).bitwiseAND(F.lit(1)) == 1).alias("heads")
    tossed = elements.select(*KEY, *NEXT, *weights, coin)
    tails = tossed.where("NOT heads").select(
        F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("b1").alias("n1"), F.col("b2").alias("n2"), *[F.col(w).alias(f"of_{w}") for w in weights]
    )
    met = saved(tossed.where("heads").join(tails.withColumn("takes", F.lit(True)), NEXT, "left"), "list-met")
    took = met.where("takes")
    gone = took.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("h1"), F.col("a2").alias("h2"), *weights)
    merged = took.select(*KEY, F.col("n1").alias("b1"), F.col("n2").alias("b2"), *[(F.col(w) + F.col(f"of_{w}")).alias(w) for w in weights])
    rest = met.where("takes IS NULL").select(*KEY, *NEXT, *weights)
    others = tossed.where("NOT heads").join(gone.select(*KEY), KEY, "left_anti").select(*KEY, *NEXT, *weights)
    return saved(merged.unionByName(rest).unionByName(others), "list-rest"), gone


def before(elements: DataFrame, weights: list[str], rows: int = ROWS) -> DataFrame:
    """(a1, a2, weights): the sums of all that stands before each element of a list of any length."""
    left, taken, turn = elements, [], 0
    while left.count() > rows:
        left, gone = _thinned(left, weights, turn)
        taken.append(gone)
        turn += 1
    ranked = contracted(left, weights, 1).select(*KEY, *weights)
    own = left.select(*KEY, *[F.col(w).alias(f"own_{w}") for w in weights])
    found = ranked.join(own, KEY).select(*KEY, *[(F.col(w) - F.col(f"own_{w}")).alias(w) for w in weights])
    for gone in reversed(taken):
        found = saved(found, "list-ranks")
        base = found.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), *[F.col(w).alias(f"of_{w}") for w in weights])
        back = gone.join(base, ["h1", "h2"]).select(*KEY, *[(F.col(w) + F.col(f"of_{w}")).alias(w) for w in weights])
        found = found.unionByName(back)
    return found


def ranks(elements: DataFrame, weights: list[str], rows: int = ROWS) -> DataFrame:
    """(a1, a2, weights): the sums of weights along the list up to and with each element."""
    elements = saved(elements.select(*KEY, *NEXT, *weights), "list")
    least = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = elements.count()
    parts = saved(contracted(elements, weights, max(min(least, n // 1000 + 1), -(-n // rows))), "list-segments")
    heads = parts.where("tail").select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), *NEXT, *weights)
    base = before(heads, weights, rows).select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), *[F.col(w).alias(f"of_{w}") for w in weights])
    return parts.join(base, ["h1", "h2"]).select(*KEY, *[(F.col(w) + F.col(f"of_{w}")).alias(w) for w in weights])
