"""Hard negatives by threshold joins over an inverted index with norm bounds.

Vectors are taken as integers and scored by inner product. Rows are dealt into shards by a hash. A task
searches a shard for a block of requests, each of which wants the best ``k`` rows of a score window:

* Dimensions are taken in groups, the heaviest first. A row is indexed in its first groups only: its
  other dimensions are omitted once the norms of what follows, its own times the greatest of the
  requests', stay below the least threshold. A row that is not indexed at all cannot reach it.
* A request accumulates partial scores group by group and drops each row whose partial score plus
  the product of the remaining norms stays below the request's threshold.
* What is left is scored exactly.

Thresholds begin high, so that a round returns few rows of a shard; requests whose windows are not
filled come again with a lower one, searching only the band below, down to the window's end.
Positives are searched from the greatest possible score downwards, negatives from 0.9 of the positive's.

Memory: a task holds one shard (``VALUES`` numbers) and one block of ``ASKED`` requests at a time; a shard
returns at most k rows a request and round. Every request meets every shard, which is the work of a
search of given queries against all rows, in blocks.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part;
components of shorter vectors that are missing count as 0; whole rows that are repeated count once; rows
that share a vec_id are rows of their own, tied by label and vector; a null vec_id comes last among
equal scores and is no anchor; an empty table or one without anchors gives no rows; other columns are
left out. Scores have to fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import lean, saved

SCALE = 256
VALUES = 1 << 19
ASKED = 512
BLOCKS = 16
GROUP = 8
# shares of the greatest possible score at which the search for positives stops in turn, then nothing
STEPS = (0.5, 0.25, 0.0)
# shares of a window that are searched in turn
BANDS = (0.125, 0.25, 0.5, 1.0)
LEAST, MOST = -(1 << 63), (1 << 63) - 1

PACKED = (
    "part long, n int, width int, keys binary, ids binary, unnamed binary, labels binary, kind string, data binary, "
    "run binary, wanted binary, low binary, high binary"
)
_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def integer_vectors(df: DataFrame, vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """key, vec_id, label and vector (floors of ``SCALE`` times the components) of the rows that take part."""
    given = df.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"))

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    given = given.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", usable))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE))
    rows = given.select("vec_id", "label", whole.alias("vector")).distinct()
    return rows.select(F.xxhash64("vec_id", "label", "vector").alias("key"), "vec_id", "label", "vector")


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def packed(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """One row for each part: (key, vec_id, label, vector) and the requests (wanted, low, high), if any, as arrays."""
    asked = "wanted" in rows.columns
    more = ["wanted", "low", "high"] if asked else []
    given = rows.select(F.pmod("key", F.lit(parts)).alias("part"), "key", "vec_id", "label", "vector", *more)
    order = ["part", "key", "vec_id", *more[:1]]

    def one(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        key, label = table.column("key").to_numpy(), table.column("label").to_numpy()
        ids, unnamed = table.column("vec_id").fill_null(0).to_numpy(), table.column("vec_id").is_null().to_numpy()
        data = _matrix(table.column("vector").combine_chunks(), width)
        # requests of one anchor follow each other and share its vector
        starts = np.ones(len(key), bool)
        if asked:
            starts[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (label[1:] != label[:-1]) | (data[1:] != data[:-1]).any(axis=1)
        kind = next((k for k in ("<i2", "<i4") if np.abs(data).max(initial=0) < np.iinfo(k).max), "<i8")
        arrays = [key[starts], ids[starts], unnamed[starts], label[starts]]
        tail = [np.cumsum(starts) - 1, *(table.column(c).to_numpy() for c in more)]
        tail += [np.empty(0, np.int64)] * (4 - len(tail))
        row = [part, int(starts.sum()), width, *(a.tobytes() for a in arrays), kind, data[starts].astype(kind).tobytes(), *(a.tobytes() for a in tail)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.string(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], _NAMES)

    @lean
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = None
        for batch in batches:
            own = batch.column(0).to_numpy()
            for begin, end in _runs(own):
                if held and own[begin] != part:
                    yield one(part, held)
                    held = []
                part = int(own[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield one(part, held)

    return given.repartition("part").sortWithinPartitions(*order).mapInArrow(made, PACKED)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)])) if len(values) else []


class Block:
    """The arrays of a packed row."""

    def __init__(self, row: dict):
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("keys", "ids", "labels"))
        self.unnamed = np.frombuffer(row["unnamed"], bool)
        data = np.frombuffer(row["data"], row["kind"]).reshape(row["n"], row["width"])
        self.run, self.wanted, self.low, self.high = (np.frombuffer(row[c], np.int64) for c in ("run", "wanted", "low", "high"))
        self.top = int(np.abs(data).max(initial=0).astype(object))
        self.data = data


def _tails(data: np.ndarray) -> np.ndarray:
    """Norms of what follows the first 0, 1, ... groups of dimensions, rounded up."""
    squares = np.square(data.astype(np.float64))
    edges = range(0, data.shape[1], GROUP)
    groups = np.add.reduceat(squares, list(edges), axis=1) if data.shape[1] else np.zeros((len(data), 0))
    sums = np.concatenate([groups[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(data), 1))], axis=1)
    return np.sqrt(sums) * (1 + 1e-9)


class Index:
    """A shard indexed for a block: its rows by falling number of indexed groups."""

    def __init__(self, shard: Block, asked: Block):
        order = np.argsort(-np.square(shard.data.astype(np.float64)).sum(axis=0), kind="stable")
        # whole numbers below 2**53 are exact as doubles
        exact = shard.top * asked.top * max(1, len(order)) < 1 << 53
        kind = np.float64 if exact else np.int64
        self.queries = asked.data[:, order].astype(kind)
        data = shard.data[:, order].astype(kind)
        self.query_tails, tails = _tails(self.queries), _tails(data)
        reach = self.query_tails.max(axis=0) * tails + 0.5
        groups = (reach[:, :-1] >= float(asked.low.min())).sum(axis=1)
        self.rows = np.argsort(-groups, kind="stable")
        self.groups = groups[self.rows]
        self.data, self.tails = data[self.rows], tails[self.rows]
        self.labels = shard.labels[self.rows]
        # how many rows, from the first, are indexed in each group
        self.indexed = [int(np.searchsorted(-self.groups, -g, "left")) for g in range(data.shape[1] and tails.shape[1] - 1)]

    def reaching(self, query: int, alive: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows ``alive`` (ascending places) that score ``least`` or more, with their scores."""
        vector, tail = self.queries[query], self.query_tails[query]
        partial = np.zeros(len(alive), self.data.dtype)
        for group, indexed in enumerate(self.indexed):
            n = int(np.searchsorted(alive, indexed))
            if not n:
                break
            cut = slice(group * GROUP, (group + 1) * GROUP)
            partial[:n] += self.data[alive[:n], cut] @ vector[cut]
            near = np.ones(len(alive), bool)
            near[:n] = partial[:n] + tail[group + 1] * self.tails[alive[:n], group + 1] + 0.5 >= least
            alive, partial = alive[near], partial[near]
        scores = (self.data[alive] @ vector).astype(np.int64)
        good = scores >= least
        return alive[good], scores[good]


def best(shard: Block, asked: Block, same: bool, k: int) -> list[np.ndarray]:
    """Columns key, wanted, row's key, vec_id, unnamed, label and score of each request's best rows in a shard."""
    index, out = Index(shard, asked), []
    all_rows = np.arange(np.count_nonzero(index.groups))
    keys, ids, unnamed = (x[index.rows] for x in (shard.keys, shard.ids, shard.unnamed))
    for begin, end in _runs(asked.run):
        query = int(asked.run[begin])
        alike = index.labels[: len(all_rows)] == asked.labels[query]
        alive, scores = index.reaching(query, all_rows[alike if same else ~alike], int(asked.low[begin:end].min()))
        if same:
            itself = (keys[alive] == asked.keys[query]) & (ids[alive] == asked.ids[query]) & ~unnamed[alive]
            alive, scores = alive[~itself], scores[~itself]
        for i in range(begin, end):
            at = np.flatnonzero((scores >= asked.low[i]) & (scores <= asked.high[i]))
            if not len(at):
                continue
            if len(at) > 4 * k:
                at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
            rows = alive[at]
            first = np.lexsort([keys[rows], index.labels[rows], ids[rows], unnamed[rows], -scores[at]])[:k]
            rows, own = rows[first], scores[at[first]]
            n = len(rows)
            out.append([np.full(n, asked.keys[query]), np.full(n, asked.wanted[i]), keys[rows], ids[rows], unnamed[rows], index.labels[rows], own])
    return [np.concatenate(c) for c in zip(*out)] if out else []


FOUND = "key long, wanted long, row_key long, vec_id long, label long, score long"


def search(requests: DataFrame, shards: DataFrame, n_shards: int, width: int, same: bool, k: int) -> DataFrame:
    """``FOUND``: the best ``k`` rows within [low, high] in every shard, of the same label or of others.

    ``requests`` has key, vec_id, label, vector, wanted (number among the key's requests), low and high.
    """
    blocks = max(1, -(-requests.count() // ASKED))
    teams = -(-blocks // BLOCKS)
    names = [c.split()[0] for c in FOUND.split(", ")]
    asked = packed(requests, blocks, width)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    asked = asked.withColumn("team", (F.col("part") / BLOCKS).cast("long"))
    held = shards.withColumn("shard", F.col("part").cast("int")).withColumn("part", F.lit(-1).cast("long"))
    held = held.withColumn("team", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(teams - 1).cast("long"))))
    dealt = held.unionByName(asked).repartition(n_shards * teams, "shard", "team")

    @lean
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] < 0:
                    shard, at = Block(row), (row["shard"], row["team"])
                elif at == (row["shard"], row["team"]) and len(shard.keys) and len(found := best(shard, Block(row), same, k)):
                    key, wanted, row_key, ids, unnamed, label, score = found
                    columns = [key, wanted, row_key, pa.array(ids, mask=unnamed), label, score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    return dealt.sortWithinPartitions("shard", "team", "part").mapInArrow(searched, FOUND)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each request with their ``rank``."""
    order = F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("u"), "vec_id", "label", "row_key")
    place = F.row_number().over(Window.partitionBy("key", "wanted").orderBy(order))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def filled(requests: DataFrame, lows: list[Column], shards: DataFrame, n_shards: int, width: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows of each request within its window, searched in bands downwards from ``high``.

    Band by band the threshold is lowered to the next of ``lows``; requests that have k rows stop.
    """
    left, parts = requests, []
    for low in lows:
        band = left.withColumn("floor", low)
        band = saved(band.where("floor <= high").withColumn("low", F.col("floor")).drop("floor"), "requests")
        if band.isEmpty():
            break
        parts.append(saved(search(band, shards, n_shards, width, same, k), "found"))
        all_found = parts[0]
        for part in parts[1:]:
            all_found = all_found.unionByName(part)
        counted = all_found.groupBy("key", "wanted").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        left = band.join(counted.select("key", "wanted"), ["key", "wanted"], "left_anti").withColumn("high", F.col("low") - 1)
        left = left.withColumn("low", F.lit(None).cast("long"))
    if not parts:
        return shards.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    return _best_of(all_found, k)


def mine(
    df: DataFrame,
    anchor: Column,
    vector: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    values: int = VALUES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of (vec_id, label, vector).

    An anchor's positives are its best rows of the same label. For each, the negatives are the best rows
    of other labels whose score is within the window's percentages of the positive's score.
    """
    rows = saved(integer_vectors(df, vector, label), "vectors")
    squares = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(squares)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not width:
        return df.sparkSession.createDataFrame([], schema)
    n_shards = -(-n * width // values)
    shards = saved(packed(rows, n_shards, width), "shards")
    anchors = rows.where(anchor)

    reach = F.ceil(squares * F.lit(longest) * (1 + 1e-9))
    wanted = anchors.select("*", F.lit(0).cast("long").alias("wanted"), F.lit(MOST).alias("high"), reach.alias("reach"))
    lows = [*(F.floor(F.col("reach") * s).cast("long") for s in STEPS), F.lit(LEAST + 1)]
    near = filled(wanted, lows, shards, n_shards, width, True, positives)
    near = saved(near.select("key", F.col("rank").cast("long").alias("wanted"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    least, most = (F.expr(f"(positive_score * {p} + {add}) div 100") for p, add in ((window[0], 99), (window[1], 0)))
    wanted = anchors.join(near.where("positive_score >= 0"), "key").withColumn("end", least).withColumn("high", most).withColumn("top", most)
    wanted = wanted.drop("positive_id", "positive_score").where("end <= high")
    lows = [F.greatest("end", F.col("top") - F.floor((F.col("top") - F.col("end")) * b).cast("long")) for b in BANDS]
    far = filled(wanted, lows, shards, n_shards, width, False, negatives)
    far = far.select("key", "wanted", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = far.join(near, ["key", "wanted"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
