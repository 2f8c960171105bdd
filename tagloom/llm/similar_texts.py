"""Texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more, found by SimHash balls.

At 0.8 a SimHash of 64 bits differs in about 10 bits, so one fingerprint and a small radius do not
find the pair. Here each distinct shingle set has ``PRINTS`` fingerprints of different mixes of its
shingle hashes, each cut into three parts of 21 bits. A part emits a ball of its value: every
combination of flips of its ``FREE`` bits nearest to the threshold and single flips of the ``NEXT``
ones, since those bits are the ones that differ between similar sets. A shuffle brings equal values
together; those that meet and differ in at most ``APART`` of 128 bits are candidates. By calculation
a part meets at 0.8 with probability 0.53, so one of nine parts with 0.998, and more above 0.8.

Candidates are only connected, by stars, into blocks. Then the shingle sets of a block, each once,
are compared exactly, and only pairs of ``LEAST`` or more are linked. A block of more than ``TILE``
sets is compared tile against tile, so no task holds it whole; its sets are copied once a tile.

Defined cases: a text without words has the empty set; equal sets are one class, whatever their
texts; a text of at most five words is one shingle; a null id gets the component of its class, null
if no row of the component has an id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import lean, saved, slices
from tagloom.llm.graph import components
from tagloom.llm.simhash_ball import SEED, shingles

WORDS = 5
LEAST = (4, 5)
PRINTS = 3
PARTS, WIDTH = 3, 21
FREE, NEXT = 3, 5
APART = 31
TILE = 256
MARKS = 1 << 24
_BLOCK = 1 << 14
_LOOKED = 32
_FEATURES = 4096

_SUBSETS = (np.arange(1 << FREE)[None, :] >> np.arange(FREE)[:, None]) & 1
_VARIANTS = (1 << FREE) + NEXT


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(s, SEED) for s in set(shingles(text, WORDS))}), np.uint64)


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    if not turn:
        return hashes
    x = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a shingle set and the keys (part and value, 32 bits) of its balls."""
    counts = np.zeros((PRINTS, 64), np.int64)
    for turn in range(PRINTS):
        for begin in range(0, len(hashes), _BLOCK):
            block = _mixed(hashes[begin : begin + _BLOCK], turn).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts[turn] += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    lean_to = counts * 2 - len(hashes)
    bits = lean_to > 0
    prints = np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]
    cut = (slice(None), slice(0, PARTS * WIDTH))
    values = bits[cut].reshape(-1, WIDTH) @ (1 << np.arange(WIDTH))
    weak = 1 << np.argsort(np.abs(lean_to[cut]).reshape(-1, WIDTH), axis=1, kind="stable")[:, : FREE + NEXT]
    flips = np.concatenate([weak[:, :FREE] @ _SUBSETS, weak[:, FREE:]], axis=1)
    keys = (values[:, None] ^ flips) | (np.arange(len(values)) << WIDTH)[:, None]
    return prints, keys.astype(np.int32)


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, row, class (hash of the shingle set), prints and keys of every (doc_id, row, text)."""

    @lean
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            classes, prints, keys = [], [], []
            for text in batch.column(2).to_pylist():
                held = shingle_set(text)
                own, balls = signature(held)
                classes.append(xxhash.xxh64_intdigest(held.tobytes(), SEED))
                prints.append(own.tobytes())
                # a set without shingles is similar to itself alone
                keys.append(balls.tobytes() if len(held) else b"")
            named = [np.array(classes, np.uint64).view(np.int64), pa.array(prints, pa.binary()), pa.array(keys, pa.binary())]
            columns = [batch.column(0), batch.column(1), pa.array(named[0]), *named[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "class", "prints", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"doc_id {kind}, row long, class long, prints binary, keys binary")


def balls(classes: DataFrame) -> DataFrame:
    """(key, class, own, other): the values a class emits, with the fingerprint and the next one."""
    names = ["key", "class", "own", "other"]

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                given = [(c, p, k) for c, p, k in zip(*(col.to_pylist() for col in batch.columns)) if k]
                if not given:
                    continue
                keys = np.frombuffer(b"".join(k for _, _, k in given), np.int32)
                prints = np.frombuffer(b"".join(p for _, p, _ in given), "<i8").reshape(-1, PRINTS)
                each = PARTS * _VARIANTS
                own, other = np.repeat(prints, each, axis=1), np.repeat(np.roll(prints, -1, axis=1), each, axis=1)
                who = np.repeat(np.array([c for c, _, _ in given], np.int64), PRINTS * each)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, who, own.ravel(), other.ravel())], names)

    return classes.select("class", "prints", "keys").mapInArrow(emitted, "key int, class long, own long, other long")


def _distance(own: np.ndarray, other: np.ndarray, a, b) -> np.ndarray:
    """Bits that differ between the fingerprints at ``a`` and ``b``."""
    return np.bitwise_count(own[a] ^ own[b]).astype(np.int16) + np.bitwise_count(other[a] ^ other[b])


def _stars(size: int, near) -> Iterator[tuple[int, np.ndarray]]:
    """(first member, the others) of each component of ``size`` nodes; ``near(i, left)`` tells i's neighbours."""
    left = np.arange(size)
    while len(left) > 1:
        seed, left = left[0], left[1:]
        found, waiting = [], [seed]
        while waiting and len(left):
            is_near = near(waiting.pop(), left)
            found.append(left[is_near])
            waiting += found[-1].tolist()
            left = left[~is_near]
        members = np.concatenate(found) if found else left[:0]
        if len(members):
            yield seed, members


def _pairs_table(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    b = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _met(keys: np.ndarray, who: np.ndarray, own: np.ndarray, other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars of the candidates in whole buckets of sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    wanted = sizes > _LOOKED
    most = int(sizes[~wanted].max(initial=0))
    for step in range(1, most):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        at = at[_distance(own, other, at, at + step) <= APART]
        wanted[bucket[at]] = True
    out = []
    for begin, size in zip(starts[wanted].tolist(), sizes[wanted].tolist()):
        mine = slice(begin, begin + size)
        o, t, w = own[mine], other[mine], who[mine]
        for seed, members in _stars(size, lambda i, left: _distance(o, t, left, i) <= APART):
            out.append((w[members], np.full(len(members), w[seed])))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Batches of sorted rows, cut only between different values of the first ``by`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [c[batch.num_rows - 1].as_py() for c in batch.columns[:by]]
        same = np.ones(batch.num_rows, bool)
        for c, value in zip(batch.columns[:by], last):
            same &= c.to_numpy(zero_copy_only=False) == value
        cut = int(np.argmax(same))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and [c[held[-1].num_rows - 1].as_py() for c in held[-1].columns[:by]] != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def candidates(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the classes whose balls meet and whose fingerprints are near."""

    @lean
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            keys, who, own, other = (c.to_numpy() for c in rows.columns)
            yield _pairs_table(_met(keys, who, own.view(np.uint64), other.view(np.uint64)))

    return balls(classes).repartition("key").sortWithinPartitions("key", "class").mapInArrow(met, "a long, b long")


def hooked(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: each a with its least b, and its other bs with that one.

    A member meets at most one star a key, or a tile pair, so its list is bounded by the keys that it
    emits, or by the tiles of its block. Of a group of many members the seeds are few, so about one
    link a member is left.
    """
    lists = links.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("seeds"))
    lists = lists.withColumn("least", F.get("seeds", F.lit(0)))
    others = lists.select(F.explode(F.slice("seeds", 2, 1 << 20)).alias("a"), F.col("least").alias("b")).distinct()
    return lists.select("a", F.col("least").alias("b")).unionByName(others)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share."""
    sizes = [len(s) for s in sets]
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    rank = np.cumsum(held > 1) - 1
    keep = held[at] > 1
    row, column = row[keep], rank[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, _FEATURES):
        a, b = np.searchsorted(column, [begin, begin + _FEATURES])
        has = np.zeros((len(sets), _FEATURES), np.float32)
        has[row[a:b], column[a:b] - begin] = 1
        shared += has @ has.T
    return shared.astype(np.int64)


def similar_stars(who: np.ndarray, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars of the pairs of sets whose Jaccard similarity is at least ``LEAST``."""
    if len(sets) < 2:
        return []
    shared, sizes = shared_counts(sets), np.array([len(s) for s in sets])
    either = sizes[:, None] + sizes[None, :] - shared
    linked = (shared * LEAST[1] >= either * LEAST[0]) & (either > 0)
    return [(who[m], np.full(len(m), who[s])) for s, m in _stars(len(sets), lambda i, left: linked[i, left])]


def wanted_sets(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, hashes): the shingle sets of (row, text) whose row is in ``chosen``, and of few others.

    The chosen rows are marked in ``MARKS`` bits, so that the other texts need no shuffle.
    """
    place = chosen.select((F.pmod("row", F.lit(MARKS)) + 1).alias("p"))
    parts = place.groupBy(F.expr("bitmap_bucket_number(p)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    marks = np.zeros(MARKS // 8, np.uint8)
    for n, bits in parts.collect():
        marks[(n - 1) * 4096 : n * 4096] = np.frombuffer(bits, np.uint8)

    @lean
    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column(0).to_numpy() % MARKS
            left = batch.filter(pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            sets = pa.array([shingle_set(t).tobytes() for t in left.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([left.column(0), sets], ["row", "hashes"])

    return rows.mapInArrow(with_sets, "row long, hashes binary")


def verified(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect the similar classes within each block of (block, class, hashes)."""
    sets = saved(members, "shingle-sets")
    tiles = F.ceil(F.count("*") / TILE).cast("int")
    large = sets.groupBy("block").agg(tiles.alias("tiles")).where("tiles > 1")
    rows = sets.join(F.broadcast(large), "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("block", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "class", "hashes")

    @lean
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches, 3):
            block, i, j, who = (c.to_numpy() for c in held.columns[:4])
            changes = np.flatnonzero((block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds, hashes, out = [0, *changes.tolist(), len(who)], held.column("hashes"), []
            for begin, end in zip(bounds, bounds[1:]):
                own = [np.frombuffer(h, np.uint64) for h in hashes.slice(begin, end - begin).to_pylist()]
                out += similar_stars(who[begin:end], own)
            yield _pairs_table(out)

    order = ["block", "i", "j", "class"]
    return rows.repartition("block", "i", "j").sortWithinPartitions(*order).mapInArrow(compared, "a long, b long")


def similar(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's doc_id, row (hash of id and text), class, component_id (the least doc_id linked) and root (of the component)."""
    given = df.select(F.col(f"`{doc}`").alias("doc_id"), F.xxhash64(f"`{doc}`", f"`{text}`").alias("row"), F.col(f"`{text}`").alias("text"))
    rows = saved(signatures(given), "signatures")
    first = [F.min(c).alias(c) for c in ("row", "prints", "keys")]
    classes = saved(rows.groupBy("class").agg(F.min("doc_id").alias("least"), *first), "classes")
    blocks = components(hooked(candidates(classes)))
    blocks = blocks.select(F.col("u").alias("class"), F.col("v").alias("block"))
    blocks = blocks.union(blocks.select("block", "block")).distinct()
    chosen = blocks.join(classes.select("class", "row"), "class")
    chosen = saved(chosen, "chosen")
    members = wanted_sets(given.select("row", "text"), chosen).join(chosen, "row")
    members = members.select("block", "class", "hashes").dropDuplicates(["class"])
    roots = components(hooked(verified(members))).select(F.col("u").alias("class"), F.col("v").alias("root"))
    rooted = classes.select("class", "least").join(roots, "class", "left")
    rooted = rooted.select("class", "least", F.coalesce("root", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("class", "component_id", "root")
    return rows.select("doc_id", "row", "class").join(found, "class").select("doc_id", "row", "class", "component_id", "root")
