"""SimHash near duplicates by meeting in the middle of a ball.

Two fingerprints within ``radius`` bits share a value that is within half the radius of both. So each
distinct fingerprint emits every value in that smaller ball, a shuffle brings equal values together,
and colliding fingerprints are deduplicated and verified by their distance.

Over all 64 bits the ball of radius 2 has 2,081 values, 16 kB a fingerprint and several times the
corpus. The default therefore emits per half: of two fingerprints within 4 bits, one half differs in
2 at most, so each half emits its ball of radius 1, 66 values in all, and the verification of the
whole distance does the rest. ``parts=1`` is the undivided form; its collisions are links by
themselves, so a value's fingerprints are hung on the least of them and no pairs are made. A value
with more than ``MOST`` fingerprints is left to that form too, which costs the same for each
fingerprint however many meet: no bucket is ever compared pair by pair beyond that size.

Defined cases: a text without words (null, empty, white space) has the fingerprint zero and is linked
like any other; equal texts and equal fingerprints are one class; a document whose id is null gets the
component of its fingerprint's class, null if no document of the component has an id; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import lean, saved, slices
from tagloom.llm.graph import components

WORDS = 4
RADIUS = 4
SEED = 42
MOST = 8192
_BLOCK = 1 << 16


def shingles(text: str | None, size: int = WORDS) -> list[bytes]:
    """The shingles of a text, repeats included; bytes lower and split as ASCII only."""
    words = text.encode().lower().split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends]]
    return [line[a:b] for a, b in zip(starts, ends[size - 1 :])]


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """The 64-bit SimHash of a text as a signed integer."""
    digest = xxhash.xxh64_intdigest
    hashes = [digest(s, SEED) for s in shingles(text, size)]
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[begin : begin + _BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little") if hashes else np.zeros(8, np.uint8)
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (signed 64 bits) of every row."""
    given = df.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    @lean
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fp"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(hashed, f"doc_id {kind}, fp long")


def masks(width: int, radius: int) -> list[int]:
    """All bit masks of ``width`` bits with at most ``radius`` set, as signed 64-bit integers."""
    found = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(width), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def variants(fps: DataFrame, radius: int, parts: int) -> DataFrame:
    """(key, fp): every value within half the radius left to a part, for each part of a fingerprint."""
    width = 64 // parts
    flips = F.array(*[F.lit(m) for m in masks(width, (radius // parts + 1) // 2)])
    if parts == 1:
        return fps.select(F.explode(flips).alias("flip"), "fp").select(F.expr("fp ^ flip").alias("key"), "fp")
    cut = F.array(*[F.struct(F.lit(p).alias("p"), F.shiftrightunsigned("fp", p * width).alias("v")) for p in range(parts)])
    rows = fps.select("fp", F.explode(cut).alias("part")).select("fp", "part", F.explode(flips).alias("flip"))
    value = F.col("part.v").bitwiseAND(F.lit((1 << width) - 1)).bitwiseXOR(F.col("flip"))
    return rows.select(F.shiftleft(F.col("part.p").cast("long"), width).bitwiseOR(value).alias("key"), "fp")


def _local_links(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Stars of the links among a bucket's distinct fingerprints: (member, least of its component)."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        seed, left = left[:1], left[1:]
        found, frontier = [], seed
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for f in frontier:
                near |= np.bitwise_count(left ^ f) <= radius
            frontier, left = left[near], left[~near]
            found.append(frontier)
        members = np.concatenate(found) if found else seed[:0]
        if len(members):
            out.append(np.stack([members.view(np.int64), np.full(len(members), seed[0], np.uint64).view(np.int64)]))
    return out


def _met(keys: np.ndarray, fps: np.ndarray, radius: int, width: int) -> list[np.ndarray]:
    """The verified links in whole buckets of sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    two = starts[sizes == 2]
    near = np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius
    out = [np.stack([fps[two + 1][near], fps[two][near]])]
    for begin, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        own = fps[begin : begin + size]
        part, value = divmod(int(keys[begin]), 1 << width)
        halves = (own.view(np.uint64) >> np.uint64(part * width)) & np.uint64((1 << width) - 1)
        if (halves == halves[0]).all() and int(halves[0]) != value:
            continue  # they meet at their own value as well
        out += _local_links(own, radius)
    return out


def _verified(rows: DataFrame, radius: int, width: int, most: int) -> DataFrame:
    """Links (a, b) of the buckets of (key, fp); fingerprints of larger buckets come with b null."""

    def table(parts: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def left_over(fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64())], ["a", "b"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, large = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            if large is not None:
                own = int(np.searchsorted(keys, large, "right"))
                yield left_over(fps[:own])
                keys, fps = keys[own:], fps[own:]
                if not len(keys):
                    continue
                large = None
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from bounded(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > most:
                yield left_over(fps)
                large, keys, fps = keys[0], keys[:0], fps[:0]
        if len(keys):
            yield from bounded(keys, fps)

    def bounded(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        over = np.repeat(sizes > most, sizes)
        if over.any():
            yield left_over(fps[over])
        if not over.all():
            yield table(_met(keys[~over], fps[~over], radius, width))

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(met, "a long, b long")


def undivided_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links from the whole ball: each fingerprint with the least one that shares a value."""
    rows = variants(fps, radius, 1)
    least = rows.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b != top")
    return rows.join(least, "key").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, radius: int = RADIUS, parts: int = 2, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` within ``radius`` bits."""
    if parts == 1:
        # values meet within half an odd radius only after rounding up, so that form needs a check
        if radius % 2 == 0:
            return undivided_links(fps, radius)
        raise ValueError("the undivided form needs an even radius")
    met = saved(_verified(variants(fps, radius, parts), radius, 64 // parts, most), "met")
    found, rest = met.where("b IS NOT NULL"), met.where("b IS NULL").select(F.col("a").alias("fp"))
    if rest.isEmpty():
        return found
    if radius % 2:
        raise ValueError("buckets this large need an even radius")
    return found.union(undivided_links(rest.distinct(), radius))


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row."""
    docs = saved(fingerprints(df, doc, text), "fingerprints")
    classes = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> F.Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
