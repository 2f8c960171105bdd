"""Exact removal of long strings that an earlier document already has, by sharded suffix arrays.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document with a smaller id.

1. *Shards.* Every ``LENGTH``-byte string is filed under the least of its ``GRAM``-byte hashes (the
   leftmost of equals). That choice depends on the string alone, so equal strings are filed alike
   wherever they stand, and neighbouring strings mostly share one file: about one in sixteen
   positions is an anchor. Only anchors that two documents have go on.
2. *Fragments.* A document cuts out the strings of each such anchor as one fragment, and fragments are
   dealt to shards by their anchor. Equal fragments are merged; what is merged keeps the least id.
3. *Suffix arrays.* The fragments of a shard that share an anchor but differ are set end to end and
   sorted by induced sorting; permuted common prefixes show where neighbours in that order share
   ``LENGTH`` bytes. The least document id of each such run decides its strings.
4. *Removal.* A document unites the strings of its fragments that an earlier document has.

Copies of a whole text need none of this: the copy with the least id stands for the class, the others
lose every byte if they have ``LENGTH`` at all. A shard whose distinct fragments outgrow ``CROWDED`` bytes
(one anchor in very many contexts) is not sorted in one task: its strings are then grouped by a shuffle.

Defined cases: a null or empty text has no bytes and loses none; a row with a null id neither loses nor
covers anything; rows that repeat an id and its text lose the same bytes, and different texts
of one id count as documents in order of their digest; a very long text is held whole only by a task
that reads it, its fragments are dealt like all others; an empty table gives no rows; other columns are
kept, the operator's own replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import lean, saved, slices, text_bytes
from tagloom.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH = 50
GRAM = 20
SPREAD = LENGTH - GRAM + 1
SHARD_BYTES = 3 << 20
CROWDED = 8 << 20
HELD_ANCHORS = 2_000_000
SYMBOLS = 258  # closing mark, separator, bytes
NOBODY = np.iinfo(np.int64).max

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("last", "<i4"), ("at", "<i4")])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place, by doubling a polynomial's length."""
    done, size, power = None, 0, _MIX
    part, length, left = data.astype(np.uint64) + np.uint64(1), 1, GRAM
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done, size = part, length
                else:
                    n = len(part) - size
                    done, size = done[:n] * power + part[size:], size + length
            left >>= 1
            if left:
                n = len(part) - length
                part, power, length = part[:n] * power + part[length:], power * power, 2 * length
        done = (done ^ done >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return done ^ done >> np.uint64(32)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value, the leftmost of equals, in each run of ``width`` values."""
    least, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        n = len(least) - step
        right = least[step:] < least[:n]
        at = np.where(right, at[step:], at[:n])
        least = np.minimum(least[:n], least[step:])
        size += step
    return at


def anchors(texts: list[bytes]) -> np.ndarray:
    """The anchors of the texts: hash, number of the text, first and last string filed under it, its place."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return np.empty(0, ANCHOR)
    hashes = gram_hashes(data)
    place = leftmost_least((hashes >> np.uint64(32)).astype(np.uint32), SPREAD)
    begins = np.cumsum(lengths) - lengths
    starts = np.repeat(begins, np.maximum(0, lengths - LENGTH + 1))
    kept = lengths >= LENGTH
    counts = (lengths - LENGTH + 1)[kept]
    starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(starts):
        return np.empty(0, ANCHOR)
    place = place[starts]
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    out = np.empty(len(edges), ANCHOR)
    first, last = starts[edges], starts[np.append(edges[1:], len(starts)) - 1]
    at = place[edges]
    out["doc"] = np.searchsorted(begins + lengths, first, "right")
    base = begins[out["doc"]]
    out["hash"] = hashes[at] >> np.uint64(16)
    out["first"], out["last"], out["at"] = first - base, last - base, at - base
    return out


_COLUMNS = (("hash", "<u8"), ("doc", "<i8"), ("at", "<i4"))


def packed(rows: np.ndarray) -> bytes:
    """Anchor rows column by column, compressed: places and ids repeat much, hashes lose their empty bytes."""
    hashes = rows["hash"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    near = [(rows["at"] - rows["first"]).astype(np.uint8), (rows["last"] - rows["first"]).astype(np.uint8)]
    parts = [np.int32(len(rows)), hashes, rows["doc"].astype("<i8").view(np.uint8).reshape(-1, 8).T]
    parts += [rows["at"].astype("<i4").view(np.uint8).reshape(-1, 4).T, *near]
    return zstandard.ZstdCompressor(1).compress(b"".join(p.tobytes() for p in parts))


def unpacked(blob: bytes) -> np.ndarray:
    """The rows of :func:`packed`."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(data[:4].view("<i4")[0])
    out, begin = np.empty(n, ANCHOR), 4

    def column(width: int, kind: str) -> np.ndarray:
        nonlocal begin
        raw = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        raw[:, :width] = data[begin : begin + n * width].reshape(width, n).T
        begin += n * width
        return raw.view(kind).ravel()

    out["hash"], out["doc"], out["at"] = column(6, "<u8"), column(8, "<i8"), column(4, "<i4")
    out["first"] = out["at"] - column(1, "u1")
    out["last"] = out["first"] + column(1, "u1")
    return out


@lean
def anchor_rows(batches: Iterator[pa.RecordBatch], shards: int, doc: int, text: int) -> Iterator[pa.RecordBatch]:
    """(shard, anchors): the anchors of a piece of the documents, dealt to shards by hash."""
    for batch in slices(batches, text):
        ids = batch.column(doc).to_numpy()
        texts, pieces, begin, size = raw(batch.column(text)), [], 0, 0
        for i, t in enumerate(texts):  # hashing stays within the processor's cache
            size += len(t)
            if size > 1 << 20 or i + 1 == len(texts):
                found = anchors(texts[begin : i + 1])
                found["doc"] = ids[begin + found["doc"]]
                pieces.append(found)
                begin, size = i + 1, 0
        rows = np.concatenate(pieces)
        shard = rows["hash"] % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        rows, shard = rows[order], shard[order]
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(rows) else []
        blobs = [packed(r) for r in np.split(rows, cuts[1:])] if len(rows) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[cuts].astype(np.int64) if len(rows) else [], pa.int64()), pa.array(blobs, pa.binary())],
            ["shard", "anchors"],
        )


def raw(texts: pa.Array) -> list[bytes]:
    """The texts' bytes, none for null."""
    return texts.cast(pa.binary()).fill_null(b"").to_pylist()


@lean
def shared(batches: Iterator[pa.RecordBatch], doc: str = "doc_id") -> Iterator[pa.RecordBatch]:
    """(doc_id, place) of the anchors whose hash two documents have; rows come sorted by shard.

    A place is the anchor's, then how far before it the first string begins and how many follow.

    Of the anchors seen so far one row stays for each hash that is shared already, and the rows of one
    document for each that is not, so what is held follows the distinct hashes of a shard.
    """

    def sifted(rows: np.ndarray, is_shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rows["doc"], rows["hash"]))
        rows, is_shared = rows[order], is_shared[order]
        edges = np.flatnonzero(np.concatenate([[True], rows["hash"][1:] != rows["hash"][:-1]]))
        sizes = np.diff(np.append(edges, len(rows)))
        ends = edges + sizes - 1
        two = (rows["doc"][edges] != rows["doc"][ends]) | np.logical_or.reduceat(is_shared, edges)
        two_rows = np.repeat(two, sizes)
        is_first = np.zeros(len(rows), bool)
        is_first[edges] = True
        stays = ~two_rows | is_first
        return rows[two_rows & ~is_shared], rows[stays], two_rows[stays]

    def out(rows: np.ndarray) -> pa.RecordBatch:
        at, first = rows["at"].astype(np.int64), rows["first"].astype(np.int64)
        places = at << 16 | at - first << 8 | rows["last"] - first
        return pa.RecordBatch.from_arrays([pa.array(rows["doc"].copy()), pa.array(places)], [doc, "place"])

    empty = np.empty(0, ANCHOR)
    now, held, flags, new = None, empty, np.empty(0, bool), []

    def taken() -> np.ndarray:
        nonlocal held, flags, new
        rows = np.concatenate([held, *new])
        found, held, flags = sifted(rows, np.concatenate([flags, np.zeros(len(rows) - len(held), bool)]))
        new = []
        return found

    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != now:
                if new:
                    yield out(taken())
                now, held, flags = shard, empty, np.empty(0, bool)
            new.append(unpacked(blob))
            if sum(map(len, new)) > HELD_ANCHORS:
                yield out(taken())
    if new:
        yield out(taken())


@lean
def fragment_rows(batches: Iterator[pa.RecordBatch], shards: int, doc: int, text: int) -> Iterator[pa.RecordBatch]:
    """(shard, fragments): the strings of a document's shared anchors (last column), dealt by the anchor's bytes."""
    for batch in slices(batches, text):
        parts: dict[int, list] = {}
        listed = batch.column(batch.num_columns - 1)
        places, ends = listed.values.to_numpy(), listed.offsets.to_numpy()
        near, more = places >> 8 & 255, places & 255
        first = ((places >> 16) - near).tolist()
        near, more = near.tolist(), more.tolist()
        for own, data, a, b in zip(batch.column(doc).to_pylist(), raw(batch.column(text)), ends, ends[1:]):
            for i in range(a, b):
                begin = first[i]
                fragment = data[begin : begin + more[i] + LENGTH]
                shard = hash_bytes(fragment[near[i] : near[i] + GRAM]) % shards
                row = (own, begin, near[i], fragment)
                if shard in parts:
                    parts[shard].append(row)
                else:
                    parts[shard] = [row]
        blobs = [packed_fragments(rows) for rows in parts.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "fragments"]
        )


def hash_bytes(data: bytes) -> int:
    """A hash of a few bytes that is the same in every process."""
    return xxhash.xxh64_intdigest(data) >> 1


def packed_fragments(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """Fragments with their documents and places, compressed."""
    docs, firsts, nears, texts = zip(*rows)
    parts = [
        np.int32(len(rows)).tobytes(),
        np.array(docs, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(),
        np.array(firsts, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(),
        bytes(nears),
        bytes(map(len, texts)),
        *texts,
    ]
    return zstandard.ZstdCompressor(3).compress(b"".join(parts))


def unpacked_fragments(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes, list[bytes]]:
    """Documents, places, anchors' offsets and the fragments of :func:`packed_fragments`."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i4", 1)[0])
    docs = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 4).reshape(8, n).T).view("<i8").ravel()
    firsts = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 4 + 8 * n).reshape(4, n).T).view("<i4").ravel()
    begin = 4 + 12 * n
    nears, sizes = data[begin : begin + n], np.frombuffer(data, np.uint8, n, begin + n).astype(np.int64)
    ends = (begin + 2 * n + np.cumsum(sizes)).tolist()
    return docs, firsts, nears, [data[b - s : b] for s, b in zip(sizes.tolist(), ends)]


def earliest(fragments: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the fragments set end to end with separators: the least document with its string.

    Also returns where each fragment begins. Places with fewer than ``LENGTH`` bytes left mean nothing.
    """
    sizes = np.array([len(f) for f in fragments], np.int64) + 1
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8).astype(np.int64) + 2
    data[begins + sizes - 1] = 1
    text = np.append(data, 0)
    order = suffix_array(text, SYMBOLS)
    common = permuted_prefixes(text, order)[order]
    owner = np.append(np.repeat(docs, sizes), NOBODY)
    left = np.append(np.repeat(begins + sizes - 1, sizes) - np.arange(len(data)), 0)
    owner[left < LENGTH] = NOBODY
    common[0] = 0
    groups = np.flatnonzero(common < LENGTH)
    least = np.minimum.reduceat(owner[order], groups)
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(groups, len(order))))
    return out, begins


class _Shard:
    """The distinct fragments of a shard and where they occur."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.least: list[int] = []
        self.near: list[int] = []
        self.docs: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.which: list[list[int]] = []
        self.size = 0

    def add(self, blob: bytes) -> None:
        docs, firsts, nears, texts = unpacked_fragments(blob)
        number, least, which = self.number, self.least, []
        for doc, near, text in zip(docs.tolist(), nears, texts):
            # the same bytes around another anchor are another fragment, filed elsewhere
            key = text + bytes((near,))
            at = number.get(key)
            if at is None:
                at = number[key] = len(least)
                least.append(doc)
                self.near.append(near)
                self.size += len(text)
            elif doc < least[at]:
                least[at] = doc
            which.append(at)
        self.docs.append(docs)
        self.firsts.append(firsts)
        self.which.append(np.array(which, np.int64))

    def covered(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc, start, end) of the runs that an earlier document has."""
        texts = [k[:-1] for k in self.number]
        least = np.array(self.least, np.int64)
        by_anchor: dict[bytes, list[int]] = {}
        for i, (text, near) in enumerate(zip(texts, self.near)):
            by_anchor.setdefault(text[near : near + GRAM], []).append(i)
        differing = [i for own in by_anchor.values() if len(own) > 1 for i in own]
        counts = np.array([len(t) for t in texts], np.int64) - LENGTH + 1
        begins = np.cumsum(counts) - counts
        strings = np.repeat(least, counts)  # a fragment alone at its anchor is its own class
        if differing:
            found, places = earliest([texts[i] for i in differing], least[differing])
            own = counts[differing]
            inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            strings[np.repeat(begins[differing], own) + inside] = found[np.repeat(places, own) + inside]
        for docs, firsts, which in zip(self.docs, self.firsts, self.which):
            own = counts[which]
            inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            has = strings[np.repeat(begins[which], own) + inside] < np.repeat(docs, own)
            row = np.repeat(np.arange(len(which)), own)
            hit = np.flatnonzero(has)
            if not len(hit):
                continue
            new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])])
            a, b = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
            yield docs[row[a]], firsts[row[a]] + inside[a], firsts[row[a]] + inside[b] + LENGTH


@lean
def covered_rows(batches: Iterator[pa.RecordBatch], crowded: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, end, string): covered runs; of crowded shards each string itself, with end null."""

    def out(docs, starts, ends, strings=None) -> pa.RecordBatch:
        n = len(docs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(docs, np.int64)),
                pa.array(np.asarray(starts).astype(np.int32)),
                pa.nulls(n, pa.int32()) if ends is None else pa.array(np.asarray(ends).astype(np.int32)),
                pa.nulls(n, pa.binary()) if strings is None else pa.array(strings, pa.binary()),
            ],
            ["doc_id", "start", "end", "string"],
        )

    def all_strings(blob: bytes) -> Iterator[pa.RecordBatch]:
        docs, firsts, _, texts = unpacked_fragments(blob)
        rows = [
            (d, f + i, t[i : i + LENGTH])
            for d, f, t in zip(docs.tolist(), firsts.tolist(), texts)
            for i in range(len(t) - LENGTH + 1)
        ]
        for begin in range(0, len(rows), 20_000):
            d, s, t = zip(*rows[begin : begin + 20_000])
            yield out(d, s, None, list(t))

    now, shard, blobs, held = None, _Shard(), [], 0
    for batch in batches:
        for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if number != now:
                if shard is not None:
                    for found in shard.covered():
                        yield out(*found)
                now, shard, blobs, held = number, _Shard(), [], 0
            if shard is not None:
                blobs.append(blob)
                held += len(blob)
                shard.add(blob)
                if max(shard.size, held) > crowded:
                    for old in blobs:
                        yield from all_strings(old)
                    shard, blobs = None, []
            else:
                yield from all_strings(blob)
    if shard is not None:
        for found in shard.covered():
            yield out(*found)


def removed(text: bytes, runs: list[int] | None, is_copy: bool) -> tuple[list[dict[str, int]], bytes]:
    """The maximal removed runs of a text and the bytes that stay."""
    if is_copy:
        return ([{"start": 0, "end": len(text)}], b"") if len(text) >= LENGTH else ([], text)
    if not runs:
        return [], text
    pairs = np.sort(np.array(runs, np.int64))
    begins, reach = pairs >> 32, np.maximum.accumulate(pairs & 0xFFFFFFFF)
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > reach[:-1]]))
    starts, ends = begins[new].tolist(), reach[np.append(new[1:], len(pairs)) - 1].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
    return [{"start": a, "end": b} for a, b in zip(starts, ends)], kept


def covered_runs(texts: DataFrame, doc: str, text: str, shards: int, crowded: int = CROWDED) -> DataFrame:
    """(doc, runs) of the documents that lose something; ``doc`` of ``texts`` is a long and not null."""
    at = {"shards": shards, "doc": texts.columns.index(doc), "text": texts.columns.index(text)}
    # every column goes through, so that the shuffle of the texts by document is the same everywhere and made once
    rows = texts.mapInArrow(partial(anchor_rows, **at), "shard long, anchors binary")
    rows = rows.repartition("shard").sortWithinPartitions("shard")
    places = rows.mapInArrow(partial(shared, doc=doc), f"`{doc}` long, place long")
    listed = places.groupBy(doc).agg(F.collect_list("place").alias("__places"))
    cut = texts.join(listed, doc).select(*texts.columns, "__places")
    cut = cut.mapInArrow(partial(fragment_rows, **at), "shard long, fragments binary")
    cut = cut.repartition("shard").sortWithinPartitions("shard")
    kind = "doc_id long, start int, end int, string binary"
    # read twice below: stored, so that the suffix arrays are built once
    found = saved(cut.mapInArrow(partial(covered_rows, crowded=crowded), kind), "covered")
    # strings of crowded shards: the least document of each is found before a shuffle, and a hot string's rows
    # meet it in a join that Spark can split
    strings = found.where("end IS NULL")
    least = strings.groupBy("string").agg(F.min("doc_id").alias("least"))
    more = strings.join(least, "string").where(F.col("least") < F.col("doc_id"))
    more = more.select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))
    found = found.where("end IS NOT NULL").select("doc_id", "start", "end").unionByName(more)
    runs = F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("end"))
    return found.groupBy(F.col("doc_id").alias(doc)).agg(runs.alias("__runs"))


def deduplicated(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", shards: int | None = None, crowded: int = CROWDED
) -> DataFrame:
    """``documents`` with n_bytes, spans (removed runs, in bytes) and kept (the bytes that stay); ``doc`` is a long."""
    own = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", _SPANS), T.StructField("kept", T.BinaryType())]
    names = [c for c in documents.columns if c not in {f.name for f in own}]
    shards = shards or max(1, text_bytes(documents, text) // SHARD_BYTES)
    given = documents.select(*[F.col(f"`{c}`") for c in names])
    base = given.where(F.col(doc).isNotNull())
    digests = base.select(doc, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    if not digests.groupBy(doc).agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").isEmpty():
        return _by_row(documents, digests, doc, text, shards, crowded)
    first = digests.groupBy("digest").agg(F.min(doc).alias("least"), F.max(doc).alias("most"))
    copies = digests.join(first.where("least < most"), "digest").where(F.col(doc) > F.col("least")).select(doc).distinct()
    runs = covered_runs(base.join(copies, doc, "left_anti").select(*names), doc, text, shards, crowded)
    verdict = runs.withColumn("__copy", F.lit(False)).union(copies.select(doc, F.lit(None).cast("array<long>"), F.lit(True)))
    judged = base.join(verdict, doc, "left").select(*names, "__runs", "__copy")
    nameless = given.where(F.col(doc).isNull()).select("*", F.lit(None).cast("array<long>"), F.lit(False))
    schema = T.StructType([documents.schema[c] for c in names] + own)
    n, at = len(names), names.index(text)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            data = raw(batch.column(at))
            made = [removed(*row) for row in zip(data, batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(n)],
                    pa.array([len(d) for d in data], pa.int64()),
                    pa.array([m[0] for m in made], spans_type),
                    pa.array([m[1] for m in made], pa.binary()),
                ],
                schema.names,
            )

    return judged.union(nameless).mapInArrow(cut, schema)


def _by_row(documents: DataFrame, digests: DataFrame, doc: str, text: str, shards: int, crowded: int) -> DataFrame:
    """``deduplicated`` where an id has several texts: each gets a number of its own, in order of id, then digest."""
    pairs = digests.distinct().repartitionByRange(doc, "digest").sortWithinPartitions(doc, "digest")
    numbers = saved(pairs.withColumn("__number", F.monotonically_increasing_id()), "text-numbers")
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = documents.withColumn("digest", digest).join(numbers, [doc, "digest"], "left").drop("digest")
    found = deduplicated(keyed.withColumnRenamed(doc, "__id").withColumnRenamed("__number", doc), doc, text, shards, crowded)
    own = found.columns[-3:]
    names = [c for c in documents.columns if c not in own]
    return found.select(*[F.col("__id" if c == doc else f"`{c}`").alias(c) for c in names], *own)


@F.pandas_udf(T.StringType())
def whole_characters(data: pd.Series) -> pd.Series:
    """The text of bytes that may hold parts of characters, without those parts."""
    return data.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")
