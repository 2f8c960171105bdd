"""Quartile bucket digests: a text's byte triplets counted in buckets, each bucket coded by its quartile.

Every three bytes in a row are hashed into one of ``BUCKETS`` buckets. With the quartiles of the
bucket counts, a bucket is coded in two bits: how many of the three its count is above. The digest is
a byte for the length (eighths of a doubling), a byte for the quartiles' proportions, and the codes;
it is written as hex digits. Two digests are compared by a difference score: the distance of the
codes, bucket by bucket (3 apart counts ``FAR``), and of the two header bytes, bounded by ``BOUND``.
Likeness is 1 for equal digests and 0 at the bound.

Counting goes by pieces of ``PIECE`` bytes, so a very long text needs no more memory than its bytes.

Defined cases: a null text is the empty text, whose digest is all zeros, like that of any text of less
than three bytes but for the length; equal texts have equal digests; repeated rows and ids are rows of
their own; an empty table gives no rows; other columns are left out by ``fingerprints`` and ``edited``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import lean, saved, slices
from tagloom.llm.ordered import SPREAD, dealt, following

BUCKETS = 256
MIX = 2654435761
FAR = 6
# the mean difference of unrelated digests whose codes are all as frequent
BOUND = 416
PIECE = 1 << 20

_CODES = (np.arange(256)[:, None] >> np.arange(6, -1, -2)[None, :]) & 3
_APART = np.abs(_CODES[:, None, :].astype(np.int16) - _CODES[None, :, :])
_APART = np.where(_APART == 3, FAR, _APART).sum(axis=2).astype(np.int16)


def _counts(data: list[bytes]) -> np.ndarray:
    """Triplets by bucket, a row for each text."""
    sizes = np.array([len(d) for d in data])
    own = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(own) < 3:
        return np.zeros((len(data), BUCKETS), np.int64)
    triplets = own[:-2] << np.uint32(16) | own[1:-1] << np.uint32(8) | own[2:]
    at = (triplets * np.uint32(MIX) >> np.uint32(24)).astype(np.int64)
    at += np.repeat(np.arange(len(data)), sizes)[:-2] * BUCKETS
    ends = np.cumsum(sizes)
    # a triplet that begins in the last two bytes of a text is none of its own
    outside = np.concatenate([ends[sizes > 0] - 1, ends[sizes > 1] - 2])
    at[outside[outside < len(at)]] = len(data) * BUCKETS
    return np.bincount(at, minlength=(len(data) + 1) * BUCKETS)[: len(data) * BUCKETS].reshape(-1, BUCKETS)


def counts(data: list[bytes]) -> np.ndarray:
    """``_counts`` by pieces of bounded size."""
    out = np.zeros((len(data), BUCKETS), np.int64)
    begin = held = 0
    for i, text in enumerate(data):
        if held + len(text) > PIECE:
            out[begin:i] = _counts(data[begin:i]) if begin < i else 0
            begin, held = i, 0
        if len(text) > PIECE:
            for at in range(0, len(text), PIECE):
                out[i] += _counts([text[at : at + PIECE + 2]])[0]
            begin = i + 1
        else:
            held += len(text)
    if begin < len(data):
        out[begin:] = _counts(data[begin:])
    return out


def digests(data: list[bytes]) -> np.ndarray:
    """The digests of texts, a row of bytes each."""
    found = counts(data)
    ordered = np.sort(found, axis=1)
    quartiles = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (found[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8).reshape(len(data), -1, 4)
    body = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    length = np.floor(8 * np.log2(np.array([len(d) for d in data], float) + 1)).clip(0, 255)
    shape = 16 * quartiles[:, :2] // (quartiles[:, 2:] + 1)
    head = np.stack([length, shape[:, 0] * 16 + shape[:, 1]], axis=1).astype(np.uint8)
    return np.concatenate([head, body], axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bounded difference scores of digests, row by row."""
    head_a, head_b = a[:, :2].astype(np.int64), b[:, :2].astype(np.int64)
    length = np.abs(head_a[:, 0] - head_b[:, 0])
    shape = np.abs(head_a[:, 1] // 16 - head_b[:, 1] // 16) + np.abs(head_a[:, 1] % 16 - head_b[:, 1] % 16)
    body = _APART[a[:, 2:], b[:, 2:]].sum(axis=1, dtype=np.int64)
    return np.minimum(BOUND, length + shape + body)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0 for those that differ by ``BOUND`` or more."""
    return 1 - difference(a, b) / BOUND


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [t.encode() if t else b"" for t in texts]


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    given = df.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    @lean
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PIECE):
            found = _hex(digests(_encoded(batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(made, f"doc_id {kind}, fingerprint string")


def compared(df: DataFrame, first: str, second: str, name: str = "likeness") -> DataFrame:
    """``df`` with the likeness of two columns of fingerprints, null where one is null."""

    @F.pandas_udf("double")
    def like(a, b):
        both = a.notna() & b.notna()
        out = a.astype(object).where(both).map(lambda _: np.nan).astype(float)
        if both.any():
            left, right = (np.frombuffer(bytes.fromhex("".join(c[both])), np.uint8).reshape(int(both.sum()), -1) for c in (a, b))
            out[both] = likeness(left, right)
        return out

    return df.withColumn(name, F.nanvl(like(F.col(f"`{first}`"), F.col(f"`{second}`")), F.lit(None).cast("double")))


ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [part.split()[0] for part in ROW.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared_rows(texts: list[str], own: np.ndarray, nexts: list[str], after: np.ndarray) -> list[pa.Array]:
    """The columns of ``ROW``: each text against its edited form and against the text that follows it."""
    edited = []
    for text, following_text in zip(texts, nexts):
        quarter = len(text) // 4
        edited.append((text[: len(text) - quarter] + following_text[:quarter]).encode())
    changed = digests(edited)
    columns = [
        [len(t) for t in texts],
        [hashlib.sha256(e).hexdigest() for e in edited],
        _hex(own),
        _hex(changed),
        likeness(own, changed),
        likeness(own, after),
    ]
    return [pa.array(c, k) for c, k in zip(columns, _KINDS)]


def edited(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint against that of its edited text and that of the next row.

    The next row is the next in ascending order of id, then of the text's hash; after the last comes
    the first. The edited text has its last quarter replaced by as much of the next text's beginning.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, by ranges of the order. A partition's last row meets the first row of the
    next partition in a join of one row a partition.
    """
    given = df.select(F.col(f"`{doc}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *_NAMES, "pid", "edge", "text"]

    @lean
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()

        def edge(batch: pa.RecordBatch, which: str, at: int, texts: list[str], own: np.ndarray) -> pa.RecordBatch:
            empty = [pa.nulls(1, k) for k in _KINDS]
            empty[0], empty[2] = pa.array([len(texts[at])], pa.int64()), pa.array(_hex(own[at : at + 1]))
            tail = [pa.array([pid], pa.int32()), pa.array([which]), pa.array([texts[at]])]
            return pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), *empty, *tail], names)

        held = None  # the last row so far: its id, text and digest
        for batch in slices(batches, most=PIECE):
            texts = batch.column(1).to_pylist()
            own = digests(_encoded(texts))
            if held is None:
                yield edge(batch, "first", 0, texts, own)
                ids, before, prints = batch.column(0).slice(0, 0), [], own[:0]
            else:
                ids, before, prints = held
            ids = pa.concat_arrays([ids, batch.column(0).slice(0, batch.num_rows - 1)])
            before, prints = [*before, *texts[:-1]], np.concatenate([prints, own[:-1]])
            held = batch.column(0).slice(batch.num_rows - 1), texts[-1:], own[-1:]
            if before:
                first = batch.num_rows - len(before)
                columns = _compared_rows(before, prints, texts[first:], own[first:])
                n = len(before)
                tail = [pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *columns, *tail], names)
        if held is not None:
            last = pa.RecordBatch.from_arrays([held[0]], ["doc_id"])
            yield edge(last, "last", 0, held[1], held[2])

    ordered = dealt(given.withColumn("tie", F.xxhash64("text")), "doc_id", "tie").drop("tie", SPREAD)
    rows = saved(ordered.mapInArrow(passed, f"doc_id {kind}, {ROW}, pid int, edge string, text string"), "edited")
    whole = rows.where("edge IS NULL").select("doc_id", *_NAMES)

    # each partition's last row and the first row of the next partition, round to the first one
    firsts = rows.where("edge = 'first'").select(F.col("pid").alias("at"), F.col("text").alias("next"), F.col("fingerprint").alias("after"))
    order = following(rows.where("edge = 'first'"), around=True).withColumnRenamed("next_pid", "at")
    lasts = rows.where("edge = 'last'").select("doc_id", "text", "fingerprint", "pid")
    met = lasts.join(order, "pid").join(firsts, "at").select("doc_id", "text", "fingerprint", "next", "after")

    @lean
    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PIECE):
            _, texts, own, nexts, after = (c.to_pylist() for c in batch.columns)
            own, after = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(len(x), -1) for x in (own, after))
            columns = _compared_rows(texts, own, nexts, after)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_NAMES])

    return whole.unionByName(met.mapInArrow(finished, f"doc_id {kind}, {ROW}"))
