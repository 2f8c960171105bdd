"""WARC archives with a two-level capture index.

Records are written as separate gzip members, so each can be read by its range. Their captures are
sorted by reversed-host URL keys into shards; a shard is a file of compressed blocks of lines, with a
sparse directory of the blocks' first and last keys beside it. A look-up finds the shards of a key
among the shards' bounds (one pair a partition), searches the shard's directory by halving, reads and
searches the block, and reads the record's range. Nobody holds the index as a whole.

Records of equal payload: the one with the largest page id is written as a response, the others as
revisits of it without payload.

Files are written under the name of the task attempt, and only names that Spark committed are read.

Defined cases: a null html is an empty payload; a null page id is written as a response that no record
refers to; rows that repeat both id and payload of a class's response are responses as well; a null
url is filed under ``-``; an empty table gives no files and no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import opened, saved, slices

BLOCK_LINES = 1000
FILE_BYTES = 1 << 30
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query: ``com,example,www)/path?query``."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url.strip()) or "-"
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return re.sub(r"\s", "%20", key + (f"?{parts.query}" if parts.query else ""))


def record_id(page_id: int | None) -> str:
    """A record id that holds the page id."""
    number = 0 if page_id is None else 1 << 64 | page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id."""
    number = uuid.UUID(record[1:-1]).int if record else 0
    low = number & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if number >> 64 else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One record; ``refers`` makes it a revisit, which keeps the HTTP head alone."""
    kind = "response" if refers is None else "revisit"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body += payload if refers is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers is None else [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers)}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """The columns of :data:`RECORD` from one record; a response's digest is taken from its payload and checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, page = fields["WARC-Type"], page_of(fields["WARC-Record-ID"])
    if kind == "revisit":
        return page, fields.get("WARC-Target-URI"), kind, size, digest, page_of(fields["WARC-Refers-To"]), None
    if base32_sha1(payload) != digest or len(payload) != size:
        raise ValueError(f"the payload of page {page} does not match its record")
    return page, fields.get("WARC-Target-URI"), kind, size, digest, None, payload


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_referred(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest (hex) and refers_to, the page that a revisit refers to."""
    given = pages.select(
        F.col(f"`{page}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    narrow = given.where("page_id IS NOT NULL").select("page_id", "digest")
    most = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    # only classes of several pages are joined back, on the digest and then on the page
    classes = most.where("least < refers_to").select("digest", "refers_to")
    revisits = narrow.join(classes, "digest").where("page_id < refers_to").distinct()
    return given.join(revisits, ["page_id", "digest"], "left")


def _writer(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = opened(folder)
    files.create_dir(root, recursive=True)
    out, name, at = None, "", 0
    for batch in slices(batches, 2):
        rows = []
        for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if out is None or at > FILE_BYTES:
                if out is not None:
                    out.close()
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = files.open_output_stream(f"{root}/{name}", compression=None)
                info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                at += out.write(member(info % str(uuid.uuid4()).encode()))
            payload = html.encode()
            base32 = base64.b32encode(bytes.fromhex(digest)).decode()
            data = member(record(page, url, payload, base32, len(payload), refers))
            out.write(data)
            rows.append((url_key(url), page, name, at, len(data)))
            at += len(data)
        if rows:
            yield _batch(rows, CAPTURE)
    if out is not None:
        out.close()


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(part.split(" ") for part in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], list(names))


def write(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write the records of ``pages`` below ``folder``; returns their captures, kept in the shared folder."""
    given = with_referred(pages, **columns).select("page_id", "url", "html", "digest", "refers_to")
    return saved(given.mapInArrow(partial(_writer, folder=folder), CAPTURE), "captures")


SHARD = "name string, first string, last string, captures long"


def _index_writer(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = opened(folder)
    name, out, at, lines, directory = f"{uuid.uuid4().hex}", None, 0, [], []

    def block() -> None:
        nonlocal at, out, lines
        if out is None:
            files.create_dir(root, recursive=True)
            out = files.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
        data = member("".join(f"{k} {json.dumps(rest)}\n" for k, *rest in lines).encode())
        out.write(data)
        directory.append((lines[0][0], lines[-1][0], at, len(data)))
        at, lines = at + len(data), []

    total = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            lines.append(row)
            total += 1
            if len(lines) == BLOCK_LINES:
                block()
    if lines:
        block()
    if out is not None:
        out.close()
        with files.open_output_stream(f"{root}/{name}.dir") as file:
            file.write(json.dumps(directory).encode())
        yield _batch([(name, directory[0][0], directory[-1][1], total)], SHARD)


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted shards of ``captures`` with their directories; returns a row a shard."""
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return saved(ordered.mapInArrow(partial(_index_writer, folder=folder), SHARD), "capture-shards")


def search(folder: str, shard: str, keys: list[str], files=None) -> Iterator[tuple]:
    """The captures in one shard of sorted keys."""
    files, root = files or opened(folder)
    with files.open_input_file(f"{root}/{shard}.dir") as file:
        directory = json.loads(file.read())
    lasts = [d[1] for d in directory]
    with files.open_input_file(f"{root}/{shard}.cdx.gz") as file:
        loaded, lines, starts = -1, [], []
        for key in keys:
            number = bisect_left(lasts, key)
            while number < len(directory) and directory[number][0] <= key:
                if number != loaded:
                    file.seek(directory[number][2])
                    text = zlib.decompress(file.read(directory[number][3]), 31).decode()
                    loaded, lines = number, text.splitlines()
                    starts = [line.split(" ", 1)[0] for line in lines]
                at = bisect_left(starts, key)
                while at < len(lines) and starts[at] == key:
                    yield key, *json.loads(lines[at].split(" ", 1)[1])
                    at += 1
                if at < len(lines):
                    break
                number += 1


def look_up(shards: DataFrame, folder: str, urls: DataFrame) -> DataFrame:
    """The captures of the urls in the one column of ``urls``, each once however often it is asked for."""
    bounds = sorted((r["first"], r["last"], r["name"]) for r in shards.collect())  # one row a shard
    lasts = [b[1] for b in bounds]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in {url_key(u) for u in batch.column(0).to_pylist()}:
                number = bisect_left(lasts, key)
                while number < len(bounds) and bounds[number][0] <= key:
                    rows.append((bounds[number][2], key))
                    number += 1
            yield _batch(rows, "shard string, key string")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys = None, []
        for batch in batches:
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now and keys:
                    yield _batch(list(search(folder, now, keys)), CAPTURE)
                    keys = []
                now = shard
                keys.append(key)
                if len(keys) == 5000:
                    yield _batch(list(search(folder, now, keys)), CAPTURE)
                    keys = []
        if keys:
            yield _batch(list(search(folder, now, keys)), CAPTURE)

    asked = urls.mapInArrow(dealt, "shard string, key string").distinct()
    return asked.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(found, CAPTURE)


def read(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures, by range reads in the order of each file."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        now, file = None, None
        for batch in batches:
            rows, size = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    now, file = name, files.open_input_file(f"{root}/{name}")
                file.seek(offset)
                rows.append(parsed(zlib.decompress(file.read(length), 31)))
                size += rows[-1][3]
                if size > 8 << 20:
                    yield _batch(rows, RECORD)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, RECORD)

    # captures are tiny rows that stand for large ranges, so their own bytes must not decide on the partitions
    part, n = F.floor(F.col("offset") / (16 << 20)), captures.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = captures.select("file", "offset", "length").repartition(int(n), "file", part)
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(records, RECORD)
