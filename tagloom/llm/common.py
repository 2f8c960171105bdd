"""Helpers the corpus operators share: bounded batches, scratch tables, file access."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import scratch_path

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and reread, so that no later stage computes it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` over a partition's batches, then what the task freed goes back to the system.

    Python workers outlive their tasks, and several of them share an executor's memory.
    """

    @wraps(run)
    def wrapped(*args, **named):
        yield from run(*args, **named)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: int = -1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of ``column`` in a piece hold about ``most`` bytes (or one text)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it for a folder or file named by uri or plain path."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column; sizes partitions, never results."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
