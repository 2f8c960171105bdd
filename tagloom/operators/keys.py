"""Helpers for keys: row ids, uniqueness, and joins against skewed groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_id(key: Sequence[str]) -> Column:
    """A repeatable id made from the key columns."""
    return F.sha2(F.concat_ws("\u0001", *key), 256)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; empty when the key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def one_per_key(
    df: DataFrame, key: Sequence[str], newest: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the greatest by ``newest``, then by content.

    Written as an aggregate, so copies of a key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    order = [*newest, *[c for c in rest if c not in newest]]
    kept = df.groupBy(*key).agg(F.max(F.struct(*order)).alias("__row"))
    return kept.select(*key, *[F.col(f"__row.{c}") for c in rest]).select(*df.columns)


def spread_scan(scan: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spread a scan over the cores when its files give fewer partitions than that.

    A table of many files is left as it is, so its texts are not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(*by) if scan.rdd.getNumPartitions() < cores else scan


def salted_join(
    large: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    also: Column | None = None,
    salts: int = 16,
) -> DataFrame:
    """Join ``large`` to a smaller ``lookup`` whose keys may be hot in ``large``.

    The rows of one key are spread over ``salts`` shuffle partitions by a hash of the
    ``spread`` columns, and the lookup rows are repeated once per salt. Spark still
    broadcasts the lookup when its measured size is below the broadcast limit. ``also``
    is a further condition on columns of both sides.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    keys = [F.col(c).alias(f"__on_{c}") for c in on]
    rest = [c for c in lookup.columns if c not in on]
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__on_salt")
    repeated = lookup.select(*keys, *rest, every_salt)
    condition = F.col("__salt") == F.col("__on_salt")
    for c in on:
        condition = condition & (F.col(c) == F.col(f"__on_{c}"))
    if also is not None:
        condition = condition & also
    joined = large.withColumn("__salt", salt).join(repeated, condition, how)
    return joined.drop("__salt", "__on_salt", *[f"__on_{c}" for c in on])
