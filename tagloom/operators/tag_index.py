"""A stored bitmap index of tags: rows with all of several tags without reading the others' entries.

Rows are numbered when they are stored. For each tag and each run of 32,768 numbers a bitmap tells
which rows have the tag; each tag is a folder of its own, so a filter opens only the folders of its
tags. Bitmaps of one run are intersected by an aggregate, and only rows in the result are fetched.
A tag that most rows have is as many small groups as there are runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_BITMAP = 32768
_INDEX = "run long, bits binary, tag string"


def write_tag_index(rows: DataFrame, root: str, tags: str = "tech_stack") -> None:
    """Store ``rows`` with their numbers, then the bitmaps; rows without tags are in no bitmap."""
    spark = rows.sparkSession
    # numbers are dense within a partition of the write, so bitmaps are as well
    numbered = rows.withColumn("__number", F.monotonically_increasing_id())
    numbered.withColumn("__run", F.col("__number").bitwiseAND(F.lit(-ROWS_A_BITMAP).cast("long"))).write.parquet(f"{root}/rows")
    stored = spark.read.parquet(f"{root}/rows")
    entries = stored.select("__number", F.explode(F.array_distinct(F.array_compact(tags))).alias("tag"))
    place = F.bitmap_bit_position(F.col("__number") + 1)
    bitmaps = entries.groupBy("tag", F.bitmap_bucket_number(F.col("__number") + 1).alias("run")).agg(
        F.bitmap_construct_agg(place).alias("bits")
    )
    bitmaps.repartition("tag", F.floor(F.col("run") / 64)).write.partitionBy("tag").parquet(f"{root}/tags")


def _common(spark: SparkSession, root: str, tags: Sequence[str]) -> DataFrame:
    """(run, bits): the rows that have all of the tags."""
    wanted = sorted(set(tags))
    index = spark.read.schema(_INDEX).parquet(f"{root}/tags").where(F.col("tag").isin(wanted))
    met = index.groupBy("run").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return met.where(F.col("n") == len(wanted)).select("run", "bits")


def count_with_all_tags(spark: SparkSession, root: str, tags: Sequence[str]) -> DataFrame:
    """One row with ``total``; no rows are read."""
    counted = _common(spark, root, tags).agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return counted.select(F.coalesce("n", F.lit(0)).alias("total"))


def rows_with_all_tags(spark: SparkSession, root: str, tags: Sequence[str]) -> DataFrame:
    """The stored rows that have all of the tags (case-sensitive); without tags all rows."""
    rows = spark.read.parquet(f"{root}/rows")
    if not tags:
        return rows.drop("__number", "__run")
    # a run's first number is that of its first bit; bits are counted from the low end of each byte
    first = ((F.col("run") - 1) * ROWS_A_BITMAP).alias("__run")
    bits = _common(spark, root, tags).where(F.bitmap_count("bits") > 0).select(first, "bits")
    joined = rows.join(bits, "__run")
    place = F.col("__number") - F.col("__run")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int"))
    has = bit.bitwiseAND(F.lit(1)) == 1
    return joined.where(has).drop("__number", "__run", "bits")
