"""Ranks that stay distributed however many rows there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import cut_lineage


def number_rows(
    df: DataFrame, order: Sequence[Column], rank: str = "rank", total: str | None = None
) -> DataFrame:
    """Add the position of each row in the given order, from 1.

    Rows are sorted by range across partitions and kept in the checkpoint folder, so that
    the partition sizes and the rows read below are the same. Only one small row per
    partition is counted up in a single place.
    """
    ordered = cut_lineage(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    # the id holds the partition number above bit 33 and the position in it below
    part = F.shiftright("__at", 33).cast("int")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy()).alias("__total"),
    )
    # one row per partition: at most the number of shuffle partitions
    numbered = ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    columns = [*df.columns, (F.col("__before") + within + 1).alias(rank)]
    if total:
        columns.append(F.col("__total").alias(total))
    return numbered.select(*columns)


def count_ranks(
    counts: DataFrame,
    name: str,
    count: str = "count",
    rank: str = "rank",
    total: str = "total",
    prefixes: Sequence[int] = (2, 8),
) -> DataFrame:
    """Add the position by falling count, ties by name, and the number of rows; starts no job.

    The rows are counted by count and by growing prefixes of the name, and prefix sums over
    those counts give what stands before each such part: N counted things have at most
    sqrt(2 N) different counts. Only names that share a count and the longest prefix are
    numbered by a sort, each part by itself.
    """
    keys = [count, *[f"__p{i}" for i in range(len(prefixes))]]
    keyed = counts.withColumns({k: F.substring(name, 1, n) for k, n in zip(keys[1:], prefixes)})
    levels = [keyed.groupBy(*keys).agg(F.count("*").alias("__n"))]
    for depth in range(len(keys) - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*keys[:depth]).agg(F.sum("__n").alias("__n")))
    # what stands before each part: within the part one level up, added to what stands before that
    placed = None
    for depth, level in enumerate(levels):
        order = F.col(keys[depth]).desc() if depth == 0 else F.col(keys[depth]).asc()
        here = Window.partitionBy(*keys[:depth]).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("__here", F.coalesce(F.sum("__n").over(here), F.lit(0)))
        if placed is None:
            everything = F.sum("__n").over(Window.partitionBy())
            placed = level.select(keys[0], F.col("__here").alias("__before"), everything.alias(total))
            continue
        above = placed.select(*[F.col(k).alias(f"__up_{k}") for k in keys[:depth]], "__before", total)
        same = [F.col(k).eqNullSafe(F.col(f"__up_{k}")) for k in keys[:depth]]
        before = (F.col("__before") + F.col("__here")).alias("__before")
        placed = level.join(above, same).select(*keys[: depth + 1], before, total)
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(name))
    above = placed.select(*[F.col(k).alias(f"__up_{k}") for k in keys], "__before", total)
    same = [F.col(k).eqNullSafe(F.col(f"__up_{k}")) for k in keys]
    joined = keyed.withColumn("__within", within).join(above, same)
    return joined.select(*counts.columns, (F.col("__before") + F.col("__within")).alias(rank), total)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, position: str
) -> DataFrame:
    """First ``k`` rows of each group, numbered from 1.

    The filter on the row number lets Spark keep only ``k`` rows per group and input
    partition before the shuffle, so a hot group is never gathered whole.
    """
    numbered = df.withColumn(
        position, F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    )
    return numbered.where(F.col(position) <= k)
