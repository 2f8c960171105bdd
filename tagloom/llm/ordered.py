"""Tables dealt by ranges of their order, so that a row's place and neighbour need no single task.

Rows of one key may be very many, and even wholly repeated: the last sort key is a number of the scan,
which cuts runs of equal rows as well. What a partition cannot know (how much stands before it, which
row follows its last) is one small record a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = "__spread"


def dealt(df: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """``df`` in ascending order over its partitions and within each; adds the column ``SPREAD``."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col(SPREAD)]
    numbered = df.withColumn(SPREAD, F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(parts, *keys) if parts else numbered.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def following(parts: DataFrame, around: bool = False) -> DataFrame:
    """(pid, next_pid) of each partition that holds rows and the one that comes after it.

    After the last comes none (null), or the first. ``parts`` has the column pid, one row a partition.
    """
    pids = sorted(r.pid for r in parts.select("pid").collect())
    listed = list(zip(pids, [*pids[1:], *(pids[:1] if around else [None])]))
    return parts.sparkSession.createDataFrame(listed, "pid int, next_pid int")
