"""The board followed as a stream of actions: state in the stream, changed entries in the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.board import board_fold

KEY = ("user_id", "job_id")


def follow_board(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    key: Sequence[str] = KEY,
    files_a_batch: int = 1,
) -> StreamingQuery:
    """Take in the actions that have landed since the last call, then stop.

    The last actions of each entry are the state of a streaming aggregate. A batch writes
    the entries that it changed, removed ones too, to a folder of its own, which a batch
    that is repeated after a failure replaces.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return (
        board_fold(reader.parquet(source), key)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_board(spark: SparkSession, target: str, key: Sequence[str] = KEY) -> DataFrame:
    """The present entries after the last batch: key, ``column`` and ``saved_at``."""
    rows = spark.read.parquet(target)
    values = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*key, "last.*").where("present").drop("present")
