"""The board of saved rows, folded from a log of save, move and remove actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import small_table


def board_fold(
    actions: DataFrame,
    key: Sequence[str] = ("user_id", "job_id"),
    order: Sequence[str] = ("ts", "seq"),
    first_column: str = "watching",
) -> DataFrame:
    """Key, ``present``, ``column`` and ``saved_at`` of every entry that has an action.

    Each entry needs only its last action of each kind, so the log is reduced before the
    shuffle and no entry's history is gathered. Over a stream the same aggregate is the
    state that is kept; actions may come late, since the order is that of their times.
    """
    at = F.struct(*order)

    def last(kind: str) -> Column:
        return F.max(F.when(F.col("action") == kind, at))

    # a move counts with its target column, which never decides between two times
    moves = F.max(F.when(F.col("action") == "move", F.struct(at.alias("at"), F.col("column"))))
    folded = actions.groupBy(*key).agg(
        last("save").alias("saved"), last("remove").alias("removed"), moves.alias("moved")
    )
    present = F.col("saved").isNotNull() & (
        F.col("removed").isNull() | (F.col("saved") > F.col("removed"))
    )
    moved_after = F.col("moved").isNotNull() & (F.col("moved.at") > F.col("saved"))
    return folded.select(
        *key,
        present.alias("present"),
        F.when(moved_after, F.col("moved.column")).otherwise(F.lit(first_column)).alias("column"),
        F.col(f"saved.{order[0]}").alias("saved_at"),
    )


def board_state(
    actions: DataFrame,
    key: Sequence[str] = ("user_id", "job_id"),
    order: Sequence[str] = ("ts", "seq"),
    first_column: str = "watching",
) -> DataFrame:
    """Present entries: key, ``column`` and ``saved_at``.

    A save puts the row into the first column, a move after it changes the column and a
    remove drops the entry.
    """
    return board_fold(actions, key, order, first_column).where("present").drop("present")


def latest_action(
    actions: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """The last action of each key, as plain columns."""
    last = actions.groupBy(*key).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("__last")
    )
    return last.select(*key, *[F.col(f"__last.{v}").alias(v) for v in values])


def board_counts(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Entries per board column, with a 0 for empty columns."""
    numbered = [(name, i) for i, name in enumerate(columns)]
    fixed = small_table(state.sparkSession, numbered, ["column", "position"])
    counted = state.groupBy("column").agg(F.count("*").alias("n"))
    return fixed.join(counted, "column", "left").select(
        "position", "column", F.coalesce("n", F.lit(0)).alias("count")
    )


def board_summary(state: DataFrame, filters: DataFrame) -> DataFrame:
    """Saved rows, latest save and enabled filters in one row."""
    enabled = filters.agg(F.count_if("enabled").alias("n")).scalar()
    saved = state.agg(F.count("*").alias("saved"), F.max("saved_at").alias("latest_saved_at"))
    return saved.select("*", enabled.alias("active_filters"))


def board_list(state: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Entries, newest save first."""
    return state.orderBy(F.col("saved_at").desc(), *tie)
