"""Tag frequency, co-occurrence and the placement of a radar chart."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.rules import segment
from tagloom.operators.ranking import count_ranks, top_per_group

WINDOW_DAYS = {"7d": 7, "30d": 30, "90d": 90, "all": None}
DEFAULT_WINDOW = "30d"


def in_window(rows: DataFrame, window: str, as_of: Column, by: str = "first_seen_at") -> DataFrame:
    """Rows from midnight ``window`` days before ``as_of``; unknown names mean 30 days."""
    days = WINDOW_DAYS.get(window, WINDOW_DAYS[DEFAULT_WINDOW])
    if days is None:
        return rows
    return rows.where(F.col(by) >= F.date_sub(F.to_date(as_of), days).cast("timestamp"))


def in_segment(rows: DataFrame, rules: Sequence, name: str | None) -> DataFrame:
    """Rows whose tags classify to segment ``name``; no name keeps all rows."""
    known = {segment_name for segment_name, _ in rules}
    if name not in known:
        return rows
    return rows.where(segment(F.col("tech_stack"), rules) == name)


def pick_categories(
    text: str | None, known: Sequence[str], defaults: Sequence[str], k: int = 4
) -> list[str]:
    """``k`` known categories from a comma list, filled up from the defaults."""
    asked = [part.strip().lower() for part in (text or "").split(",")]
    wanted = [name for name in asked if name in known]
    return list(dict.fromkeys([*wanted, *defaults]))[:k]


def segment_categories(
    name: str | None,
    text: str | None,
    known: Sequence[str],
    by_segment: Mapping[str, Sequence[str]],
    defaults: Sequence[str],
    k: int = 4,
) -> list[str]:
    """The asked categories, filled up from those of the segment, or from the general ones."""
    return pick_categories(text, known, by_segment.get(name or "", defaults), k)


def segment_leaders(
    rows: DataFrame,
    categories: DataFrame,
    rules: Sequence,
    name: str | None,
    chosen: Sequence[str],
    k: int = 8,
) -> DataFrame:
    """First ``k`` tags of each chosen category among the rows of a segment, ranked among all its tags."""
    frequency = tag_frequency(in_segment(rows, rules, name), categories)
    return top_per_category(frequency, chosen, k)


def tag_counts(rows: DataFrame, column: str = "tech_stack") -> DataFrame:
    return (
        rows.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
    )


def tag_frequency(
    rows: DataFrame, categories: DataFrame, column: str = "tech_stack", other: str = "other"
) -> DataFrame:
    """Tags by falling count (ties by name): tag, count, rank, tag_total, category."""
    ranked = count_ranks(tag_counts(rows, column), "tag", total="tag_total")
    return ranked.join(categories, "tag", "left").select(
        "tag", "count", "rank", "tag_total", F.coalesce("category", F.lit(other)).alias("category")
    )


def tag_pairs(rows: DataFrame, column: str = "tech_stack") -> DataFrame:
    """Rows in which two tags occur together, for both orders of each pair.

    Pairs stream out of two nested explodes, one order only, and are counted on the map
    side; the other order is added to the counts.
    """
    half = (
        rows.select(F.posexplode(column).alias("i", "a"), F.col(column).alias("all"))
        .select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("count"))
    )
    # a tag listed twice in one row pairs with itself, once for each order
    sides = F.when(
        F.col("a") == F.col("b"), F.array(F.struct("a", "b", (F.col("count") * 2).alias("count")))
    ).otherwise(
        F.array(
            F.struct("a", "b", "count"),
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "count"),
        )
    )
    return half.select(F.inline(sides))


def rounded_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(part / whole * F.lit(100) + F.lit(0.5)).cast("int")


def top_partners(rows: DataFrame, column: str = "tech_stack", k: int = 8) -> DataFrame:
    """The ``k`` most frequent partners of each tag, with their share of its own count."""
    pairs = tag_pairs(rows, column)
    best = top_per_group(
        pairs, ["a"], [F.col("count").desc(), F.col("b").asc()], k, "position"
    )
    base = tag_counts(rows, column).select(F.col("tag").alias("a"), F.col("count").alias("base"))
    return best.join(base, "a").select(
        F.col("a").alias("tag"),
        "position",
        F.col("b").alias("partner"),
        "count",
        rounded_percent(F.col("count"), F.col("base")).alias("pct"),
    )


def chosen_categories(frequency: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Rows of the chosen categories; ranks stay those of the full list."""
    return frequency.where(F.col("category").isin(*chosen))


def partners_of(partners: DataFrame, frequency: DataFrame) -> DataFrame:
    """Partners of the tags in ``frequency``; the partners may be of any category."""
    return partners.join(frequency.select("tag"), "tag", "left_semi")


def top_per_category(
    frequency: DataFrame, chosen: Sequence[str] | None = None, k: int = 8
) -> DataFrame:
    """First ``k`` tags of each category; the first one is its leader."""
    rows = frequency if chosen is None else chosen_categories(frequency, chosen)
    best = top_per_group(rows, ["category"], [F.col("rank").asc()], k, "position")
    return best.withColumn("leader", F.col("position") == 1)


def radar_layout(
    frequency: DataFrame,
    chosen: Sequence[str],
    k: int = 8,
    center: tuple[float, float] = (280.0, 240.0),
    radius: float = 200.0,
) -> DataFrame:
    """Place the top tags of each chosen category in its sector.

    The angle comes from the position in the sector, the distance from the rank among all
    tags and the size from the count.
    """
    placed = top_per_category(frequency, chosen, k).withColumn(
        # at most k rows per category
        "n",
        F.count("*").over(Window.partitionBy("category")),
    )
    sector = 2 * math.pi / len(chosen)
    index = F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col("category")) - 1
    angle = (
        F.lit(-math.pi / 2) + index * F.lit(sector) + F.lit(sector) * F.col("position") / (F.col("n") + 1)
    )
    share = F.col("rank") / F.greatest(F.col("tag_total"), F.lit(1))
    distance = F.lit(radius) * (
        F.lit(0.16) + F.lit(0.76) * F.least(F.lit(1.0), share * F.lit(1.8))
    )
    x = F.lit(center[0]) + F.cos(angle) * distance
    size = F.greatest(F.lit(6.0), F.least(F.lit(20.0), F.sqrt("count") * F.lit(1.3)))
    return placed.select(
        "category",
        "position",
        "tag",
        "count",
        "rank",
        "leader",
        x.alias("x"),
        (F.lit(center[1]) + F.sin(angle) * distance).alias("y"),
        size.alias("size"),
        F.when(x > center[0], F.lit("right")).otherwise(F.lit("left")).alias("label_side"),
    )


def leaders_rail(frequency: DataFrame, partners: DataFrame, k: int = 8) -> DataFrame:
    """First ``k`` tags overall, and after them the partners of the first one."""
    top = frequency.where(F.col("rank") <= k).select(
        F.lit("top").alias("part"), F.col("rank").cast("int").alias("position"), "tag", "count"
    )
    first = frequency.where(F.col("rank") == 1).select("tag")
    focus = partners.join(first, "tag", "left_semi").select(
        F.lit("partner").alias("part"), "position", F.col("partner").alias("tag"), "count"
    )
    return top.unionByName(focus)
