"""Headline figures, facet counts and option lists over the serving view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import small_table


def hours_between(earlier: Column, later: Column) -> Column:
    """Whole hours, rounded down."""
    hours = F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))
    return F.floor(hours / F.lit(3_600_000))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole`` in decimal arithmetic; 0 when ``whole`` is 0."""
    share = F.lit(100).cast("decimal(20,1)") * part.cast("decimal(20,0)")
    return F.when(whole == 0, F.lit(0).cast("decimal(10,1)")).otherwise(
        F.round(F.try_divide(share, whole.cast("decimal(20,0)")), digits).cast("decimal(10,1)")
    )


def kpis(view: DataFrame, as_of: Column, stale_hours: int = 36) -> DataFrame:
    """One row of headline figures, from one scan.

    ``new_today`` counts a rolling 24 hours. Hybrid and unknown workplaces count as
    remote; only rows marked on-site do not. Data is stale ``stale_hours`` after the last
    fetch.
    """
    not_on_site = F.coalesce(F.col("is_remote"), F.lit(True))
    rows = F.count("*")
    latest = F.max("fetched_at")
    return view.agg(
        rows.alias("active_roles"),
        F.count_if(F.col("first_seen_at") >= as_of - F.expr("INTERVAL 24 HOURS")).alias(
            "new_today"
        ),
        F.count_distinct("company").alias("company_count"),
        percent(F.count_if(not_on_site), rows).alias("remote_percent"),
        latest.alias("last_updated"),
        F.coalesce(hours_between(latest, as_of) >= stale_hours, F.lit(False)).alias("stale"),
    )


def relative_time(earlier: Column, later: Column) -> Column:
    """Age as text: minutes under an hour, hours under a day, else days, all rounded down."""
    millis = F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))

    def ago(number: Column, unit: str) -> Column:
        plural = F.when(F.abs(number) == 1, F.lit(unit)).otherwise(F.lit(f"{unit}s"))
        past = F.concat(number.cast("string"), F.lit(" "), plural, F.lit(" ago"))
        future = F.concat(F.lit("in "), (-number).cast("string"), F.lit(" "), plural)
        return F.when(number < 0, future).otherwise(past)

    minutes, hours, days = (F.floor(millis / F.lit(n)) for n in (60_000, 3_600_000, 86_400_000))
    return (
        F.when(minutes == 0, F.lit("this minute"))
        .when(minutes < 60, ago(minutes, "minute"))
        .when(hours < 24, ago(hours, "hour"))
        .when(days == 1, F.lit("yesterday"))
        .otherwise(ago(days, "day"))
    )


def kpi_record(view: DataFrame, as_of: Column, stale_hours: int = 36) -> DataFrame:
    """Headline figures, facet counts and option lists as one row, from one scan.

    Each row of the view is counted under every value it has, with a map-side count, so what is
    shuffled is a row for each distinct company, tag and facet value of a partition. The maps and
    lists hold facet values and tags, which the dictionaries bound; companies are only counted.
    """

    def entry(group: str, value: Column) -> Column:
        return F.struct(F.lit(group).alias("group"), value.cast("string").alias("value"))

    one = F.lit("")
    is_new = F.col("first_seen_at") >= as_of - F.expr("INTERVAL 24 HOURS")
    fixed = F.array(
        entry("rows", one),
        entry("new", F.when(is_new, one)),
        entry("remote", F.when(F.coalesce(F.col("is_remote"), F.lit(True)), one)),
        entry("company", F.col("company")),
        *[entry(name, value) for name, value in standard_facets().items()],
    )
    tags = F.transform(
        F.coalesce("tech_stack", F.array().cast("array<string>")),
        lambda t: entry("tag", F.nullif(t, F.lit(""))),
    )
    counted = (
        view.select("fetched_at", F.inline(F.concat(fixed, tags)))
        .where("value IS NOT NULL")
        .groupBy("group", "value")
        .agg(F.count("*").alias("count"), F.max("fetched_at").alias("latest"))
    )

    def total(group: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("group") == group, F.col("count"))), F.lit(0))

    def listed(group: str, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("group") == group, value)))

    pair = F.struct("value", "count")
    latest = F.max("latest")
    return counted.agg(
        total("rows").alias("active_roles"),
        total("new").alias("new_today"),
        F.count_if(F.col("group") == "company").alias("company_count"),
        percent(total("remote"), total("rows")).alias("remote_percent"),
        *[F.map_from_entries(listed(g, pair)).alias(f"{g}_counts") for g in standard_facets()],
        listed("source", F.col("value")).alias("source_options"),
        listed("tag", F.col("value")).alias("tech_options"),
        latest.alias("last_updated"),
        relative_time(latest, as_of).alias("updated_text"),
        F.coalesce(hours_between(latest, as_of) >= stale_hours, F.lit(False)).alias("stale"),
    )


def workplace_key(flag: Column) -> Column:
    """``true`` / ``false`` / ``null`` as text."""
    return F.coalesce(flag.cast("string"), F.lit("null"))


def standard_facets() -> dict[str, Column]:
    return {
        "source": F.col("source"),
        "workplace": workplace_key(F.col("is_remote")),
        "seniority": F.col("seniority"),
    }


def facet_counts(
    rows: DataFrame, facets: Mapping[str, Column], conditions: Mapping[str, Column] | None = None
) -> DataFrame:
    """Counts by facet value, each facet under all conditions but its own.

    One scan serves all facets. A value that occurs in ``rows`` but never under the
    conditions is listed with count 0; null values are not listed.
    """
    conditions = conditions or {}

    def others(facet: str) -> Column:
        kept = [c for name, c in conditions.items() if name != facet]
        return F.coalesce(reduce(lambda a, b: a & b, kept, F.lit(True)), F.lit(False))

    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("facet"),
                value.alias("value"),
                others(name).alias("kept"),
            )
            for name, value in facets.items()
        ]
    )
    return (
        rows.select(F.inline(entries))
        .where("value IS NOT NULL")
        .groupBy("facet", "value")
        .agg(F.count_if("kept").alias("count"))
    )


def contextual_facets(
    rows: DataFrame, facets: Mapping[str, Column], conditions: Mapping[str, Column]
) -> DataFrame:
    """Facet counts without the values that have none."""
    return facet_counts(rows, facets, conditions).where(F.col("count") > 0)


def zero_filled_facets(
    rows: DataFrame,
    facets: Mapping[str, Column],
    conditions: Mapping[str, Column],
    options: Mapping[str, Sequence[str]],
    hide_empty: Sequence[str] = ("seniority",),
) -> DataFrame:
    """Facet counts with a 0 for every known option.

    Options are the values in ``rows`` plus the fixed ones in ``options``. Facets named
    in ``hide_empty`` list only values that have rows.
    """
    counted = facet_counts(rows, facets, conditions)
    fixed = [(name, value) for name, values in options.items() for value in values]
    if fixed:
        zeros = small_table(rows.sparkSession, fixed, ["facet", "value"])
        counted = (
            counted.unionByName(zeros.withColumn("count", F.lit(0).cast("bigint")))
            .groupBy("facet", "value")
            .agg(F.sum("count").alias("count"))
        )
    return counted.where((F.col("count") > 0) | ~F.col("facet").isin(*hide_empty))


def tag_options(view: DataFrame, column: str = "tech_stack") -> DataFrame:
    """Distinct non-empty tags, one per row."""
    tags = view.select(F.explode(column).alias("tag"))
    return tags.where((F.col("tag") != "") & F.col("tag").isNotNull()).distinct()


def source_options(view: DataFrame) -> DataFrame:
    return view.where("source IS NOT NULL").select("source").distinct()


def tags_by_category(
    options: DataFrame, categories: DataFrame, text: str = "", other: str = "other"
) -> DataFrame:
    """Tags that contain ``text`` in any case, with their category (``other`` if none)."""
    found = options.where(F.contains(F.lower("tag"), F.lit(text.lower())))
    return found.join(categories, "tag", "left").select(
        F.coalesce("category", F.lit(other)).alias("category"), "tag"
    )
