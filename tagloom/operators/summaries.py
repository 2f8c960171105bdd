"""Headline counts kept beside the versioned table and brought up to date from what changed.

A summary counts the active rows under every value they have, as (group, value, n). Buckets that two
versions share are the same files, so the difference of two versions is that of their other buckets:
the new rows' counts less the old rows' counts are added to the stored ones. A value that no row has
any more leaves with its last count, companies as well, so distinct companies are a count of rows.
Times are kept as values (one a run), so figures that depend on the clock are read off at any time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.merge import bucket_folders, latest_version, read_version
from tagloom.operators.metrics import hours_between, percent, relative_time, standard_facets
from tagloom.operators.serving import active_view

COUNTS_SCHEMA = "group string, value string, n bigint"
# the row that marks a stored summary, which may have no others
_MARK = "version"


def value_counts(view: DataFrame, sign: int = 1) -> DataFrame:
    """(group, value, n): the rows of the view under each value, times ``sign``; counted on the map side."""

    def entry(group: str, value: Column) -> Column:
        return F.struct(F.lit(group).alias("group"), value.cast("string").alias("value"))

    one = F.lit("")
    fixed = F.array(
        entry("rows", one),
        entry("remote", F.when(F.coalesce(F.col("is_remote"), F.lit(True)), one)),
        entry("company", F.col("company")),
        entry("seen", F.unix_micros("first_seen_at")),
        entry("fetched", F.unix_micros("fetched_at")),
        *[entry(name, value) for name, value in standard_facets().items()],
    )
    none = F.array().cast("array<string>")
    tags = F.transform(F.coalesce("tech_stack", none), lambda t: entry("tag", F.nullif(t, F.lit(""))))
    listed = view.select(F.inline(F.concat(fixed, tags))).where("value IS NOT NULL")
    return listed.groupBy("group", "value").agg((F.count("*") * sign).alias("n"))


def _stored(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(f"{COUNTS_SCHEMA}, version string").json(f"{root}/summaries")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{COUNTS_SCHEMA}, version string")


def refreshed_summary(spark: SparkSession, root: str) -> DataFrame:
    """The counts of the newest version, stored; only buckets that changed since the last summary are read.

    A repeated call reads the stored counts. Counts of a version are one file, seen once complete.
    """
    latest = latest_version(spark, root)
    if latest is None:
        return spark.createDataFrame([], COUNTS_SCHEMA)
    stored = _stored(spark, root)
    # a row a summary
    marks = [r.version for r in stored.where(F.col("group") == _MARK).select("version").collect()]
    if latest not in marks:
        base = max((v for v in marks if v < latest), default=None)
        old, new = bucket_folders(spark, root, base), bucket_folders(spark, root, latest)
        changed = [b for b in old.keys() | new.keys() if old.get(b) != new.get(b)]
        mark = spark.createDataFrame([(_MARK, "", 1)], COUNTS_SCHEMA)
        counts = stored.where((F.col("version") == base) & (F.col("group") != _MARK)).drop("version") if base else mark.limit(0)
        for version, sign in ((base, -1), (latest, 1)):
            if version is not None and changed:
                rows = active_view(read_version(spark, root, version, changed))
                counts = counts.unionByName(value_counts(rows, sign))
        counts = counts.groupBy("group", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        folder = f"{root}/summaries/version={latest}"
        counts.unionByName(mark).coalesce(1).write.mode("overwrite").json(folder)
    found = _stored(spark, root).where((F.col("version") == latest) & (F.col("group") != _MARK))
    return found.select("group", "value", "n")


def summary_record(counts: DataFrame, as_of: Column, stale_hours: int = 36) -> DataFrame:
    """The headline figures, facet maps and option lists of ``kpi_record`` from stored counts."""
    group = F.col("group")
    time = F.timestamp_micros(F.when(group.isin("seen", "fetched"), F.col("value")).cast("long"))
    is_new = (group == "seen") & (time >= as_of - F.expr("INTERVAL 24 HOURS"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    def listed(name: str, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(group == name, value)))

    rows, latest = total(group == "rows"), F.max(F.when(group == "fetched", time))
    pair = F.struct("value", F.col("n").alias("count"))
    return counts.agg(
        rows.alias("active_roles"),
        total(is_new).alias("new_today"),
        F.count_if(group == "company").alias("company_count"),
        percent(total(group == "remote"), rows).alias("remote_percent"),
        *[F.map_from_entries(listed(g, pair)).alias(f"{g}_counts") for g in standard_facets()],
        listed("source", F.col("value")).alias("source_options"),
        listed("tag", F.col("value")).alias("tech_options"),
        latest.alias("last_updated"),
        relative_time(latest, as_of).alias("updated_text"),
        F.coalesce(hours_between(latest, as_of) >= stale_hours, F.lit(False)).alias("stale"),
    )
