"""Daily snapshot merge with soft deletes, and the versioned table it is kept in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.keys import one_per_key, row_id

KEY = ["source", "external_id", "company_slug"]
SCOPE = ["source", "company_slug"]

JOBS_SCHEMA = (
    "id string, source string, external_id string, company string, company_slug string, "
    "title string, department string, location string, description_html string, "
    "source_url string, is_qc boolean, is_remote boolean, seniority string, "
    "tech_stack array<string>, employment_type string, posted_at timestamp, "
    "fetched_at timestamp, first_seen_at timestamp, last_seen_at timestamp, "
    "is_active boolean, enriched_at timestamp, enriched_prompt_hash string, "
    "enriched_tech_stack array<string>"
)

# Columns the merge writes by itself.
STAMPS = ["fetched_at", "last_seen_at"]


def empty_jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], JOBS_SCHEMA)


def _daily_columns(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> list[str]:
    reserved = {*key, *STAMPS, "first_seen_at", "is_active", "id"}
    return [c for c in current.columns if c in incoming.columns and c not in reserved]


def _merged_columns(
    current: DataFrame, daily: Sequence[str], key: Sequence[str], as_of: Column, closed: Column
) -> list[Column]:
    """Output columns from ``__old`` and ``__new`` structs (either may be null)."""
    seen = F.col("__new").isNotNull()
    known = F.col("__old").isNotNull()
    types = dict(current.dtypes)
    out = []
    for name in current.columns:
        old = F.col(f"__old.{name}")
        if name in key:
            value = F.col(name)
        elif name == "id":
            value = F.when(known, old).otherwise(row_id(key))
        elif name in STAMPS:
            value = F.when(seen, as_of).otherwise(old)
        elif name == "first_seen_at":
            value = F.coalesce(old, F.when(seen, as_of))
        elif name == "is_active":
            value = F.when(seen, F.lit(True)).when(closed, F.lit(False)).otherwise(old)
        elif name in daily:
            value = F.when(seen, F.col(f"__new.{name}")).otherwise(old)
        elif name == "enriched_tech_stack":
            value = F.when(known, old).otherwise(F.array().cast(types[name]))
        else:
            value = old
        out.append(value.alias(name))
    change = (
        F.when(~known, F.lit("inserted"))
        .when(seen, F.lit("updated"))
        .when(closed, F.lit("deactivated"))
        .otherwise(F.lit("unchanged"))
    )
    return [*out, change.alias("change_type")]


def merge_snapshot(
    current: DataFrame,
    incoming: DataFrame,
    as_of: Column,
    key: Sequence[str] = KEY,
    scope: Sequence[str] = SCOPE,
    newest: Sequence[str] = (),
    incoming_is_small: bool = False,
) -> DataFrame:
    """Merge one run into the stored rows; adds ``change_type``.

    New keys are inserted. Known keys take the incoming values, become active and keep
    ``first_seen_at`` and the enrichment columns. Active rows that are missing from a
    scope (company) with at least one incoming row become inactive; other scopes are
    left alone. Of several incoming rows with one key the greatest by ``newest`` counts.

    Which stored rows belong to a company of the run is decided on their keys alone; that
    mark and the incoming rows then meet the stored rows by the key, so wide rows are
    shuffled once. With ``incoming_is_small`` the stored side is not shuffled as long as
    Spark finds the incoming side below its broadcast limit; keys are then read a second time.
    """
    daily = _daily_columns(current, incoming, key)
    fresh = one_per_key(incoming.select(*key, *daily), key, newest)
    old = current.select(*key, F.struct(*current.columns).alias("__old"))
    new = fresh.select(*key, F.struct(*daily).alias("__new"))
    # a lookup with one row per company that sent anything
    scopes = incoming.select(*scope).distinct()
    within = current.select(*dict.fromkeys([*key, *scope])).join(scopes, list(scope), "left_semi")
    marks = within.select(*key).distinct().withColumn("__in_scope", F.lit(True))

    if incoming_is_small:
        known = old.select(*key).join(new.select(*key), list(key), "left_semi")
        added = new.join(known, list(key), "left_anti").select(
            *key,
            F.lit(None).cast(old.schema["__old"].dataType).alias("__old"),
            F.lit(None).cast("boolean").alias("__in_scope"),
            "__new",
        )
        flagged = scopes.withColumn("__in_scope", F.lit(True))
        placed = old.select(*key, "__old", *[F.col(f"__old.{c}").alias(f"__scope_{c}") for c in scope])
        same = [F.col(f"__scope_{c}") == F.col(f"__of_{c}") for c in scope]
        flagged = flagged.select(*[F.col(c).alias(f"__of_{c}") for c in scope], "__in_scope")
        joined = placed.join(flagged, same, "left").select(*key, "__old", "__in_scope")
        joined = joined.join(new, list(key), "left").unionByName(added)
    else:
        # the left join keeps the partitioning by key that the full join needs
        joined = old.join(marks, list(key), "left").join(new, list(key), "full_outer")

    closed = (
        F.col("__new").isNull()
        & F.coalesce(F.col("__old.is_active"), F.lit(False))
        & F.coalesce(F.col("__in_scope"), F.lit(False))
    )
    return joined.select(*_merged_columns(current, daily, key, as_of, closed))


def run_summary(merged: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: rows fetched, upserted and deactivated."""
    changes = merged.agg(
        F.count_if(F.col("change_type").isin("inserted", "updated")).alias("upserted"),
        F.count_if(F.col("change_type") == "deactivated").alias("deactivated"),
    )
    fetched = extracted.agg(F.count("*").alias("fetched"))
    return changes.select(fetched.scalar().alias("fetched"), "upserted", "deactivated")


def apply_enrichment(jobs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Write tags, time and hash of ``results`` (id, known, prompt_hash) back by id."""
    answer = results.select(
        F.col("id"), F.struct(F.col("known"), F.col("prompt_hash")).alias("__answer")
    )
    joined = jobs.join(answer, "id", "left")
    written = F.col("__answer").isNotNull()
    updates = {
        "enriched_tech_stack": F.col("__answer.known"),
        "enriched_at": as_of,
        "enriched_prompt_hash": F.col("__answer.prompt_hash"),
    }
    return joined.select(
        *[
            F.when(written, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
            for c in jobs.columns
        ]
    )


# --- the versioned table ----------------------------------------------------------------------

BUCKETS = 32
MANIFEST_SCHEMA = "version string, buckets int, bucket int, folder string"
# the manifest row that stands for the version itself
_HEADER = -1


def bucket_of(buckets: int, scope: Sequence[str] = SCOPE) -> Column:
    """The bucket of a row: a run touches whole companies, so a company is in one bucket."""
    return F.pmod(F.xxhash64(*scope), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of all versions; a version exists once its one manifest file does."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/manifests")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def prepare(spark: SparkSession, root: str) -> None:
    """Make the folder of manifests, so that readers find one without versions."""
    nothing = spark.createDataFrame([(0, _HEADER, "")], "buckets int, bucket int, folder string")
    nothing.coalesce(1).write.mode("ignore").json(f"{root}/manifests/version=none")


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the complete versions, in order."""
    headers = _manifests(spark, root).where((F.col("bucket") == _HEADER) & (F.col("buckets") > 0))
    return sorted(r.version for r in headers.collect())


def latest_version(spark: SparkSession, root: str, before: str | None = None) -> str | None:
    """Name of the newest complete version, older than ``before`` if that is given."""
    return max((v for v in versions(spark, root) if before is None or v < before), default=None)


def bucket_folders(spark: SparkSession, root: str, version: str | None) -> dict[int, str]:
    """The folder of each bucket of a version, below ``root``; at most one row a bucket."""
    if version is None:
        return {}
    rows = _manifests(spark, root).where(F.col("version") == version)
    return {r.bucket: r.folder for r in rows.collect() if r.bucket != _HEADER}


def touched_buckets(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets that ``rows`` fall into."""
    found = rows.select(bucket_of(buckets).alias("bucket")).distinct()
    return sorted(r.bucket for r in found.collect())


def write_version(
    jobs: DataFrame,
    root: str,
    version: str,
    previous: str | None = None,
    touched: Sequence[int] | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Write the ``touched`` buckets of a version; the others stay the files of ``previous``.

    ``jobs`` holds all rows of the touched buckets (of all buckets by default). Each bucket
    is a folder, and its active rows are a folder of their own, sorted by age within files,
    so that the serving filters skip the rest by folder and by file statistics. Spark splits
    a large bucket over several files and puts small ones together in a task. The manifest
    is written last, as one file, and readers take the files that it names.
    """
    spark = jobs.sparkSession
    rows = f"rows/version={version}"
    if touched is None:
        touched = touched_buckets(jobs, buckets)
    kept = bucket_folders(spark, root, previous)
    filled = set()
    if touched:
        (
            jobs.withColumn("bucket", bucket_of(buckets))
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "is_active", "first_seen_at")
            .write.mode("overwrite")
            .partitionBy("bucket", "is_active")
            .parquet(f"{root}/{rows}", compression="zstd")
        )
        written = spark.read.schema(f"{JOBS_SCHEMA}, bucket int").parquet(f"{root}/{rows}")
        filled = {r.bucket for r in written.select("bucket").distinct().collect()}
    # a touched bucket that has no rows any more leaves the manifest
    folders = {b: f for b, f in kept.items() if b not in touched}
    folders |= {b: f"{rows}/bucket={b}" for b in filled}
    listed = [(buckets, _HEADER, ""), *((buckets, b, f) for b, f in sorted(folders.items()))]
    manifest = spark.createDataFrame(listed, "buckets int, bucket int, folder string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifests/version={version}")


def read_version(
    spark: SparkSession, root: str, version: str | None, only: Sequence[int] | None = None
) -> DataFrame:
    """The rows of a version, or of some of its buckets; the other buckets' files stay closed."""
    folders = bucket_folders(spark, root, version)
    paths = [f"{root}/{f}" for b, f in sorted(folders.items()) if only is None or b in set(only)]
    if not paths:
        return empty_jobs(spark)
    names = empty_jobs(spark).columns
    return spark.read.schema(JOBS_SCHEMA).option("basePath", f"{root}/rows").parquet(*paths).select(names)
