"""Incremental ingestion: newly landed runs are merged into the versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.merge import (
    latest_version,
    merge_snapshot,
    prepare,
    read_version,
    touched_buckets,
    versions,
    write_version,
)
from tagloom.plans.postings import JOB_COLUMNS, in_region, read_postings
from tagloom.sources.landed import read_landed

RUN_FORMAT = "yyyyMMdd'T'HHmmss"

# What a file listing shows; the content column is never selected and so never read.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

LOG_SCHEMA = (
    "run_id string, batch bigint, fetched bigint, upserted bigint, deactivated bigint, "
    "buckets_touched int"
)

# What a batch read: for each source of a run the rows found, and whether any of them is stored.
EXTRACTS_SCHEMA = (
    "batch bigint, run_id string, source string, companies string, fetched bigint, filled boolean"
)


def apply_run(
    spark: SparkSession, incoming: DataFrame, target: str, run_id: str, batch_id: int
) -> dict[str, int]:
    """Merge the in-region rows of one run into the newest version of an earlier run.

    Only the buckets of companies that sent rows are read and written again. Returns the
    numbers of upserted and deactivated rows and of touched buckets.
    """
    # a version's name begins with its run, so every version of this run sorts behind the bare id
    previous = latest_version(spark, target, before=run_id)
    touched = touched_buckets(incoming)
    current = read_version(spark, target, previous, touched)
    as_of = F.to_timestamp(F.lit(run_id), RUN_FORMAT)
    changes = Observation(f"changes-{run_id}")
    merged = merge_snapshot(current, incoming, as_of).observe(
        changes,
        F.count_if(F.col("change_type").isin("inserted", "updated")).alias("upserted"),
        F.count_if(F.col("change_type") == "deactivated").alias("deactivated"),
    )
    write_version(
        merged.drop("change_type"), target, f"{run_id}-{batch_id:010d}", previous, touched
    )
    counted = changes.get if touched else {"upserted": 0, "deactivated": 0}
    return {**counted, "buckets_touched": len(touched)}


def log_run(spark: SparkSession, target: str, run_id: str, batch_id: int, numbers: dict) -> None:
    """Write the run's row of the log; a repeated batch or re-applied run replaces it."""
    row = [batch_id, numbers["fetched"], numbers["upserted"], numbers["deactivated"], numbers["buckets_touched"]]
    schema = LOG_SCHEMA.removeprefix("run_id string, ")
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(
        f"{target}/log/run_id={run_id}"
    )


def read_log(spark: SparkSession, target: str) -> DataFrame:
    """One row per merged run."""
    names = [column.split()[0] for column in LOG_SCHEMA.split(", ")]
    return spark.read.schema(LOG_SCHEMA).json(f"{target}/log").select(*names)


def _extracts(spark: SparkSession, target: str, before: int, companies: str) -> dict[tuple[str, str], Row]:
    """For each run and source the newest batch older than ``before`` that read it.

    Readings with another company list than ``companies`` are left out.
    """
    rows = spark.read.schema(EXTRACTS_SCHEMA).json(f"{target}/extracts").where(F.col("batch") < before)
    newest = sorted(rows.collect(), key=lambda r: r.batch)
    return {(r.run_id, r.source): r for r in newest if r.companies == companies}


def _write_extracts(spark: SparkSession, target: str, batch_id: int, rows: list[tuple], mode: str) -> None:
    schema = EXTRACTS_SCHEMA.removeprefix("batch bigint, ")
    listed = spark.createDataFrame(rows, schema).coalesce(1)
    listed.write.mode(mode).json(f"{target}/extracts/batch={batch_id}")


def _fingerprint(companies: DataFrame) -> str:
    """The same for equal company lists, in any order."""
    used = F.to_json(F.struct("source", "slug", "name", "api_url", "base_url"))
    total = F.sum(F.xxhash64(used).cast("decimal(20,0)")).cast("string")
    return companies.agg(F.concat_ws(":", F.count("*"), total)).first()[0]


def _runs_and_sources(files: DataFrame) -> DataFrame:
    parts = [F.regexp_extract("path", f"/{n}=([^/]+)/", 1).alias(n) for n in ("run_id", "source")]
    return files.select(*parts)


def ingest_landed(
    spark: SparkSession, landing: str, companies: DataFrame, target: str, checkpoint: str
) -> StreamingQuery:
    """Process everything that has landed since the last call, then stop.

    The stream only watches which sources of which runs got new files; it does not open them.
    Each such source is read whole from its folder in the run, so a file that lands late cannot
    make the rest of its run look gone. Runs are merged in the order of their ids, because a
    soft delete needs one company list at a time. When files land for a run that later runs
    were already merged over, the later runs are merged again, in order, from the version
    before the late run; the result is that of ordered landing. What the rules made of a source
    of a run is kept beside the table, and read again from there until files land for it or
    the company list changes. A version is named by run and batch, so a batch that is repeated
    after a failure writes the same versions again from the same predecessors. Each run leaves
    one row in the log.
    """
    pattern = f"{landing}/run_id={{}}/source=*/kind=*"

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        # one small row per source of a landed run
        landed = {tuple(r) for r in batch.distinct().collect()}
        applied = {v.split("-", 1)[0] for v in versions(spark, target)}
        late = {r for r in applied if landed and r > min(landed)[0]}
        runs = sorted({run for run, _ in landed} | late)
        if not runs:
            return
        listed = spark.read.format("binaryFile").schema(FILE_SCHEMA).load([pattern.format(r) for r in runs])
        parts = sorted(tuple(r) for r in _runs_and_sources(listed).distinct().collect())
        names = _fingerprint(companies)
        known = _extracts(spark, target, batch_id, names)
        fresh = [p for p in parts if p in landed or p not in known]
        extracted = read_postings(read_landed(spark, landing, fresh), companies, carry=["run_id"])
        fetched = Observation(f"fetched-{batch_id}")
        counts = [
            F.count_if((F.col("run_id") == run) & (F.col("source") == source)).alias(f"n{i}")
            for i, (run, source) in enumerate(fresh)
        ]
        # the rules run once for all runs of the batch; each merge reads the folders of its run
        rows = f"{target}/extracted/batch={batch_id}"
        in_region(extracted.observe(fetched, *counts)).write.mode("overwrite").partitionBy(
            "run_id", "source"
        ).parquet(rows, compression="zstd")
        written = spark.read.schema(extracted.schema).parquet(rows).select("run_id", "source")
        filled = {tuple(r) for r in written.distinct().collect()}
        made = [(*p, names, fetched.get[f"n{i}"], p in filled) for i, p in enumerate(fresh)]
        _write_extracts(spark, target, batch_id, made, "overwrite")
        known = _extracts(spark, target, batch_id + 1, names)
        for run_id in runs:
            own = [known[p] for p in parts if p[0] == run_id]
            paths = [f"{target}/extracted/batch={k.batch}/run_id={run_id}/source={k.source}" for k in own if k.filled]
            incoming = spark.createDataFrame([], extracted.schema)
            if paths:
                reader = spark.read.schema(extracted.schema).option("basePath", f"{target}/extracted")
                incoming = reader.parquet(*paths)
            numbers = apply_run(spark, incoming.select(JOB_COLUMNS), target, run_id, batch_id)
            log_run(spark, target, run_id, batch_id, {**numbers, "fetched": sum(k.fetched for k in own)})

    prepare(spark, target)
    _write_extracts(spark, target, -1, [], "ignore")
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(pattern.format("*"))
    return (
        _runs_and_sources(files)
        .writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
