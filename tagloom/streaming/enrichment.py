"""Stored enrichment runs: pending rows to requests, answers to results, results to a version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.enrich import enrichment_results
from tagloom.operators.merge import (
    JOBS_SCHEMA,
    SCOPE,
    apply_enrichment,
    latest_version,
    read_version,
    touched_buckets,
    versions,
    write_version,
)
from tagloom.operators.model_input import model_inputs
from tagloom.operators.serving import pending_enrichment


def request_enrichment(
    spark: SparkSession,
    target: str,
    details: DataFrame,
    run: str,
    as_of: Column,
    prompt_hash: str,
    sources: Sequence[str],
    gated: Column,
    limit: int = 200,
) -> DataFrame:
    """Store the requests of an enrichment run over the newest version and return them.

    A repeated call replaces the run's requests. ``details`` has source, detail_url,
    landed_at and payload.
    """
    jobs = read_version(spark, target, latest_version(spark, target))
    columns = ["id", *SCOPE, "title", "company", "description_html", "source_url", "tech_stack"]
    pending = pending_enrichment(jobs, prompt_hash, sources, limit).select(*columns)
    folder = f"{target}/enrichment/requests/run={run}"
    model_inputs(pending, details, as_of, prompt_hash, gated).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def store_answers(
    spark: SparkSession, target: str, run: str, answers: DataFrame, as_of: Column
) -> DataFrame:
    """Store the results of a run and the version that has them; returns the results.

    ``answers`` has id and answer; requests without a readable answer count as attempted,
    as do gated ones. Only the buckets of companies with a request are written again. The new
    version sorts behind the one it is made from and before that of any later run; a repeated
    call writes the same version again.
    """
    requests = spark.read.parquet(f"{target}/enrichment/requests/run={run}")
    hashes = [r.prompt_hash for r in requests.select("prompt_hash").distinct().collect()]
    folder = f"{target}/enrichment/results/run={run}"
    if hashes:
        results = enrichment_results(requests, answers, hashes[0], F.col("gated"))
    else:
        results = spark.createDataFrame(
            [], "id string, known array<string>, unknown array<string>, status string, "
            "prompt_hash string, tech_stack array<string>"
        )
    results.write.mode("overwrite").parquet(folder)
    results = spark.read.parquet(folder)
    mark = f"+{run}"
    base = max((v for v in versions(spark, target) if not v.endswith(mark)), default=None)
    if base is None or not hashes:
        return results
    touched = touched_buckets(requests)
    current = read_version(spark, target, base, touched)
    names = spark.createDataFrame([], JOBS_SCHEMA).columns
    written = apply_enrichment(current, results, as_of).select(*names)
    write_version(written, target, f"{base}{mark}", base, touched)
    return results
