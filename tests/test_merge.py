"""Snapshot merge, versions, write-back and incremental runs."""

import json
from datetime import datetime

import pytest
from helpers import companies, greenhouse_job, lever_job, ts
from pyspark.sql import functions as F

from tagloom.operators import merge
from tagloom.operators.keys import duplicate_keys
from tagloom.sources.landed import read_landed
from tagloom.streaming.landing import ingest_landed, read_log

OLD, NOW = datetime(2026, 5, 1), datetime(2026, 5, 9, 6)
CURRENT = "source string, external_id string, company_slug string, title string, is_active boolean"


def stored(spark, rows):
    frame = spark.createDataFrame(rows, CURRENT)
    return frame.select(
        F.concat(F.lit("id-"), "external_id", "company_slug").alias("id"),
        "*",
        *[F.lit(OLD).cast("timestamp").alias(c) for c in ("fetched_at", "first_seen_at", "last_seen_at")],
        F.array(F.lit("model")).alias("enriched_tech_stack"),
        F.lit("h").alias("enriched_prompt_hash"),
    )


def incoming(spark, rows):
    return spark.createDataFrame(
        rows, "source string, external_id string, company_slug string, title string"
    )


@pytest.fixture(params=[False, True], ids=["full", "small"])
def merged(spark, request):
    current = stored(
        spark,
        [
            ("s", "1", "a", "old", True),
            ("s", "2", "a", "gone", True),
            ("s", "3", "a", "was off", False),
            ("s", "4", "a", "back", False),
            ("s", "1", "b", "other company", True),
            ("t", "1", "a", "other source", True),
        ],
    )
    run = incoming(
        spark,
        [("s", "1", "a", "new title"), ("s", "4", "a", "back"), ("s", "9", "a", "first"),
         ("s", "9", "a", "second"), ("s", "7", "c", "new company")],
    )
    out = merge.merge_snapshot(current, run, ts("2026-05-09 06:00:00"), incoming_is_small=request.param)
    return {(r.source, r.external_id, r.company_slug): r for r in out.collect()}


def test_change_types(merged):
    assert {k: r.change_type for k, r in merged.items()} == {
        ("s", "1", "a"): "updated",
        ("s", "2", "a"): "deactivated",
        ("s", "3", "a"): "unchanged",
        ("s", "4", "a"): "updated",
        ("s", "9", "a"): "inserted",
        ("s", "7", "c"): "inserted",
        ("s", "1", "b"): "unchanged",
        ("t", "1", "a"): "unchanged",
    }


def test_columns_after_the_merge(merged):
    known = merged["s", "1", "a"]
    assert (known.title, known.first_seen_at, known.last_seen_at) == ("new title", OLD, NOW)
    assert (known.id, known.enriched_tech_stack, known.enriched_prompt_hash) == ("id-1a", ["model"], "h")
    gone = merged["s", "2", "a"]
    assert (gone.is_active, gone.last_seen_at, gone.title) == (False, OLD, "gone")
    assert merged["s", "4", "a"].is_active
    new = merged["s", "9", "a"]
    assert (new.title, new.first_seen_at, new.fetched_at, new.is_active) == ("second", NOW, NOW, True)
    assert (new.enriched_tech_stack, new.enriched_prompt_hash, len(new.id)) == ([], None, 64)
    assert merged["s", "1", "b"].is_active


def test_repeating_a_run_changes_only_times(spark):
    run = incoming(spark, [("s", str(i), "a", f"t{i}") for i in range(5)])
    empty = stored(spark, [("s", "0", "a", "t0", True)]).limit(0)
    first = merge.merge_snapshot(empty, run, ts("2026-05-08 06:00:00")).drop("change_type")
    again = merge.merge_snapshot(first, run, ts("2026-05-09 06:00:00"))
    assert {r.change_type for r in again.collect()} == {"updated"}
    same = [c for c in first.columns if c not in ("fetched_at", "last_seen_at")]
    assert again.select(same).exceptAll(first.select(same)).count() == 0
    assert duplicate_keys(again, merge.KEY).count() == 0


def test_empty_run_changes_nothing(spark):
    current = stored(spark, [("s", "1", "a", "x", True)])
    out = merge.merge_snapshot(current, incoming(spark, []), ts("2026-05-09 06:00:00"))
    assert [(r.change_type, r.is_active) for r in out.collect()] == [("unchanged", True)]


def test_hot_company(spark):
    """A company with most rows is closed out completely."""
    rows = [("s", str(i), "hot" if i % 3 else f"c{i}", "x", True) for i in range(600)]
    run = incoming(spark, [("s", "1", "hot", "x")])
    out = merge.merge_snapshot(stored(spark, rows), run, ts("2026-05-09 06:00:00"))
    counts = {r["change_type"]: r["count"] for r in out.groupBy("change_type").count().collect()}
    assert counts == {"updated": 1, "deactivated": 399, "unchanged": 200}


def test_run_summary(spark):
    current = stored(spark, [("s", "1", "a", "x", True), ("s", "2", "a", "x", True)])
    run = incoming(spark, [("s", "1", "a", "y"), ("s", "3", "a", "z")])
    out = merge.merge_snapshot(current, run, ts("2026-05-09 06:00:00"))
    assert tuple(merge.run_summary(out, run).first()) == (2, 2, 1)


def test_apply_enrichment(spark):
    jobs = spark.createDataFrame(
        [("1", "t", ["x"], None, None), ("2", "u", ["y"], OLD, "old")],
        "id string, title string, enriched_tech_stack array<string>, enriched_at timestamp, "
        "enriched_prompt_hash string",
    )
    results = spark.createDataFrame(
        [("1", ["Go"], "new")], "id string, known array<string>, prompt_hash string"
    )
    out = merge.apply_enrichment(jobs, results, ts("2026-05-09 06:00:00")).orderBy("id").collect()
    assert tuple(out[0]) == ("1", "t", ["Go"], NOW, "new")
    assert tuple(out[1]) == ("2", "u", ["y"], OLD, "old")


def land(folder, run_id, rows, first=0):
    for i, (source, kind, slug, url, payload) in enumerate(rows, first):
        path = folder / f"run_id={run_id}" / f"source={source}" / f"kind={kind}"
        path.mkdir(parents=True, exist_ok=True)
        line = {"company_slug": slug, "detail_url": url, "payload": payload}
        (path / f"part-{i}.json").write_text(json.dumps(line))


def test_readers_open_only_their_files(spark, tmp_path):
    land(tmp_path, "20260501T060000", [board(1), ("lever", "list", "bolt", None, "[]")])
    rows = read_landed(spark, str(tmp_path))
    assert sorted((r.source, r.run_id) for r in rows.collect()) == [
        ("greenhouse", "20260501T060000"), ("lever", "20260501T060000"),
    ]
    plan = rows.where("source = 'lever' AND kind = 'list'")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(source" in plan.toString()


def board(*ids):
    jobs = {"jobs": [greenhouse_job(f"Engineer {i}", "Python", id=i) for i in ids]}
    return ("greenhouse", "list", "acme", None, json.dumps(jobs))


def test_incremental_runs(spark, tmp_path):
    landing, target, state = (str(tmp_path / n) for n in ("landing", "jobs", "state"))
    land(tmp_path / "landing", "20260501T060000", [board(1, 2), ("lever", "list", "bolt", None, json.dumps([lever_job()]))])
    land(tmp_path / "landing", "20260502T060000", [board(2, 3)])

    def run():
        ingest_landed(spark, landing, companies(spark), target, state).awaitTermination()
        latest = merge.latest_version(spark, target)
        rows = merge.read_version(spark, target, latest).collect()
        return latest, {r.external_id: r for r in rows}

    version, rows = run()
    assert version.startswith("20260502T060000")
    active = {k: r.is_active for k, r in rows.items()}
    # the other company sent nothing in the second run and keeps its row
    assert active == {"1": False, "2": True, "3": True, "lev-1": True}
    assert rows["2"].first_seen_at == datetime(2026, 5, 1, 6)
    assert rows["2"].last_seen_at == datetime(2026, 5, 2, 6)
    # nothing new landed: no new version
    assert run()[0] == version
    land(tmp_path / "landing", "20260503T060000", [board(1)])
    version, rows = run()
    assert {k: r.is_active for k, r in rows.items()} == {
        "1": True, "2": False, "3": False, "lev-1": True,
    }
    assert rows["1"].first_seen_at == datetime(2026, 5, 1, 6)


def test_a_late_file_gives_what_ordered_landing_gives(spark, tmp_path):
    first, second, third = "20260501T060000", "20260502T060000", "20260503T060000"

    def state_after(name, landings):
        folder, target, state = tmp_path / name, str(tmp_path / f"{name}-jobs"), str(tmp_path / f"{name}-state")
        for group in landings:
            for number, (run_id, rows) in group:
                land(folder, run_id, rows, number)
            ingest_landed(spark, str(folder), companies(spark), target, state).awaitTermination()
        rows = merge.read_version(spark, target, merge.latest_version(spark, target)).collect()
        return sorted((r.external_id, r.is_active, r.first_seen_at, r.last_seen_at) for r in rows)

    one, two, late, last = (0, (first, [board(1, 2)])), (0, (second, [board(2, 3)])), (9, (first, [board(9)])), (0, (third, [board(3)]))
    ordered = state_after("ordered", [[one, late], [two], [last]])
    assert state_after("late", [[one], [two], [late], [last]]) == ordered
    assert [r[:2] for r in ordered] == [("1", False), ("2", False), ("3", True), ("9", False)]


def test_rows_are_derived_again_only_where_files_landed(spark, tmp_path):
    landing, target, state = (str(tmp_path / n) for n in ("landing", "jobs", "state"))
    first, second = "20260501T060000", "20260502T060000"
    lever = ("lever", "list", "bolt", None, json.dumps([lever_job()]))
    land(tmp_path / "landing", first, [board(1, 2)])
    land(tmp_path / "landing", second, [board(2, 3)])

    def read_by(batch, known=None):
        ingest_landed(spark, landing, known or companies(spark), target, state).awaitTermination()
        rows = spark.read.json(f"{target}/extracts/batch={batch}").collect()
        assert [(r.run_id, r.fetched) for r in read_log(spark, target).orderBy("run_id").collect()][1] == (second, 2)
        return sorted((r.run_id, r.source, r.fetched) for r in rows)

    assert read_by(0) == [(first, "greenhouse", 2), (second, "greenhouse", 2)]
    # the later run is merged again, from the rows that were kept
    land(tmp_path / "landing", first, [lever], 9)
    assert read_by(1) == [(first, "lever", 1)]
    # another company list: what is merged again is read again
    renamed = companies(spark).withColumn("name", F.upper("name"))
    land(tmp_path / "landing", first, [lever], 10)
    assert read_by(2, renamed) == [(first, "greenhouse", 2), (first, "lever", 2), (second, "greenhouse", 2)]
    rows = merge.read_version(spark, target, merge.latest_version(spark, target)).collect()
    assert all(r.company == r.company.upper() for r in rows)
    assert {r.external_id: r.is_active for r in rows} == {"1": False, "2": True, "3": True, "lev-1": True}


def test_versions_are_stored_densely(spark, tmp_path):
    one = spark.range(1).selectExpr("'a' AS id", "'s' AS source", "'1' AS external_id", "'c' AS company_slug")
    jobs = merge.empty_jobs(spark).unionByName(one, allowMissingColumns=True)
    merge.write_version(jobs.fillna({"is_active": True}), str(tmp_path), "v1")
    files = [f.name for f in (tmp_path / "rows").rglob("part-*")]
    assert files and all(name.endswith(".zstd.parquet") for name in files)
    assert merge.read_version(spark, str(tmp_path), "v1").count() == 1
