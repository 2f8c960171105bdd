"""Model inputs, stored enrichment runs, bucketed versions and the run log."""

import json
from datetime import datetime

from helpers import companies, greenhouse_job, lever_job, ts
from pyspark.sql import functions as F
from test_merge import board, land

from tagloom.operators import merge, model_input
from tagloom.operators.metrics import kpi_record
from tagloom.operators.serving import active_view
from tagloom.operators.summaries import refreshed_summary, summary_record
from tagloom.streaming.enrichment import request_enrichment, store_answers
from tagloom.streaming.landing import ingest_landed, read_log

DETAILS = "source string, detail_url string, landed_at timestamp, payload string"
PENDING = "id string, source string, title string, description_html string, source_url string"
URL, PAGE = "https://w.example/c/j/AB12", "https://w.example/c/jobs/view/AB12.md"


def day(n):
    return datetime(2026, 5, n)


def inputs(spark, pending, details, as_of="2026-05-05 00:00:00"):
    rows, pages = spark.createDataFrame(pending, PENDING), spark.createDataFrame(details, DETAILS)
    found = model_input.model_inputs(rows, pages, ts(as_of), "h1", F.col("title").contains("Chef"))
    assert found.columns == ["id", "source", "title", "gated", "detail_at", "message", "prompt_hash"]
    return {r.id: r for r in found.collect()}


def message(title, body):
    return f"Title: {title}\n\nDescription:\n{body}"


def test_newest_page_at_or_before_the_run(spark):
    pending = [("1", "workable", "Dev", "<p>stored</p>", URL), ("2", "workable", "Dev", "x", "https://other")]
    details = [
        ("workable", PAGE, day(1), "# Old"),
        ("workable", PAGE, day(5), "## A **b** *c*\n- d"),
        ("workable", PAGE, day(5), "# A smaller text"),
        ("workable", PAGE, day(6), "# Too late"),
        ("workable", PAGE, None, "# Never"),
        ("lever", PAGE, day(5), "# Z"),
        ("workable", None, day(5), "# Z"),
    ]
    found = inputs(spark, pending, details)
    # of two pages of one time the greater text counts, and '##' sorts behind '# '
    assert found["1"].detail_at == day(5)
    assert found["1"].message == message("Dev", "A b c d")
    # a page source never falls back to the stored text
    assert found["2"].detail_at is None
    assert found["2"].message == message("Dev", "(no description available)")


def test_other_sources_use_the_stored_text(spark):
    pending = [
        ("1", "lever", "Dev", "<p>a</p>  b", URL),
        ("2", "lever", "Dev", None, None),
        ("3", "lever", "Chef", "x", None),
        ("4", "lever", None, "y" * 2001, None),
    ]
    found = inputs(spark, pending, [("lever", PAGE, day(1), "# no")])
    assert found["1"].message == message("Dev", "a b")
    assert found["2"].message == message("Dev", "(no description available)")
    assert (found["3"].gated, found["3"].message) == (True, None)
    assert found["4"].message == message("", "y" * 2000 + "…")
    assert inputs(spark, [], []) == {}


def test_as_of_may_differ_by_row(spark):
    rows = spark.createDataFrame([("1", "k", day(1)), ("2", "k", day(9)), ("3", None, day(9))], "id string, k string, t timestamp")
    details = spark.createDataFrame([("k", day(d), f"v{d}") for d in (1, 2, 8)] + [("k", day(8), "v0")], "k string, at timestamp, v string")
    found = model_input.attach_newest(rows, details, "k", "at", F.col("t"))
    assert {r.id: r.v for r in found.collect()} == {"1": "v1", "2": "v8", "3": None}


def stored(spark, rows):
    """(id, company, active, title) as rows of the versioned table."""
    listed = [(i, "lever", i, c, a, t, day(1)) for i, c, a, t in rows]
    frame = spark.createDataFrame(
        listed, "id string, source string, external_id string, company_slug string, is_active boolean, title string, first_seen_at timestamp"
    )
    return merge.empty_jobs(spark).unionByName(frame, allowMissingColumns=True)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "jobs")
    rows = [(str(i), f"c{i % 20}", True, "t") for i in range(200)]
    merge.write_version(stored(spark, rows), root, "1")
    before = merge.bucket_folders(spark, root, "1")
    part = stored(spark, [(str(i), "c3", False, "new") for i in range(3, 200, 20)])
    touched = merge.touched_buckets(part)
    assert len(touched) == 1
    whole = merge.read_version(spark, root, "1", touched)
    assert {r.company_slug for r in whole.collect()} >= {"c3"} and whole.count() < 200
    changed = whole.where("company_slug <> 'c3'").unionByName(part)
    merge.write_version(changed, root, "2", "1", touched)
    after = merge.bucket_folders(spark, root, "2")
    assert after.keys() == before.keys()
    assert {b for b in after if after[b] != before[b]} == set(touched)
    untouched = merge.read_version(spark, root, "2", [b for b in after if b not in touched])
    assert all("/version=1/" in f for f in untouched.inputFiles())
    titles = {r.id: r.title for r in merge.read_version(spark, root, "2").collect()}
    assert titles == {str(i): "new" if i % 20 == 3 else "t" for i in range(200)}
    # the older version is still whole
    assert merge.read_version(spark, root, "1").where("title = 't'").count() == 200
    assert merge.versions(spark, root) == ["1", "2"]


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "jobs")
    assert merge.latest_version(spark, root) is None
    merge.write_version(stored(spark, [("1", "a", True, "t")]), root, "1")
    # rows without a manifest, as a stopped run leaves them
    stored(spark, [("1", "a", True, "u")]).write.parquet(f"{root}/rows/version=2")
    assert merge.latest_version(spark, root) == "1"
    assert [r.title for r in merge.read_version(spark, root, "1").collect()] == ["t"]


def test_run_log_and_reused_files(spark, tmp_path):
    landing, target, state = (str(tmp_path / n) for n in ("landing", "jobs", "state"))
    first, second = "20260501T060000", "20260502T060000"
    lever = ("lever", "list", "bolt", None, json.dumps([lever_job()]))
    far = {"jobs": [greenhouse_job("Engineer", id=7, location={"name": "Toronto"})]}

    def run():
        ingest_landed(spark, landing, companies(spark), target, state).awaitTermination()
        return [tuple(r) for r in read_log(spark, target).orderBy("run_id").collect()]

    land(tmp_path / "landing", first, [board(1, 2), lever, ("greenhouse", "list", "acme", None, json.dumps(far))])
    land(tmp_path / "landing", second, [board(2, 3)])
    # fetched counts rows outside the region as well
    assert run() == [(first, 0, 4, 3, 0, 2), (second, 0, 2, 2, 1, 1)]
    folders = merge.bucket_folders(spark, target, merge.latest_version(spark, target))
    assert len({f.split("/")[1] for f in folders.values()}) == 2
    # a late file: both rows are replaced, none is added
    land(tmp_path / "landing", first, [board(9)], first=9)
    assert run() == [(first, 1, 5, 4, 0, 2), (second, 1, 2, 2, 2, 1)]


def test_stored_enrichment(spark, tmp_path):
    root = str(tmp_path / "jobs")
    rows = [("1", "a", True, "Dev"), ("2", "b", True, "Chef"), ("3", "c", True, "Ops"), ("4", "a", False, "Dev")]
    merge.write_version(stored(spark, rows), root, "20260501T060000-0000000000")
    details = spark.createDataFrame([], DETAILS)
    asked = request_enrichment(
        spark, root, details, "w1", ts("2026-05-03 00:00:00"), "h1", ["lever"], F.col("title") == "Chef"
    )
    assert {r.id: r.message is None for r in asked.collect()} == {"1": False, "2": True, "3": False}
    answers = spark.createDataFrame([("1", '{"technologies": ["Go", "?Zig"]}'), ("2", "{}")], "id string, answer string")
    for _ in range(2):  # a repeated call changes nothing
        results = store_answers(spark, root, "w1", answers, ts("2026-05-03 00:00:00"))
        assert {r.id: r.status for r in results.collect()} == {"1": "enriched", "2": "skipped", "3": "error"}
        latest = merge.latest_version(spark, root)
        assert latest == "20260501T060000-0000000000+w1"
        found = {r.id: r for r in merge.read_version(spark, root, latest).collect()}
        assert found["1"].enriched_tech_stack == ["Go"] and found["3"].enriched_tech_stack == []
        assert {i: r.enriched_prompt_hash for i, r in found.items()} == {"1": "h1", "2": "h1", "3": "h1", "4": None}
    # nothing is pending any more under this prompt
    again = request_enrichment(spark, root, details, "w2", ts("2026-05-04 00:00:00"), "h1", ["lever"], F.lit(False))
    assert again.count() == 0
    assert store_answers(spark, root, "w2", answers, ts("2026-05-04 00:00:00")).count() == 0
    assert merge.latest_version(spark, root) == latest


def test_summary_equals_figures_from_scratch(spark, tmp_path):
    root, as_of = str(tmp_path / "jobs"), ts("2026-05-02 05:00:00")

    def jobs(version, companies):
        rows = [
            (f"{c}{i}", "lever" if i % 3 else "workday", f"{c}{i}", c, c.upper(), i % 4 != version, True, "t",
             datetime(2026, 5, 1, i % 24), datetime(2026, 5, 1, 6 + version), ["Go", f"v{version}"][: i % 3], [True, False, None][i % 3])
            for c in companies for i in range(12)
        ]
        frame = spark.createDataFrame(
            rows, "id string, source string, external_id string, company_slug string, company string, is_active boolean, is_qc boolean, "
            "title string, first_seen_at timestamp, fetched_at timestamp, tech_stack array<string>, is_remote boolean",
        )
        return merge.empty_jobs(spark).unionByName(frame, allowMissingColumns=True)

    assert refreshed_summary(spark, root).count() == 0
    merge.write_version(jobs(0, "abcdefgh"), root, "1")
    refreshed_summary(spark, root)
    touched = merge.touched_buckets(jobs(1, "ab"))
    others = merge.read_version(spark, root, "1", touched).where("company_slug NOT IN ('a', 'b')")
    merge.write_version(others.unionByName(jobs(1, "ab")), root, "2", "1", touched)
    # a company leaves with its bucket's last rows
    gone = merge.touched_buckets(jobs(0, "h"))
    left = merge.read_version(spark, root, "2", gone).where("company_slug <> 'h'")
    merge.write_version(left, root, "3", "2", gone)
    for _ in range(2):
        counts = refreshed_summary(spark, root)
        view = active_view(merge.read_version(spark, root, "3"))
        assert summary_record(counts, as_of).collect() == kpi_record(view, as_of).collect()
    assert {r.value for r in counts.where("group = 'company'").collect()} == set("ABCDEFG")
