"""Landed documents of the four sources to canonical rows."""

from datetime import datetime

import pytest
from helpers import (
    BOARD_API,
    companies,
    greenhouse_job,
    lever_job,
    payloads,
    table_document,
    table_row,
    workday_job,
)
from pyspark.sql import functions as F

from tagloom.plans import postings
from tagloom.plans.postings import WORKABLE_COLUMNS, read_postings
from tagloom.sources import landed


def read(spark, *rows):
    return [r.asDict() for r in read_postings(payloads(spark, rows), companies(spark)).collect()]


def greenhouse(spark, *jobs):
    return read(spark, ("greenhouse", "list", "acme", None, {"jobs": list(jobs)}))


def lever(spark, *jobs):
    return read(spark, ("lever", "list", "bolt", None, list(jobs)))


def test_greenhouse_row(spark):
    [row] = greenhouse(spark, greenhouse_job("Senior Engineer (Part-time)", "<p>Python</p>"))
    assert row["external_id"] == "999"
    assert (row["company"], row["company_slug"]) == ("Acme", "acme")
    assert row["department"] == "R&D"
    assert row["posted_at"] == datetime(2026, 4, 28, 16)
    assert (row["is_qc"], row["is_remote"], row["is_active"]) == (True, None, True)
    assert (row["seniority"], row["employment_type"]) == ("senior", "part-time")
    assert row["tech_stack"] == ["Python"]


def test_workplace_rules_by_source(spark):
    places = ["Remote", "Hybrid - Remote", "Montréal (On-site)", "Bureau de Québec", "Laval"]
    jobs = [greenhouse_job(id=i + 1, location={"name": p}) for i, p in enumerate(places)]
    rows = {r["location"]: r["is_remote"] for r in greenhouse(spark, *jobs)}
    assert rows == dict(zip(places, [True, None, False, False, None], strict=True))
    # a structured mode comes before the text of the location
    jobs = [
        lever_job(id=str(i), workplaceType=mode, categories={"location": "Remote"})
        for i, mode in enumerate(["remote", "hybrid", "on-site", None])
    ]
    modes = {r["external_id"]: r["is_remote"] for r in lever(spark, *jobs)}
    assert modes == {"0": True, "1": None, "2": False, "3": True}


def test_missing_required_and_gated_rows_are_dropped(spark):
    rows = greenhouse(
        spark,
        greenhouse_job(id=0),
        greenhouse_job(id=1, title=""),
        greenhouse_job(id=2, absolute_url=None),
        greenhouse_job("Paralegal", id=3),
        greenhouse_job(id=4, content="", departments=[], location=None),
    )
    assert [r["external_id"] for r in rows] == ["4"]
    assert rows[0]["description_html"] is None and rows[0]["department"] is None
    assert rows[0]["is_qc"] is False


def test_gate_off_keeps_the_row_without_tags(spark):
    items = payloads(
        spark, [("greenhouse", "list", "acme", None, {"jobs": [greenhouse_job("Paralegal", "Python")]})]
    ).withColumn("company", F.lit("Acme"))
    rows = postings.extract(landed.json_items(items, "jobs"), postings.GREENHOUSE, gate=False)
    assert [r.tech_stack for r in rows.collect()] == [[]]


def test_lever_sections_count(spark):
    sections = [{"content": "<li>Strong Python</li>"}, {"content": ""}, {"text": "x"}]
    [row] = lever(spark, lever_job(description="<div>Join</div>", lists=sections))
    assert row["description_html"] == "<div>Join</div> <li>Strong Python</li>"
    assert row["tech_stack"] == ["Python"]
    assert row["employment_type"] == "full-time"
    assert row["posted_at"] == datetime(2023, 11, 14, 22, 13, 20)
    [bare] = lever(spark, lever_job())
    assert bare["description_html"] is None


def test_table_rows_and_details(spark):
    url = "https://apply.workable.com/cask/jobs/view/AB12.md"
    document = table_document(
        table_row("Senior React Developer"),
        table_row("Stage", place="Toronto (Remote)", kind="—", code="cd34"),
        "| too | short |",
        table_row("No details", code="EE99"),
        "| x | - | a | b | c | d | e |",
    )
    rows = read(
        spark,
        ("workable", "list", "cask", None, document),
        ("workable", "detail", "cask", url, "# Dev\n\nWe use AWS and Kubernetes."),
        ("workable", "detail", "cask", "/relative.md", "ignored"),
    )
    by_id = {r["external_id"]: r for r in rows}
    assert set(by_id) == {"AB12", "cd34", "EE99"}
    full = by_id["AB12"]
    assert full["source_url"] == "https://apply.workable.com/cask/j/AB12"
    assert full["tech_stack"] == ["React", "AWS", "Kubernetes"]
    assert (full["is_remote"], full["employment_type"]) == (None, "full-time")
    assert full["posted_at"] == datetime(2026, 5, 1)
    # a lower-case code keeps its detail url
    assert by_id["cd34"]["source_url"].endswith("/jobs/view/cd34.md")
    assert (by_id["cd34"]["is_remote"], by_id["cd34"]["seniority"]) == (True, "internship")
    assert by_id["EE99"]["description_html"] is None


def test_header_like_columns_is_dropped(spark):
    document = "\n".join(
        ["| title | department | location | _employment_raw | _salary | _posted_raw | _detail_url |",
         table_row("Dev")]
    )
    frame = payloads(spark, [("workable", "list", "cask", None, document)])
    rows = landed.markdown_rows(frame, WORKABLE_COLUMNS, "_detail_url").collect()
    assert [r.title for r in rows] == ["Dev"]


def test_board_rows(spark):
    detail = BOARD_API.removesuffix("/jobs") + "/job/Montreal/Engineer_JR-1"
    info = {"jobPostingInfo": {"jobDescription": "<p>Docker</p>", "startDate": "04/28/2026"}}
    rows = read(
        spark,
        (
            "workday", "list", "dune", None,
            {
                "jobPostings": [
                    workday_job(),
                    workday_job("Senior Python Developer", externalPath="/job/X/Dev_JR-2/", jobReqId=""),
                    workday_job("No path", externalPath="", jobReqId="JR-3"),
                    workday_job("", jobReqId="JR-4"),
                ]
            },
        ),
        ("workday", "detail", "dune", detail, info),
        ("workday", "list", "nourl", None, {"jobPostings": [workday_job(jobReqId="JR-9")]}),
    )
    by_id = {r["external_id"]: r for r in rows}
    assert set(by_id) == {"JR-1", "Dev_JR-2", "JR-3"}
    assert by_id["JR-1"]["tech_stack"] == ["Docker"]
    assert by_id["JR-1"]["posted_at"] == datetime(2026, 4, 28)
    assert by_id["JR-1"]["source_url"] == "https://fix.example.com/Careers/job/Montreal/Engineer_JR-1"
    second = by_id["Dev_JR-2"]
    assert second["source_url"] == "https://fix.example.com/Careers/job/X/Dev_JR-2/"
    assert second["description_html"] is None and second["tech_stack"] == ["Python"]
    assert by_id["JR-3"]["source_url"] is None


@pytest.mark.parametrize("document", ["not json", '{"other": []}', "[]", ""])
def test_broken_documents_add_no_rows(spark, document):
    rows = read(
        spark,
        ("greenhouse", "list", "acme", None, document),
        ("lever", "list", "bolt", None, [lever_job()]),
    )
    assert [r["source"] for r in rows] == ["lever"]


def test_region_filter(spark):
    frame = read_postings(
        payloads(
            spark,
            [("greenhouse", "list", "acme", None, {"jobs": [
                greenhouse_job(id=1), greenhouse_job(id=2, location={"name": "Toronto"}),
                greenhouse_job(id=3, location={"name": "SAINT-JEAN-SUR-RICHELIEU"}),
            ]})],
        ),
        companies(spark),
    )
    kept = {r.external_id for r in postings.in_region(frame).collect()}
    assert kept == {"1", "3"}


def test_details_with_null_and_repeated_keys(spark):
    rows = spark.createDataFrame(
        [("c", 0, None), ("c", 1, "u"), ("c", 2, "u"), ("c", 3, "v")],
        "company_slug string, pos int, url string",
    )
    details = spark.createDataFrame([("u", "b"), ("u", "a"), (None, "z")], "url string, d string")
    got = landed.attach_details(rows, details, "url").orderBy("pos").collect()
    assert [r.d for r in got] == [None, "b", "b", None]


def test_documents_from_files(spark, tmp_path):
    folder = tmp_path / "source=lever" / "company=bolt"
    folder.mkdir(parents=True)
    (folder / "list.json").write_text('[{"id": "a",\n "text": "b"}]')
    frame = landed.read_documents(spark, str(tmp_path))
    [row] = frame.collect()
    assert (row.source, row.company_slug, row.kind) == ("lever", "bolt", "list")
    assert landed.json_items(frame, None).count() == 1


def test_table_rows_of_one_split_are_read_by_many_tasks(spark):
    from __spark_entry__ import queries

    rows = queries()["markdown_table_rows"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # the parts are dealt out before their documents are cut into lines
    assert "Generate" in plan.split("hashpartitioning(p_partkey", 1)[0]
    assert "Exchange hashpartitioning(p_partkey" in plan
