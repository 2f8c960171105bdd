"""Small builders for literal rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tagloom.sources.landed import PAYLOAD_SCHEMA

COMPANY_SCHEMA = "source string, slug string, name string, api_url string, base_url string"
BOARD_API = "https://fix.example.com/wday/cxs/fix/Careers/jobs"
BOARD_BASE = "https://fix.example.com"


def companies(spark):
    return spark.createDataFrame(
        [
            ("greenhouse", "acme", "Acme", None, None),
            ("lever", "bolt", "Bolt", None, None),
            ("workable", "cask", "Cask", None, None),
            ("workday", "dune", "Dune", BOARD_API, BOARD_BASE),
            ("workday", "nourl", "No Url", None, BOARD_BASE),
        ],
        COMPANY_SCHEMA,
    )


def payloads(spark, rows):
    """Rows of (source, kind, slug, detail_url, document); documents may be objects."""
    text = [
        (s, k, c, u, d if isinstance(d, str) or d is None else json.dumps(d))
        for s, k, c, u, d in rows
    ]
    return spark.createDataFrame(text, PAYLOAD_SCHEMA)


def greenhouse_job(title="Engineer", content="", **more):
    return {
        "id": 999,
        "title": title,
        "absolute_url": "https://g.example/jobs/999",
        "content": content,
        "location": {"name": "Montréal, QC"},
        "departments": [{"id": 1, "name": "R&D", "parent_id": None}],
        "updated_at": "2026-04-28T12:00:00-04:00",
    } | more


def lever_job(title="Engineer", description="", lists=(), **more):
    return {
        "id": "lev-1",
        "text": title,
        "hostedUrl": "https://l.example/lev-1",
        "description": description,
        "lists": list(lists),
        "categories": {"location": "Montreal, QC", "commitment": "Full-Time", "department": "Eng"},
        "workplaceType": "hybrid",
        "createdAt": 1700000000000,
    } | more


def workday_job(title="Engineer", **more):
    return {
        "title": title,
        "externalPath": "/Careers/job/Montreal/Engineer_JR-1",
        "locationsText": "Montréal, Quebec, Canada",
        "jobReqId": "JR-1",
    } | more


def table_document(*rows):
    head = [
        "# Roles",
        "| Title | Department | Location | Type | Salary | Posted | Details |",
        "|---|---|---|---|---|---|---|",
    ]
    return "\n".join([*head, *rows])


def table_row(title="Engineer", place="Montreal, Canada (Hybrid)", kind="Full-time", code="AB12"):
    link = f"[View](https://apply.workable.com/cask/jobs/view/{code}.md)"
    return f"| {title} | R&D | {place} | {kind} | — | 2026-05-01 | {link} |"


def values(spark, column, rows, schema, *names):
    """Evaluate a column over literal rows and return the results in order."""
    data = [(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(data, f"__i int, {schema}")
    return [r.v for r in frame.orderBy("__i").select(column.alias("v")).collect()]


def as_rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order or frame.columns).collect()]


def ts(text):
    return F.lit(text).cast("timestamp")
