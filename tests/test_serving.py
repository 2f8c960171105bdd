"""View, filters, pages, search, facets, headline figures, saved filters."""

import random
import re
from datetime import datetime, timedelta

import pytest
from helpers import as_rows, ts
from pyspark.sql import functions as F

from tagloom.operators import alerts, metrics, serving, tag_index
from tagloom.plans import presets

NOW = datetime(2026, 5, 10, 12)
SCHEMA = (
    "id string, source string, company string, title string, is_remote boolean, seniority string, "
    "tech_stack array<string>, enriched_tech_stack array<string>, first_seen_at timestamp, "
    "fetched_at timestamp, is_qc boolean, is_active boolean, enriched_prompt_hash string"
)


def job(id, source="lever", remote=None, seniority=None, tags=(), model=(), hours=1.0, **more):
    row = {
        "id": id, "source": source, "company": f"co-{source}", "title": f"Job {id}",
        "is_remote": remote, "seniority": seniority, "tech_stack": list(tags),
        "enriched_tech_stack": list(model), "first_seen_at": NOW - timedelta(hours=hours),
        "fetched_at": NOW - timedelta(hours=hours / 2), "is_qc": True, "is_active": True,
        "enriched_prompt_hash": None,
    }
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(
        [
            job("a", "lever", True, "senior", ["Go", "Python"], ["AWS", "Go"], 1),
            job("b", "lever", False, "junior", ["Go"], [], 23),
            job("c", "workday", None, "senior", ["Python"], [], 25),
            job("d", "workday", None, None, [], ["aws"], 400),
            job("e", "workable", True, "senior", ["Go"], [], 30, is_active=False),
            job("f", "workable", True, "senior", ["Go"], [], 30, is_qc=False),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def view(jobs):
    return serving.active_view(jobs)


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_view(view):
    rows = {r.id: r.tech_stack for r in view.collect()}
    assert rows == {"a": ["AWS", "Go", "Python"], "b": ["Go"], "c": ["Python"], "d": ["aws"]}


@pytest.mark.parametrize(
    "filters, expected",
    [
        ({}, "abcd"),
        ({"tags": ["Go", "Python"]}, "a"),
        ({"tags": ["go"]}, ""),
        ({"source": "workday"}, "cd"),
        ({"source": "", "seniority": "senior"}, "ac"),
        ({"remote": "true"}, "a"),
        ({"remote": "false"}, "b"),
        ({"remote": "null"}, "cd"),
        ({"remote": "anything"}, "abcd"),
        ({"remote": "null", "seniority": "senior"}, "c"),
    ],
)
def test_filters(view, filters, expected):
    conditions = serving.filter_conditions(**filters)
    found = serving.filter_rows(view, conditions)
    assert "".join(ids(found)) == expected
    assert serving.total_count(found).first().total == len(expected)


def test_pages(view):
    def page(number, **more):
        return [r.id for r in serving.page(view, number, 3, **more).collect()]

    assert [page(1), page(2), page(-4), page(1, ascending=True), page(9)] == [
        ["a", "b", "c"], ["d"], ["a", "b", "c"], ["d", "c", "b"], [],
    ]


@pytest.mark.parametrize("ascending", [False, True])
def test_pages_at_every_depth_equal_a_plain_sort(spark, ascending):
    rows = [(f"i{n % 7}" if n % 11 else None, NOW - timedelta(hours=n // 3 * 5)) for n in range(60)]
    rows += [("n1", None), ("n2", None), ("n1", None)]
    table = spark.createDataFrame(rows, "id string, first_seen_at timestamp")
    time = F.col("first_seen_at").asc() if ascending else F.col("first_seen_at").desc()
    plain = [tuple(r) for r in table.orderBy(time, F.col("id").asc()).collect()]
    for number in range(1, 15):
        found = serving.page(table, number, 5, ascending=ascending).collect()
        assert [tuple(r) for r in found] == plain[number * 5 - 5 : number * 5]


def test_search(spark):
    rows = [
        job(f"t{i:02}", title=f"React dev {i}", hours=100 + i) for i in range(7)
    ] + [job(f"g{i:02}", tags=["React"], hours=i) for i in range(8)]
    rows += [job("both", title="REACT lead", tags=["React"], hours=50), job("pct", title="100% sure")]
    view = serving.active_view(spark.createDataFrame(rows, SCHEMA))

    def found(query):
        return [r.id for r in serving.search(view, query).orderBy("position").collect()]

    assert found(" react ") == ["both"] + [f"t{i:02}" for i in range(7)] + ["g00", "g01"]
    assert found("r") == [] and found("  ") == []
    assert found("0%") == ["pct"] and found("_ev") == []
    assert found("co-lever")[0] == "pct" or len(found("co-lever")) == 10


def test_kpi_record_agrees_with_the_single_figures(spark, view):
    at = ts("2026-05-10 12:00:00")
    row, plain = metrics.kpi_record(view, at).first(), metrics.kpis(view, at).first()
    for name in plain.asDict():
        assert row[name] == plain[name]
    facets = metrics.facet_counts(view, metrics.standard_facets()).collect()
    for name in metrics.standard_facets():
        assert row[f"{name}_counts"] == {r.value: r["count"] for r in facets if r.facet == name}
    assert row.source_options == sorted(r.source for r in metrics.source_options(view).collect())
    assert row.tech_options == sorted(r.tag for r in metrics.tag_options(view).collect())
    empty = metrics.kpi_record(view.limit(0), at).first()
    assert (empty.active_roles, empty.company_count, empty.tech_options, empty.source_counts) == (0, 0, [], {})
    assert empty.updated_text is None and empty.stale is False


def test_relative_time(spark):
    later = ts("2026-05-10 12:00:00")
    wanted = {
        "2026-05-10 11:59:30": "this minute",
        "2026-05-10 11:59:00": "1 minute ago",
        "2026-05-10 11:00:01": "59 minutes ago",
        "2026-05-10 11:00:00": "1 hour ago",
        "2026-05-09 12:00:01": "23 hours ago",
        "2026-05-09 12:00:00": "yesterday",
        "2026-05-08 11:00:00": "2 days ago",
        "2026-05-10 12:01:30": "in 2 minutes",
    }
    texts = spark.range(1).select(*[metrics.relative_time(ts(t), later) for t in wanted]).first()
    assert list(texts) == list(wanted.values())


def test_kpis(spark, view):
    row = metrics.kpis(view, ts("2026-05-10 12:00:00")).first()
    assert (row.active_roles, row.new_today, row.company_count) == (4, 2, 2)
    assert float(row.remote_percent) == 75.0
    assert row.last_updated == NOW - timedelta(minutes=30) and row.stale is False
    late = metrics.kpis(view, ts("2026-05-11 23:30:00")).first()
    assert late.stale is True
    empty = metrics.kpis(view.limit(0), ts("2026-05-10 12:00:00")).first()
    assert (empty.active_roles, float(empty.remote_percent), empty.last_updated) == (0, 0.0, None)
    assert empty.stale is False


def test_rounding_of_percent(spark):
    rows = [job(str(i), remote=i > 0) for i in range(8)]  # 7 of 8 -> 87.5
    view = serving.active_view(spark.createDataFrame(rows, SCHEMA))
    assert float(metrics.kpis(view, ts("2026-05-10")).first().remote_percent) == 87.5


def facets(view, **filters):
    conditions = serving.filter_conditions(**filters)
    got = metrics.contextual_facets(view, metrics.standard_facets(), conditions)
    return {(r.facet, r.value): r["count"] for r in got.collect()}


def test_facets_leave_out_their_own_filter(view):
    assert facets(view) == {
        ("source", "lever"): 2, ("source", "workday"): 2, ("seniority", "senior"): 2,
        ("seniority", "junior"): 1, ("workplace", "true"): 1, ("workplace", "false"): 1,
        ("workplace", "null"): 2,
    }
    assert facets(view, source="lever", seniority="senior") == {
        ("source", "lever"): 1, ("source", "workday"): 1,
        ("seniority", "senior"): 1, ("seniority", "junior"): 1,
        ("workplace", "true"): 1,
    }
    assert facets(view, tags=["nothing"]) == {}


def test_facet_sums_equal_the_filtered_total(view):
    conditions = serving.filter_conditions(tags=["Go"], remote="true")
    total = serving.total_count(serving.filter_rows(view, conditions)).first().total
    counts = facets(view, tags=["Go"], remote="true")
    assert sum(n for (facet, _), n in counts.items() if facet == "source") == total


def test_zero_fill(view):
    got = metrics.zero_filled_facets(
        view,
        metrics.standard_facets(),
        serving.filter_conditions(source="lever", remote="true"),
        {"workplace": ["true", "false", "null"]},
    )
    assert {(r.facet, r.value): r["count"] for r in got.collect()} == {
        ("source", "lever"): 1, ("source", "workday"): 0, ("workplace", "true"): 1,
        ("workplace", "false"): 1, ("workplace", "null"): 0, ("seniority", "senior"): 1,
    }


def test_options(spark, view):
    tags = sorted(r.tag for r in metrics.tag_options(view).collect())
    assert tags == ["AWS", "Go", "Python", "aws"]
    assert sorted(r.source for r in metrics.source_options(view).collect()) == ["lever", "workday"]
    categories = spark.createDataFrame(list(presets.category_of().items()), "tag string, category string")
    grouped = metrics.tags_by_category(metrics.tag_options(view), categories, "A")
    assert as_rows(grouped) == [("cloud", "AWS"), ("other", "aws")]


QUERIES = {
    "tag": "tech=go,%20Rust&sort=asc",
    "tag+source": "tech=AWS&source=lever",
    "senior": "seniority=senior",
    "hybrid": "remote=maybe",
    "remote": "?remote=true&remote=false",
    "other": "sort=asc",
    "blank": "",
    "no names": "tech=%2C+%2C",
    "empty tag": "tech=&source=workday",
}


@pytest.fixture(scope="module")
def filters(spark):
    rows = [(name, query, name != "senior") for name, query in QUERIES.items()]
    frame = spark.createDataFrame(rows, "filter_id string, query string, enabled boolean")
    return alerts.parse_filters(frame, presets.SENIORITY_LABELS, presets.WORKPLACE_LABELS)


def test_parsed_filters(filters):
    rows = {r.filter_id: r for r in filters.collect()}
    assert rows["tag"].tags == ["go", "rust"]
    assert rows["tag"].filter_name == "go/Rust"
    assert rows["tag"].filter_summary == "tech: go, Rust"
    assert rows["tag+source"].filter_summary == "tech: AWS · source: lever"
    assert (rows["senior"].filter_name, rows["senior"].filter_summary) == ("Senior", "seniority: Senior")
    assert rows["remote"].workplace == "true" and rows["remote"].filter_name == "Remote"
    assert rows["hybrid"].filter_name == "All roles"
    assert rows["no names"].tags == []
    assert rows["empty tag"].tags is None


def test_matches(view, filters):
    got = {}
    for r in alerts.match_filters(view, filters).collect():
        got.setdefault(r.filter_id, []).append(r.id)
    assert {k: "".join(sorted(v)) for k, v in got.items()} == {
        "tag": "ab", "tag+source": "a", "senior": "ac", "hybrid": "cd", "remote": "a",
        "other": "abcd", "empty tag": "cd",
    }


def test_match_flags(view, filters):
    only = filters.where("filter_id IN ('tag', 'senior')")
    flags = {r.id: r.matches_filter for r in alerts.flag_matches(view, only).collect()}
    # the disabled filter would have matched c
    assert flags == {"a": True, "b": True, "c": False, "d": False}


def test_pending_and_sample(spark):
    rows = [
        job("1", "lever", hours=5, enriched_prompt_hash="new"),
        job("2", "lever", hours=4, enriched_prompt_hash="old"),
        job("3", "workday", hours=9),
        job("4", "workable", hours=8, is_qc=False),
        job("5", "greenhouse", hours=7, is_active=False),
        job("6", "greenhouse", hours=1),
    ]
    jobs = spark.createDataFrame(rows, SCHEMA)
    pending = serving.pending_enrichment(jobs, "new", presets.ENRICHED_SOURCES, limit=2)
    assert [r.id for r in pending.collect()] == ["4", "2"]
    assert ids(serving.sample_rows(jobs, 2)) == ["1", "2"]
    assert ids(serving.sample_rows(jobs, 5, "greenhouse")) == ["6"]


@pytest.mark.parametrize("share", [7, 1 << 20])
def test_random_matches_equal_all_pairs(spark, share):
    """Without broadcasts, with hot keys that are spread and a filter that matches all rows."""
    rng = random.Random(9)
    tags, levels, sources = ["Go", "go", "Rust", "C++", "SQL"], ["junior", "senior", None], ["lever", "workday", None]
    rows = [
        (str(i), rng.sample(tags, rng.randint(0, 3)), rng.choice(levels), rng.choice(sources), rng.choice([True, False, None]))
        for i in range(120)
    ]
    schema = "id string, tech_stack array<string>, seniority string, source string, is_remote boolean"
    frame = spark.createDataFrame(rows, schema).repartition(3)

    def query():
        parts = [
            f"tech={','.join(rng.sample(['go', 'RUST', 'sql', 'none'], rng.randint(0, 2)))}",
            f"seniority={rng.choice(['senior', 'junior', ''])}",
            f"source={rng.choice(['lever', 'other', ''])}",
            f"remote={rng.choice(['true', 'false', 'hybrid', ''])}",
        ]
        return "&".join(rng.sample(parts, rng.randint(1, 4)))

    listed = [(f"f{i}", query(), rng.random() < 0.5) for i in range(40)] + [("none", "", True), ("all", "x=1", False)]
    parsed = alerts.parse_filters(
        spark.createDataFrame(listed, "filter_id string, query string, enabled boolean"),
        presets.SENIORITY_LABELS, presets.WORKPLACE_LABELS,
    )
    place = {True: "true", False: "false", None: "null"}
    wanted = set()
    for f in parsed.collect():
        for i, tech, level, source, remote in rows:
            known = {t.lower() for t in tech}
            ok = f.query and (f.tags is None or known & set(f.tags)) and f.seniority in (None, level)
            ok = ok and f.source in (None, source)
            where = f.workplace if f.workplace in ("true", "false") else "null"
            if ok and (f.workplace is None or where == place[remote]):
                wanted.add((i, f.filter_id))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [tuple(r) for r in alerts.match_filters(frame, parsed, share=share).collect()]
        flags = {r.id: r.matches_filter for r in alerts.flag_matches(frame, parsed, share=share).collect()}
        entries = alerts._rarest(frame, alerts._candidates(parsed, "query"))
        # each filter is entered by one field, and keys that no filter is entered by list no rows
        assert entries.groupBy("filter_id").agg(F.count_distinct("field").alias("n")).where("n > 1").count() == 0
        used = {r.key for r in entries.select("key").distinct().collect()}
        listed = alerts._row_keys(frame, entries).select(F.explode("keys").alias("key")).distinct().collect()
        assert {r.key for r in listed if not r.key.startswith("t:")} <= used
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == len(set(found)) and set(found) == wanted
    enabled = {f for f, _, on in [(f.filter_id, f.query, f.enabled) for f in parsed.collect()] if on}
    assert flags == {i: any((i, f) in wanted for f in enabled) for i, *_ in rows}


def test_an_empty_filter_flags_every_row(spark, view):
    frame = spark.createDataFrame([("all", "x=1", True)], "filter_id string, query string, enabled boolean")
    parsed = alerts.parse_filters(frame, presets.SENIORITY_LABELS, presets.WORKPLACE_LABELS)
    flagged = alerts.flag_matches(view, parsed)
    assert all(r.matches_filter for r in flagged.collect())
    none = alerts.flag_matches(view, parsed.limit(0))
    assert not any(r.matches_filter for r in none.collect())
    assert alerts.match_filters(view, parsed.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["text", "number"])
@pytest.mark.parametrize("bound", [1, 9, 10_000])
def test_pages_of_one_day_and_one_time_equal_a_sort(spark, ids, bound):
    """Bulk loads: many rows of one day, of one time, and without a time; ids that share a beginning."""
    rng = random.Random(12)
    at = datetime(2026, 5, 1, 6)
    times = [*[at] * 40, *[None] * 40, *[at + timedelta(microseconds=rng.randrange(50)) for _ in range(40)], *[at + timedelta(days=d) for d in range(5)]]
    rows = [(f"same-beginning-{i:03d}" if ids == "text" else i * 7 - 300, t) for i, t in enumerate(times)]
    rows.append((rows[3][0], at))
    table = spark.createDataFrame(rows, f"id {'string' if ids == 'text' else 'long'}, first_seen_at timestamp").repartition(4)
    for ascending in (True, False):
        sign = 1 if ascending else -1
        missing = -1 if ascending else 1
        ordered = sorted(rows, key=lambda r: ((missing, 0) if r[1] is None else (0, sign * (r[1] - at).total_seconds()), r[0]))
        for number in (1, 4, 11, 40):
            got = [tuple(r) for r in serving.page(table, number, 8, ascending=ascending, bound=bound).collect()]
            assert got == ordered[(number - 1) * 8 : number * 8], (ascending, number)


def test_tag_index_equals_the_filter(spark, tmp_path):
    rng = random.Random(15)
    names = ["C++", "C#", "a/b", "2024", "é", "Go"]
    rows = [(str(i), rng.choice([None, [], rng.sample(names, 2), rng.sample(names, 5), ["Go", "Go", None]])) for i in range(300)]
    table = spark.createDataFrame(rows, "id string, tech_stack array<string>").repartition(3)
    root = str(tmp_path / "index")
    tag_index.write_tag_index(table, root)
    for tags in (["C++"], ["C#", "Go"], ["a/b", "2024", "é"], ["Go", "Go"], ["go"], ["C++", "none"], []):
        want = sorted(i for i, have in rows if set(tags) <= set(have or []))
        found = tag_index.rows_with_all_tags(spark, root, tags)
        assert found.columns == table.columns
        assert sorted(r.id for r in found.collect()) == want
        if tags:
            assert tag_index.count_with_all_tags(spark, root, tags).first().total == len(want)
    plan = tag_index._common(spark, root, ["C++"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*tag#\d+ = C", plan)


def test_tag_index_of_nothing(spark, tmp_path):
    table = spark.createDataFrame([], "id string, tech_stack array<string>")
    tag_index.write_tag_index(table, str(tmp_path / "index"))
    assert tag_index.rows_with_all_tags(spark, str(tmp_path / "index"), ["Go"]).count() == 0
    assert tag_index.count_with_all_tags(spark, str(tmp_path / "index"), ["Go"]).first().total == 0


def test_saved_filters_compute_the_rows_once(spark, view, tmp_path):
    """The rows, which may come from large joins, are not computed again for the matches."""
    frame = spark.createDataFrame([("a", "tech=go", True)], "filter_id string, query string, enabled boolean")
    parsed = alerts.parse_filters(frame, presets.SENIORITY_LABELS, presets.WORKPLACE_LABELS)
    view.write.parquet(str(tmp_path / "given-rows"))
    rows = spark.read.parquet(str(tmp_path / "given-rows"))
    found = alerts.match_filters(rows, parsed)
    assert not any("given-rows" in file for file in found.inputFiles())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, alerts.match_filters(view, parsed).collect()))
