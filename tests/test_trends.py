"""Frequency, pairs, partners, radar, board, ranks, enrichment."""

import hashlib
import itertools
import math
import random
from collections import Counter
from datetime import datetime

import pytest
from helpers import as_rows, ts, values
from pyspark.sql import functions as F

from tagloom.operators import board, enrich, trends
from tagloom.operators.keys import one_per_key, salted_join
from tagloom.operators.ranking import count_ranks, number_rows, top_per_group
from tagloom.plans import presets

BASKETS = [["a", "b", "c"], ["a", "b"], ["a"], ["c", "a"], [], ["d", "b"], ["z"]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(BASKETS)], "id int, tech_stack array<string>")


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame(
        [("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")], "tag string, category string"
    )


def test_frequency(rows, categories):
    got = as_rows(trends.tag_frequency(rows, categories), "rank")
    assert got == [
        ("a", 4, 1, 5, "x"), ("b", 3, 2, 5, "x"), ("c", 2, 3, 5, "y"), ("d", 1, 4, 5, "x"),
        ("z", 1, 5, 5, "other"),
    ]


def test_numbered_rows_on_many_partitions(spark):
    frame = spark.range(0, 5000, 1, 16).select(
        F.col("id"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("k")
    )
    got = number_rows(frame, [F.col("k").desc(), F.col("id").asc()], "n", "total").orderBy("n")
    expected = sorted(((r.k, r.id) for r in frame.collect()), key=lambda p: (-p[0], p[1]))
    assert [(r.n, r.total, r.k, r.id) for r in got.collect()] == [
        (i + 1, 5000, k, row_id) for i, (k, row_id) in enumerate(expected)
    ]
    assert number_rows(frame.limit(0), [F.col("id").asc()]).count() == 0


def test_pairs_are_symmetric_and_complete(rows):
    got = {(r.a, r.b): r["count"] for r in trends.tag_pairs(rows).collect()}
    expected = Counter()
    for tags in BASKETS:
        for x, y in itertools.permutations(tags, 2):
            expected[x, y] += 1
    assert got == dict(expected)
    assert all(got[b, a] == n for (a, b), n in got.items())


def test_a_repeated_tag_pairs_with_itself(spark):
    frame = spark.createDataFrame([(["a", "a", "b"],)], "tech_stack array<string>")
    got = {(r.a, r.b): r["count"] for r in trends.tag_pairs(frame).collect()}
    assert got == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 2}


def test_partners(rows):
    got = as_rows(trends.top_partners(rows, k=2), "tag", "position")
    assert got == [
        ("a", 1, "b", 2, 50), ("a", 2, "c", 2, 50),
        ("b", 1, "a", 2, 67), ("b", 2, "c", 1, 33),
        ("c", 1, "a", 2, 100), ("c", 2, "b", 1, 50),
        ("d", 1, "b", 1, 100),
    ]


def test_percent_halves_go_up(spark):
    frame = spark.createDataFrame([(1, 200), (1, 8), (3, 8)], "a bigint, b bigint")
    got = [r[0] for r in frame.select(trends.rounded_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [1, 13, 38]


def test_top_per_category_and_layout(rows, categories):
    frequency = trends.tag_frequency(rows, categories)
    top = as_rows(trends.top_per_category(frequency, k=2).select("category", "position", "tag", "leader"))
    assert top == [
        ("other", 1, "z", True), ("x", 1, "a", True), ("x", 2, "b", False), ("y", 1, "c", True),
    ]
    placed = {r.tag: r for r in trends.radar_layout(frequency, ["y", "x"]).collect()}
    assert set(placed) == {"a", "b", "c", "d"}
    # tag b: second of three in the second of two sectors
    angle = -math.pi / 2 + math.pi + math.pi * 2 / 4
    r = 200 * (0.16 + 0.76 * min(1, 2 / 5 * 1.8))
    assert placed["b"].x == pytest.approx(280 + math.cos(angle) * r)
    assert placed["b"].y == pytest.approx(240 + math.sin(angle) * r)
    assert placed["b"].size == 6.0 and placed["b"].label_side == "left"


def test_rail(rows, categories):
    rail = trends.leaders_rail(trends.tag_frequency(rows, categories), trends.top_partners(rows), k=2)
    assert as_rows(rail.select("part", "position", "tag")) == [
        ("partner", 1, "b"), ("partner", 2, "c"), ("top", 1, "a"), ("top", 2, "b"),
    ]


def test_category_argument():
    known, defaults = list(presets.category_of().values()), presets.DEFAULT_CATEGORIES
    assert trends.pick_categories(None, known, defaults) == defaults
    assert trends.pick_categories("Cloud, nope,cloud,frontend", known, defaults) == [
        "cloud", "frontend", "languages", "devops",
    ]


def test_window(spark):
    days = ["2026-05-03 00:00:00", "2026-05-02 23:59:59", "2026-04-10 00:00:00", "2026-01-01 00:00:00"]
    frame = spark.createDataFrame([(d,) for d in days], "d string").select(
        F.col("d").cast("timestamp").alias("first_seen_at")
    )

    def count(window):
        return trends.in_window(frame, window, ts("2026-05-10 15:00:00")).count()

    assert [count(w) for w in ("7d", "30d", "90d", "all", "junk")] == [1, 3, 3, 4, 3]


def test_segment_filter(spark):
    frame = spark.createDataFrame([(["Java", "Kafka"],), (["x"],)], "tech_stack array<string>")
    assert trends.in_segment(frame, presets.SEGMENTS, "fintech").count() == 1
    assert trends.in_segment(frame, presets.SEGMENTS, None).count() == 2
    assert trends.in_segment(frame, presets.SEGMENTS, "unknown").count() == 2


def test_top_per_group_uses_a_group_limit(spark):
    frame = spark.range(1000).select(F.when(F.col("id") > 1, "hot").alias("g"), "id")
    top = top_per_group(frame, ["g"], [F.col("id").asc()], 3, "n")
    assert sorted(r.id for r in top.collect()) == [0, 1, 2, 3, 4]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_one_per_key(spark):
    frame = spark.createDataFrame(
        [("k", 1, "b"), ("k", 2, "a"), ("k", 2, "c"), ("l", 0, "x")], "k string, v int, t string"
    )
    assert as_rows(one_per_key(frame, ["k"], ["v"])) == [("k", 2, "c"), ("l", 0, "x")]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_salted_join_is_a_plain_join(spark, broadcast):
    pick = random.Random(3)
    large = spark.createDataFrame(
        [(i, pick.choice(["hot"] * 8 + ["b", "c", None])) for i in range(300)], "id int, k string"
    )
    lookup = spark.createDataFrame([("hot", 1), ("b", 2), ("q", 3)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for how in ("left", "inner", "left_semi", "left_anti"):
            got = salted_join(large, lookup, ["k"], ["id"], how)
            want = large.join(lookup, "k", how).select(got.columns)
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ACTIONS = [
    ("u", 1, "save", None, 1), ("u", 1, "move", "applied", 2),
    ("u", 2, "save", None, 1), ("u", 2, "remove", None, 3), ("u", 2, "move", "archived", 4),
    ("u", 3, "move", "applied", 1), ("u", 3, "save", None, 2),
    ("u", 4, "save", None, 1), ("u", 4, "remove", None, 2), ("u", 4, "save", None, 3),
    ("v", 1, "move", "applied", 9), ("v", 5, "save", None, 2), ("v", 5, "move", "applied", 4),
    ("v", 5, "move", "interviewing", 4),
]


def replay(actions):
    state = {}
    for seq, (user, row, action, column, t) in enumerate(actions):
        key = (user, row)
        if action == "save":
            state[key] = ["watching", t]
        elif action == "remove":
            state.pop(key, None)
        elif key in state:
            state[key][0] = column
        del seq
    return {k: tuple(v) for k, v in state.items()}


def action_log(spark, actions):
    data = [(u, j, a, c, datetime(2026, 5, t), i) for i, (u, j, a, c, t) in enumerate(actions)]
    return spark.createDataFrame(
        data, "user_id string, job_id int, action string, column string, ts timestamp, seq int"
    )


def test_board(spark):
    state = board.board_state(action_log(spark, ACTIONS))
    got = {(r.user_id, r.job_id): (r["column"], r.saved_at.day) for r in state.collect()}
    assert got == replay(ACTIONS)
    counts = {r["column"]: r["count"] for r in board.board_counts(state, presets.BOARD_COLUMNS).collect()}
    assert counts == {"watching": 2, "applied": 1, "interviewing": 1, "archived": 0}
    filters = spark.createDataFrame([(True,), (False,), (True,)], "enabled boolean")
    assert tuple(board.board_summary(state, filters).first()) == (4, datetime(2026, 5, 3), 2)
    listed = [(r.user_id, r.job_id) for r in board.board_list(state, ["user_id", "job_id"]).collect()]
    assert listed == [("u", 4), ("u", 3), ("v", 5), ("u", 1)]


def test_board_against_replay_of_random_logs(spark):
    pick = random.Random(11)
    kinds = ["save", "move", "remove"]
    log = [
        (pick.choice("uv"), pick.randint(1, 6), pick.choice(kinds), pick.choice(presets.BOARD_COLUMNS), t // 12 + 1)
        for t in range(300)
    ]
    state = board.board_state(action_log(spark, log))
    got = {(r.user_id, r.job_id): (r["column"], r.saved_at.day) for r in state.collect()}
    assert got == replay(log)


ANSWERS = [
    ('{"technologies": ["Python", "Django", "?Temporal", "? Elixir"]}', ["Python", "Django"], ["Temporal", "Elixir"]),
    ('```json\n{"technologies": ["Go", " gRPC\\n"]}\n```', ["Go", "gRPC"], []),
    ('{"technologies": []}', [], []),
    ('  { "technologies" :  [ "TypeScript" ,  "React" ]  }  ', ["TypeScript", "React"], []),
    ('{"technologies": ["Python", 42, null, true, {"a": 1}, "Django"]}', ["Python", "Django"], []),
    ("I found Python.", None, None),
    ('{"techs": ["Python"]}', None, None),
    ('{"technologies": "Python"}', None, None),
    ('{"technologies": ["a"]} and {"technologies": ["b"]}', None, None),
    ('{"technologies": ["a"]}}', None, None),
    ('{"technologies": ["a"]} ] [{"x": 1}', None, None),
    ('{"technologies": ["a"]}, {"x": 1}', None, None),
    ("{broken", None, None),
    (None, None, None),
]


def test_answers(spark):
    frame = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(ANSWERS)], "i int, answer string")
    got = enrich.with_parsed_answer(frame, "answer").orderBy("i").collect()
    for row, (answer, known, unknown) in zip(got, ANSWERS, strict=True):
        assert (row.known, row.unknown) == (known, unknown), answer
        assert (row.error is None) == (known is not None), answer


def test_enrichment_results_and_totals(spark):
    pending = spark.createDataFrame(
        [("1", "Dev", ["Go"]), ("2", "Paralegal", ["Go"]), ("3", "Dev", []), ("4", "Dev", ["R"])],
        "id string, title string, tech_stack array<string>",
    )
    answers = spark.createDataFrame(
        [("1", '{"technologies": ["Go", "AWS", "AWS", "?New"]}'), ("2", '{"technologies": ["X"]}'), ("3", "none")],
        "id string, answer string",
    )
    results = enrich.enrichment_results(pending, answers, "h", F.col("title") == "Paralegal")
    rows = {r.id: (r.status, r.known, r.unknown) for r in results.collect()}
    assert rows == {
        "1": ("enriched", ["Go", "AWS", "AWS"], ["New"]), "2": ("skipped", [], []),
        "3": ("error", [], []), "4": ("error", [], []),
    }
    assert tuple(enrich.run_totals(results).first()) == (2, 2, 1)
    assert tuple(enrich.run_totals(results.limit(0)).first()) == (0, 0, 0)


def test_tag_diff(spark):
    frame = spark.createDataFrame(
        [(["b", "a"], ["c", "a"]), (["a"], ["a"])], "x array<string>, y array<string>"
    )
    got = enrich.tag_diff(frame, "x", "y").collect()
    assert (got[0].added, got[0].removed, got[0].diff) == (["c"], ["b"], "+c  -b")
    assert got[1].diff == "(no diff)"


def test_version_hash(spark):
    def frame(categories):
        rows = [
            (i, name, j, tag)
            for i, (name, tags) in enumerate(categories.items())
            for j, tag in enumerate(tags)
        ]
        return spark.createDataFrame(rows, "category_pos int, category string, tag_pos int, tag string")

    template = "Known:\n{{canonical_tech_list}}\nEnd"

    def mine(categories, text=template):
        return enrich.version_hash(frame(categories), text).first().prompt_hash

    listed = "\n".join(f"{c}: {', '.join(tags)}" for c, tags in presets.CATEGORIES.items())
    expected = hashlib.sha256(template.replace("{{canonical_tech_list}}", listed).encode()).hexdigest()[:8]
    assert mine(presets.CATEGORIES) == expected
    longer = presets.CATEGORIES | {"languages": [*presets.CATEGORIES["languages"], "COBOL"]}
    assert mine(longer) != expected
    assert mine(presets.CATEGORIES, template + " ") != expected


def test_values_helper_keeps_order(spark):
    assert values(spark, F.col("a"), [3, 1, 2], "a int") == [3, 1, 2]


def test_segments_bring_their_own_categories():
    known = sorted({c for listed in presets.SEGMENT_CATEGORIES.values() for c in listed} | set(presets.DEFAULT_CATEGORIES))

    def chosen(name, text=None):
        return trends.segment_categories(name, text, known, presets.SEGMENT_CATEGORIES, presets.DEFAULT_CATEGORIES)

    assert chosen("mobile") == ["mobile", "languages", "frontend", "backend"]
    assert chosen("ai_ml", "Cloud,none") == ["cloud", "data", "ai_concepts", "languages"]
    assert chosen(None) == chosen("other") == ["languages", "frontend", "devops", "data"]


def test_count_ranks_start_no_job_and_equal_a_sort(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("ab+é") for _ in range(rng.randint(0, 12))) for _ in range(400)}
    rows = [(n, rng.choice([1, 1, 1, 2, 5, 9])) for n in sorted(names)] + [(None, 2)]
    frame = spark.createDataFrame(rows, "tag string, count long").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("compose", "nothing may run")
    ranked = count_ranks(frame, "tag")
    assert not tracker.getJobIdsForGroup("compose")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    key = lambda r: (-r[1], r[0] is not None, (r[0] or "").encode())
    want = [(*r, i, len(rows)) for i, r in enumerate(sorted(rows, key=key), 1)]
    assert sorted(map(tuple, ranked.collect()), key=lambda r: r[2]) == want
    assert count_ranks(frame.limit(0), "tag").count() == 0


def test_board_stream_lands_and_takes_in_many_files(spark, monkeypatch):
    from __spark_entry__ import queries
    from tagloom.plans import trend_queries

    seen, follow = [], trend_queries.follow_board

    def counted(spark, source, schema, target, *rest, **named):
        seen.append(len(spark.read.schema(schema).parquet(source).inputFiles()))
        running = follow(spark, source, schema, target, *rest, **named)
        running.awaitTermination()
        batches.append(spark.read.parquet(target).select("batch").distinct().count())
        return running

    batches = []
    monkeypatch.setattr(trend_queries, "follow_board", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries()["board_stream"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] > 1 and batches == [1, 2, 3]
