"""Queries over tag frequency, co-occurrence, the radar, segments and the board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.rules import segment
from tagloom.operators import board, metrics, trends
from tagloom.operators.keys import spread_scan
from tagloom.plans.registry import query
from tagloom.plans.tables import (
    AS_OF,
    BRAND_GROUPS,
    BRAND_SEGMENTS,
    CATEGORY_SQL,
    FREQUENCY_SQL,
    PARTNERS_SQL,
    SEGMENT_SQL,
    VIEW_SQL,
    as_of,
    brand_categories,
    table,
    time_text,
    view,
)
from tagloom.session import scratch_path
from tagloom.streaming.board import follow_board, read_board

CHOSEN = trends.pick_categories("gamma, nothing,alpha", list(BRAND_GROUPS), ["beta", "gamma"], k=3)


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.tag_frequency(view(spark, sf_dir), brand_categories(spark))


@query(f"WITH {FREQUENCY_SQL} SELECT tag, count, rank, category FROM frequency")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequency(spark, sf_dir).drop("tag_total")


@query(f"""WITH {VIEW_SQL}
SELECT strftime(first_seen_at, '%Y-%m-%d') AS day, count(*) AS rows FROM view
WHERE first_seen_at >= CAST(CAST(TIMESTAMP '{AS_OF}' AS DATE) - 90 AS TIMESTAMP) GROUP BY 1""")
def window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trends.in_window(view(spark, sf_dir), "90d", as_of())
    return rows.groupBy(F.date_format("first_seen_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("rows")
    )


@query(f"""WITH {VIEW_SQL}, s AS (SELECT *, {SEGMENT_SQL} AS segment FROM view)
SELECT segment, count(*) AS rows FROM s GROUP BY segment""")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = segment(F.col("tech_stack"), BRAND_SEGMENTS).alias("segment")
    return view(spark, sf_dir).groupBy(name).agg(F.count("*").alias("rows"))


@query(f"""WITH {VIEW_SQL},
t AS (SELECT unnest(tech_stack) AS tag FROM view
      WHERE {SEGMENT_SQL} = 'paired'
        AND first_seen_at >= CAST(CAST(TIMESTAMP '{AS_OF}' AS DATE) - 30 AS TIMESTAMP))
SELECT tag, count(*) AS count FROM t GROUP BY tag""")
def segment_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = trends.in_window(view(spark, sf_dir), "no such window", as_of())
    return trends.tag_counts(trends.in_segment(recent, BRAND_SEGMENTS, "paired"))


@query(f"WITH {PARTNERS_SQL} SELECT a, b, count FROM pairs")
def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.tag_pairs(view(spark, sf_dir))


@query(f"WITH {PARTNERS_SQL} SELECT tag, position, partner, count, pct FROM partners")
def top_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_partners(view(spark, sf_dir))


_CHOSEN_SQL = "category IN ('gamma', 'alpha', 'beta')"


@query(f"WITH {FREQUENCY_SQL} SELECT tag, count, rank, category FROM frequency WHERE {_CHOSEN_SQL}")
def radar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.chosen_categories(_frequency(spark, sf_dir), CHOSEN).drop("tag_total")


@query(f"""WITH {PARTNERS_SQL} SELECT tag, position, partner, count, pct FROM partners
WHERE tag IN (SELECT tag FROM frequency WHERE {_CHOSEN_SQL})""")
def radar_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir)
    tags = trends.tag_counts(rows).join(brand_categories(spark), "tag")
    return trends.partners_of(trends.top_partners(rows), trends.chosen_categories(tags, CHOSEN))


_TOP_SQL = """
top AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank) AS position
        FROM frequency)"""


@query(f"""WITH {FREQUENCY_SQL}, {_TOP_SQL}
SELECT category, position, tag, count, rank, position = 1 AS leader FROM top WHERE position <= 4""")
def top_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_per_category(_frequency(spark, sf_dir), k=4).drop("tag_total")


@query(f"""WITH {FREQUENCY_SQL}, {_TOP_SQL},
p AS (SELECT *, count(*) OVER (PARTITION BY category) AS n,
             list_position(['gamma', 'alpha', 'beta'], category) - 1 AS i
      FROM top WHERE {_CHOSEN_SQL} AND position <= 8),
q AS (SELECT *, -pi() / 2 + i * (2 * pi() / 3) + (2 * pi() / 3) * position / (n + 1) AS angle,
             200 * (0.16 + 0.76 * least(1.0, rank / greatest(tag_total, 1) * 1.8)) AS r FROM p)
SELECT category, position, tag, round(280 + cos(angle) * r, 6) AS x,
       round(240 + sin(angle) * r, 6) AS y,
       round(greatest(6, least(20, sqrt(count) * 1.3)), 6) AS size,
       CASE WHEN 280 + cos(angle) * r > 280 THEN 'right' ELSE 'left' END AS label_side FROM q""")
def radar_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = trends.radar_layout(_frequency(spark, sf_dir), CHOSEN)
    return placed.select(
        "category",
        "position",
        "tag",
        F.round("x", 6).alias("x"),
        F.round("y", 6).alias("y"),
        F.round("size", 6).alias("size"),
        "label_side",
    )


# Categories shown first for a segment of the benchmark's tags; the third one has none of its own.
_SEGMENT_GROUPS = {"starter": ["alpha", "gamma"], "broad": ["delta", "beta"]}


@query(f"""WITH {VIEW_SQL},
s AS (SELECT *, {SEGMENT_SQL} AS segment FROM view),
f AS (SELECT segment, tag, count(*) AS count FROM (SELECT segment, unnest(tech_stack) AS tag FROM s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY count DESC, tag) AS rank, {CATEGORY_SQL} AS category
      FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY segment, category ORDER BY rank) AS position FROM r
      WHERE (segment = 'starter' AND category IN ('alpha', 'gamma')) OR (segment = 'broad' AND category IN ('gamma', 'delta'))
         OR (segment = 'paired' AND category IN ('beta', 'gamma')))
SELECT segment, category, position, tag, count, rank FROM t WHERE position <= 3""")
def segment_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading tags of each segment in its own categories; one segment asks for another one."""
    rows, categories, known = view(spark, sf_dir), brand_categories(spark), list(BRAND_GROUPS)
    parts = None
    for name, asked in (("starter", None), ("broad", "Gamma"), ("paired", "none")):
        chosen = trends.segment_categories(name, asked, known, _SEGMENT_GROUPS, ["beta", "gamma"], k=2)
        part = trends.segment_leaders(rows, categories, BRAND_SEGMENTS, name, chosen, k=3)
        part = part.select(F.lit(name).alias("segment"), "category", "position", "tag", "count", "rank")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query(f"""WITH {PARTNERS_SQL}
SELECT 'top' AS part, rank AS position, tag, count FROM frequency WHERE rank <= 8
UNION ALL SELECT 'partner', position, partner, count FROM partners
WHERE tag = (SELECT tag FROM frequency WHERE rank = 1)""")
def leaders_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir)
    return trends.leaders_rail(_frequency(spark, sf_dir), trends.top_partners(rows))


@query(f"""WITH o AS (SELECT DISTINCT p_brand AS tag FROM part)
SELECT {CATEGORY_SQL} AS category, tag FROM o WHERE contains(lower(tag), 'd#2')""")
def tags_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag")).distinct()
    return metrics.tags_by_category(options, brand_categories(spark), "D#2")


# --- board: events as an action log ----------------------------------------------------------

_ACTIONS = {"view": "move", "click": "save", "purchase": "move", "signup": "save", "error": "remove"}
_COLUMN = {"view": "applied", "purchase": "interviewing"}


def _actions(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Each event is an action of its user on the row its payload number points to.

    With ``spread`` a log of few splits is dealt out over the cores.
    """
    events = table(spark, sf_dir, "events")
    events = spread_scan(events, ["event_id"]) if spread else events

    def mapped(values: dict[str, str]):
        result = F.lit(None).cast("string")
        for key, value in values.items():
            result = F.when(F.col("event_type") == key, F.lit(value)).otherwise(result)
        return result

    return events.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("job_id"),
        mapped(_ACTIONS).alias("action"),
        mapped(_COLUMN).alias("column"),
        "ts",
        F.col("event_id").alias("seq"),
    )


_STATE_SQL = """
acts AS (
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS job_id, ts, event_id,
         CASE WHEN event_type IN ('click', 'signup') THEN 'save' WHEN event_type = 'error' THEN 'remove'
              WHEN event_type IN ('view', 'purchase') THEN 'move' END AS action,
         CASE event_type WHEN 'view' THEN 'applied' WHEN 'purchase' THEN 'interviewing' END AS col
  FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY ts, event_id) AS n FROM acts),
saves AS (
  SELECT user_id, job_id, max(n) FILTER (action = 'save') AS saved,
         coalesce(max(n) FILTER (action = 'remove'), 0) AS removed
  FROM ranked GROUP BY 1, 2),
state AS (
  SELECT s.user_id, s.job_id,
         coalesce((SELECT arg_max(col, n) FROM ranked r WHERE r.user_id = s.user_id
                   AND r.job_id = s.job_id AND r.action = 'move' AND r.n > s.saved), 'watching') AS col,
         (SELECT ts FROM ranked r WHERE r.user_id = s.user_id AND r.job_id = s.job_id
          AND r.n = s.saved) AS saved_at
  FROM saves s WHERE saved > removed)"""


@query(f"""WITH {_STATE_SQL}
SELECT user_id, job_id, col AS "column", strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at
FROM state""")
def board_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = board.board_state(_actions(spark, sf_dir))
    return state.withColumn("saved_at", time_text("saved_at"))


@query(f"""WITH {_STATE_SQL}
SELECT user_id, job_id, col AS "column", strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at
FROM state""")
def board_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board followed as a stream: the actions land in three parts, later times first."""
    source, target, state = (scratch_path(spark, n) for n in ("actions", "board", "stream"))
    actions = _actions(spark, sf_dir, spread=True)
    for part in (2, 0, 1):
        landed = actions.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part)
        # many tasks write and read a part, and a batch takes in its files together
        landed.write.mode("append").parquet(source)
        follow_board(spark, source, actions.schema, target, state, files_a_batch=1000).awaitTermination()
    return read_board(spark, target).withColumn("saved_at", time_text("saved_at"))


@query(f"""WITH {_STATE_SQL}
SELECT user_id, job_id, col AS "column", strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at
FROM state ORDER BY state.saved_at DESC, user_id, job_id""")
def board_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = board.board_list(board.board_state(_actions(spark, sf_dir)), ["user_id", "job_id"])
    return listed.withColumn("saved_at", time_text("saved_at"))


@query(f"""WITH {_STATE_SQL}, c(position, name) AS (
  VALUES (0, 'watching'), (1, 'applied'), (2, 'interviewing'), (3, 'archived'))
SELECT position, name AS "column", (SELECT count(*) FROM state WHERE col = name) AS count FROM c""")
def board_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.plans.presets import BOARD_COLUMNS

    return board.board_counts(board.board_state(_actions(spark, sf_dir)), BOARD_COLUMNS)


@query(f"""WITH {_STATE_SQL}
SELECT count(*) AS saved, strftime(max(saved_at), '%Y-%m-%d %H:%M:%S') AS latest_saved_at,
       (SELECT count(*) * 5 FROM nation WHERE n_regionkey <> 3) AS active_filters FROM state""")
def board_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.plans.serving_queries import saved_filters

    state = board.board_state(_actions(spark, sf_dir))
    summary = board.board_summary(state, saved_filters(spark, sf_dir))
    return summary.withColumn("latest_saved_at", time_text("latest_saved_at"))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
       arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def latest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return board.latest_action(events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])
