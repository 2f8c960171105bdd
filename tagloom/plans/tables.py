"""The benchmark tables seen as postings.

Orders play the postings: the brands of their line items are the tags (returned items
give the model's tags, all others the rules' tags), the priority is the source, the
customer the company, and the status the three-valued workplace flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.rules import any_of, at_least
from tagloom.operators.keys import spread_scan
from tagloom.operators.serving import active_view
from tagloom.session import small_table

AS_OF = "2001-08-01 12:00:00"

# Brand groups standing for tag categories; Brand#21 to Brand#25 belong to none.
BRAND_GROUPS = {
    "alpha": [f"Brand#{i}" for i in range(1, 6)],
    "beta": [f"Brand#{i}" for i in range(6, 11)],
    "gamma": [f"Brand#{i}" for i in range(11, 16)],
    "delta": [f"Brand#{i}" for i in range(16, 21)],
}
GROUP_OF = {brand: group for group, brands in BRAND_GROUPS.items() for brand in brands}

BRAND_SEGMENTS = [
    ("starter", [[any_of("Brand#1"), any_of("Brand#2", "Brand#3")], [any_of("Brand#25")]]),
    ("broad", [[at_least(2, "Brand#4", "Brand#5", "Brand#6", "Brand#7", "Brand#8")]]),
    ("paired", [[any_of("Brand#9", "Brand#10"), any_of("Brand#11", "Brand#12")]]),
]


# Tables with times are read by schema, so that their zone-less times become UTC instants
# at the scan and time filters still reach the files.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, "
    "value double, props string",
}


# Keys of the tables with long texts, whose rows are worth spreading before heavy work.
TEXT_KEYS = {
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    rows = reader.parquet(f"{sf_dir}/{name}.parquet")
    return spread_scan(rows, TEXT_KEYS[name]) if name in TEXT_KEYS else rows


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


def brand_categories(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(GROUP_OF.items()), ["tag", "category"])


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule tags, model tags and latest shipment per order.

    The tag sets are built on the map side and hold at most the 25 brands, whatever the
    number of line items of an order.
    """
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"
    )
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    returned = F.col("l_returnflag") == "R"
    return (
        items.join(brands, "l_partkey")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.array_sort(F.collect_set(F.when(~returned, F.col("p_brand")))).alias("tech_stack"),
            F.array_sort(F.collect_set(F.when(returned, F.col("p_brand")))).alias(
                "enriched_tech_stack"
            ),
            F.max("l_shipdate").alias("shipped_at"),
        )
    )


def order_columns(orders: DataFrame) -> DataFrame:
    """Posting columns that come from the order itself."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_custkey").alias("company"),
        F.when(price >= 400000, "director")
        .when(price >= 250000, "senior")
        .when(price >= 100000, "junior")
        .alias("seniority"),
        F.when(status == "O", True).when(status == "F", False).alias("is_remote"),
        (price >= 20000).alias("is_qc"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_active"),
        F.col("o_orderdate").alias("first_seen_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as stored postings; an order without items has no tags."""
    none = F.array().cast("array<string>")
    orders = order_columns(table(spark, sf_dir, "orders"))
    joined = orders.join(baskets(spark, sf_dir), "id", "left")
    return joined.select(
        *orders.columns,
        F.coalesce("tech_stack", none).alias("tech_stack"),
        F.coalesce("enriched_tech_stack", none).alias("enriched_tech_stack"),
        F.coalesce("shipped_at", "first_seen_at").alias("fetched_at"),
    )


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active_view(jobs(spark, sf_dir))


def text_of(tags: str) -> F.Column:
    """A tag array as one comparable string."""
    return F.array_join(tags, ",")


def time_text(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- the same tables in SQL ---------------------------------------------------------------

JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS id, o_orderpriority AS source, o_custkey AS company,
         CASE WHEN o_totalprice >= 400000 THEN 'director' WHEN o_totalprice >= 250000 THEN 'senior'
              WHEN o_totalprice >= 100000 THEN 'junior' END AS seniority,
         CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END AS is_remote,
         o_totalprice >= 20000 AS is_qc, o_orderpriority <> '5-LOW' AS is_active,
         o_orderdate AS first_seen_at, coalesce(rule_tags, []) AS tech_stack,
         coalesce(model_tags, []) AS enriched_tech_stack,
         coalesce(shipped_at, o_orderdate) AS fetched_at
  FROM orders LEFT JOIN (
    SELECT l_orderkey,
           list_sort(list(DISTINCT p_brand) FILTER (l_returnflag <> 'R')) AS rule_tags,
           list_sort(list(DISTINCT p_brand) FILTER (l_returnflag = 'R')) AS model_tags,
           max(l_shipdate) AS shipped_at
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) b
  ON o_orderkey = l_orderkey)"""

VIEW_SQL = (
    JOBS_SQL
    + """,
view AS (
  SELECT * EXCLUDE (tech_stack, enriched_tech_stack, is_qc, is_active),
         list_sort(list_distinct(list_concat(tech_stack, enriched_tech_stack))) AS tech_stack
  FROM jobs WHERE is_qc AND is_active)"""
)


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CATEGORY_SQL = (
    "CASE "
    + " ".join(
        f"WHEN list_contains({sql_list(brands)}, tag) THEN '{group}'"
        for group, brands in BRAND_GROUPS.items()
    )
    + " ELSE 'other' END"
)

SEGMENT_SQL = """CASE
  WHEN (list_has_any(tech_stack, ['Brand#1']) AND list_has_any(tech_stack, ['Brand#2', 'Brand#3']))
       OR list_has_any(tech_stack, ['Brand#25']) THEN 'starter'
  WHEN len(list_intersect(tech_stack, ['Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8'])) >= 2
       THEN 'broad'
  WHEN list_has_any(tech_stack, ['Brand#9', 'Brand#10'])
       AND list_has_any(tech_stack, ['Brand#11', 'Brand#12']) THEN 'paired' END"""

FREQUENCY_SQL = (
    VIEW_SQL
    + f""",
frequency AS (
  SELECT tag, count, row_number() OVER (ORDER BY count DESC, tag) AS rank,
         count(*) OVER () AS tag_total, {CATEGORY_SQL} AS category
  FROM (SELECT tag, count(*) AS count FROM (SELECT unnest(tech_stack) AS tag FROM view) GROUP BY tag))"""
)

PARTNERS_SQL = (
    FREQUENCY_SQL
    + """,
exploded AS (SELECT id, unnest(tech_stack) AS tag FROM view),
pairs AS (
  SELECT x.tag AS a, y.tag AS b, count(*) AS count FROM exploded x JOIN exploded y
  ON x.id = y.id AND x.tag <> y.tag GROUP BY 1, 2),
partners AS (
  SELECT a AS tag, position, b AS partner, p.count,
         CAST(floor(p.count / f.count * 100 + 0.5) AS INTEGER) AS pct
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY count DESC, b) AS position
        FROM pairs) p JOIN frequency f ON f.tag = p.a WHERE position <= 8)"""
)
