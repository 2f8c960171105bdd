"""Queries for landed payloads, the snapshot merge, enrichment batches and daily runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import coerce
from tagloom.operators import enrich, merge, serving
from tagloom.operators.keys import spread_scan
from tagloom.plans import postings
from tagloom.plans.registry import query
from tagloom.plans.serving_queries import document_jobs
from tagloom.plans.tables import table, text_of, time_text
from tagloom.plans.text_queries import _EDGE_L, _EDGE_R, ANSWERS_SQL, order_answers
from tagloom.session import scratch_path, stored
from tagloom.sources import landed
from tagloom.sources.large_lists import large_json_items, large_markdown_rows
from tagloom.streaming.landing import ingest_landed

# --- landed documents -------------------------------------------------------------------------


@query("""
SELECT o_orderkey, 0 AS pos, CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def json_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(
        F.struct(F.col("o_custkey").cast("string").alias("id")),
        F.struct(F.col("o_orderpriority").alias("id")),
    )
    payloads = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", F.to_json(items))
        .when(F.col("o_orderstatus") == "O", F.to_json(F.struct(items.alias("jobs"))))
        .otherwise(F.lit('{"error": "no board"}'))
        .alias("payload"),
    )
    bare = landed.json_items(payloads.where("o_orderstatus = 'P'"), None)
    keyed = landed.json_items(payloads.where("o_orderstatus <> 'P'"), "jobs")
    return bare.unionByName(keyed).select(
        "o_orderkey", "pos", coerce.path_value(F.col("raw"), "id").alias("id")
    )


@query("""
SELECT p_partkey, p_name AS title, p_type AS department,
       CASE WHEN p_size > 25 THEN p_brand END AS location, upper(md5(p_name)) AS external_id,
       'https://x.example/c/j/' || upper(md5(p_name)) AS source_url FROM part
UNION ALL SELECT p_partkey, 'second', p_type, NULL, NULL, NULL FROM part""")
def markdown_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("—"))
    url = F.concat(
        F.lit("[View](https://x.example/c/jobs/view/"), F.upper(F.md5("p_name")), F.lit(".md)")
    )
    lines = [
        F.lit("# Open roles"),
        F.lit("| title | department | location | url |"),
        F.lit("|---|:--|---|---|"),
        F.concat_ws(" | ", F.concat(F.lit("| "), "p_name"), "p_type", place, F.concat(url, F.lit(" |"))),
        F.concat(F.lit("| second |"), "p_type", F.lit(" | — | https://x.example/other |")),
        F.lit("| too | few |"),
        F.lit("| only | dashes | - | here |"),
    ]
    # parts are small rows in one split of a file, but reading their documents is heavy
    parts = spread_scan(table(spark, sf_dir, "part"), ["p_partkey"])
    payloads = parts.select("p_partkey", F.concat_ws("\n", *lines).alias("payload"))
    rows = landed.markdown_rows(payloads, ["title", "department", "location", "url"], "url")
    return rows.drop("pos", "url")


def _land_lines(lines: DataFrame, root: str) -> str:
    """Write lines (company, place, line) as one document per company and return the folder."""
    ordered = lines.repartition("company").sortWithinPartitions("company", "place")
    written = ordered.select(F.lit("orders").alias("source"), "company", "line")
    written.write.partitionBy("source", "company").text(root)
    return root


@query("""
WITH o AS (SELECT c_nationkey, o_orderkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (
  SELECT c_nationkey, o_orderkey AS place, CAST(o_orderkey AS VARCHAR) AS id, '["' || o_orderpriority || ']' AS note FROM o
  UNION ALL SELECT c_nationkey, max(o_orderkey) + 1, 'last', NULL FROM o GROUP BY c_nationkey)
SELECT 'orders' AS source, CAST(c_nationkey AS VARCHAR) AS company_slug, id, note,
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY place) - 1 AS INTEGER) AS pos FROM e""")
def large_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list document per nation, cut into its elements by the tasks that read its splits."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey")
    company, place = F.col("c_nationkey").cast("string").alias("company"), F.col("o_orderkey")
    note = F.concat(F.lit('["'), "o_orderpriority", F.lit("]"))
    element = F.to_json(F.struct(place.cast("string").alias("id"), note.alias("note"), F.array(F.lit(1), F.lit(2)).alias("x")))
    body = rows.select(company, place.alias("place"), F.concat(element, F.lit(",")).alias("line"))
    ends = rows.groupBy(company).agg(F.max("o_orderkey").alias("most"))
    head = F.lit('{"meta": [1, {"jobs": [3]}], "jobs": [')
    ends = ends.select(
        "company",
        F.inline(
            F.array(
                F.struct(F.lit(-1).cast("long").alias("place"), head.alias("line")),
                F.struct((F.col("most") + 1).alias("place"), F.lit('{"id": "last"}], "end": 2}').alias("line")),
            )
        ),
    )
    root = _land_lines(body.unionByName(ends), scratch_path(spark, "large-lists"))
    items = large_json_items(spark, root, "jobs")
    return items.select(
        "source", "company_slug", "pos",
        coerce.path_value(F.col("raw"), "id").alias("id"), coerce.path_value(F.col("raw"), "note").alias("note"),
    )


@query("""
SELECT replace(p_brand, '#', '') AS company_slug, p_name AS title, CASE WHEN p_size > 25 THEN p_type END AS type,
       upper(md5(p_name)) AS external_id,
       CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS INTEGER) AS pos FROM part""")
def large_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipe table per brand, read line by line."""
    parts, brand = table(spark, sf_dir, "part"), F.replace("p_brand", F.lit("#"), F.lit(""))
    url = F.concat(F.lit("[View](https://x.example/c/jobs/view/"), F.upper(F.md5("p_name")), F.lit(".md) |"))
    kind = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit("—"))
    line = F.concat_ws(" | ", F.concat(F.lit("| "), "p_name"), kind, url)
    body = parts.select(brand.alias("company"), F.col("p_partkey").alias("place"), line.alias("line"))
    head = F.inline(
        F.array(
            F.struct(F.lit(-2).cast("long").alias("place"), F.lit("| title | type | url |").alias("line")),
            F.struct(F.lit(-1).cast("long").alias("place"), F.lit("|---|---|---|").alias("line")),
        )
    )
    heads = parts.select(brand.alias("company")).distinct().select("company", head)
    root = _land_lines(body.unionByName(heads), scratch_path(spark, "large-tables"))
    found = large_markdown_rows(spark, root, ["title", "type", "url"], "url")
    return found.select("company_slug", "pos", "title", "type", "external_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN c_name END AS name,
       CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS segment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def attached_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("url")
    )
    details = (
        table(spark, sf_dir, "customer")
        .where("c_acctbal > 0")
        .select(
            F.col("c_custkey").cast("string").alias("url"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"),
        )
    )
    return landed.attach_details(rows, details, "url", row_id=["o_orderkey"]).drop("url")


@query("""
WITH p AS (SELECT *, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, CASE WHEN contains(url, 'blog') THEN '/Site' || path ELSE path END AS ext FROM p)
SELECT page_id, CASE WHEN contains(url, '?') THEN 'JR-' || page_id
              ELSE regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) END AS external_id,
       'https://b.example/Site' || path AS source_url,
       'https://b.example/api/Site' || path AS detail_url FROM q""")
def board_item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    site = F.when(F.contains("url", F.lit("blog")), F.lit("/Site")).otherwise(F.lit(""))
    raw = F.struct(
        F.concat(site, path).alias("externalPath"),
        F.when(F.contains("url", F.lit("?")), F.concat(F.lit("JR-"), "page_id"))
        .otherwise(F.lit(""))
        .alias("jobReqId"),
    )
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.try_parse_json(F.to_json(raw)).alias("raw"),
        F.lit("https://b.example/api/Site/jobs").alias("api_url"),
        F.lit("https://b.example/").alias("base_url"),
    )
    return landed.board_keys(rows).select(
        "page_id",
        F.col("_external_id").alias("external_id"),
        F.col("_source_url").alias("source_url"),
        F.col("_detail_url").alias("detail_url"),
    )


@query("""
SELECT event_id FROM events WHERE event_type <> 'view' AND user_id <> 0
AND json_extract_string(props, '$.k') <> '0' AND event_type NOT IN ('error', 'click')""")
def required_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = F.struct(
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(kind != "view", kind).otherwise(F.lit("")).alias("title"),
        F.when(kind != "error", F.array(kind)).otherwise(F.array().cast("array<string>")).alias("list"),
        (kind != "click").alias("open"),
    )
    payloads = table(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.array(raw)).alias("payload")
    )
    rows = landed.json_items(payloads, None)
    needed = ["user_id", "k", "title", "list", "open"]
    return rows.where(postings.has_required(rows, needed)).select("event_id")


# --- all sources end to end ------------------------------------------------------------------------

_SOURCE_OF = {"en": "greenhouse", "fr": "lever", "de": "workable", "es": "workday"}


def _by(column: str, values: dict[str, F.Column]) -> F.Column:
    result = F.lit(None)
    for key, value in values.items():
        result = F.when(F.col(column) == key, value).otherwise(result)
    return result


def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a posting, landed in the form of the source its language stands for."""
    doc, text = F.col("doc_id").cast("string"), F.col("text")
    title = F.concat(F.lit("Sr. Engineer "), "source")
    code = F.upper(F.md5(doc))
    detail = F.concat(F.lit("https://apply.example/x/jobs/view/"), code, F.lit(".md"))
    place = F.when(F.col("n_chars") > 800, F.lit("Montréal (Remote)")).otherwise(
        F.lit("Toronto (On-site)")
    )
    lists = {
        "en": F.to_json(
            F.struct(
                F.array(
                    F.struct(
                        doc.alias("id"),
                        title.alias("title"),
                        F.concat(F.lit("https://g.example/"), doc).alias("absolute_url"),
                        F.struct(place.alias("name")).alias("location"),
                        text.alias("content"),
                        F.lit("2026-04-28T12:00:00-04:00").alias("updated_at"),
                    )
                ).alias("jobs")
            )
        ),
        "fr": F.to_json(
            F.array(
                F.struct(
                    F.concat(F.lit("L"), doc).alias("id"),
                    title.alias("text"),
                    F.concat(F.lit("https://l.example/"), doc).alias("hostedUrl"),
                    F.struct(place.alias("location"), F.lit("Full Time").alias("commitment")).alias(
                        "categories"
                    ),
                    F.lit("").alias("description"),
                    F.array(F.struct(text.alias("content"))).alias("lists"),
                    F.lit("On-Site").alias("workplaceType"),
                    F.lit(1700000000000).alias("createdAt"),
                )
            )
        ),
        "de": F.concat_ws(
            " | ", F.concat(F.lit("| "), title), F.lit("R&D"), place, F.lit("Contract"),
            F.lit("—"), F.lit("2026-05-01"), F.concat(F.lit("[View]("), detail, F.lit(") |")),
        ),
        "es": F.to_json(
            F.struct(
                F.array(
                    F.struct(
                        title.alias("title"),
                        F.concat(F.lit("/job/E_JR-"), doc).alias("externalPath"),
                        place.alias("locationsText"),
                    )
                ).alias("jobPostings")
            )
        ),
    }
    pages = {
        "de": text,
        "es": F.to_json(
            F.struct(
                F.struct(text.alias("jobDescription"), F.lit("04/28/2026").alias("startDate")).alias(
                    "jobPostingInfo"
                )
            )
        ),
    }
    urls = {"de": detail, "es": F.concat(F.lit("https://b.example/api/Site/job/E_JR-"), doc)}
    documents = table(spark, sf_dir, "documents")
    source = _by("lang", {k: F.lit(v) for k, v in _SOURCE_OF.items()}).alias("source")
    none = F.lit(None).cast("string")
    listed = documents.select(
        source, F.lit("list").alias("kind"), F.col("source").alias("company_slug"),
        none.alias("detail_url"), _by("lang", lists).alias("payload"), "n_chars",
    )
    details = documents.where(F.col("lang").isin("de", "es")).select(
        source, F.lit("detail").alias("kind"), F.col("source").alias("company_slug"),
        _by("lang", urls).alias("detail_url"), _by("lang", pages).alias("payload"), "n_chars",
    )
    return listed.unionByName(details)


def document_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company list, kept as a table whose size Spark knows, so that no payload is shuffled for it."""
    pairs = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    board = F.col("lang") == "es"
    companies = pairs.select(
        _by("lang", {k: F.lit(v) for k, v in _SOURCE_OF.items()}).alias("source"),
        F.col("source").alias("slug"),
        F.upper("source").alias("name"),
        F.when(board, F.lit("https://b.example/api/Site/jobs")).alias("api_url"),
        F.when(board, F.lit("https://b.example")).alias("base_url"),
    )
    return stored(companies, "companies")


_POSTINGS_SQL = """
postings AS (
  SELECT CASE lang WHEN 'en' THEN 'greenhouse' WHEN 'fr' THEN 'lever' WHEN 'de' THEN 'workable'
              ELSE 'workday' END AS source,
         CASE lang WHEN 'en' THEN CAST(doc_id AS VARCHAR) WHEN 'fr' THEN 'L' || doc_id
              WHEN 'de' THEN upper(md5(CAST(doc_id AS VARCHAR))) ELSE 'E_JR-' || doc_id END
           AS external_id,
         upper(source) AS company, source AS company_slug, 'Sr. Engineer ' || source AS title,
         CASE lang WHEN 'en' THEN 'https://g.example/' || doc_id WHEN 'fr' THEN 'https://l.example/' || doc_id
              WHEN 'de' THEN 'https://apply.example/x/j/' || upper(md5(CAST(doc_id AS VARCHAR)))
              ELSE 'https://b.example/Site/job/E_JR-' || doc_id END AS source_url,
         n_chars > 800 AS is_qc, n_chars, text, lang,
         CASE WHEN lang = 'fr' THEN FALSE ELSE n_chars > 800 END AS is_remote,
         'senior' AS seniority,
         CASE lang WHEN 'fr' THEN 'full-time' WHEN 'de' THEN 'contract' END AS employment_type,
         CASE lang WHEN 'en' THEN '2026-04-28 16:00:00' WHEN 'fr' THEN '2023-11-14 22:13:20'
              WHEN 'de' THEN '2026-05-01 00:00:00' ELSE '2026-04-28 00:00:00' END AS posted_at
  FROM documents)"""


@query(f"""WITH {_POSTINGS_SQL}
SELECT source, external_id, company, company_slug, title, source_url, is_qc, is_remote, seniority,
       employment_type, posted_at, length(trim(text, ' ' || chr(10) || chr(13) || chr(9))) AS size,
       (regexp_matches(text, '{_EDGE_L}R{_EDGE_R}') AND lang <> 'de') AS tagged_r
FROM postings""")
def landed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = document_payloads(spark, sf_dir)
    rows = postings.read_postings(payloads, document_companies(spark, sf_dir))
    body = F.regexp_replace("description_html", r"^[ \n\r\t]+|[ \n\r\t]+\z", "")
    return rows.select(
        "source", "external_id", "company", "company_slug", "title", "source_url", "is_qc",
        "is_remote", "seniority", "employment_type", time_text("posted_at").alias("posted_at"),
        F.length(body).alias("size"), F.array_contains("tech_stack", "R").alias("tagged_r"),
    )


@query(f"""WITH {_POSTINGS_SQL}
SELECT source, company_slug, count(*) AS rows FROM postings WHERE is_qc GROUP BY ALL""")
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = document_payloads(spark, sf_dir)
    rows = postings.read_postings(payloads, document_companies(spark, sf_dir))
    return postings.in_region(rows).groupBy("source", "company_slug").agg(
        F.count("*").alias("rows")
    )


# --- snapshot merge -------------------------------------------------------------------------------

_RUN_AT = "2001-09-01 06:00:00"
_CUT = "1998-01-01 00:00:00"
_KEY = ["source", "external_id", "company_slug"]


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older orders as the stored table; urgent ones were deactivated before."""
    day = F.col("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .where(day < F.lit(_CUT).cast("timestamp"))
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.lit("orders").alias("source"),
            F.col("o_orderkey").cast("string").alias("external_id"),
            F.col("o_custkey").cast("string").alias("company_slug"),
            F.col("o_orderpriority").alias("title"),
            day.alias("fetched_at"),
            day.alias("first_seen_at"),
            day.alias("last_seen_at"),
            (F.col("o_orderpriority") != "1-URGENT").alias("is_active"),
            F.array("o_orderstatus").alias("enriched_tech_stack"),
        )
    )


def incoming_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of orders with open lines; every line is one (repeated) incoming row."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("orders").alias("source"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.col("o_custkey").cast("string").alias("company_slug"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("title"),
        "l_linenumber",
    )


_MERGE_SQL = f"""
cur AS (SELECT *, o_orderpriority <> '1-URGENT' AS active FROM orders
        WHERE o_orderdate < TIMESTAMP '{_CUT}'),
inc AS (SELECT o_orderkey, o_custkey, max('line ' || l_linenumber) AS title
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderstatus <> 'F' AND l_returnflag = 'N' GROUP BY ALL),
merged AS (
  SELECT coalesce(c.o_orderkey, i.o_orderkey) AS external_id,
         coalesce(c.o_custkey, i.o_custkey) AS company_slug,
         coalesce(i.title, c.o_orderpriority) AS title,
         CASE WHEN c.o_orderkey IS NULL THEN 'inserted' WHEN i.o_orderkey IS NOT NULL THEN 'updated'
              WHEN c.active AND c.o_custkey IN (SELECT o_custkey FROM inc) THEN 'deactivated'
              ELSE 'unchanged' END AS change_type,
         coalesce(c.o_orderdate, TIMESTAMP '{_RUN_AT}') AS first_seen_at,
         CASE WHEN i.o_orderkey IS NULL THEN c.o_orderdate ELSE TIMESTAMP '{_RUN_AT}' END AS last_seen_at,
         c.active, coalesce(c.o_orderstatus, '') AS model_tags
  FROM cur c FULL JOIN inc i ON c.o_orderkey = i.o_orderkey)"""

_MERGED_SQL = f"""WITH {_MERGE_SQL}
SELECT CAST(external_id AS VARCHAR) AS external_id, CAST(company_slug AS VARCHAR) AS company_slug, title,
       change_type, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at,
       strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at,
       CASE change_type WHEN 'deactivated' THEN FALSE WHEN 'unchanged' THEN active ELSE TRUE END
         AS is_active, model_tags
FROM merged"""


def _merged(spark: SparkSession, sf_dir: str, small: bool) -> DataFrame:
    return merge.merge_snapshot(
        stored_orders(spark, sf_dir),
        incoming_orders(spark, sf_dir).drop("l_linenumber"),
        F.lit(_RUN_AT).cast("timestamp"),
        newest=["title"],
        incoming_is_small=small,
    )


def _merged_text(merged: DataFrame) -> DataFrame:
    return merged.select(
        "external_id", "company_slug", "title", "change_type",
        time_text("first_seen_at").alias("first_seen_at"),
        time_text("last_seen_at").alias("last_seen_at"),
        "is_active", text_of("enriched_tech_stack").alias("model_tags"),
    )


@query(_MERGED_SQL)
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_text(_merged(spark, sf_dir, small=False))


@query(_MERGED_SQL)
def snapshot_merge_small_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_text(_merged(spark, sf_dir, small=True))


_SHARED_SQL = f"""
cur AS (
  SELECT o_orderpriority AS source, CAST(o_orderkey % 211 AS VARCHAR) AS external_id,
         CAST(o_custkey % 13 AS VARCHAR) AS company_slug, min(o_orderdate) AS seen,
         min(o_orderstatus) <> 'F' AS active, max(o_totalprice) AS price
  FROM orders WHERE o_orderdate < TIMESTAMP '{_CUT}' GROUP BY ALL),
inc AS (
  SELECT o_orderpriority AS source, CAST(o_orderkey % 211 AS VARCHAR) AS external_id,
         CAST(o_custkey % 13 AS VARCHAR) AS company_slug, max(o_totalprice) AS price
  FROM orders WHERE o_orderdate >= TIMESTAMP '{_CUT}' AND o_orderpriority <> '2-HIGH' AND o_custkey % 13 < 9
  GROUP BY ALL)"""


@query(f"""WITH {_SHARED_SQL}
SELECT source, external_id, company_slug, CAST(coalesce(i.price, c.price) * 100 AS BIGINT) AS cents,
       strftime(coalesce(c.seen, TIMESTAMP '{_RUN_AT}'), '%Y-%m-%d %H:%M:%S') AS first_seen_at,
       strftime(CASE WHEN i.price IS NULL THEN c.seen ELSE TIMESTAMP '{_RUN_AT}' END, '%Y-%m-%d %H:%M:%S')
         AS fetched_at,
       CASE WHEN c.price IS NULL THEN sha256(source || chr(1) || external_id || chr(1) || company_slug)
            ELSE 'old ' || external_id END AS id,
       CASE WHEN c.price IS NULL THEN 'inserted' WHEN i.price IS NOT NULL THEN 'updated'
            WHEN c.active AND EXISTS (SELECT 1 FROM inc s WHERE s.source = c.source
                                      AND s.company_slug = c.company_slug) THEN 'deactivated'
            ELSE 'unchanged' END AS change_type
FROM cur c FULL JOIN inc i USING (source, external_id, company_slug)""")
def snapshot_merge_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge in which one id stands in several companies and one company in several sources."""
    orders, cut = table(spark, sf_dir, "orders"), F.lit(_CUT).cast("timestamp")
    keyed = orders.select(
        F.col("o_orderpriority").alias("source"),
        (F.col("o_orderkey") % 211).cast("string").alias("external_id"),
        (F.col("o_custkey") % 13).cast("string").alias("company_slug"),
        "o_orderdate", "o_orderstatus", F.col("o_totalprice").alias("price"), "o_custkey",
    )
    stored = keyed.where(F.col("o_orderdate") < cut).groupBy(*_KEY).agg(
        F.concat(F.lit("old "), "external_id").alias("id"),
        F.max("price").alias("price"),
        F.min("o_orderdate").alias("first_seen_at"),
        F.min("o_orderdate").alias("fetched_at"),
        (F.min("o_orderstatus") != "F").alias("is_active"),
    )
    run = keyed.where((F.col("o_orderdate") >= cut) & (F.col("source") != "2-HIGH") & (F.col("o_custkey") % 13 < 9))
    merged = merge.merge_snapshot(stored, run.select(*_KEY, "price"), F.lit(_RUN_AT).cast("timestamp"))
    return merged.select(
        *_KEY, F.round(F.col("price") * 100).cast("long").alias("cents"),
        time_text("first_seen_at").alias("first_seen_at"), time_text("fetched_at").alias("fetched_at"),
        "id", "change_type",
    )


@query(f"""WITH {_MERGE_SQL}
SELECT (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderstatus <> 'F' AND l_returnflag = 'N') AS fetched,
       count(*) FILTER (change_type IN ('inserted', 'updated')) AS upserted,
       count(*) FILTER (change_type = 'deactivated') AS deactivated FROM merged""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.run_summary(_merged(spark, sf_dir, small=False), incoming_orders(spark, sf_dir))


# --- enrichment ---------------------------------------------------------------------------------

_HASH = "4f2a91c7"


@query(f"""WITH {ANSWERS_SQL}
SELECT id, CASE WHEN source = '5-LOW' THEN 'skipped' WHEN error IS NULL THEN 'enriched' ELSE 'error' END
         AS status,
       CASE WHEN source <> '5-LOW' AND error IS NULL
            THEN array_to_string(enriched_tech_stack, ',') ELSE '' END AS known,
       '{_HASH}' AS prompt_hash FROM answered WHERE seniority IS NOT NULL""")
def enrichment_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select(
        "id", "status", text_of("known").alias("known"), "prompt_hash"
    )


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_answers(spark, sf_dir)
    return enrich.enrichment_results(
        rows.where("seniority IS NOT NULL").drop("answer"),
        rows.select("id", "answer"),
        _HASH,
        gated=F.col("source") == "5-LOW",
    )


@query(f"""WITH {ANSWERS_SQL},
r AS (SELECT *, source <> '5-LOW' AND error IS NULL AS ok FROM answered WHERE seniority IS NOT NULL)
SELECT count(*) FILTER (source = '5-LOW' OR error IS NULL) AS enriched,
       count(*) FILTER (source <> '5-LOW' AND error IS NOT NULL) AS errors,
       CAST(sum(CASE WHEN ok THEN len(list_filter(enriched_tech_stack,
         lambda t: NOT list_contains(tech_stack, t))) ELSE 0 END) AS BIGINT) AS new_signals FROM r""")
def enrichment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.run_totals(_batch(spark, sf_dir))


@query(f"""
WITH p AS (SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
           WHERE n_chars > 200 AND d.source IN ('src1', 'src2', 'src3', 'src4')
             AND (quality IS NULL OR quality <> 1)
           ORDER BY n_chars, d.doc_id LIMIT 50)
SELECT d.doc_id AS id, CASE WHEN p.doc_id IS NOT NULL THEN '{_HASH}' WHEN quality IS NOT NULL
         THEN 'q' || quality END AS enriched_prompt_hash,
       CASE WHEN p.doc_id IS NULL THEN 'old' WHEN toxic IS NULL THEN '' ELSE 'tool' || toxic END AS model_tags
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN p ON d.doc_id = p.doc_id""")
def enrichment_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_jobs(spark, sf_dir).withColumns(
        {
            "enriched_tech_stack": F.array(F.lit("old")),
            "enriched_at": F.lit(None).cast("timestamp"),
        }
    )
    pending = serving.pending_enrichment(rows, "q1", ["src1", "src2", "src3", "src4"], limit=50)
    answers = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit('{"technologies": ["tool'), "toxic", F.lit('"]}')).alias("answer"),
    )
    results = enrich.enrichment_results(
        pending, answers, _HASH, gated=postings.is_non_tech_title(F.col("title"))
    )
    written = merge.apply_enrichment(rows, results, F.lit(_RUN_AT).cast("timestamp"))
    return written.select(
        "id", "enriched_prompt_hash", text_of("enriched_tech_stack").alias("model_tags")
    )


# --- daily runs -----------------------------------------------------------------------------------


@query(f"""WITH {_POSTINGS_SQL},
a AS (SELECT * FROM postings WHERE is_qc),
b AS (SELECT * FROM a WHERE n_chars > 2000)
SELECT source, external_id, company_slug, '2026-05-01 06:00:00' AS first_seen_at,
       CASE WHEN n_chars > 2000 THEN '2026-05-02 06:00:00' ELSE '2026-05-01 06:00:00' END AS last_seen_at,
       n_chars > 2000 OR NOT EXISTS (SELECT 1 FROM b WHERE b.source = a.source
                                     AND b.company_slug = a.company_slug) AS is_active
FROM a""")
def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two landed runs, the second without the shorter documents, merged by a stream."""
    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "jobs")
    payloads = document_payloads(spark, sf_dir)
    runs = {"20260501T060000": payloads, "20260502T060000": payloads.where("n_chars > 2000")}
    for run_id, rows in runs.items():
        landed_run = rows.drop("n_chars").write.partitionBy("source", "kind")
        landed_run.json(f"{landing}/run_id={run_id}", compression="gzip")
    companies = document_companies(spark, sf_dir)
    ingest_landed(spark, landing, companies, target, scratch_path(spark, "stream")).awaitTermination()
    stored = merge.read_version(spark, target, merge.latest_version(spark, target))
    return stored.select(
        "source", "external_id", "company_slug",
        time_text("first_seen_at").alias("first_seen_at"),
        time_text("last_seen_at").alias("last_seen_at"), "is_active",
    )
