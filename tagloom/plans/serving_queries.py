"""Queries over the serving view: listing, search, facets, headline figures, saved filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import alerts, metrics, serving, tag_index
from tagloom.plans import presets
from tagloom.plans.registry import query
from tagloom.plans.tables import (
    AS_OF,
    JOBS_SQL,
    VIEW_SQL,
    as_of,
    jobs,
    table,
    text_of,
    time_text,
    view,
)
from tagloom.session import scratch_path

_LISTED = ["id", "source", "is_remote", "seniority"]
_LISTED_SQL = """id, source, is_remote, seniority, array_to_string(tech_stack, ',') AS tags,
  strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at"""


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select(
        *_LISTED, text_of("tech_stack").alias("tags"), time_text("first_seen_at").alias("first_seen_at")
    )


@query(f"WITH {VIEW_SQL} SELECT {_LISTED_SQL} FROM view")
def active_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(view(spark, sf_dir))


@query(
    f"WITH {VIEW_SQL} SELECT {_LISTED_SQL} FROM view "
    "WHERE list_has_all(tech_stack, ['Brand#1', 'Brand#2'])"
)
def filter_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = serving.split_list("Brand#1, Brand#2,")
    rows = view(spark, sf_dir)
    return _listed(rows.where(serving.has_all_tags(F.col("tech_stack"), wanted)))


@query(
    f"WITH {VIEW_SQL} SELECT {_LISTED_SQL} FROM view "
    "WHERE list_has_all(tech_stack, ['Brand#1', 'Brand#2'])"
)
def indexed_filter_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filter_all_tags`` over a stored bitmap index."""
    root = scratch_path(spark, "tag-index")
    tag_index.write_tag_index(view(spark, sf_dir), root)
    return _listed(tag_index.rows_with_all_tags(spark, root, ["Brand#1", "Brand#2"]))


@query(
    f"WITH {VIEW_SQL} SELECT count(*) AS total FROM view "
    "WHERE list_has_all(tech_stack, ['Brand#3', 'Brand#4', 'Brand#5'])"
)
def indexed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have all of three tags, from bitmaps alone."""
    root = scratch_path(spark, "tag-index")
    tag_index.write_tag_index(view(spark, sf_dir), root)
    return tag_index.count_with_all_tags(spark, root, ["Brand#3", "Brand#4", "Brand#5"])


@query(
    f"WITH {VIEW_SQL} SELECT {_LISTED_SQL} FROM view "
    "WHERE source = '2-HIGH' AND seniority = 'senior'"
)
def filter_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = serving.filter_conditions(source="2-HIGH", seniority="senior", remote="anything")
    return _listed(serving.filter_rows(view(spark, sf_dir), conditions))


@query(f"WITH {VIEW_SQL} SELECT {_LISTED_SQL} FROM view WHERE is_remote IS NULL")
def filter_workplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = serving.filter_conditions(remote="null")
    return _listed(serving.filter_rows(view(spark, sf_dir), conditions))


@query(
    f"WITH {VIEW_SQL} SELECT count(*) AS total FROM view "
    "WHERE list_contains(tech_stack, 'Brand#3') AND is_remote"
)
def listing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = serving.filter_conditions(tags=["Brand#3"], remote="true")
    return serving.total_count(serving.filter_rows(view(spark, sf_dir), conditions))


@query(
    f"WITH {VIEW_SQL} SELECT {_LISTED_SQL} FROM view WHERE list_contains(tech_stack, 'Brand#3') "
    "ORDER BY view.first_seen_at DESC, id LIMIT 30 OFFSET 30"
)
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = serving.filter_conditions(tags=["Brand#3"])
    rows = serving.filter_rows(view(spark, sf_dir), conditions)
    return _listed(serving.page(rows, 2, presets.PAGE_SIZE))


@query(
    f"WITH {VIEW_SQL} SELECT {_LISTED_SQL} FROM view "
    "ORDER BY view.first_seen_at, id LIMIT 30 OFFSET 10170"
)
def listing_far_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(serving.page(view(spark, sf_dir), 340, presets.PAGE_SIZE, ascending=True))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("company"),
        F.array("p_brand").alias("tech_stack"),
        F.col("p_retailprice").alias("first_seen_at"),
    )


def _search_sql(text: str, tag: str) -> str:
    return f"""
    WITH a AS (SELECT 0 AS branch, * FROM part
               WHERE p_name ILIKE '%{text}%' OR p_type ILIKE '%{text}%'
               ORDER BY p_retailprice DESC, p_partkey LIMIT 10),
         b AS (SELECT 1 AS branch, * FROM part WHERE p_brand = '{tag}'
               ORDER BY p_retailprice DESC, p_partkey LIMIT 10),
         u AS (SELECT min(branch) AS branch, p_partkey, p_name, p_type, p_brand, p_retailprice
               FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
    SELECT p_partkey AS id, p_name AS title, p_type AS company, p_brand AS tags,
           row_number() OVER (ORDER BY branch, p_retailprice DESC, p_partkey) AS position
    FROM (SELECT * FROM u ORDER BY branch, p_retailprice DESC, p_partkey LIMIT 10)"""


def _search(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    found = serving.search(_parts(spark, sf_dir), text, presets.SEARCH_LIMIT)
    return found.select("id", "title", "company", text_of("tech_stack").alias("tags"), "position")


@query(_search_sql("ring", "Ring"))
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, " ring ")


@query(_search_sql("brand#7", "Brand#7"))
def search_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "brand#7")


# --- headline figures and facets -----------------------------------------------------------


@query(f"""
WITH {VIEW_SQL}
SELECT count(*) AS active_roles,
       count(*) FILTER (first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS) AS new_today,
       count(DISTINCT company) AS company_count,
       CAST(round(100.0 * count(*) FILTER (is_remote IS NOT FALSE) / count(*), 1) AS DOUBLE)
         AS remote_percent,
       strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS last_updated,
       date_diff('minute', max(fetched_at), TIMESTAMP '{AS_OF}') >= 36 * 60 AS stale
FROM view""")
def kpi_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = metrics.kpis(view(spark, sf_dir), as_of(), presets.STALE_AFTER_HOURS)
    return one.withColumn("last_updated", time_text("last_updated")).withColumn(
        "remote_percent", F.col("remote_percent").cast("double")
    )


# after the last shipment, so that the age of the data is a past one
RECORD_AT = "2002-01-31 12:00:00"


@query(f"""
WITH {VIEW_SQL},
s AS (SELECT source AS v, count(*) AS n FROM view WHERE source IS NOT NULL GROUP BY 1),
l AS (SELECT seniority AS v, count(*) AS n FROM view WHERE seniority IS NOT NULL GROUP BY 1),
w AS (SELECT coalesce(CAST(is_remote AS VARCHAR), 'null') AS v, count(*) AS n FROM view GROUP BY 1),
t AS (SELECT DISTINCT unnest(tech_stack) AS v FROM view),
m AS (SELECT max(fetched_at) AS latest FROM view)
SELECT (SELECT count(*) FROM view) AS active_roles,
       (SELECT count(*) FROM view WHERE first_seen_at >= TIMESTAMP '{RECORD_AT}' - INTERVAL 24 HOURS)
         AS new_today,
       (SELECT count(DISTINCT company) FROM view) AS company_count,
       (SELECT CAST(round(100.0 * count(*) FILTER (is_remote IS NOT FALSE) / count(*), 1) AS DOUBLE)
        FROM view) AS remote_percent,
       (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM s) AS source_counts,
       (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM l) AS seniority_counts,
       (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM w) AS workplace_counts,
       (SELECT string_agg(v, ',' ORDER BY v) FROM s) AS source_options,
       (SELECT string_agg(v, ',' ORDER BY v) FROM t WHERE v <> '') AS tech_options,
       strftime(latest, '%Y-%m-%d %H:%M:%S') AS last_updated,
       CAST(floor(epoch(TIMESTAMP '{RECORD_AT}' - latest) / 86400) AS BIGINT) || ' days ago' AS updated_text,
       epoch(TIMESTAMP '{RECORD_AT}' - latest) >= 36 * 3600 AS stale
FROM m""")
def kpi_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = metrics.kpi_record(view(spark, sf_dir), as_of(RECORD_AT), presets.STALE_AFTER_HOURS)

    def pairs(counts: str) -> F.Column:
        listed = F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.array_join(listed, ",")

    return one.withColumns(
        {
            **{c: pairs(c) for c in ("source_counts", "seniority_counts", "workplace_counts")},
            **{c: text_of(c) for c in ("source_options", "tech_options")},
            "last_updated": time_text("last_updated"),
            "remote_percent": F.col("remote_percent").cast("double"),
        }
    )


@query(f"""
WITH {VIEW_SQL}
SELECT 'source' AS facet, source AS value, count(*) AS count FROM view
WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'seniority', seniority, count(*) FROM view
WHERE seniority IS NOT NULL GROUP BY seniority
UNION ALL SELECT 'workplace', coalesce(CAST(is_remote AS VARCHAR), 'null'), count(*) FROM view
GROUP BY 2""")
def global_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.facet_counts(view(spark, sf_dir), metrics.standard_facets())


_FACET_SQL = f"""
WITH {VIEW_SQL},
c AS (SELECT *, list_contains(tech_stack, 'Brand#3') AS t, source = '1-URGENT' AS s,
             is_remote IS NULL AS w, coalesce(seniority = 'senior', FALSE) AS l FROM view),
f AS (SELECT 'source' AS facet, source AS value, count(*) FILTER (t AND w AND l) AS count
      FROM c WHERE source IS NOT NULL GROUP BY source
      UNION ALL SELECT 'workplace', coalesce(CAST(is_remote AS VARCHAR), 'null'),
                       count(*) FILTER (t AND s AND l) FROM c GROUP BY 2
      UNION ALL SELECT 'seniority', seniority, count(*) FILTER (t AND s AND w)
                FROM c WHERE seniority IS NOT NULL GROUP BY seniority)"""


def _filters():
    return serving.filter_conditions(
        tags=["Brand#3"], source="1-URGENT", remote="null", seniority="senior"
    )


@query(f"{_FACET_SQL} SELECT * FROM f WHERE count > 0")
def contextual_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contextual_facets(
        view(spark, sf_dir), metrics.standard_facets(), _filters()
    )


@query(f"""{_FACET_SQL}
SELECT * FROM f WHERE count > 0 OR facet <> 'seniority'
UNION ALL SELECT 'source', '9-NEVER', 0""")
def zero_filled_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.zero_filled_facets(
        view(spark, sf_dir),
        metrics.standard_facets(),
        _filters(),
        {"workplace": ["true", "false", "null"], "source": ["9-NEVER"]},
    )


@query(f"WITH {VIEW_SQL} SELECT DISTINCT unnest(tech_stack) AS tag FROM view")
def tag_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tag_options(view(spark, sf_dir))


@query(f"WITH {VIEW_SQL} SELECT DISTINCT source FROM view")
def source_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_options(view(spark, sf_dir))


# --- saved filters ------------------------------------------------------------------------

# Every customer segment, priority and status seen in the data gives stored filters.
_QUERY_TEXTS = [
    "concat('tech=brand%23', n_nationkey + 1, ',+Brand%23', n_regionkey + 7, '&sort=asc')",
    "concat('tech=BRAND%23', n_nationkey + 1, '&remote=true&source=', n_regionkey + 1, '-', 'HIGH')",
    "concat('seniority=senior&remote=', if(n_regionkey > 2, 'false', 'hybrid'))",
    "concat('source=', '2-HIGH', '&seniority=director&tech=')",
    "if(n_regionkey = 0, '', concat('tech=,', '%20'))",
]


def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored filters made from the nation table, several query shapes per nation."""
    nations = table(spark, sf_dir, "nation")
    shapes = [F.expr(f"concat('', {text})") for text in _QUERY_TEXTS]
    rows = nations.select(
        "n_nationkey", "n_regionkey", F.posexplode(F.array(*shapes)).alias("shape", "query")
    )
    return rows.select(
        F.concat("n_nationkey", F.lit("/"), "shape").alias("filter_id"),
        "query",
        (F.col("n_regionkey") != 3).alias("enabled"),
    )


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.parse_filters(
        saved_filters(spark, sf_dir), presets.SENIORITY_LABELS, presets.WORKPLACE_LABELS
    )


_PARSED_SQL = """
parsed AS (
  SELECT n_nationkey || '/0' AS filter_id, n_regionkey <> 3 AS enabled,
         ['brand#' || (n_nationkey + 1), 'brand#' || (n_regionkey + 7)] AS tags,
         NULL AS seniority, NULL AS source, NULL AS workplace,
         'brand#' || (n_nationkey + 1) || '/Brand#' || (n_regionkey + 7) AS filter_name,
         'tech: brand#' || (n_nationkey + 1) || ', Brand#' || (n_regionkey + 7) AS filter_summary
  FROM nation
  UNION ALL
  SELECT n_nationkey || '/1', n_regionkey <> 3, ['brand#' || (n_nationkey + 1)], NULL,
         (n_regionkey + 1) || '-HIGH', 'true', 'BRAND#' || (n_nationkey + 1) || ' · Remote',
         'tech: BRAND#' || (n_nationkey + 1) || ' · workplace: Remote · source: '
           || (n_regionkey + 1) || '-HIGH'
  FROM nation
  UNION ALL
  SELECT n_nationkey || '/2', n_regionkey <> 3, NULL, 'senior', NULL,
         CASE WHEN n_regionkey > 2 THEN 'false' ELSE 'hybrid' END,
         CASE WHEN n_regionkey > 2 THEN 'Senior · On-site' ELSE 'Senior' END,
         CASE WHEN n_regionkey > 2 THEN 'seniority: Senior · workplace: On-site'
              ELSE 'seniority: Senior' END
  FROM nation
  UNION ALL
  SELECT n_nationkey || '/3', n_regionkey <> 3, NULL, 'director', '2-HIGH', NULL, 'Director',
         'seniority: Director · source: 2-HIGH'
  FROM nation
  UNION ALL
  SELECT n_nationkey || '/4', n_regionkey <> 3, CASE WHEN n_regionkey <> 0 THEN [] END,
         NULL, NULL, NULL, 'All roles',
         CASE WHEN n_regionkey = 0 THEN 'No active filters — matches all roles'
              ELSE 'tech: , ' END
  FROM nation)"""

_MATCH_SQL = """
matched AS (
  SELECT v.id, p.filter_id, p.enabled FROM view v JOIN parsed p
  ON (p.tags IS NULL OR list_has_any(list_transform(v.tech_stack, lambda t: lower(t)), p.tags))
     AND (p.seniority IS NULL OR p.seniority = v.seniority)
     AND (p.source IS NULL OR p.source = v.source)
     AND (p.workplace IS NULL OR v.is_remote IS NOT DISTINCT FROM
            CASE p.workplace WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END)
  WHERE NOT (p.filter_id LIKE '%/4'))"""


@query(f"""WITH {_PARSED_SQL}
SELECT filter_id, enabled, array_to_string(tags, ',') AS tags, seniority, source, workplace,
       filter_name, filter_summary FROM parsed""")
def saved_filters_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).drop("query").withColumn("tags", text_of("tags"))


@query(f"WITH {VIEW_SQL}, {_PARSED_SQL}, {_MATCH_SQL} SELECT id, filter_id FROM matched")
def saved_filter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.match_filters(view(spark, sf_dir), _parsed(spark, sf_dir))


@query(f"""WITH {VIEW_SQL}, {_PARSED_SQL}, {_MATCH_SQL}
SELECT id, id IN (SELECT id FROM matched WHERE enabled) AS matches_filter FROM view""")
def saved_filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = alerts.flag_matches(view(spark, sf_dir), _parsed(spark, sf_dir))
    return flagged.select("id", "matches_filter")


# --- rows chosen for enrichment ---------------------------------------------------------------


def document_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored postings; a label means that version ``q<quality>`` has run."""
    labels = table(spark, sf_dir, "labels")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            "source",
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("description_html"),
            (F.col("n_chars") > 200).alias("is_active"),
            (F.col("lang") != "es").alias("is_qc"),
            F.array("lang").alias("tech_stack"),
            F.timestamp_seconds("n_chars").alias("first_seen_at"),
            F.concat(F.lit("q"), "quality").alias("enriched_prompt_hash"),
        )
    )


@query("""
SELECT d.doc_id AS id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE n_chars > 200 AND d.source IN ('src1', 'src2', 'src3')
  AND (quality IS NULL OR quality <> 1)
ORDER BY n_chars, d.doc_id LIMIT 200""")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.pending_enrichment(
        document_jobs(spark, sf_dir), "q1", ["src1", "src2", "src3"], limit=200
    )
    return rows.select("id", "source")


@query("""
SELECT doc_id AS id, source FROM documents
WHERE n_chars > 200 AND lang <> 'es' AND source = 'src7' ORDER BY doc_id LIMIT 20""")
def dry_run_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.sample_rows(document_jobs(spark, sf_dir), 20, "src7")
    return rows.select("id", "source")


@query(f"""WITH {JOBS_SQL}
SELECT id, count(*) AS n FROM jobs GROUP BY id HAVING count(*) > 1""")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.operators.keys import duplicate_keys

    return duplicate_keys(jobs(spark, sf_dir), ["id"])


@query(f"""WITH {JOBS_SQL}
SELECT company, source, count(*) AS n FROM jobs GROUP BY ALL HAVING count(*) > 1""")
def repeated_company_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.operators.keys import duplicate_keys

    return duplicate_keys(jobs(spark, sf_dir), ["company", "source"])
