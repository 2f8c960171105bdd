"""Queries for the model-input table, stored enrichment runs and the log of merged runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import merge, model_input, serving
from tagloom.operators.summaries import refreshed_summary
from tagloom.plans.ingest_queries import (
    _POSTINGS_SQL,
    document_companies,
    document_payloads,
)
from tagloom.plans.registry import query
from tagloom.plans.serving_queries import document_jobs
from tagloom.plans.tables import table, text_of, time_text
from tagloom.plans.text_queries import _STRIP_SQL
from tagloom.session import scratch_path
from tagloom.streaming.enrichment import request_enrichment, store_answers
from tagloom.streaming.landing import ingest_landed, read_log

_HASH = "4f2a91c7"
_AS_OF = "2026-05-05 00:00:00"
_SOURCES = ["src1", "src2", "src3"]

# (day, pages that land then, payload): some land twice on a day, some only after the run
_LANDINGS = [
    ("2026-05-01", "page_id % 5 <> 4", "'# ' || url || chr(10) || '- ' || html"),
    ("2026-05-03", "page_id % 3 = 0", "'**' || url || '** ' || html"),
    ("2026-05-03", "page_id % 6 = 0", "'a ' || html"),
    ("2026-05-09", "true", "'too late'"),
]


def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the landed detail pages of one source, in several landings."""
    pages = table(spark, sf_dir, "pages")
    code = F.upper(F.md5(F.col("page_id").cast("string").cast("binary")))
    parts = [
        pages.where(chosen).select(
            F.lit("src2").alias("source"),
            F.concat(F.lit("https://apply.example/x/jobs/view/"), code, F.lit(".md")).alias("detail_url"),
            F.lit(day).cast("timestamp").alias("landed_at"),
            F.expr(payload.replace("chr(10)", "'\\n'")).alias("payload"),
        )
        for day, chosen, payload in _LANDINGS
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _posting_url(number: F.Column) -> F.Column:
    code = F.upper(F.md5(number.cast("string").cast("binary")))
    return F.concat(F.lit("https://apply.example/x/j/"), code)


_PAGE_TEXT_SQL = "payload"
for _pattern, _replacement in [
    (r"(?m)^#{1,6}[\s\v]+", ""),
    (r"\*\*([^*]+)\*\*", r"\1"),
    (r"\*([^*]+)\*", r"\1"),
    (r"(?m)^[-*][\s\v]+", ""),
    (r"[\s\v]+", " "),
]:
    _PAGE_TEXT_SQL = f"regexp_replace({_PAGE_TEXT_SQL}, '{_pattern}', '{_replacement}', 'g')"

_LANDED_SQL = " UNION ALL ".join(
    f"SELECT page_id, TIMESTAMP '{day}' AS landed, {payload} AS payload FROM pages WHERE {chosen}"
    for day, chosen, payload in _LANDINGS
)


@query(f"""
WITH pending AS (
  SELECT d.doc_id AS id, d.source, split_part(text, chr(10), 1) AS title, text, lang = 'fr' AS gated,
         CASE WHEN d.source = 'src2' THEN d.doc_id % 400 END AS page_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE n_chars > 200 AND d.source IN ('src1', 'src2', 'src3') AND (quality IS NULL OR quality <> 1)),
landed AS ({_LANDED_SQL}),
newest AS (
  SELECT page_id, max(landed) AS detail_at, arg_max(payload, row(landed, payload)) AS payload
  FROM landed WHERE landed <= TIMESTAMP '{_AS_OF}' GROUP BY page_id),
bodies AS (
  SELECT p.*, n.detail_at, CASE WHEN source = 'src2' THEN coalesce(trim({_PAGE_TEXT_SQL}), '')
         ELSE {_STRIP_SQL.format('text')} END AS body
  FROM pending p LEFT JOIN newest n USING (page_id))
SELECT id, source, gated, strftime(detail_at, '%Y-%m-%d %H:%M:%S') AS detail_at, '{_HASH}' AS prompt_hash,
       CASE WHEN NOT gated THEN 'Title: ' || title || chr(10) || chr(10) || 'Description:' || chr(10)
         || CASE WHEN body = '' THEN '(no description available)'
                 WHEN length(body) > 2000 THEN substr(body, 1, 2000) || '…' ELSE body END END AS message
FROM bodies""")
def model_input_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of all pending documents; one source reads its landed pages."""
    rows = document_jobs(spark, sf_dir).withColumn("source_url", _posting_url(F.col("id") % 400))
    pending = serving.pending_enrichment(rows, "q1", _SOURCES, limit=None)
    found = model_input.model_inputs(
        pending,
        page_details(spark, sf_dir),
        F.lit(_AS_OF).cast("timestamp"),
        _HASH,
        gated=F.array_contains("tech_stack", "fr"),
        page_sources=["src2"],
    )
    return found.select(
        "id", "source", "gated", time_text("detail_at").alias("detail_at"), "prompt_hash", "message"
    )


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored rows of the versioned table."""
    doc = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.col("source"),
        doc.alias("external_id"),
        F.concat(F.lit("c"), (F.col("doc_id") % 40).cast("string")).alias("company_slug"),
        F.concat(F.lit("Engineer "), "lang").alias("title"),
        F.col("text").alias("description_html"),
        _posting_url(F.col("doc_id") % 400).alias("source_url"),
        F.array("lang").alias("tech_stack"),
        (F.col("n_chars") > 200).alias("is_active"),
        F.timestamp_seconds("n_chars").alias("first_seen_at"),
    )
    return merge.empty_jobs(spark).unionByName(rows, allowMissingColumns=True)


@query(f"""
WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 200 AND source IN ('src1', 'src2', 'src3')
           ORDER BY n_chars, CAST(doc_id AS VARCHAR) LIMIT 150),
a AS (SELECT doc_id, toxic FROM labels)
SELECT CAST(d.doc_id AS VARCHAR) AS id, n_chars > 200 AS is_active,
       CASE WHEN p.doc_id IS NOT NULL THEN '{_HASH}' END AS enriched_prompt_hash,
       CASE WHEN p.doc_id IS NOT NULL THEN '{_AS_OF}' END AS enriched_at,
       CASE WHEN p.doc_id IS NULL THEN NULL WHEN lang = 'fr' OR toxic IS NULL THEN '' ELSE 'tool' || toxic END
         AS model_tags,
       CASE WHEN p.doc_id IS NULL THEN NULL WHEN lang = 'fr' THEN 'skipped' WHEN toxic IS NULL THEN 'error'
            ELSE 'enriched' END AS status
FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN a USING (doc_id)""")
def stored_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored version, its requests, their answers, and the version that has the results."""
    target, as_of = scratch_path(spark, "jobs"), F.lit(_AS_OF).cast("timestamp")
    merge.write_version(stored_documents(spark, sf_dir), target, "20260501T060000-0000000000")
    request_enrichment(
        spark, target, page_details(spark, sf_dir), "weekly", as_of, _HASH, _SOURCES,
        gated=F.array_contains("tech_stack", "fr"), limit=150,
    )
    answers = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit('{"technologies": ["tool'), "toxic", F.lit('"]}')).alias("answer"),
    )
    results = store_answers(spark, target, "weekly", answers, as_of)
    stored = merge.read_version(spark, target, merge.latest_version(spark, target))
    return stored.join(results.select("id", "status"), "id", "left").select(
        "id", "is_active", "enriched_prompt_hash", time_text("enriched_at").alias("enriched_at"),
        text_of("enriched_tech_stack").alias("model_tags"), "status",
    )


@query(f"""WITH {_POSTINGS_SQL},
a AS (SELECT * FROM postings WHERE is_qc),
b AS (SELECT * FROM a WHERE n_chars > 2000)
SELECT '20260501T060000' AS run_id, (SELECT count(*) FROM postings) AS fetched,
       (SELECT count(*) FROM a) AS upserted, 0 AS deactivated
UNION ALL
SELECT '20260502T060000', (SELECT count(*) FROM postings WHERE n_chars > 2000), (SELECT count(*) FROM b),
       (SELECT count(*) FROM a WHERE n_chars <= 2000 AND EXISTS (
          SELECT 1 FROM b WHERE b.source = a.source AND b.company_slug = a.company_slug))""")
def ingestion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after two runs and a late file for the first one, which makes both be merged again."""
    landing, target, state = (scratch_path(spark, n) for n in ("landing", "jobs", "stream"))
    payloads, companies = document_payloads(spark, sf_dir), document_companies(spark, sf_dir)

    def land(run_id: str, rows: DataFrame) -> None:
        folder = f"{landing}/run_id={run_id}"
        rows.drop("n_chars").write.mode("append").partitionBy("source", "kind").json(folder)
        ingest_landed(spark, landing, companies, target, state).awaitTermination()

    land("20260501T060000", payloads.where("source <> 'lever'"))
    land("20260502T060000", payloads.where("n_chars > 2000"))
    land("20260501T060000", payloads.where("source = 'lever'"))
    return read_log(spark, target).select("run_id", "fetched", "upserted", "deactivated")


_CHANGED_SQL = """
state AS (
  SELECT doc_id, source, doc_id % 40 AS company, n_chars, lang,
         n_chars > 200 AND NOT (doc_id % 40 % 4 = 1 AND n_chars <= 1000) AND NOT doc_id % 40 = 7 AS active,
         CASE WHEN doc_id % 40 % 4 = 2 THEN 'X' ELSE lang END AS tag,
         CASE WHEN doc_id % 40 % 4 = 2 THEN 'senior' END AS seniority
  FROM documents),
kept AS (SELECT * FROM state WHERE active AND lang <> 'es')"""


@query(f"""WITH {_CHANGED_SQL}
SELECT 'rows' AS "group", '' AS value, count(*) AS n FROM kept HAVING count(*) > 0
UNION ALL SELECT 'remote', '', count(*) FROM kept HAVING count(*) > 0
UNION ALL SELECT 'company', 'C' || company, count(*) FROM kept GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM kept WHERE source IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'seniority', seniority, count(*) FROM kept WHERE seniority IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'tag', tag, count(*) FROM kept GROUP BY ALL""")
def maintained_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after three versions, brought up to date from the first and the third one."""
    target = scratch_path(spark, "jobs")
    company = F.concat(F.lit("C"), F.substring("company_slug", 2, 9))
    number = F.substring("company_slug", 2, 9).cast("int")
    none = F.lit(None).cast("string")
    first = stored_documents(spark, sf_dir).withColumns(
        {"company": company, "is_qc": ~F.array_contains("tech_stack", "es")}
    )
    merge.write_version(first, target, "1")
    refreshed_summary(spark, target)

    def change(version: str, before: str, chosen: F.Column, changes: dict[str, F.Column]) -> None:
        touched = merge.touched_buckets(first.where(chosen))
        rows = merge.read_version(spark, target, before, touched)
        new = rows.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in changes.items()})
        merge.write_version(new, target, version, before, touched)

    short = F.unix_seconds("first_seen_at") <= 1000
    change("2", "1", ((number % 4 == 1) & short) | (number == 7), {"is_active": F.lit(False)})
    change("3", "2", number % 4 == 2, {"tech_stack": F.array(F.lit("X")), "seniority": F.lit("senior"), "department": none})
    found = refreshed_summary(spark, target)
    return found.where(F.col("group").isin("rows", "remote", "company", "source", "seniority", "tag"))
