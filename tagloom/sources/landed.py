"""Readers for landed payloads: one JSON or markdown document per company and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.coerce import us_or_iso_date
from tagloom.functions.patterns import strip

# A landed payload: the whole answer of one request, kept as text. ``kind`` is "list" for
# the postings of a company and "detail" for the page at ``detail_url``.
PAYLOAD_SCHEMA = (
    "source string, kind string, company_slug string, detail_url string, payload string"
)

# The daily job writes JSON lines to run_id=<yyyyMMdd'T'HHmmss>/source=S/kind=K, so that the
# readers of one source and kind open no other files.
LANDING_SCHEMA = f"{PAYLOAD_SCHEMA}, run_id string"

_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def read_landed(
    spark: SparkSession, root: str, only: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Landed payloads below ``root``; run, source and kind come from the folders.

    With ``only`` just the folders of those runs and sources are listed.
    """
    reader = spark.read.schema(LANDING_SCHEMA).option("basePath", root)
    return reader.json(root if only is None else [f"{root}/run_id={r}/source={s}" for r, s in only])


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """List documents stored one per file as ``…/source=S/company=C/<file>``."""
    path = F.col("_metadata.file_path")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.regexp_extract(path, "/source=([^/]+)/", 1).alias("source"),
        F.lit("list").alias("kind"),
        F.regexp_extract(path, "/company=([^/]+)/", 1).alias("company_slug"),
        F.lit(None).cast("string").alias("detail_url"),
        F.col("value").alias("payload"),
    )


def json_items(payloads: DataFrame, list_key: str | None) -> DataFrame:
    """One row per element of the job list: variant ``raw`` and its position ``pos``.

    ``list_key`` names the list inside the document; None means the document is the
    list. Unreadable documents and missing lists yield no rows.
    """
    document = F.try_parse_json("payload")
    path = "$" if list_key is None else f"$.{list_key}"
    items = F.try_variant_get(document, path, "array<variant>")
    kept = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*kept, F.posexplode(items).alias("pos", "raw"))


def _cell_value(cell: Column) -> Column:
    link = r"^\[([^\]]+)\]\(([^)]+)\)\z"
    return F.when(F.rlike(cell, F.lit(link)), F.regexp_extract(cell, link, 2)).when(
        cell != "—", cell
    )


def markdown_rows(payloads: DataFrame, columns: Sequence[str], url_column: str) -> DataFrame:
    """Rows of the pipe table in each markdown document, one column per table column.

    Lines of another width, separator lines and a header spelled like ``columns`` are
    dropped. A dash cell becomes null and a link cell its url. ``external_id`` and
    ``source_url`` come from the detail url in ``url_column``; both are null when that
    url has another shape.
    """
    kept = [c for c in payloads.columns if c != "payload"]
    lines = payloads.select(
        *kept, F.posexplode(F.split("payload", _LINE_BREAK)).alias("pos", "line")
    )
    return table_rows(lines, columns, url_column)


def table_rows(lines: DataFrame, columns: Sequence[str], url_column: str) -> DataFrame:
    """``markdown_rows`` of the lines in ``line``; all other columns are kept."""
    kept = [c for c in lines.columns if c not in ("pos", "line")]
    inner = F.regexp_replace("line", r"^\|+|\|+\z", "")
    cells = F.transform(F.split(inner, r"\|"), strip)
    rows = (
        lines.where(F.startswith(F.col("line"), F.lit("|")))
        .withColumn("cells", cells)
        .where(F.size("cells") == len(columns))
        .where(~F.exists("cells", lambda c: F.rlike(c, F.lit(r"^[-: ]+\z"))))
        .where(F.get("cells", F.lit(0)) != columns[0])
    )
    rows = rows.select(
        *kept,
        "pos",
        *[_cell_value(F.get("cells", F.lit(i))).alias(name) for i, name in enumerate(columns)],
    )
    url = F.col(url_column)
    shortcode = F.nullif(F.regexp_extract(url, r"(?i)/view/([A-F0-9]+)\.md$", 1), F.lit(""))
    return rows.withColumn("external_id", shortcode).withColumn(
        "source_url",
        # the public form exists for upper-case codes only; other urls are kept as they are
        F.when(shortcode.isNotNull(), F.regexp_replace(url, r"/jobs/view/([A-F0-9]+)\.md$", "/j/$1")),
    )


def attach_details(
    rows: DataFrame,
    details: DataFrame,
    key: str,
    row_id: Sequence[str] = ("company_slug", "pos"),
    within: Sequence[str] = (),
) -> DataFrame:
    """Left join the detail columns by ``key``; rows without a detail keep nulls.

    One detail per key is kept, and per value of the ``within`` columns both sides have.
    Rows whose key is null can match nothing, so they get a key made from ``row_id`` and
    do not all meet in one shuffle partition.
    """
    payload = [c for c in details.columns if c != key and c not in within]
    one_each = (
        details.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"), *within)
        .agg(F.max(F.struct(*payload)).alias("__detail"))
    )
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*row_id).cast("string"))
    keyed = rows.withColumn("__key", F.coalesce(F.col(key), spread))
    return keyed.join(one_each, ["__key", *within], "left").select(
        *rows.columns, *[F.col(f"__detail.{c}").alias(c) for c in payload]
    )


def board_keys(
    rows: DataFrame, raw: str = "raw", api_url: str = "api_url", base_url: str = "base_url"
) -> DataFrame:
    """Ids and urls of job-board items: ``_external_id``, ``_source_url``, ``_detail_url``.

    The id is the requisition id, else the last part of the item path. Public urls need
    the site name before the path, detail urls need it removed.
    """
    path = F.coalesce(F.try_variant_get(raw, "$.externalPath", "string"), F.lit(""))
    req_id = F.nullif(F.try_variant_get(raw, "$.jobReqId", "string"), F.lit(""))
    api = F.rtrim(F.regexp_replace(api_url, r"/jobs\z", ""), F.lit("/"))
    site = F.substring_index(api, "/", -1)
    base = F.rtrim(F.coalesce(F.col(base_url), F.lit("")), F.lit("/"))
    prefix = F.concat(F.lit("/"), site)
    last_part = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    public_path = F.when(F.startswith(path, prefix), path).otherwise(F.concat(prefix, path))
    inner_path = F.when(
        F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)
    ).otherwise(path)
    return rows.select(
        "*",
        F.coalesce(req_id, F.when(path != "", last_part)).alias("_external_id"),
        F.when((base != "") & (path != ""), F.concat(base, public_path)).alias("_source_url"),
        F.when((api != "") & (path != ""), F.concat(api, inner_path)).alias("_detail_url"),
    )


def board_details(details: DataFrame) -> DataFrame:
    """Replace the JSON ``payload`` by ``description_html`` and ``_posted_at``."""
    info = F.try_parse_json("payload")

    def field(name: str) -> Column:
        value = F.try_variant_get(info, f"$.jobPostingInfo.{name}", "string")
        return F.nullif(value, F.lit(""))

    return details.select(
        *[c for c in details.columns if c != "payload"],
        field("jobDescription").alias("description_html"),
        us_or_iso_date(field("startDate")).alias("_posted_at"),
    )
