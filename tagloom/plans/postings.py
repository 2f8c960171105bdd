"""Landed payloads to canonical posting rows, one specification per source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import coerce
from tagloom.functions.patterns import matches
from tagloom.functions.rules import Keyword, Rule, first_match, with_keyword_tags
from tagloom.plans import presets
from tagloom.sources import landed

JOB_COLUMNS = [
    "source", "external_id", "company", "company_slug", "title", "department", "location",
    "description_html", "source_url", "is_qc", "is_remote", "seniority", "tech_stack",
    "employment_type", "posted_at", "is_active",
]


@dataclass(frozen=True)
class Field:
    """Column ``name`` is the raw value at ``path``, converted to ``kind``."""

    name: str
    path: str
    kind: str = "string"
    empty_as_null: bool = False
    append_array: tuple[str, str] | None = None


@dataclass(frozen=True, eq=False)
class PostingSpec:
    source: str
    fields: Sequence[Field]
    required: Sequence[str]
    region: Sequence[Rule]
    workplace: Sequence[Rule]
    seniority: Sequence[Rule]
    employment: Sequence[Rule]
    keywords: Sequence[Keyword]
    list_key: str | None = None


GREENHOUSE = PostingSpec(
    source="greenhouse",
    list_key="jobs",
    required=["id", "title", "absolute_url"],
    fields=[
        Field("external_id", "id"),
        Field("title", "title"),
        Field("source_url", "absolute_url"),
        Field("location", "location.name"),
        Field("department", "departments.0.name"),
        Field("description_html", "content", empty_as_null=True),
        Field("posted_at", "updated_at", "datetime"),
    ],
    region=presets.WIDE_REGION_RULES,
    workplace=presets.WORKPLACE_RULES["greenhouse"],
    seniority=presets.SENIORITY_RULES,
    employment=presets.EMPLOYMENT_RULES["greenhouse"],
    keywords=presets.KEYWORDS,
)

LEVER = PostingSpec(
    source="lever",
    required=["id", "text", "hostedUrl"],
    fields=[
        Field("external_id", "id"),
        Field("title", "text"),
        Field("source_url", "hostedUrl"),
        Field("location", "categories.location"),
        Field("department", "categories.department"),
        Field(
            "description_html", "description", empty_as_null=True, append_array=("lists", "content")
        ),
        Field("posted_at", "createdAt", "unix_ms"),
        Field("_workplace_type", "workplaceType"),
        Field("_commitment", "categories.commitment"),
    ],
    region=presets.REGION_RULES,
    workplace=presets.WORKPLACE_RULES["lever"],
    seniority=presets.SENIORITY_RULES,
    employment=presets.EMPLOYMENT_RULES["lever"],
    keywords=presets.PLATFORMS_LAST,
)

WORKABLE_COLUMNS = [
    "title", "department", "location", "_employment_raw", "_salary", "_posted_raw", "_detail_url",
]

WORKABLE = PostingSpec(
    source="workable",
    required=["external_id", "title", "source_url"],
    fields=[
        Field("external_id", "external_id"),
        Field("source_url", "source_url"),
        Field("description_html", "description_html"),
        Field("title", "title"),
        Field("department", "department"),
        Field("location", "location"),
        Field("posted_at", "_posted_raw", "date"),
        Field("_employment_raw", "_employment_raw"),
    ],
    region=presets.REGION_RULES,
    workplace=presets.WORKPLACE_RULES["workable"],
    seniority=presets.WIDE_SENIORITY_RULES,
    employment=presets.EMPLOYMENT_RULES["workable"],
    keywords=presets.dictionary(presets.TABLE_SOURCE_TAGS),
)

WORKDAY = PostingSpec(
    source="workday",
    list_key="jobPostings",
    required=["title", "_external_id"],
    fields=[
        Field("external_id", "_external_id"),
        Field("source_url", "_source_url"),
        Field("title", "title"),
        Field("location", "locationsText"),
        Field("description_html", "description_html"),
        Field("posted_at", "_posted_at", "datetime"),
    ],
    region=presets.WIDE_REGION_RULES,
    workplace=presets.WORKPLACE_RULES["workday"],
    seniority=presets.WIDE_SENIORITY_RULES,
    employment=presets.EMPLOYMENT_RULES["workday"],
    keywords=presets.KEYWORDS,
)

SPECS: Mapping[str, PostingSpec] = {s.source: s for s in (GREENHOUSE, LEVER, WORKABLE, WORKDAY)}


def is_non_tech_title(title: Column) -> Column:
    return F.coalesce(matches(title, presets.NON_TECH_TITLE), F.lit(False))


def _raw_value(rows: DataFrame, path: str) -> Column:
    """A prepared column of that name, else the path inside the raw payload."""
    if path in rows.columns:
        return F.col(path)
    return coerce.path_value(F.col("raw"), path) if "raw" in rows.columns else F.lit(None)


def has_required(rows: DataFrame, required: Sequence[str]) -> Column:
    """All required raw values are present and truthy."""
    tests = []
    for path in required:
        if path in rows.columns:
            tests.append(F.coalesce(F.col(path) != "", F.lit(False)))
        else:
            tests.append(coerce.is_truthy(path))
    return reduce(lambda a, b: a & b, tests)


def map_fields(rows: DataFrame, spec: PostingSpec, carry: Sequence[str] = ()) -> DataFrame:
    """Direct field mappings plus company name and slug, and the ``carry`` columns."""
    mapped = []
    for field in spec.fields:
        value = _raw_value(rows, field.path)
        if field.append_array:
            value = coerce.append_array_field(value, F.col("raw"), *field.append_array)
        if field.path in rows.columns and dict(rows.dtypes)[field.path] != "string":
            mapped.append(value.alias(field.name))  # already typed by the source
        else:
            mapped.append(coerce.coerce(value, field.kind, field.empty_as_null).alias(field.name))
    return rows.select("company", "company_slug", *carry, *mapped)


def derive(rows: DataFrame, spec: PostingSpec) -> DataFrame:
    """Rule-based columns: region, workplace, seniority, employment type and tags."""
    derived = rows.withColumns(
        {
            "is_qc": first_match(spec.region, False, "boolean"),
            "is_remote": first_match(spec.workplace, None, "boolean"),
            "seniority": first_match(spec.seniority),
            "employment_type": first_match(spec.employment),
        }
    )
    tagged = with_keyword_tags(derived, ["title", "description_html"], spec.keywords, "tech_stack")
    return tagged.withColumn(
        "tech_stack",
        F.when(is_non_tech_title(F.col("title")), F.array().cast("array<string>")).otherwise(
            F.col("tech_stack")
        ),
    )


def extract(
    raw_rows: DataFrame, spec: PostingSpec, gate: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """Validated, mapped and derived rows of one source in the canonical columns.

    Titles outside technical work are dropped before any tag is looked for; with
    ``gate=False`` they stay, with an empty tag array.
    """
    valid = raw_rows.where(has_required(raw_rows, spec.required))
    mapped = map_fields(valid, spec, carry)
    if gate:
        mapped = mapped.where(~is_non_tech_title(F.col("title")))
    rows = derive(mapped, spec)
    constants = {"source": F.lit(spec.source), "is_active": F.lit(True)}
    missing = F.lit(None).cast("string")
    return rows.select(
        *carry,
        *[
            name if name in rows.columns else constants.get(name, missing).alias(name)
            for name in JOB_COLUMNS
        ]
    )


def read_postings(
    payloads: DataFrame, companies: DataFrame, carry: Sequence[str] = ()
) -> DataFrame:
    """Canonical rows of all four sources.

    ``payloads`` has source, kind, company_slug, detail_url and payload (see
    ``sources.landed``), ``companies`` has source, slug, name, api_url and base_url. A
    source without readable payloads adds no rows. Columns in ``carry``, such as a run id,
    are kept, and lists and details meet only within them.
    """
    names = companies.select(
        "source",
        F.col("slug").alias("company_slug"),
        F.col("name").alias("company"),
        "api_url",
        "base_url",
    )
    # Spark broadcasts the company list by itself while it is below the size limit.
    known = payloads.join(names, ["source", "company_slug"])

    def lists(source: str) -> DataFrame:
        chosen = known.where((F.col("source") == source) & (F.col("kind") == "list"))
        return chosen.select(*carry, "company_slug", "company", "api_url", "base_url", "payload")

    def details(source: str) -> DataFrame:
        chosen = payloads.where((F.col("source") == source) & (F.col("kind") == "detail"))
        return chosen.select(*carry, F.col("detail_url").alias("_detail_url"), "payload")

    def attach(rows: DataFrame, pages: DataFrame) -> DataFrame:
        return landed.attach_details(rows, pages, "_detail_url", within=carry)

    table = landed.markdown_rows(lists("workable"), WORKABLE_COLUMNS, "_detail_url")
    absolute = details("workable").where(F.col("_detail_url").startswith("https://"))
    table = attach(table, absolute.withColumnRenamed("payload", "description_html"))
    with_api = lists("workday").where(F.coalesce(F.col("api_url"), F.lit("")) != "")
    board = landed.board_keys(landed.json_items(with_api, WORKDAY.list_key))
    board = attach(board, landed.board_details(details("workday")))
    raw = {
        GREENHOUSE: landed.json_items(lists("greenhouse"), GREENHOUSE.list_key),
        LEVER: landed.json_items(lists("lever"), LEVER.list_key),
        WORKABLE: table,
        WORKDAY: board,
    }
    rows = [extract(items, spec, carry=carry) for spec, items in raw.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def in_region(postings: DataFrame) -> DataFrame:
    """Rows that are stored at all."""
    return postings.where("is_qc")
