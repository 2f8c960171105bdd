"""Queries for the per-row derivations: rules, tags, markup, urls, display fields, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import coerce, text
from tagloom.functions.rules import (
    Keyword,
    Rule,
    first_match,
    keyword_evidence,
    segment,
    with_keyword_tags,
)
from tagloom.operators import enrich
from tagloom.plans import presets
from tagloom.plans.postings import is_non_tech_title
from tagloom.plans.registry import query
from tagloom.plans.tables import (
    AS_OF,
    BRAND_SEGMENTS,
    GROUP_OF,
    JOBS_SQL,
    SEGMENT_SQL,
    VIEW_SQL,
    as_of,
    jobs,
    sql_list,
    table,
    text_of,
    view,
)


_EDGE_L, _EDGE_R = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


def sql_quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- paths and types ------------------------------------------------------------------------


def _payload():
    """A nested payload built from an event."""
    return F.try_parse_json(
        F.to_json(
            F.struct(
                F.struct(F.col("event_type").alias("name")).alias("kind"),
                F.array(
                    F.struct(F.col("value").alias("n")), F.struct(F.col("user_id").alias("n"))
                ).alias("items"),
                F.get_json_object("props", "$.k").alias("k"),
            )
        )
    )


@query("""
SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS second,
       json_extract_string(props, '$.k') AS k, NULL AS missing FROM events""")
def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", _payload().alias("raw"))
    paths = {"kind": "kind.name", "second": "items.1.n", "k": "k", "missing": "items.7.n.deep"}
    values = [coerce.path_value(F.col("raw"), path).alias(name) for name, path in paths.items()]
    return raw.select("event_id", *values)


@query("""
SELECT event_id, strftime(ts - INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S') AS iso,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ms,
       CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS day,
       event_type = 'click' AS flag, CASE WHEN event_type <> 'error' THEN event_type END AS word
FROM events""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("iso"),
        F.concat(F.unix_seconds("ts"), F.lit("000")).alias("ms"),
        F.when(kind == "view", F.lit("2024-13-45"))
        .otherwise(F.date_format("ts", " yyyy-M-d "))
        .alias("day"),
        F.when(kind == "click", F.lit("YES")).otherwise(F.lit("no")).alias("flag"),
        F.when(kind == "error", F.lit("")).otherwise(kind).alias("word"),
    )
    return raw.select(
        "event_id",
        F.date_format(coerce.coerce(F.col("iso"), "datetime"), "yyyy-MM-dd HH:mm:ss").alias("iso"),
        F.date_format(coerce.coerce(F.col("ms"), "unix_ms"), "yyyy-MM-dd HH:mm:ss").alias("ms"),
        F.date_format(coerce.coerce(F.col("day"), "date"), "yyyy-MM-dd HH:mm:ss").alias("day"),
        coerce.coerce(F.col("flag"), "bool").alias("flag"),
        coerce.coerce(F.col("word"), "string", empty_as_null=True).alias("word"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
  WHEN o_orderstatus = 'P' THEN strftime(o_orderdate + INTERVAL 4 HOURS, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS started FROM orders""")
def start_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    written = (
        F.when(status == "O", F.date_format(day, "MM/dd/yyyy"))
        .when(status == "F", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("Posted 5 Days Ago"))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00")))
    )
    started = coerce.us_or_iso_date(written)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(started, "yyyy-MM-dd HH:mm:ss").alias("started")
    )


@query("""
SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE trim(lang || ' ' || text || ' ' || source,
       ' ' || chr(10) || chr(13) || chr(9)) END AS full_text FROM documents""")
def appended_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = F.array(
        F.struct(F.col("text").alias("content")),
        F.struct(F.lit("").alias("content")),
        F.struct(F.col("source").alias("content")),
    )
    raw = F.try_parse_json(
        F.to_json(F.struct(F.when(F.col("lang") != "de", sections).alias("lists")))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", raw.alias("raw"))
    return rows.select(
        "doc_id",
        coerce.append_array_field(F.col("lang"), F.col("raw"), "lists", "content").alias(
            "full_text"
        ),
    )


# --- first-match rules -----------------------------------------------------------------------

_TITLES = {
    "AUTOMOBILE": "Sr. Développeur Go",
    "BUILDING": "Stagiaire – Marketing Manager",
    "FURNITURE": "Tech Lead (Remote)",
    "HOUSEHOLD": "GESTIONNAIRE de Médias, contractuel",
    "MACHINERY": "Expérimenté / EXPÉRIMENTÉ adjoint Part time",
}
_PLACES = ["Montréal, QC", "QUÉBEC (Hybrid)", "Toronto – Remote", "LAVAL on-site", "Saint-Jean"]


def _candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as postings: title from the market segment, place from the region."""
    title = F.lit(None).cast("string")
    for name, value in _TITLES.items():
        title = F.when(F.col("c_mktsegment") == name, F.lit(value)).otherwise(title)
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    places = F.array(*[F.lit(p) for p in _PLACES])
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        "c_custkey",
        F.concat_ws(" ", title, "c_name").alias("title"),
        F.when(F.col("c_nationkey") != 7, F.get(places, F.col("n_regionkey"))).alias("location"),
    )


_CANDIDATES_SQL = f"""
cand AS (
  SELECT c_custkey, CASE c_mktsegment
    {" ".join(f"WHEN {sql_quote(k)} THEN {sql_quote(v)}" for k, v in _TITLES.items())} END
      || ' ' || c_name AS title,
    CASE WHEN c_nationkey <> 7 THEN list_extract({sql_list(_PLACES)}, n_regionkey + 1) END
      AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _sql_edges(pattern: str) -> str:
    """Word edges around a group, which SQL would otherwise take for ASCII letters only."""
    return pattern.replace(r"\b(", _EDGE_L + "(").replace(r")\b", ")" + _EDGE_R)


def _rules_sql(rules: list[Rule], default: str) -> str:
    """Ordered rules as a CASE."""

    def literal(value: object) -> str:
        return "NULL" if value is None else str(value).upper() if value in (True, False) else sql_quote(value)

    cases = " ".join(
        f"WHEN regexp_matches({r.field}, {sql_quote(_sql_edges(r.pattern))}) THEN {literal(r.value)}"
        for r in rules
    )
    return f"CASE {cases} ELSE {default} END" if rules else default


@query(f"""WITH {_CANDIDATES_SQL}
SELECT c_custkey, {_rules_sql(presets.WIDE_REGION_RULES, 'FALSE')} AS is_qc,
       {_rules_sql(presets.WORKPLACE_RULES["greenhouse"], 'NULL')} AS is_remote,
       {_rules_sql(presets.WORKPLACE_RULES["workable"], 'NULL')} AS table_is_remote,
       {_rules_sql(presets.WIDE_SENIORITY_RULES, 'NULL')} AS seniority,
       {_rules_sql(presets.EMPLOYMENT_RULES["greenhouse"], 'NULL')} AS employment_type,
       regexp_matches(title, {sql_quote(_sql_edges(presets.NON_TECH_TITLE))}) AS non_tech
FROM cand""")
def posting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_rows(spark, sf_dir).select(
        "c_custkey",
        first_match(presets.WIDE_REGION_RULES, False, "boolean").alias("is_qc"),
        first_match(presets.WORKPLACE_RULES["greenhouse"], None, "boolean").alias("is_remote"),
        first_match(presets.WORKPLACE_RULES["workable"], None, "boolean").alias("table_is_remote"),
        first_match(presets.WIDE_SENIORITY_RULES).alias("seniority"),
        first_match(presets.EMPLOYMENT_RULES["greenhouse"]).alias("employment_type"),
        is_non_tech_title(F.col("title")).alias("non_tech"),
    )


_PAGE_RULES = [
    Rule("url", r"(?i)^https?://M\.", "mobile"),
    Rule("url", r"#top$", None),
    Rule("url", r"\bblog\b", "blog"),
    Rule("url", r"\.html$|\?page=\d+", "document"),
]


@query(f"SELECT page_id, {_rules_sql(_PAGE_RULES, sql_quote('site'))} AS kind FROM pages")
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", first_match(_PAGE_RULES, "site").alias("kind")
    )


@query(f"""WITH {_CANDIDATES_SQL}
SELECT c_custkey, CASE WHEN regexp_matches(title, '(?i)[{presets.FRENCH_ACCENTS}]') THEN 'fr'
  WHEN regexp_matches(title, '(?i)\\b({"|".join(presets.ENGLISH_TITLE_WORDS)})\\b') THEN 'en'
  WHEN regexp_matches(title, '(?i)\\b({"|".join(presets.FRENCH_TITLE_WORDS)})\\b') THEN 'fr' END
  AS language FROM cand""")
def title_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = text.title_language(
        F.col("title"),
        presets.FRENCH_ACCENTS,
        presets.ENGLISH_TITLE_WORDS,
        presets.FRENCH_TITLE_WORDS,
    )
    return _candidate_rows(spark, sf_dir).select("c_custkey", language.alias("language"))


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[{presets.FRENCH_ACCENTS}]') THEN 'fr'
  WHEN regexp_matches(text, '(?i)\\b(the|und|of)\\b') THEN 'en'
  WHEN regexp_matches(text, '(?i)\\b(el|les)\\b') THEN 'fr' END AS language FROM documents""")
def text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = text.title_language(
        F.col("text"), presets.FRENCH_ACCENTS, ["the", "und", "of"], ["el", "les"]
    )
    return table(spark, sf_dir, "documents").select("doc_id", language.alias("language"))


# --- markup ------------------------------------------------------------------------------------

_STRIP_SQL = (
    "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[\\s\\v]+', ' ', 'g'))"
)
# The four references the pages hold; some are cut off before their semicolon.
_DECODE_SQL = "{0}"
for _name, _char in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
    _DECODE_SQL = f"regexp_replace({_DECODE_SQL}, '&{_name};?', '{_char}', 'g')"


@query(f"SELECT page_id, {_STRIP_SQL.format('html')} AS text FROM pages")
def pages_without_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_STRIP_SQL.format(_DECODE_SQL.format('html'))} AS text FROM pages")
def pages_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.clean_markup(F.col("html")).alias("text"))


_MARKDOWN_SQL = (
    "'## ' || lang || chr(10) || '- *' || source || '* **bold and** ' || lang || chr(10) || text"
)
for _pattern, _replacement in [
    (r"(?m)^#{1,6}[\s\v]+", ""),
    (r"\*\*([^*]+)\*\*", r"\1"),
    (r"\*([^*]+)\*", r"\1"),
    (r"(?m)^[-*][\s\v]+", ""),
    (r"[\s\v]+", " "),
]:
    _MARKDOWN_SQL = f"regexp_replace({_MARKDOWN_SQL}, '{_pattern}', '{_replacement}', 'g')"


@query(f"SELECT doc_id, trim({_MARKDOWN_SQL}) AS text FROM documents")
def markdown_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(
        F.lit("## "), "lang", F.lit("\n- *"), "source", F.lit("* **bold and** "), "lang",
        F.lit("\n"), "text",
    )
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.strip_markdown(marked).alias("text"))


# --- keyword tags -------------------------------------------------------------------------------

WORDS = [
    Keyword("the", r"the"),
    Keyword("THE", r"The", case_sensitive=True),
    Keyword("de", r"de"),
    Keyword("of-the", r"of\s+the"),
    Keyword("und", r"(?:Und|UND|und)", case_sensitive=True),
    Keyword("que", r"(?:les )?que(?:,)?"),
    Keyword("que,", r"que,"),
    Keyword("é", r"é"),
    Keyword("the", r"thea"),
]

_WORD_SQL = [
    ("the", f"(?i){_EDGE_L}the{_EDGE_R}"),
    ("THE", f"{_EDGE_L}The{_EDGE_R}"),
    ("de", f"(?i){_EDGE_L}de{_EDGE_R}"),
    ("of-the", f"(?i){_EDGE_L}of[\\s\\v]+the{_EDGE_R}"),
    ("und", f"{_EDGE_L}(?:Und|UND|und){_EDGE_R}"),
    ("que", f"(?i){_EDGE_L}(?:les )?que"),
    ("que,", f"(?i){_EDGE_L}que,"),
    ("é", "(?i)é"),
    ("the", f"(?i){_EDGE_L}thea{_EDGE_R}"),
]


def _tags_sql(entries, column: str) -> str:
    tests = ", ".join(
        f"CASE WHEN regexp_matches({column}, {sql_quote(p)}) THEN {sql_quote(t)} END"
        for t, p in entries
    )
    return f"array_to_string(list_filter([{tests}], lambda t: t IS NOT NULL), '|')"


@query(f"""WITH c AS (SELECT doc_id, lang || ' ' || {_STRIP_SQL.format('text')} AS t FROM documents)
SELECT doc_id, {_tags_sql(_WORD_SQL, 't')} AS tags FROM c""")
def word_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    tagged = with_keyword_tags(documents, ["lang", "text"], WORDS, "tags")
    return tagged.select("doc_id", F.array_join("tags", "|").alias("tags"))


def _preset_sql() -> list[tuple[str, str]]:
    out = []
    for entry in presets.KEYWORDS:
        pattern = entry.anchored
        if pattern.startswith(r"\b"):
            pattern = _EDGE_L + pattern[2:]
        if pattern.endswith(r"\b"):
            pattern = pattern[:-2] + _EDGE_R
        out.append((entry.tag, ("" if entry.case_sensitive else "(?i)") + pattern))
    return out


# Conversation turns mention tools when the tool names of their customer number are put in.
_MENTIONS = [e.tag for e in presets.KEYWORDS]


@query(f"""
WITH c AS (SELECT conv_id, turn, {_STRIP_SQL.format("text")} || ' ' || role || ' uses '
  || list_extract({sql_list(_MENTIONS)}, CAST((conv_id * 7 + turn) % {len(_MENTIONS)} AS INTEGER) + 1)
  || ', go-to ' || list_extract({sql_list(_MENTIONS)},
       CAST((conv_id * 3 + turn * 5) % {len(_MENTIONS)} AS INTEGER) + 1) || 'x.' AS t
  FROM conversations)
SELECT conv_id, turn, {_tags_sql(_preset_sql(), 't')} AS tags FROM c""")
def tool_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m in _MENTIONS])

    def mention(number):
        return F.get(names, (number % len(_MENTIONS)).cast("int"))

    conv, turn = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").withColumn(
        "note",
        F.concat(
            F.col("role"), F.lit(" uses "), mention(conv * 7 + turn), F.lit(", go-to "),
            mention(conv * 3 + turn * 5), F.lit("x."),
        ),
    )
    tagged = with_keyword_tags(rows, ["text", "note"], presets.KEYWORDS, "tags")
    return tagged.select("conv_id", "turn", F.array_join("tags", "|").alias("tags"))


_EVIDENCE = [Keyword("the", r"the"), Keyword("de", r"de", True), Keyword("de-en", r"de\s+en")]


def _evidence_sql(tag: str, word: str, pattern: str, effective: str) -> str:
    def hit(field: str) -> str:
        return f"regexp_matches({field}, '{_EDGE_L}{word}{_EDGE_R}')"

    def snippet(field: str) -> str:
        # the edge character before the word belongs to the text before it
        before = f"regexp_extract({field}, '(?s)^(.*?{_EDGE_L}){word}{_EDGE_R}', 1)"
        found = f"regexp_extract(substr({field}, length({before}) + 1), '^{word}', 0)"
        start = f"greatest(length({before}) - 40, 0)"
        size = f"length({before}) - {start} + length({found}) + 40"
        return f"'...' || trim(substr({field}, {start} + 1, {size})) || '...'"

    return f"""
    SELECT doc_id, '{tag}' AS tag, CASE WHEN {hit("a")} THEN 'lang' ELSE 'text' END AS field,
           CASE WHEN {hit("a")} THEN {snippet("a")} ELSE {snippet("b")} END AS snippet,
           '{pattern}' AS pattern, '{effective}' AS effective_pattern
    FROM c WHERE {hit("a")} OR {hit("b")}"""


@query(f"""
WITH c AS (SELECT doc_id, lang AS a, {_STRIP_SQL.format('text')} AS b FROM documents)
{_evidence_sql('the', '(?i:the)', 'the', chr(92) + 'bthe' + chr(92) + 'b')}
UNION ALL {_evidence_sql('de', 'de', 'de', chr(92) + 'bde' + chr(92) + 'b')}
UNION ALL {_evidence_sql('de-en', '(?i:de +en)', 'de' + chr(92) + 's+en',
                         chr(92) + 'bde' + chr(92) + 's+en' + chr(92) + 'b')}""")
def tag_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return keyword_evidence(documents, ["doc_id"], ["lang", "text"], _EVIDENCE)


# --- urls -------------------------------------------------------------------------------------

_URLS = [
    ("mobile", r"https://m\.([^/]+)/([^/?#]+)"),
    ("blog", r"//blog\.([^/]+)/([^/?#]+)"),
    ("plain", r"https?://([^/]+)/[a-z]{2}/([^/?#]+)"),
]


def _url_sql(group: int) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(url, {sql_quote(p)}) THEN regexp_extract(url, {sql_quote(p)}, {group})"
        for _, p in _URLS
    )
    return f"CASE {cases} END"


@query(f"""
SELECT page_id, CASE {" ".join(f"WHEN regexp_matches(url, {sql_quote(p)}) THEN '{s}'" for s, p in _URLS)}
         END AS source, {_url_sql(1)} AS company_slug, {_url_sql(2)} AS external_id FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").select(
        "page_id", text.posting_url_parts(F.col("url"), _URLS).alias("p")
    )
    return parts.select("page_id", "p.source", "p.company_slug", "p.external_id")


@query("""
SELECT page_id, 'https://apply.workable.com/c' || page_id || '/jobs/view/' || upper(md5(url)) || '.md'
  AS detail_url, 'c' || page_id AS company_slug FROM pages WHERE NOT contains(url, '?')
UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE contains(url, '?')""")
def detail_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.upper(F.md5("url"))
    public = F.concat(
        F.lit("https://apply.workable.com/c"),
        "page_id",
        F.when(F.contains("url", F.lit("?")), F.lit("/jobs/")).otherwise(F.lit("/j/")),
        code,
    )
    parts = text.posting_url_parts(F.col("public"), presets.POSTING_URLS)
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", public.alias("public"))
        .select(
            "page_id",
            text.markdown_detail_url(F.col("public")).alias("detail_url"),
            parts["company_slug"].alias("company_slug"),
        )
    )


# --- display ------------------------------------------------------------------------------------


@query(f"""WITH {JOBS_SQL},
h AS (SELECT *, date_diff('minute', first_seen_at, TIMESTAMP '{AS_OF}') // 60 AS hours FROM jobs)
SELECT id, CASE WHEN hours < 1 THEN 'just now' WHEN hours < 24 THEN hours || 'h ago'
            ELSE (hours // 24) || 'd ago' END AS age, hours // 24 <= 1 AS fresh,
       CASE hours // 24 WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday'
            ELSE (hours // 24) || 'd' END AS day,
       CASE WHEN is_remote THEN 'Remote' WHEN NOT is_remote THEN 'On-site' END AS workplace,
       upper(substr(split_part(source, '-', 1), 1, 1) || substr(split_part(source, '-', 2), 1, 1))
         AS initials
FROM h""")
def row_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.col("first_seen_at")
    return jobs(spark, sf_dir).select(
        "id",
        text.age_label(seen, as_of()).alias("age"),
        text.is_fresh(seen, as_of()).alias("fresh"),
        text.day_label(seen, as_of()).alias("day"),
        text.workplace_label(F.col("is_remote")).alias("workplace"),
        text.initials(F.col("source")).alias("initials"),
    )


_PRIORITY = ["delta", "beta", "other", "alpha"]


@query(f"""WITH {VIEW_SQL},
x AS (SELECT id, unnest(tech_stack) AS tag, generate_subscripts(tech_stack, 1) AS pos FROM view),
r AS (SELECT *, coalesce(list_position({sql_list(_PRIORITY)}, CASE
    {" ".join(f"WHEN tag = '{t}' THEN '{g}'" for t, g in GROUP_OF.items())} ELSE 'other' END), 5)
    AS rank FROM x)
SELECT v.id, coalesce((SELECT string_agg(tag, ',' ORDER BY n) FROM (
         SELECT tag, row_number() OVER (ORDER BY rank, pos) AS n FROM r WHERE r.id = v.id)
         WHERE n <= 4), '') AS shown,
       greatest(len(tech_stack) - 4, 0) AS hidden FROM view v""")
def ordered_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = text.order_by_category(F.col("tech_stack"), GROUP_OF, _PRIORITY)
    return view(spark, sf_dir).select(
        "id",
        F.array_join(text.visible_tags(ordered), ",").alias("shown"),
        text.hidden_tag_count(F.col("tech_stack")).alias("hidden"),
    )


@query(f"""WITH {VIEW_SQL} SELECT id, {SEGMENT_SQL} AS segment FROM view""")
def row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).select(
        "id", segment(F.col("tech_stack"), BRAND_SEGMENTS).alias("segment")
    )


@query("""
WITH s AS (SELECT doc_id, source, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS t FROM documents)
SELECT doc_id, 'Title: ' || source || chr(10) || chr(10) || 'Description:' || chr(10)
  || CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '…' ELSE t END AS prompt FROM s""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.prompt_text(F.col("source"), F.col("text")).alias("prompt")
    )


# --- model answers --------------------------------------------------------------------------------


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored postings with an answer text made from their model tags."""
    status = F.col("source")
    known = F.transform("enriched_tech_stack", lambda t: F.concat(F.lit('" '), t, F.lit('"')))
    unknown = F.transform("tech_stack", lambda t: F.concat(F.lit('"? x'), t, F.lit('"')))
    items = F.array_join(F.concat(known, F.array(F.lit("7"), F.lit("null")), unknown), ", ")
    body = F.concat(F.lit('```json\n{"technologies": ['), items, F.lit("]}\n``` done"))
    answer = (
        F.when(status == "1-URGENT", F.lit("I found Brand#1 and Brand#2."))
        .when(status == "2-HIGH", F.lit('{"technologies": "Brand#1"}'))
        .when(status == "3-MEDIUM", F.concat(body, F.lit("}")))
        .otherwise(body)
    )
    return jobs(spark, sf_dir).withColumn("answer", answer)


ANSWERS_SQL = f"""
{JOBS_SQL},
answered AS (
  SELECT *, CASE source WHEN '1-URGENT' THEN 'no JSON object' WHEN '2-HIGH' THEN 'no technologies list'
              WHEN '3-MEDIUM' THEN 'invalid JSON' END AS error FROM jobs)"""


@query(f"""WITH {ANSWERS_SQL}
SELECT id, error, CASE WHEN error IS NULL THEN array_to_string(enriched_tech_stack, ',') END AS known,
       CASE WHEN error IS NULL
            THEN array_to_string(list_transform(tech_stack, lambda t: 'x' || t), ',') END AS unknown
FROM answered""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.with_parsed_answer(order_answers(spark, sf_dir).select("id", "answer"), "answer")
    return rows.select(
        "id", "error", text_of("known").alias("known"), text_of("unknown").alias("unknown")
    )


_TEMPLATE = "Known tools:\n{{canonical_tech_list}}\nAnswer in JSON."


@query(f"""
WITH d AS (SELECT DISTINCT p_type, p_brand FROM part),
l AS (SELECT p_type, p_type || ': ' || string_agg(p_brand, ', ' ORDER BY p_brand) AS line
      FROM d GROUP BY p_type)
SELECT substr(sha256(replace({sql_quote(_TEMPLATE)}, '{{{{canonical_tech_list}}}}',
  (SELECT string_agg(line, chr(10) ORDER BY p_type) FROM l))), 1, 8) AS prompt_hash""")
def dictionary_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"),
        F.col("p_type").alias("category_pos"),
        F.col("p_brand").alias("tag"),
        F.col("p_brand").alias("tag_pos"),
    )
    return enrich.version_hash(known.distinct(), _TEMPLATE)


@query(f"""WITH {JOBS_SQL},
d AS (SELECT id,
  list_sort(list_filter(enriched_tech_stack, lambda t: NOT list_contains(tech_stack, t))) AS added,
  list_sort(list_filter(tech_stack, lambda t: NOT list_contains(enriched_tech_stack, t))) AS removed
  FROM jobs)
SELECT id, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed,
  CASE WHEN len(added) + len(removed) = 0 THEN '(no diff)'
       ELSE array_to_string(list_concat(list_transform(added, lambda t: '+' || t),
                                        list_transform(removed, lambda t: '-' || t)), '  ') END AS diff
FROM d""")
def tag_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).select("id", "tech_stack", "enriched_tech_stack")
    diff = enrich.tag_diff(rows, "tech_stack", "enriched_tech_stack")
    return diff.select("id", text_of("added").alias("added"), text_of("removed").alias("removed"), "diff")
