"""Markup, languages, urls, display fields and typed values."""

import html
from datetime import datetime

from helpers import ts, values
from pyspark.sql import functions as F

from tagloom.functions import coerce, patterns, text
from tagloom.plans import presets


def test_strip_tags(spark):
    got = values(
        spark,
        text.strip_tags(F.col("t")),
        ["<p>Hello <b>world</b></p>", "<li>a</li>  <li>b</li>", "", "no html", "\xa0a \n b\x1f", None],
        "t string",
    )
    assert got == ["Hello world", "a b", "", "no html", "a b", None]


def test_entities_are_decoded_like_the_standard_library(spark):
    cases = [
        "&lt;b&gt;x&lt;/b&gt; &amp;lt; &amp;amp; R&D A & B",
        "caf&eacute; &Omega; &#233; &#x1F600; &notanentity; &copy2 &",
        "&nbsp;&quot;&#39;&apos;&hellip;",
        "plain",
        None,
    ]
    got = values(spark, text.decode_entities(F.col("t")), cases, "t string")
    assert got == [None if c is None else html.unescape(c) for c in cases]


def test_markdown(spark):
    source = "# Title\n\n**bold** and *soft*\n- item one\n* item two\n###no heading"
    assert values(spark, text.strip_markdown(F.col("t")), [source], "t string") == [
        "Title bold and soft item one item two ###no heading"
    ]


def test_title_language(spark):
    column = text.title_language(
        F.col("t"), presets.FRENCH_ACCENTS, presets.ENGLISH_TITLE_WORDS, presets.FRENCH_TITLE_WORDS
    )
    cases = {
        "Développeur": "fr",
        "SÉNIOR Engineer": "fr",
        "Software Engineer": "en",
        "Engineering Lead": "en",
        "Programmeur C": "fr",
        "Responsable, designer": "en",
        "Manager": None,
        "Engineers": None,
        None: None,
    }
    assert values(spark, column, list(cases), "t string") == list(cases.values())


def test_posting_urls(spark):
    urls = [
        "https://jobs.lever.co/bolt/b45-82?x=1",
        "https://job-boards.eu.greenhouse.io/acme/jobs/4850",
        "https://boards-api.greenhouse.io/v1/boards/acme/jobs/7",
        "https://apply.workable.com/cask/j/ABC123",
        "https://example.com/j/1",
    ]
    got = values(spark, text.posting_url_parts(F.col("u"), presets.POSTING_URLS), urls, "u string")
    assert [tuple(r) if r else None for r in got] == [
        ("lever", "bolt", "b45-82"),
        ("greenhouse", "acme", "4850"),
        ("greenhouse", "acme", "7"),
        ("workable", "cask", "ABC123"),
        None,
    ]
    detail = values(spark, text.markdown_detail_url(F.col("u")), urls, "u string")
    assert detail == [None, None, None, "https://apply.workable.com/cask/jobs/view/ABC123.md", "https://example.com/jobs/view/1.md"]


def test_ages(spark):
    now = ts("2026-05-10 12:00:00")
    rows = ["2026-05-10 11:30:00", "2026-05-10 09:00:00", "2026-05-09 11:00:00", "2026-05-01 00:00:00", None]
    seen = F.col("t").cast("timestamp")
    assert values(spark, text.age_label(seen, now), rows, "t string") == [
        "just now", "3h ago", "1d ago", "9d ago", "",
    ]
    assert values(spark, text.is_fresh(seen, now), rows, "t string") == [
        True, True, True, False, False,
    ]
    assert values(spark, text.day_label(seen, now), rows, "t string") == [
        "today", "today", "yesterday", "9d", "",
    ]


def test_labels_and_initials(spark):
    assert values(spark, text.workplace_label(F.col("f")), [True, False, None], "f boolean") == [
        "Remote", "On-site", None,
    ]
    names = ["big-red box", "Solo", " & Co Inc", "é tude"]
    assert values(spark, text.initials(F.col("n")), names, "n string") == ["BR", "S", "CI", "ÉT"]


def test_tags_by_category_priority(spark):
    ordered = text.order_by_category(
        F.col("t"), presets.category_of(), presets.DISTINCTIVE_FIRST
    )
    tags = ["AWS", "CI/CD", "Docker", "Go", "PostgreSQL", "LLM", "Python"]
    [got] = values(spark, ordered, [(tags,)], "t array<string>")
    assert got == ["Go", "Python", "LLM", "PostgreSQL", "CI/CD", "Docker", "AWS"]
    assert values(spark, text.hidden_tag_count(F.col("t")), [(tags,), ([],)], "t array<string>") == [3, 0]
    assert values(spark, text.visible_tags(F.col("t")), [(tags,)], "t array<string>") == [tags[:4]]


def test_prompt_text(spark):
    column = text.prompt_text(F.lit("Dev"), F.col("d"))
    got = values(spark, column, [" a\n", None, "", "z" * 2001], "d string")
    head = "Title: Dev\n\nDescription:\n"
    missing = head + "(no description available)"
    assert got == [head + "a", missing, missing, head + "z" * 2000 + "…"]


def _times(spark, column, rows):
    return values(spark, column, rows, "v string")


def test_dates(spark):
    got = _times(
        spark,
        coerce.us_or_iso_date(F.col("v")),
        ["04/28/2026", "2026-04-28T00:00:00", "2026-04-28T12:00:00-04:00", "2026-04-28", "not-a-date", "", None, "13/45/2026"],
    )
    day = datetime(2026, 4, 28)
    assert got == [day, day, datetime(2026, 4, 28, 16), day, None, None, None, None]


def test_coercions(spark):
    v = F.col("v")
    assert _times(spark, coerce.coerce(v, "unix_ms"), ["1700000000123", "x", None, "1700000000123.5"]) == [
        datetime(2023, 11, 14, 22, 13, 20, 123000), None, None, None,
    ]
    assert _times(spark, coerce.coerce(v, "date"), [" 2026-05-04 ", "2026-5-4", "05/04/2026"]) == [
        datetime(2026, 5, 4), datetime(2026, 5, 4), None,
    ]
    assert _times(spark, coerce.coerce(v, "bool"), ["TRUE", "1", "yes", "no", None]) == [
        True, True, True, False, None,
    ]
    assert _times(spark, coerce.coerce(v, "string", empty_as_null=True), ["", "a"]) == [None, "a"]
    assert _times(spark, coerce.coerce(v, "datetime"), ["2026", "2026-04-28T12:00:00.5Z"]) == [
        None, datetime(2026, 4, 28, 12, 0, 0, 500000),
    ]


def test_truthiness_and_paths(spark):
    docs = ['{"a": "x"}', '{"a": ""}', '{"a": 0}', '{"a": 5}', '{"a": "0"}', '{"a": []}', '{"a": [1]}',
            '{"a": {}}', '{"a": false}', '{"a": true}', '{"a": null}', "{}", '{"a": 0.0}']
    frame = spark.createDataFrame(list(enumerate(docs)), "i int, j string").select(
        "i", F.parse_json("j").alias("raw")
    )
    got = [r.v for r in frame.orderBy("i").select(coerce.is_truthy("a").alias("v")).collect()]
    assert got == [True, False, False, True, True, False, True, False, False, True, False, False, False]
    assert coerce.json_path("departments.0.name") == "$.departments[0].name"


def test_spaces_and_first_letters(spark):
    cases = [" a  b ", "　a\n b\x85", "a \t", "\x1c", "  ", "", "a b", None]
    stripped = values(spark, patterns.strip(F.col("t")), cases, "t string")
    assert stripped == [c and c.strip() for c in cases]
    joined = values(spark, patterns.collapse_spaces(F.col("t")), cases, "t string")
    assert joined == [c and " ".join(c.split()) for c in cases]
    # every match of an entry begins with a letter that is tested first
    assert patterns.first_letter_first(r"\b(?:Ruby on )?Rails\b") == r"(?=[R])\b(?:Ruby on )?Rails\b"
    assert patterns.first_letter_first(r"\.NET\b") == r"(?=[\.])\.NET\b"
    assert patterns.first_letter_first(r"\b[CF]\b") == r"\b[CF]\b"
