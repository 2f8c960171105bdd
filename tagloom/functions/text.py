"""Text derivations: markup removal, language, urls, and row display fields."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import patterns
from tagloom.functions.patterns import WS, collapse_spaces, strip

# Entities decoded by plain string replacement; "&amp;" must come last so that
# "&amp;lt;" becomes "&lt;" and is not decoded twice.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&reg;": "®",
    "&middot;": "·",
    "&bull;": "•",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&hellip;": "…",
    "&eacute;": "é",
    "&egrave;": "è",
    "&amp;": "&",
}


@F.pandas_udf(T.StringType())
def _decode_any_entity(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def decode_entities(text: Column) -> Column:
    """Decode HTML character references once.

    Texts that hold only common references stay in the JVM. Any other reference sends
    the text through Python; all other rows pass null there.
    """
    common = "|".join(name[1:] for name in COMMON_ENTITIES)
    # the plain search is far cheaper than the look-ahead, and most texts hold no reference
    rare = F.contains(text, F.lit("&")) & F.rlike(text, F.lit(rf"&(?!(?:{common}))[#A-Za-z]"))
    decoded = text
    for name, char in COMMON_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    decoded = F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)
    return F.when(rare, _decode_any_entity(F.when(rare, text))).otherwise(decoded)


def strip_tags(text: Column) -> Column:
    """Drop markup tags and collapse white space."""
    untagged = F.when(
        F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", " ")
    ).otherwise(text)
    return collapse_spaces(untagged)


def clean_markup(text: Column) -> Column:
    """Decode entities, then drop tags: also removes markup that came entity-encoded."""
    return strip_tags(decode_entities(text))


def strip_markdown(text: Column) -> Column:
    """Drop heading marks, bold, italics and bullets, and collapse white space."""
    for pattern, replacement in [
        (rf"(?m)^#{{1,6}}{WS}+", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (rf"(?m)^[-*]{WS}+", ""),
    ]:
        text = patterns.replace(text, pattern, replacement)
    return collapse_spaces(text)


def _ascii_words(words: Sequence[str]) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def title_language(
    title: Column, accents: str, english: Sequence[str], french: Sequence[str]
) -> Column:
    """``fr`` for an accent, else ``en`` / ``fr`` for a listed word, else null."""
    return (
        F.when(F.rlike(title, F.lit(f"(?iu)[{accents}]")), F.lit("fr"))
        .when(F.rlike(title, F.lit(_ascii_words(english))), F.lit("en"))
        .when(F.rlike(title, F.lit(_ascii_words(french))), F.lit("fr"))
    )


def posting_url_parts(url: Column, url_patterns: Sequence[tuple[str, str]]) -> Column:
    """Struct of source, company slug and posting id from the first pattern that fits."""
    parts = F.lit(None).cast("struct<source:string,company_slug:string,external_id:string>")
    for source, pattern in reversed(url_patterns):
        regex = patterns.java_regex(pattern)
        parts = F.when(
            F.rlike(url, F.lit(regex)),
            F.struct(
                F.lit(source).alias("source"),
                F.regexp_extract(url, regex, 1).alias("company_slug"),
                F.regexp_extract(url, regex, 2).alias("external_id"),
            ),
        ).otherwise(parts)
    return parts


def markdown_detail_url(url: Column) -> Column:
    """Public posting url ``…/j/ID`` to its detail page ``…/jobs/view/ID.md``, else null."""
    regex = "(?i)/j/([A-F0-9]+)$"
    return F.when(F.rlike(url, F.lit(regex)), F.regexp_replace(url, regex, "/jobs/view/$1.md"))


def _elapsed(ts: Column, as_of: Column, unit_ms: int) -> Column:
    elapsed = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))
    return F.floor(elapsed / F.lit(unit_ms)).cast("bigint")


def age_label(ts: Column, as_of: Column) -> Column:
    """``just now``, ``5h ago``, ``3d ago``; empty for a missing time."""
    hours, days = _elapsed(ts, as_of, 3_600_000), _elapsed(ts, as_of, 86_400_000)
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(hours < 1, F.lit("just now"))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def is_fresh(ts: Column, as_of: Column) -> Column:
    """At most one full day old."""
    return F.coalesce(_elapsed(ts, as_of, 86_400_000) <= 1, F.lit(False))


def day_label(ts: Column, as_of: Column) -> Column:
    """``today``, ``yesterday``, ``5d``; empty for a missing time."""
    days = _elapsed(ts, as_of, 86_400_000)
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(days == 0, F.lit("today"))
        .when(days == 1, F.lit("yesterday"))
        .otherwise(F.concat(days.cast("string"), F.lit("d")))
    )


def workplace_label(flag: Column) -> Column:
    return F.when(flag, F.lit("Remote")).when(~flag, F.lit("On-site"))


def initials(name: Column) -> Column:
    """First letters of the first two words, upper case."""
    words = F.slice(F.filter(F.split(name, r"[\s\-&]+"), lambda w: w != ""), 1, 2)
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def order_by_category(
    tags: Column, category_of: Mapping[str, str], priority: Sequence[str]
) -> Column:
    """Tags sorted by the priority of their category; order within one is kept."""
    rank_of = {name: i for i, name in enumerate(priority)}
    unknown = rank_of.get("other", len(priority))
    pairs = [
        f"{patterns.sql_text(tag)}, {rank_of.get(category, len(priority))}"
        for tag, category in category_of.items()
    ]
    ranks = F.expr(f"map({', '.join(pairs)})")
    keyed = F.transform(
        tags,
        lambda tag, i: F.struct(
            F.coalesce(F.try_element_at(ranks, tag), F.lit(unknown)).alias("rank"),
            i.alias("pos"),
            tag.alias("tag"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["tag"])


def visible_tags(tags: Column, limit: int = 4) -> Column:
    return F.slice(tags, 1, limit)


def hidden_tag_count(tags: Column, limit: int = 4) -> Column:
    return F.greatest(F.size(tags) - limit, F.lit(0))


def prompt_text(title: Column, description: Column, limit: int = 2000) -> Column:
    """Model input: title and description, the latter cut at ``limit`` characters."""
    body = F.when(
        F.coalesce(F.length(description), F.lit(0)) > 0, strip(description)
    ).otherwise(F.lit("(no description available)"))
    cut = F.when(
        F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("…"))
    ).otherwise(body)
    return F.concat(F.lit("Title: "), title, F.lit("\n\nDescription:\n"), cut)
