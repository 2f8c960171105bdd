"""Enrichment bookkeeping: prompt version, model answers, tag differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.patterns import strip


def version_hash(
    dictionary: DataFrame, template: str, placeholder: str = "{{canonical_tech_list}}"
) -> DataFrame:
    """First 8 hex digits of the SHA-256 of the template with the tag list in place.

    ``dictionary`` has category, category_pos, tag and tag_pos; it is the fixed list of
    known tags and must fit one text, as the prompt does.
    """
    entry = F.struct("tag_pos", "tag")
    lines = dictionary.groupBy("category_pos", "category").agg(
        F.array_sort(F.collect_list(entry)).alias("tags")
    )
    line = F.concat(
        F.col("category"),
        F.lit(": "),
        F.array_join(F.transform("tags", lambda t: t["tag"]), ", "),
    )
    listed = lines.agg(
        F.array_sort(F.collect_list(F.struct("category_pos", line.alias("line")))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    rendered = F.replace(F.lit(template), F.lit(placeholder), text)
    return listed.select(F.substring(F.sha2(rendered, 256), 1, 8).alias("prompt_hash"))


def with_parsed_answer(rows: DataFrame, answer: str) -> DataFrame:
    """Add ``known``, ``unknown`` and ``error`` from a model answer.

    The answer holds one JSON object, possibly with text around it. Strings in its
    ``technologies`` list are known tags, or unknown ones with a leading question mark;
    other items are ignored. Anything else is an error, with both lists null.
    """
    body = F.col("__body")
    # Text after a complete value would go unnoticed, so the value is read inside a list
    # and inside an object: whatever follows it breaks at least one of them.
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    nested = F.try_parse_json(F.concat(F.lit('{"x":'), body, F.lit("}")))
    staged = (
        rows.withColumn("__body", F.regexp_extract(answer, r"(?s)\{.*\}", 0))
        .withColumn("__listed", F.when(nested.isNotNull(), listed))
        .withColumn("__second", F.try_variant_get("__listed", "$[1]", "variant"))
        .withColumn("__list", F.try_variant_get("__listed", "$[0].technologies", "variant"))
        .withColumn("__items", F.try_variant_get("__list", "$", "array<variant>"))
        .withColumn(
            "__texts",
            F.transform(
                F.filter("__items", lambda x: F.schema_of_variant(x) == "STRING"),
                lambda x: strip(F.try_variant_get(x, "$", "string")),
            ),
        )
    )
    valid = F.col("__listed").isNotNull() & F.col("__second").isNull()
    is_list = F.startswith(F.schema_of_variant("__list"), F.lit("ARRAY"))
    ok = F.coalesce(valid & is_list, F.lit(False))
    marked = F.lit("?")
    known = F.filter("__texts", lambda t: ~F.startswith(t, marked))
    unknown = F.transform(
        F.filter("__texts", lambda t: F.startswith(t, marked)),
        lambda t: strip(F.substr(t, F.lit(2))),
    )
    error = (
        F.when(F.coalesce(body, F.lit("")) == "", F.lit("no JSON object"))
        .when(~valid, F.lit("invalid JSON"))
        .when(~ok, F.lit("no technologies list"))
    )
    return staged.select(
        *rows.columns,
        F.when(ok, known).alias("known"),
        F.when(ok, unknown).alias("unknown"),
        error.alias("error"),
    )


def enrichment_results(
    pending: DataFrame, answers: DataFrame, prompt_hash: str, gated: Column
) -> DataFrame:
    """Result rows for pending rows: id, known, unknown, status and prompt_hash.

    Gated titles get empty tags without looking at an answer. A missing or unreadable
    answer is an error that also counts as attempted, with empty tags and this hash, so
    it is not tried again. ``answers`` has id and answer.
    """
    none = F.array().cast("array<string>")
    joined = with_parsed_answer(
        pending.join(answers.select("id", "answer"), "id", "left"), "answer"
    )
    skip = F.coalesce(gated, F.lit(False))
    failed = F.col("error").isNotNull()
    status = (
        F.when(skip, F.lit("skipped")).when(failed, F.lit("error")).otherwise(F.lit("enriched"))
    )
    return joined.select(
        "id",
        F.when(skip | failed, none).otherwise(F.col("known")).alias("known"),
        F.when(skip | failed, none).otherwise(F.col("unknown")).alias("unknown"),
        status.alias("status"),
        F.lit(prompt_hash).alias("prompt_hash"),
        F.col("tech_stack"),
    )


def tag_diff(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Tags only in ``after`` (added) and only in ``before`` (removed), both sorted."""
    added = F.array_sort(F.array_except(after, before))
    removed = F.array_sort(F.array_except(before, after))
    signed = F.concat(
        F.transform(added, lambda t: F.concat(F.lit("+"), t)),
        F.transform(removed, lambda t: F.concat(F.lit("-"), t)),
    )
    text = F.when(F.size(signed) == 0, F.lit("(no diff)")).otherwise(F.array_join(signed, "  "))
    return rows.select(
        "*", added.alias("added"), removed.alias("removed"), text.alias("diff")
    )


def run_totals(results: DataFrame) -> DataFrame:
    """Enriched rows (gated ones included), errors and tags the rules had not found."""
    fresh = F.size(F.array_except("known", F.coalesce("tech_stack", F.array())))
    return results.agg(
        F.count_if(F.col("status") != "error").alias("enriched"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum(fresh), F.lit(0)).alias("new_signals"),
    )
