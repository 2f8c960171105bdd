"""The model's input per pending row: newest landed detail, text by source, message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import markdown_detail_url, prompt_text, strip_markdown, strip_tags


def attach_newest(
    rows: DataFrame, details: DataFrame, key: str, at: str, as_of: Column, row_id: str = "id"
) -> DataFrame:
    """Left as-of join: each row with the newest detail of its key at or before ``as_of``.

    ``as_of`` may differ by row. The times are matched first, without the details' wide
    columns; only the details picked are then read. Of details with one key and time the
    greatest counts. Adds the detail columns and ``at``, null without a match.
    """
    payload = [c for c in details.columns if c not in (key, at)]
    asked = rows.where(F.col(key).isNotNull()).select(row_id, key, as_of.alias("__as_of"))
    times = details.where(F.col(at).isNotNull()).select(key, at).distinct()
    picked = (
        asked.join(times, key)
        .where(F.col(at) <= F.col("__as_of"))
        .groupBy(row_id, key)
        .agg(F.max(at).alias(at))
    )
    held = (
        details.join(picked.select(key, at).distinct(), [key, at], "left_semi")
        .groupBy(key, at)
        .agg(F.max(F.struct(*payload)).alias("__detail"))
    )
    found = picked.join(held, [key, at]).select(row_id, at, "__detail")
    return rows.join(found, row_id, "left").select(
        *rows.columns, at, *[F.col(f"__detail.{c}").alias(c) for c in payload]
    )


def model_inputs(
    pending: DataFrame,
    details: DataFrame,
    as_of: Column,
    prompt_hash: str,
    gated: Column,
    page_sources: Sequence[str] = ("workable",),
    limit: int = 2000,
) -> DataFrame:
    """One request per pending row: id, source, title, gated, detail_at, message, prompt_hash.

    Rows of ``page_sources`` take their text from the markdown page landed for their url
    (``details``: source, detail_url, landed_at, payload), all others from the stored
    description. A row without any text still gets a message; a gated title gets none.
    Further columns of ``pending`` are kept.
    """
    own_page = F.col("source").isin(*page_sources)
    asked = pending.withColumn(
        "__page", F.when(own_page, F.struct("source", markdown_detail_url(F.col("source_url")).alias("url")))
    ).withColumn("__page", F.when(F.col("__page.url").isNotNull(), F.col("__page")))
    pages = details.where(F.col("source").isin(*page_sources)).select(
        F.struct("source", F.col("detail_url").alias("url")).alias("__page"),
        F.col("landed_at").alias("detail_at"),
        F.col("payload").alias("__payload"),
    )
    found = attach_newest(asked, pages, "__page", "detail_at", as_of)
    description = F.when(own_page, strip_markdown(F.col("__payload"))).otherwise(
        strip_tags(F.col("description_html"))
    )
    # a column of its own: the message refers to the text several times
    found = found.withColumn("__text", F.coalesce(description, F.lit("")))
    message = prompt_text(F.coalesce("title", F.lit("")), F.col("__text"), limit)
    blocked = F.coalesce(gated, F.lit(False))
    kept = [c for c in pending.columns if c not in ("description_html", "source_url")]
    return found.select(
        *kept,
        blocked.alias("gated"),
        "detail_at",
        F.when(~blocked, message).alias("message"),
        F.lit(prompt_hash).alias("prompt_hash"),
    )
