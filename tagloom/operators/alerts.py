"""Saved filters: reading stored query strings and matching them against rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.patterns import strip
from tagloom.session import stored


def query_param(query: Column, name: str) -> Column:
    """First value of a parameter in a url query string, decoded; null when absent."""
    pairs = F.split(F.regexp_replace(query, r"^\?", ""), "&")

    def decoded(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))

    named = F.filter(pairs, lambda p: decoded(F.substring_index(p, "=", 1)) == name)
    pair = F.get(named, F.lit(0))
    value = F.when(
        F.contains(pair, F.lit("=")), F.substr(pair, F.locate("=", pair) + 1)
    ).otherwise(F.when(pair.isNotNull(), F.lit("")))
    return decoded(value)


def _given(query: Column, name: str) -> Column:
    return F.nullif(query_param(query, name), F.lit(""))


def _names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")


def _label(value: Column, labels: Mapping[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for key, text in labels.items():
        result = F.when(value == key, F.lit(text)).otherwise(result)
    return result


def parse_filters(
    filters: DataFrame,
    seniority_labels: Mapping[str, str],
    workplace_labels: Mapping[str, str],
    query: str = "query",
) -> DataFrame:
    """Typed columns of each stored query, plus a display name and a summary.

    ``tags`` is null without a tag parameter and an empty array when the parameter holds
    no name at all; the latter matches nothing.
    """
    q = F.col(query)
    typed = filters.select(
        "*",
        _given(q, "tech").alias("__tech"),
        _given(q, "seniority").alias("seniority"),
        _given(q, "source").alias("source"),
        _given(q, "remote").alias("workplace"),
    )
    names = _names(F.col("__tech"))
    level = _label(F.col("seniority"), seniority_labels)
    place = _label(F.col("workplace"), workplace_labels)
    every_name = F.array_join(F.transform(F.split("__tech", ","), strip), ", ")
    name = F.concat_ws(" · ", level, F.array_join(names, "/"), place)
    summary = F.concat_ws(
        " · ",
        F.concat(F.lit("tech: "), every_name),
        F.concat(F.lit("seniority: "), level),
        F.concat(F.lit("workplace: "), place),
        F.concat(F.lit("source: "), F.col("source")),
    )
    return typed.select(
        "*",
        F.transform(names, F.lower).alias("tags"),
        F.when(name == "", F.lit("All roles")).otherwise(name).alias("filter_name"),
        F.when(summary == "", F.lit("No active filters — matches all roles"))
        .otherwise(summary)
        .alias("filter_summary"),
    ).drop("__tech")


def _workplace_key(flag: Column) -> Column:
    return F.coalesce(flag.cast("string"), F.lit("null"))


def _wanted_workplace(text: Column) -> Column:
    return F.when(text.isin("true", "false"), text).otherwise(F.lit("null"))


# rows of one key that one shuffle partition takes; a key with more is spread over several
KEY_SHARE = 1 << 20


def _candidates(filters: DataFrame, query: str) -> DataFrame:
    """Each usable filter under the keys of each of its fields, ``field`` telling which.

    A filter without any known field is filed under ``any``, a key that every row has.
    """
    tags = F.col("tags")

    def one(mark: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(F.concat(F.lit(f"{mark}:"), value)))

    fields = {
        "t": F.transform(F.array_distinct(tags), lambda t: F.concat(F.lit("t:"), t)),
        "l": one("l", F.col("seniority")),
        "s": one("s", F.col("source")),
        "w": one("w", F.when(F.col("workplace").isNotNull(), _wanted_workplace(F.col("workplace")))),
    }
    empty = F.coalesce(*fields.values()).isNull()
    fields["any"] = F.when(empty, F.array(F.lit("any")))
    listed = F.array(*[F.struct(F.lit(f).alias("field"), keys.alias("keys")) for f, keys in fields.items()])
    usable = filters.where(F.coalesce(F.col(query), F.lit("")) != "")
    return (
        usable.select(
            "filter_id",
            tags.alias("f_tags"),
            F.col("seniority").alias("f_seniority"),
            F.col("source").alias("f_source"),
            F.col("workplace").alias("f_workplace"),
            F.explode(listed).alias("f"),
        )
        .select("*", "f.field", F.explode("f.keys").alias("key"))
        .drop("f")
    )


def _narrow(rows: DataFrame, row_key: str) -> DataFrame:
    """The columns that filters look at, stored once: they are read to count the keys and to match."""
    columns = dict.fromkeys([row_key, "seniority", "source", "is_remote", "tech_stack"])
    return stored(rows.select(*columns), "filtered-rows")


def _row_keys(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The narrow columns of ``rows`` with ``row_tags`` and ``keys``, the keys they can be met by.

    Of the keys that are no tags only those in ``used`` are listed: one value per
    seniority, source and workplace that occurs among the filters.
    """
    lower = F.array_distinct(F.transform("tech_stack", F.lower))
    structural = F.array_compact(
        F.array(
            F.concat(F.lit("l:"), "seniority"),
            F.concat(F.lit("s:"), "source"),
            F.concat(F.lit("w:"), _workplace_key(F.col("is_remote"))),
            F.lit("any"),
        )
    )
    wanted = used.where("field <> 't'").agg(F.collect_set("key")).scalar()
    return rows.withColumn("workplace", _workplace_key(F.col("is_remote"))).withColumn("row_tags", lower).withColumn(
        "keys",
        F.concat(
            F.transform("row_tags", lambda t: F.concat(F.lit("t:"), t)),
            F.array_intersect(structural, wanted),
        ),
    )


def _rarest(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each filter the entries of the field that fewest rows meet, with ``n``, the rows of the key.

    Rows are only counted by key, which needs no shuffle of rows. The entries are stored, so that
    Spark knows their size when it plans their join with the rows.
    """
    met = _row_keys(rows, candidates).select(F.explode("keys").alias("key"))
    counts = met.groupBy("key").agg(F.count("*").alias("n"))
    entries = candidates.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    costs = entries.groupBy("filter_id", "field").agg(F.sum("n").alias("cost"))
    best = costs.groupBy("filter_id").agg(F.min(F.struct("cost", "field")).alias("best"))
    best = best.select("filter_id", F.col("best.field").alias("field"))
    # a key without rows matches nothing
    return stored(entries.join(best, ["filter_id", "field"]).where("n > 0"), "filter-entries")


def _rest_matches() -> Column:
    """All given fields agree, and a pair that shares several tags is met by its first common one."""
    common = F.array_intersect("f_tags", "row_tags")
    first = F.concat(F.lit("t:"), F.get(common, F.lit(0)))
    return (
        F.when(F.col("field") == "t", F.col("key") == first).otherwise(
            F.col("f_tags").isNull() | F.arrays_overlap("f_tags", "row_tags")
        )
        & (F.col("f_seniority").isNull() | F.col("f_seniority").eqNullSafe(F.col("seniority")))
        & (F.col("f_source").isNull() | F.col("f_source").eqNullSafe(F.col("source")))
        & (
            F.col("f_workplace").isNull()
            | (_wanted_workplace(F.col("f_workplace")) == F.col("workplace"))
        )
    )


def _met(rows: DataFrame, entries: DataFrame, row_key: str, how: str, share: int) -> DataFrame:
    """Rows joined with the entries that they match.

    A key that more than ``share`` rows have is spread over as many parts of about that
    size, and only its entries are repeated; such keys are few, at most the rows' keys
    divided by ``share``.
    """
    parts = F.ceil(F.col("n") / F.lit(share)).cast("int")
    salted = entries.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    hot = entries.where(F.col("n") > share).select("key", parts.alias("parts")).distinct()
    hot = hot.agg(F.map_from_entries(F.collect_list(F.struct("key", "parts")))).scalar()
    spread = F.coalesce(F.try_element_at(hot, F.col("key")), F.lit(1))
    keyed = _row_keys(rows, entries).select(
        row_key, "seniority", "source", "workplace", "row_tags", F.explode("keys").alias("key")
    )
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64(row_key), spread).cast("int"))
    left, right = keyed.alias("l"), salted.select(
        F.col("key").alias("e_key"), F.col("part").alias("e_part"), "field", "filter_id",
        "f_tags", "f_seniority", "f_source", "f_workplace",
    )
    together = (F.col("key") == F.col("e_key")) & (F.col("part") == F.col("e_part"))
    return left.join(right, together & _rest_matches(), how)


def match_filters(
    rows: DataFrame, filters: DataFrame, row_key: str = "id", query: str = "query", share: int = KEY_SHARE
) -> DataFrame:
    """Pairs (row, filter) that match; ``filters`` comes from ``parse_filters``.

    All given fields must agree; of the tags one is enough, in any case. Each filter is
    entered under the keys of its rarest field among the rows, and rows are listed only
    under keys that filters are entered by. They meet by an equi-join on the key, so no
    pair is built that shares none, and each pair is produced once.
    """
    narrow = _narrow(rows, row_key)
    entries = _rarest(narrow, _candidates(filters, query))
    return _met(narrow, entries, row_key, "inner", share).select(row_key, "filter_id")


def flag_matches(
    rows: DataFrame, filters: DataFrame, row_key: str = "id", query: str = "query", share: int = KEY_SHARE
) -> DataFrame:
    """``rows`` with ``matches_filter``: at least one enabled filter matches.

    A semi-join, so the matching pairs themselves are never built. An enabled filter
    without fields flags all rows, without a join.
    """
    candidates = _candidates(filters.where("enabled"), query)
    everything = candidates.agg(F.coalesce(F.bool_or(F.col("field") == "any"), F.lit(False))).scalar()
    narrow = _narrow(rows, row_key)
    entries = _rarest(narrow, candidates.where("field <> 'any'"))
    hit = _met(narrow, entries, row_key, "left_semi", share)
    flagged = hit.select(row_key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(flagged, row_key, "left").select(
        *rows.columns, (F.coalesce("__hit", F.lit(False)) | everything).alias("matches_filter")
    )
