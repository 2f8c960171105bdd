"""The serving view: filters, pages, counts and search over active rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEW_COLUMNS = [
    "id", "source", "company", "title", "department", "location", "source_url", "is_remote",
    "seniority", "tech_stack", "employment_type", "posted_at", "first_seen_at", "fetched_at",
]


def merged_tags(rule_tags: Column, model_tags: Column) -> Column:
    """Distinct tags of both origins, sorted."""
    return F.array_sort(F.array_distinct(F.concat(rule_tags, model_tags)))


def active_view(jobs: DataFrame) -> DataFrame:
    """Active in-region rows with their merged tags; unsorted, pages sort by themselves."""
    rows = jobs.where("is_qc AND is_active").withColumn(
        "tech_stack",
        merged_tags(F.col("tech_stack"), F.coalesce("enriched_tech_stack", F.array())),
    )
    return rows.select(*[c for c in VIEW_COLUMNS if c in rows.columns])


def split_list(text: str | None) -> list[str]:
    """Comma-separated argument to a list of non-blank names."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def has_all_tags(tags: Column, wanted: Sequence[str]) -> Column:
    """Every wanted tag is in the array (case-sensitive)."""
    return reduce(lambda a, b: a & b, [F.array_contains(tags, w) for w in wanted], F.lit(True))


def equals_any_value(column: Column, value: str | None) -> Column:
    """Equality; a blank value filters nothing."""
    return column == value if value else F.lit(True)


def workplace_is(flag: Column, value: str | None) -> Column:
    """``true``, ``false`` and ``null`` select one of three states; other text nothing."""
    states = {"true": True, "false": False, "null": None}
    if value not in states:
        return F.lit(True)
    return flag.eqNullSafe(F.lit(states[value]).cast("boolean"))


def filter_conditions(
    tags: Sequence[str] = (),
    source: str | None = None,
    remote: str | None = None,
    seniority: str | None = None,
) -> Mapping[str, Column]:
    """One condition per listing filter, by facet name."""
    return {
        "tech": has_all_tags(F.col("tech_stack"), tags),
        "source": equals_any_value(F.col("source"), source),
        "workplace": workplace_is(F.col("is_remote"), remote),
        "seniority": equals_any_value(F.col("seniority"), seniority),
    }


def filter_rows(view: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    return view.where(reduce(lambda a, b: a & b, conditions.values()))


def total_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


# rows that one task may sort for a page
PAGE_BOUND = 50_000
_PARTS = 64


def _ordered(values: Sequence, ascending: bool) -> list:
    """Group values in page order: nulls first when ascending, last otherwise."""
    known = sorted((v for v in values if v is not None), reverse=not ascending)
    missing = [v for v in values if v is None]
    return missing + known if ascending else known + missing


def _among(group: Column, values: Sequence) -> Column:
    known = [v for v in values if v is not None]
    found = group.isin(known) if known else F.lit(False)
    return F.coalesce(found, F.lit(False)) | group.isNull() if None in values else found


def _text_group(text: str, least: str, most: str) -> Column:
    """The beginning by which texts differ: what all share and two characters."""
    shared = 0
    while shared < min(len(least), len(most)) and least[shared] == most[shared]:
        shared += 1
    return F.substring(text, 1, shared + 2)


def _number_group(number: Column, least: int, most: int) -> Column:
    """Which of ``_PARTS`` equal ranges a number falls into."""
    width = -(-(most - least + 1) // _PARTS)
    return F.floor((number - F.lit(least)) / F.lit(width)).cast("int")


def page(
    rows: DataFrame,
    number: int = 1,
    size: int = 30,
    ascending: bool = False,
    by: str = "first_seen_at",
    tie: str = "id",
    bound: int = PAGE_BOUND,
) -> DataFrame:
    """One page in time order, newest first by default; ties by id.

    Rows are counted by day, and the days that hold the page are sorted. Where those have
    more than ``bound`` rows, they are first narrowed by counts of ever smaller ranges, of the
    time and then of the id, whose places in the order are known; each round is a job over
    the two narrow columns. So the rows before the page are never sorted, and no task sorts
    more than ``bound`` rows, but for rows that share time and id.
    """
    time, micros = F.col(by), F.unix_micros(by)
    order = [time.asc() if ascending else time.desc(), F.col(tie).asc()]
    is_text = dict(rows.dtypes)[tie] == "string"

    def held(near: Column, group: Column, forward: bool, skip: int, size: int) -> list[tuple]:
        """(rows, places to skip, places to take) of the groups that hold the places, in order."""
        # a small row per group
        found = rows.where(near).groupBy(group.alias("g")).agg(F.count("*")).collect()
        counts, parts, passed = {r[0]: r[1] for r in found}, [], 0
        for value in _ordered(list(counts), forward):
            n = counts[value]
            if passed < skip + size and passed + n > skip:
                own = max(0, skip - passed)
                parts.append((value, n, own, min(n, skip + size - passed) - own))
            passed += n
        if sum(n for _, n, _, _ in parts) <= bound:
            values, taken = [p[0] for p in parts], sum(p[3] for p in parts)
            return [(near & _among(group, values), parts[0][2], taken)] if parts else []
        out = []
        for value, n, own, taken in parts:
            inside = near & _among(group, [value])
            out += [(inside, own, taken)] if n <= bound or taken == n else narrowed(inside, own, taken)
        return out

    def narrowed(near: Column, skip: int, size: int) -> list[tuple]:
        """The places within the rows ``near``, which are too many to be sorted."""
        known = [F.count("*"), F.count(by), F.min(micros), F.max(micros), F.count(tie), F.min(tie), F.max(tie)]
        n, timed, first, last, tied, least, most = rows.where(near).agg(*known).first()
        if timed not in (0, n) or first != last:
            group = _number_group(micros, first, last)
            return held(near, group, ascending, skip, size)
        if tied not in (0, n) or least != most:
            group = _text_group(tie, least, most) if is_text else _number_group(F.col(tie), least, most)
            return held(near, group, True, skip, size)
        return [(near, skip, size)]

    day = F.date_trunc("day", time)
    found = rows.limit(0)
    for i, (near, skip, taken) in enumerate(held(F.lit(True), day, ascending, (max(1, number) - 1) * size, size)):
        part = rows.where(near).orderBy(*order).offset(skip).limit(taken)
        found = part if i == 0 else found.unionByName(part)
    return found.orderBy(*order)


def _like_literal(text: str) -> str:
    return "".join(f"\\{c}" if c in "\\%_" else c for c in text)


def search(
    view: DataFrame,
    query: str,
    limit: int = 10,
    text_columns: Sequence[str] = ("title", "company"),
    tag_column: str = "tech_stack",
    by: str = "first_seen_at",
    tie: str = "id",
) -> DataFrame:
    """Newest rows with the text in a text column, then newest rows with it as a tag.

    A row found both ways is kept once. Queries under two characters find nothing. The
    tag form only has its first letter raised. Adds ``position``, from 1.
    """
    text = query.strip()
    if len(text) < 2:
        return view.limit(0).withColumn("position", F.lit(0))
    tag = text[0].upper() + text[1:]
    order = [F.col(by).desc(), F.col(tie).asc()]
    pattern = f"%{_like_literal(text)}%"
    in_text = reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in text_columns])
    by_text = view.where(in_text).orderBy(*order).limit(limit)
    by_tag = view.where(F.array_contains(tag_column, tag)).orderBy(*order).limit(limit)
    # at most twice ``limit`` rows from here on
    found = by_text.withColumn("__branch", F.lit(0)).unionByName(
        by_tag.withColumn("__branch", F.lit(1))
    )
    first = found.groupBy(tie).agg(F.min(F.struct("__branch", *view.columns)).alias("__r"))
    rows = first.select("__r.__branch", *[F.col(f"__r.{c}") for c in view.columns])
    best = rows.orderBy("__branch", *order).limit(limit)
    return best.withColumn(
        "position", F.row_number().over(Window.orderBy("__branch", *order))
    ).drop("__branch")


def pending_enrichment(
    jobs: DataFrame, prompt_hash: str, sources: Sequence[str], limit: int | None = 200
) -> DataFrame:
    """Oldest active rows of ``sources`` without tags of the current prompt version.

    Without a ``limit`` all such rows, in no order.
    """
    stale = ~F.col("enriched_prompt_hash").eqNullSafe(F.lit(prompt_hash))
    rows = jobs.where(F.col("is_active") & F.col("source").isin(*sources) & stale)
    return rows if limit is None else rows.orderBy("first_seen_at", "id").limit(limit)


def sample_rows(jobs: DataFrame, limit: int, source: str | None = None) -> DataFrame:
    """A fixed sample of active in-region rows for a dry run."""
    rows = jobs.where("is_active AND is_qc").where(equals_any_value(F.col("source"), source))
    return rows.orderBy("id").limit(limit)
