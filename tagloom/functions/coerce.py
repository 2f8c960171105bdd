"""Path access into raw payloads and conversion of raw values to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.patterns import replace, strip

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([zZ]|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)


def json_path(path: str) -> str:
    """``departments.0.name`` to ``$.departments[0].name``."""
    steps = [f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".")]
    return "$" + "".join(steps)


def path_value(raw: Column, path: str, dtype: str = "string") -> Column:
    """Value at a dot path of a variant; null when any step is missing."""
    return F.try_variant_get(raw, json_path(path), dtype)


def iso_timestamp(value: Column) -> Column:
    """ISO date or date-time, with or without offset (none means UTC); bad text is null."""
    return F.when(F.rlike(value, F.lit(_ISO)), F.try_to_timestamp(replace(value, ",", ".")))


def epoch_ms(value: Column) -> Column:
    """Whole milliseconds since 1970; text with a fraction or an exponent is null."""
    whole = F.rlike(value, F.lit(r"^\s*[+-]?[0-9]+\s*$"))
    return F.timestamp_millis(F.when(whole, value.try_cast("bigint")))


def plain_date(value: Column) -> Column:
    """``YYYY-MM-DD`` at midnight UTC."""
    text = strip(value)
    return F.when(
        F.rlike(text, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")),
        F.try_to_timestamp(text, F.lit("yyyy-M-d")),
    )


def us_or_iso_date(value: Column) -> Column:
    """``MM/DD/YYYY``, else ISO with or without offset, else null."""
    text = strip(value)
    return F.coalesce(
        F.when(
            F.rlike(text, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")),
            F.try_to_timestamp(text, F.lit("M/d/yyyy")),
        ),
        iso_timestamp(text),
    )


def truthy_text(value: Column) -> Column:
    """``true``, ``1`` and ``yes`` in any case are true, other text false, null null."""
    return F.lower(value).isin("true", "1", "yes")


_CONVERSIONS = {
    "string": lambda v: v,
    "datetime": iso_timestamp,
    "unix_ms": epoch_ms,
    "date": plain_date,
    "bool": truthy_text,
}


def coerce(value: Column, kind: str, empty_as_null: bool = False) -> Column:
    """Convert raw text to ``kind``; a value that does not fit becomes null."""
    if empty_as_null:
        value = F.nullif(value, F.lit(""))
    return _CONVERSIONS[kind](value)


def is_truthy(path: str, raw: str = "raw") -> Column:
    """Whether a required raw value is present: not null, empty, zero or false."""
    at = f"`{raw}`, '{json_path(path)}'"
    text = f"try_variant_get({at}, 'string')"
    # only a text that could stand for an empty value makes the type matter
    return F.expr(
        f"""CASE
          WHEN coalesce({text}, '') = '' THEN false
          WHEN {text} IN ('false', '[]', '{{}}') OR try_cast({text} AS double) = 0
            THEN schema_of_variant(try_variant_get({at}, 'variant')) = 'STRING'
          ELSE true
        END"""
    )


def append_array_field(base: Column, raw: Column, array_path: str, field: str) -> Column:
    """Base text followed by one field of every element of an array, space separated.

    Without an array the base is returned unchanged; an empty result becomes null.
    """
    items = F.try_variant_get(raw, json_path(array_path), "array<variant>")
    texts = F.filter(
        F.transform(items, lambda x: F.try_variant_get(x, f"$.{field}", "string")),
        lambda t: t.isNotNull() & (t != ""),
    )
    joined = F.concat(F.coalesce(base, F.lit("")), F.lit(" "), F.array_join(texts, " "))
    return F.when(items.isNull(), base).otherwise(F.nullif(strip(joined), F.lit("")))
