"""Small column expressions used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """A double; null where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def at_most_one(value: Column) -> Column:
    return F.least(F.lit(1.0), value)


def number(value: Column, pattern: str) -> Column:
    """Number as text by a decimal pattern; ties go to the even digit."""
    return F.call_function("format_number", value, F.lit(pattern))


def whole(value: Column) -> Column:
    return number(value.cast("double"), "#,##0")


def money(value: Column) -> Column:
    return number(value.cast("double"), "#,##0.00")


def filled(value: Column) -> Column:
    """Text without outer blanks; null when nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def or_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def prefix(value: Column, length: int) -> Column:
    return F.substring(value, 1, length)


def is_npi(value: Column) -> Column:
    return value.rlike("^[0-9]{10}$")


def state_code(value: Column) -> Column:
    return or_blank(F.upper(F.trim(value)))


def titled(flag_type: Column) -> Column:
    return F.initcap(F.replace(flag_type, F.lit("_"), F.lit(" ")))


def evidence_text(evidence_json: Column) -> Column:
    """`key: value, key: value` in the order of the JSON object."""
    entries = F.map_entries(F.from_json(evidence_json, "map<string,string>"))
    parts = F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(parts, ", ")
