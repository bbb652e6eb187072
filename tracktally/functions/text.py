"""Field-level helpers for track text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(line: Column) -> Column:
    """Comma-separated fields with every space removed."""
    return F.split(F.replace(line, F.lit(" "), F.lit("")), ",")


def field(parts: Column, position: int) -> Column:
    """1-based field, NULL when the line is shorter."""
    return F.try_element_at(parts, F.lit(position))


def int_part(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).try_cast("int")


def compact_date(text: Column) -> Column:
    """``yyyyMMdd`` to DATE, NULL when it is not a date."""
    return F.try_to_date(text, "yyyyMMdd")


def signed_degrees(text: Column, positive: str, negative: str) -> Column:
    """``28.0N`` style coordinate to signed degrees; NULL without a hemisphere letter."""
    size = F.regexp_extract(text, r"([0-9]+\.[0-9]+)", 1).try_cast("double")
    return F.when(F.contains(text, F.lit(negative)), -size).when(
        F.contains(text, F.lit(positive)), size
    )


def clock(text: Column) -> Column:
    """Time of day as four digits, whatever lost its leading zeros on the way."""
    return F.lpad(text.cast("string"), 4, "0")


def observed_at(year: Column, month: Column, day: Column, time: Column) -> Column:
    """Timestamp without zone from date parts and an ``hhmm`` text."""
    hhmm = clock(time)
    return F.try_make_timestamp_ntz(
        year,
        month,
        day,
        F.substring(hhmm, 1, 2).try_cast("int"),
        F.substring(hhmm, 3, 2).try_cast("int"),
        F.lit(0),
    )


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")
