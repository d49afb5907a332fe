"""Column helpers for clock times, dates and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

_CLOCK = r"^(2[0-3]|[01][0-9]|[0-9]):([0-5][0-9]|[0-9])\z"


def minutes(clock: Column | str) -> Column:
    """``H:M`` as minutes after midnight, else null; one-digit parts are fine."""
    c = col(clock)
    part = lambda i: F.regexp_extract(c, _CLOCK, i).try_cast("int")
    return F.when(c.rlike(_CLOCK), part(1) * 60 + part(2))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict overlap of two intervals; an overnight one never overlaps (F2)."""
    hit = (e1 > s1) & (e2 > s2) & (s1 < e2) & (s2 < e1)
    return F.coalesce(hit, F.lit(False))


def duration(start: Column, end: Column) -> Column:
    """Minutes between, 0 when unknown or overnight."""
    return F.coalesce(F.greatest(end - start, F.lit(0)), F.lit(0))


def iso_weekday(day: Column) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(day) + 1


def month_day(day: Column) -> Column:
    return F.date_format(day, "MM-dd")


def day_of(text: Column | str) -> Column:
    """Calendar date of ``Y-M-D`` text, else null."""
    c = col(text)
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
                  F.to_date(F.try_to_timestamp(c, F.lit("y-M-d"))))


def clock_error(c: Column) -> Column:
    """True when the text is not a strict ``HH:MM`` of a real time."""
    return ~c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")


def date_error(c: Column) -> Column:
    return ~c.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNull()


def coordinate_error(c: Column) -> Column:
    """True when the text is not ``lon,lat`` inside the valid ranges."""
    parts = F.split(c, ",")
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
    text = lambda i: F.trim(F.get(parts, F.lit(i)))
    number = lambda i: F.when(text(i).rlike(plain), text(i).try_cast("double"))
    lon, lat = number(0), number(1)
    good = (F.size(parts) == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    return ~F.coalesce(good, F.lit(False))
