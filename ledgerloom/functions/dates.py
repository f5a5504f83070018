"""Dates of schedules and periods as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats of schedule exports, in order of preference.
FORMATS = ("dd-MMM-yy", "dd-MMM-yyyy", "yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "d-MMM-yy")


def parse(c: Column) -> Column:
    """A schedule date, with or without the suffix `` A`` of actual dates; null if no format fits."""
    t = F.regexp_replace(F.trim(c), r"\s+A$", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]).cast("date")


def is_actual(c: Column) -> Column:
    return F.coalesce(F.trim(c).endswith(" A"), F.lit(False))


def week_start(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def month_start(d: Column) -> Column:
    return F.date_trunc("month", d).cast("date")


def iso_label(d: Column) -> Column:
    """``2024-W05``"""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def percent(c: Column) -> Column:
    """0 to 1 counts as a share; the result is clamped to 0 to 100."""
    v = F.regexp_replace(F.trim(c.cast("string")), "%", "").try_cast("double")
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.when(v <= 1, v * 100).otherwise(v), F.lit(0.0)).cast("int")))


def days(c: Column) -> Column:
    """The number in ``5``, ``5d`` or ``5 days``."""
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").cast("int")


def elapsed(start: Column, finish: Column, at: Column) -> Column:
    """Share of the way from start to finish, clamped to 0 to 1."""
    span = F.datediff(finish, start)
    part = F.try_divide(F.datediff(at, start).cast("double"), span.cast("double"))
    return F.when(at < start, 0.0).when(at >= finish, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(part, F.lit(1.0)))))


def week_share(week: Column, month: Column) -> Column:
    """Share of the seven days from ``week`` that lie in the month of ``month``."""
    first = F.greatest(week, F.trunc(month, "month"))
    last = F.least(F.date_add(week, 6), F.last_day(month))
    return F.greatest(F.lit(0), F.datediff(last, first) + 1) / 7.0
