"""Scalar column expressions whose exact semantics matter to the pipeline."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import col


def _column(c: str | Column) -> Column:
    return col(c) if isinstance(c, str) else c


def week_from_sunday(d: str | Column) -> Column:
    """Week of the year with Sunday-started weeks; days before the first Sunday are week 0."""
    d = _column(d)
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def calendar_parts(d: str | Column = "activation_date") -> list[Column]:
    """month, week, dayofweek (1 = Sunday) and day of a date."""
    d = _column(d)
    return [F.month(d).alias("month"), week_from_sunday(d).alias("week"),
            F.dayofweek(d).alias("dayofweek"), F.dayofmonth(d).alias("day")]


def days_since(d: str | Column, anchor: date) -> Column:
    return F.datediff(_column(d), F.lit(anchor)).cast("bigint")


def whole_days_between(start: str | Column, end: str | Column) -> Column:
    """Whole 24-hour units between two timestamps, truncated; not the number of midnights passed."""
    return F.timestamp_diff("DAY", _column(start), _column(end))


def clip_unit(x: str | Column) -> Column:
    """Limit to [0, 1]; NULL stays NULL, which ``greatest`` and ``least`` alone would not keep."""
    x = _column(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def log2_bucket(x: str | Column) -> Column:
    """floor(log2(1 + x)) for x >= 0."""
    return F.log2(_column(x) + 1).cast("int")


def log10_bucket(x: str | Column) -> Column:
    """floor(log10(1 + x)) for x >= 0."""
    return F.log10(_column(x) + 1).cast("int")
