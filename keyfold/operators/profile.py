"""Profiling: frequencies, distinct counts and date spans per key, as result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, keys: Sequence[str], name: str, of: str | None = None,
              order: str | None = None) -> DataFrame:
    """Rows per key tuple. With ``of``, its non-NULL values are counted, so a NULL group of that
    column counts 0. ``order`` is 'asc', 'desc' or None; rows of one count come by their keys."""
    counted = F.count(of) if of else F.count(F.lit(1))
    out = df.groupBy(*keys).agg(counted.alias(name))
    if order is None:
        return out
    # Few counts are shared by most tuples: the keys part rows of one count among the ranges of the sort.
    return out.orderBy(F.asc(name) if order == "asc" else F.desc(name), *keys)


def distinct_values(df: DataFrame, keys: Sequence[str], of: str, name: str,
                    count_name: str | None = None) -> DataFrame:
    """Distinct non-NULL values of a column per key tuple, optionally beside the row count."""
    counts = [F.count(F.lit(1)).alias(count_name)] if count_name else []
    return df.groupBy(*keys).agg(*counts, F.count_distinct(of).alias(name))


def date_span(df: DataFrame, keys: Sequence[str], name: str, count_name: str,
              date: str = "activation_date") -> DataFrame:
    """Days between the first and the last date per key tuple, beside the row count."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count_name),
        F.datediff(F.max(date), F.min(date)).cast("bigint").alias(name))


def distinct_and_span(df: DataFrame, keys: Sequence[str], of: str, date: str = "activation_date") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_distinct(of).alias("uq"),
        F.datediff(F.max(date), F.min(date)).cast("bigint").alias("minmax_diff"))
