"""Global ranks without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.session import write_stage

# monotonically_increasing_id keeps the partition number above these bits and a row number below.
_ROW_BITS = 33


def with_rank(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Append the row's place, from 0, in the given total order.

    A range-partitioned sort is written as a stage; a row's place is its partition's start plus its
    place in the partition. The starts come from a table with one row per partition, which bounds
    both its window and its broadcast, so no task ever holds all rows.
    """
    placed = write_stage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    partition = F.shiftright("_id", _ROW_BITS)
    sizes = placed.groupBy(partition.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", partition).join(F.broadcast(starts), "_part")
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return joined.select(*df.columns, place.alias(name))


def largest(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows that may be among the ``limit`` ones with the largest whole number in ``column``: all from
    the number on that the last of them has. ``df`` is read twice, so it should be a written table; for counts
    the table of distinct numbers, which one task holds, is as small as the root of what was counted."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = sizes.select(column, above.alias("_above")).filter(F.col("_above") < limit).agg(F.min(column)).first()[0]
    return df if least is None else df.filter(F.col(column) >= least)
