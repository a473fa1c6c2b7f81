"""Row-level operators: append, split, eliminate, sample."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "deal_probability"


def union_labelled(labelled: DataFrame, unlabelled: DataFrame, label: str = LABEL) -> DataFrame:
    """Append rows without a label; their label column becomes a typed NULL."""
    padded = unlabelled.withColumn(label, F.lit(None).cast(labelled.schema[label].dataType))
    return labelled.unionByName(padded.select(*labelled.columns))


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)


def labelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def unlabelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.filter(F.col(label).isNull())


def eliminate(df: DataFrame, ids: DataFrame, on: str = "item_id") -> DataFrame:
    """Drop the rows whose id is listed."""
    return df.join(ids.select(on), on, "left_anti")


def limit_sample(df: DataFrame, rows: int, order: Sequence[str | Column]) -> DataFrame:
    """The first rows in a stated order, for trial runs; without an order the sample would vary."""
    return df.orderBy(*order).limit(rows)
