"""File sources and sinks: CSV with stated types, sharded gzip CSV, word-vector text, parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Quotes are doubled inside quoted fields.
_CSV = {"header": "true", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: StructType | str, line_breaks: bool = True) -> DataFrame:
    """CSV under a stated schema. ``path`` may be a pattern, so shards are read as one table; gzip
    files are decoded by their name. Quoted fields may hold line breaks, for which every file is one
    task's work, as a gzip file is anyway; without ``line_breaks``, which asserts that no field holds
    one, plain files are split."""
    return spark.read.options(**_CSV, multiLine=str(line_breaks).lower()).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """CSV with a header. As usual in CSV files, an empty text reads back as missing."""
    df.write.options(**_CSV).csv(path, compression="gzip" if gzip else "none")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors from text lines ``word v1 v2 ...``; parts that are no numbers are dropped.

    Of lines with the same word the last one counts, files in order of their paths.
    """
    parts = F.split(F.rtrim(F.col("value")), " ")
    numbers = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: p.try_cast("float"))
    lines = spark.read.text(path).select(
        parts[0].alias("word"), F.filter(numbers, lambda v: v.isNotNull()).alias("vector"),
        # Splits are packed into tasks by size, so the place in the file comes first.
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_line"))
    return lines.groupBy("word").agg(F.max_by("vector", "_line").alias("vector"))


def write_vectors(df: DataFrame, path: str) -> None:
    """Write ``(word, vector)`` in the text form that ``read_vectors`` reads."""
    values = F.array_join(F.transform("vector", lambda v: v.cast("string")), " ")
    df.select(F.concat_ws(" ", "word", values).alias("value")).write.text(path)
