"""Corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Toxic documents go, exact copies go, one document of each near-duplicate group stays, sources are
mixed to their target weights, and what the mix takes is packed into windows of tokens.

Cases, as of the operators: a null text counts as empty and holds no words; rows without an id, and rows
of one id, are judged each for itself, but for near-duplicates, where all rows of an id go if one is not to
stay; texts are read whole; other columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import exact, minhash, mixing, packing, toxicity
from keyfold.llm.queries import WORD_TOKENIZER, toxicity_model
from keyfold.session import write_stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time a document is taken; the last one of a source may be cut."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix_sources", mixed),
    ("pack", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The fitted model has no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
