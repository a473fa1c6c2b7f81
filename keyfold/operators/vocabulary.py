"""Vocabulary, integer sequences, new words and word vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import text as T
from keyfold.operators.ranking import with_rank
from keyfold.operators.tokens import text_sequences


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """How often each white-space separated word occurs."""
    return (df.select(F.explode(T.words(text)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(df: DataFrame, text: str, order: str, cap: int) -> DataFrame:
    """The ``(word, idx, n)`` of the most frequent words, most frequent first, from 1.

    Ties go to the word met first, by ``order`` and place in the text. As in the tokenizer this
    follows, the limit is the smaller of ``cap`` and the number of distinct raw words, and only
    indexes below it are in use, so the result never has more rows than ``cap``.
    """
    limit = min(cap, df.select(F.explode(T.words(text)).alias("word")).distinct().count())
    met = df.select(F.col(order).alias("_order"), F.posexplode(T.vocabulary_words(text)).alias("_at", "word"))
    counted = met.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_order", "_at")).alias("_first"))
    ranked = with_rank(counted, [F.desc("n"), F.asc("_first")], "_rank")
    return ranked.filter(F.col("_rank") + 1 < limit).select(
        "word", (F.col("_rank") + 1).cast("int").alias("idx"), "n")


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("word", "idx", "n").write.parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, idx int, n bigint").parquet(path)


def text_to_sequence(df: DataFrame, text: str, id_col: str, vocab: DataFrame) -> DataFrame:
    """``(id, sequence)``: vocabulary indexes of a text in order; words outside are dropped. Texts are
    coded where they lie, see ``tokens.by_row``."""
    return text_sequences(df, text, vocab, id_col, lambda some: joined_sequences(some, text, id_col, vocab))


def joined_sequences(df: DataFrame, text: str, id_col: str, vocab: DataFrame) -> DataFrame:
    """``text_to_sequence`` by a join of all words with ``vocab``, which should be a written table: Spark
    broadcasts it if its size allows, and splits the partitions of very frequent words if not."""
    placed = df.select(id_col, F.posexplode_outer(T.vocabulary_words(text)).alias("_at", "word"))
    found = placed.join(vocab.select("word", "idx"), "word", "left")
    pairs = F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("_at", "idx")))
    return found.groupBy(id_col).agg(F.transform(F.array_sort(pairs), lambda p: p["idx"]).alias("sequence"))


def new_words(vocab: DataFrame, vector_tables: Sequence[DataFrame]) -> DataFrame:
    """Vocabulary words that at least one of the vector tables lacks."""
    lacking = [vocab.select("word").join(v.select("word"), "word", "left_anti") for v in vector_tables]
    return reduce(DataFrame.unionByName, lacking).distinct()


def new_word_rate(df: DataFrame, text: str, id_col: str, new: DataFrame) -> DataFrame:
    """``(id, uq_rate)``: share of a text's raw words that are new words; 1 for an empty text.

    ``new`` should be a written table, as in ``text_to_sequence``.
    """
    flagged = new.select("word", F.lit(1).alias("_new"))
    placed = df.select(id_col, F.explode_outer(T.words(text)).alias("word")).join(flagged, "word", "left")
    rate = F.sum(F.coalesce("_new", F.lit(0))) / F.count("word")
    return placed.groupBy(id_col).agg(
        F.when(F.count("word") == 0, F.lit(1.0)).otherwise(rate).alias("uq_rate"))


def attach_vectors(vocab: DataFrame, vectors: DataFrame, size: int, mean: float, std: float,
                   seed: int = 7) -> DataFrame:
    """``(word, idx, vector, is_new)``: each vocabulary word's vector, padded to ``size``.

    A word without a vector gets normal random values. They are drawn from a hash of the word, the
    dimension and the seed, so a retried task draws the same ones.
    """
    def uniform(i, stream):
        # 52 random bits, moved off zero so that the logarithm below is finite.
        bits = F.pmod(F.xxhash64(F.col("word"), i, F.lit(stream), F.lit(seed)), F.lit(1 << 52))
        return (bits + 0.5) / float(1 << 52)

    def normal(i):
        return F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1))

    drawn = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (mean + std * normal(i)).cast("float"))
    joined = vocab.join(vectors.select("word", F.col("vector").alias("_v")), "word", "left")
    return joined.select(
        "word", "idx",
        F.when(F.col("_v").isNull(), drawn).otherwise(
            T.pad_front(F.col("_v"), size, 0.0).cast("array<float>")).alias("vector"),
        F.col("_v").isNull().alias("is_new"))


def vector_stats(vectors: DataFrame, size: int) -> DataFrame:
    """Mean and population standard deviation over all values of all padded vectors."""
    values = vectors.select(F.explode(T.pad_front(F.col("vector").cast("array<double>"), size, 0.0)).alias("v"))
    return values.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
