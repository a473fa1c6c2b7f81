"""Coded tokens: texts are split once, and words become vocabulary numbers where the
texts lie.

The chain is ``split_texts`` -> ``word_dictionary`` -> ``vocabulary_of`` -> ``coded_tokens``, and each
result is meant to be written (``write_stage``) before the next one reads it. What counts words then
works on the dictionary, which has one row per distinct word, and sequences and rates are read off the
coded table without another look at a word.

Texts must be cleaned (``functions.text.clean``): their words are parted by single blanks, so that the
vocabulary words of a text are those of its words, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.features.engine import null_safe_join
from keyfold.functions import text as T
from keyfold.operators.ranking import largest, with_rank
from keyfold.session import spread, write_stage

# A row's order as a decimal, that with ten digits for the place in the text, and with eight more for the place in the word.
_ORDER, _FIRST, _PLACED = "decimal(20,0)", "decimal(31,0)", "decimal(38,0)"
# Distinct words that a task counts before it passes them on, and bits of a place in a text.
COUNTED_WORDS, _PLACE_BITS, _ROWS_IN_BATCH = 1_000_000, 36, 10_000


def split_texts(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(id, words)``: the white-space separated words of each cleaned text, in order."""
    return df.select(id_col, T.words(text).alias("words"))


def word_dictionary(split: DataFrame, order: str) -> DataFrame:
    """``(word, n, first)``: each distinct word with its count and where it is met first.

    ``first`` joins the integer column ``order`` and the place in the text into one decimal number, a
    type that can be aggregated by hash where a struct needs all tokens sorted. Null is lowest.

    Tasks count the words of their texts in Arrow, at most about ``COUNTED_WORDS`` distinct ones at a time, and
    the counts are added up once they lie by word: no task holds, or spills, all words of its texts.
    """
    row = F.coalesce(F.col(order).cast(_ORDER), F.lit(str(-10 ** 19)).cast(_ORDER))
    begin = (row * F.lit(str(10 ** 10)).cast("decimal(11,0)")).cast(_FIRST)
    words = F.coalesce("words", F.array().cast("array<string>")).alias("words")
    counted = split.select(begin.alias("begin"), words).mapInArrow(_counted, f"word string, n long, first {_FIRST}")
    return spread(counted, "word").groupBy("word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n, first)`` of texts ``(begin, words)``; a word may come again, with another part of its count."""
    held, size = [], 0
    for batch in batches:
        held.append(_batch_counts(batch))
        size += held[-1].num_rows
        if size >= 2 * COUNTED_WORDS:
            held = [_added(held)]
            size = held[0].num_rows
            if size >= COUNTED_WORDS:
                yield from held[0].to_batches(max_chunksize=_ROWS_IN_BATCH)
                held, size = [], 0
    if held:
        yield from _added(held).to_batches(max_chunksize=_ROWS_IN_BATCH)


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    begins, lists = batch.column("begin"), batch.column("words")
    # Numbers in the order of the decimals, which numpy has no type for.
    distinct = pc.unique(begins)
    distinct = distinct.take(pc.sort_indices(distinct))
    rank = pc.index_in(begins, value_set=distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = _starts(lists)
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
    words = pa.table({"word": lists.flatten(), "at": (np.repeat(rank, np.diff(starts)) << _PLACE_BITS) + place})
    found = words.group_by("word", use_threads=False).aggregate([("at", "count"), ("at", "min")])
    first = found.column("at_min").to_numpy()
    begin = distinct.take(pa.array(first >> _PLACE_BITS))
    place = pa.array(first & ((1 << _PLACE_BITS) - 1)).cast(pa.decimal128(19, 0))
    return pa.table({"word": found.column("word"), "n": found.column("at_count"),
                     "first": pc.add(begin, place).cast(pa.decimal128(31, 0))})


def _added(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    found = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum"), ("first", "min")])
    return pa.table({"word": found.column("word"), "n": found.column("n_sum"), "first": found.column("first_min")})


def vocabulary_of(dictionary: DataFrame, cap: int) -> DataFrame:
    """The ``(word, idx, n)`` that ``operators.vocabulary.vocabulary`` finds in the same texts.

    Counts and first places are summed up from the distinct words; the texts are not read. Only words as
    frequent as the last one in use are sorted.
    """
    limit = min(cap, dictionary.count())
    parts = dictionary.select("n", "first", F.posexplode(T.vocabulary_words("word")).alias("_part", "word"))
    # Eight digits more, for the place in the word; all fit in 38.
    place = (F.col("first").cast(_PLACED) * F.lit(10 ** 8).cast(_PLACED) + F.col("_part")).cast(_PLACED)
    counted = write_stage(spread(parts.select("word", "n", place.alias("_first")), "word").groupBy("word").agg(
        F.sum("n").alias("n"), F.min("_first").alias("_first")), "counted")
    ranked = with_rank(largest(counted, "n", limit), [F.desc("n"), F.asc("_first")], "_rank")
    return ranked.filter(F.col("_rank") + 1 < limit).select(
        "word", (F.col("_rank") + 1).cast("int").alias("idx"), "n")


def coded_tokens(split: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """``(id, words, sequence)``: each word's own index, and the indexes of all vocabulary words in order.

    A word that is not itself in the vocabulary has 0. Texts of one id count as one, in the order of their
    places. Texts are coded where they lie, see ``by_row``, and those of repeated ids by a join on words.
    """
    def here(df: DataFrame, known: tuple[pa.Array, pa.Array]) -> DataFrame:
        parts = F.transform("words", lambda w: F.coalesce(T.vocabulary_words(w), F.array().cast("array<string>")))
        schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, words array<int>, sequence array<int>"

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                words, part_lists = frame.column("words"), frame.column("_parts")
                flat, lists = words.flatten(), part_lists.flatten()
                found, pieces = _numbers(lists.flatten(), *known), lists.flatten()
                in_text, in_word = _starts(words), _starts(lists)
                some = in_word[1:] > in_word[:-1]
                own = np.zeros(len(flat), np.int32)
                first = pa.array(in_word[:-1][some])
                same = pc.equal(pieces.take(first), flat.filter(pa.array(some))).to_numpy(zero_copy_only=False)
                own[some] = np.where(same, found[in_word[:-1][some]], 0)
                yield pa.RecordBatch.from_arrays(
                    [frame.column(id_col), _lists(in_text, own), _kept(in_word[in_text], found)], [id_col, "words", "sequence"])

        return df.select(id_col, F.coalesce("words", F.array().cast("array<string>")).alias("words"),
                         F.coalesce(parts, F.array().cast("array<array<string>>")).alias("_parts")).mapInArrow(run, schema)

    return by_row(split, vocab, id_col, here, lambda df: joined_tokens(df, vocab, id_col))


def joined_tokens(split: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """``coded_tokens`` by a join of all tokens with ``vocab``, which may have any size. It should be a
    written table: Spark broadcasts it if its size allows, and splits the partitions of very frequent
    words if not."""
    placed = split.select(id_col, F.posexplode_outer("words").alias("_at", "_word"))
    parts = placed.select("*", F.posexplode_outer(T.vocabulary_words("_word")).alias("_part", "word"))
    found = parts.join(vocab.select("word", "idx"), "word", "left")
    own = F.when(F.col("word") == F.col("_word"), F.col("idx"))
    token = F.struct("_at", F.coalesce("_part", F.lit(0)).alias("_part"),
                     F.coalesce(own, F.lit(0)).alias("own"), "idx")
    grouped = found.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), token))).alias("_tokens"))
    first_parts = F.filter("_tokens", lambda t: t["_part"] == 0)
    known = F.filter("_tokens", lambda t: t["idx"].isNotNull())
    return grouped.select(id_col, F.transform(first_parts, lambda t: t["own"]).alias("words"),
                          F.transform(known, lambda t: t["idx"]).alias("sequence"))


def by_row(df: DataFrame, vocab: DataFrame, id_col: str,
           here: Callable[[DataFrame, tuple[pa.Array, pa.Array]], DataFrame],
           joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Texts coded row by row, without a shuffle of their tokens.

    Every task needs the whole vocabulary for that, so one of more than ``VOCABULARY_CAP`` words is joined
    instead, and so are texts whose id (null is one) has more than one row, which only a shuffle brings
    together; both by ``joined``.
    """
    bounded = vocab.select("word", "idx").limit(T.VOCABULARY_CAP + 1).toArrow()
    if bounded.num_rows > T.VOCABULARY_CAP or len(pc.unique(bounded.column("word"))) < bounded.num_rows:
        return joined(df)
    known = bounded.column("word").combine_chunks(), bounded.column("idx").combine_chunks()
    repeated = write_stage(df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(id_col), "repeated")
    if repeated.isEmpty():
        return here(df, known)
    single, several = (null_safe_join(df, repeated, [id_col], how) for how in ("left_anti", "left_semi"))
    return here(single, known).unionByName(joined(several))


def _numbers(words: pa.Array, known: pa.Array, idx: pa.Array) -> np.ndarray:
    """The index of each word, 0 for others; indexes run from 1."""
    return pc.fill_null(idx.take(pc.index_in(words, value_set=known)), 0).to_numpy(zero_copy_only=False)


def _starts(lists: pa.Array) -> np.ndarray:
    """Where each list starts among all values, and their end."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _kept(starts: np.ndarray, found: np.ndarray) -> pa.Array:
    """The lists of found indexes that are not 0."""
    before = np.concatenate([[0], np.cumsum(found > 0)])
    return _lists(before[starts], found[found > 0])


def text_sequences(df: DataFrame, text: str, vocab: DataFrame, id_col: str,
                   joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(id, sequence)`` of texts that are not split yet; ``joined`` as of ``by_row``."""
    def here(some: DataFrame, known: tuple[pa.Array, pa.Array]) -> DataFrame:
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                words = frame.column("words")
                yield pa.RecordBatch.from_arrays(
                    [frame.column(id_col), _kept(_starts(words), _numbers(words.flatten(), *known))], [id_col, "sequence"])

        words = F.coalesce(T.vocabulary_words(text), F.array().cast("array<string>")).alias("words")
        return some.select(id_col, words).mapInArrow(
            run, f"{id_col} {some.schema[id_col].dataType.simpleString()}, sequence array<int>")

    return by_row(df, vocab, id_col, here, joined)


def marked_rate(coded: DataFrame, id_col: str, marked: DataFrame) -> DataFrame:
    """``(id, uq_rate)``: share of a text's words whose index is in ``marked (idx)``; 1 without words."""
    flagged = marked.select("idx", F.lit(1).alias("_marked")).distinct()
    placed = coded.select(id_col, F.explode_outer("words").alias("idx")).join(flagged, "idx", "left")
    rate = F.sum(F.coalesce("_marked", F.lit(0))) / F.count("idx")
    return placed.groupBy(id_col).agg(
        F.when(F.count("idx") == 0, F.lit(1.0)).otherwise(rate).alias("uq_rate"))
