"""Mix sources to target weights with exact budgets of words.

Documents of a source are ordered by a random hash key. Ranges of that key, sized by the source's
number of documents, are summed first; the running sums of the few ranges give each range's offset,
and running sums inside the ranges the rest, so no task sorts a whole source. A document is taken
as often as whole epochs fit into its source's budget, and once more as far as the rest reaches.

Cases: a null text has size 0; a null source is a source of its own, the last; repeated rows count
each for itself; documents of size 0 are never taken; an empty table gives an empty result. The
key is a hash of id and seed, so reruns agree; a null id has one key for all its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.operators.ranking import with_rank
from keyfold.session import write_stage

# Weights of the sources in code point order, repeating; share of all words to take;
# how often a source may be used up.
WEIGHTS, SHARE, MAX_EPOCHS = (5, 2, 1), 1.5, 2
# Documents in one range of the hash key.
RANGE_ROWS = 2_000
SEED = "mix-1"
_KEY_BITS = 60


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    """A non-null name that sorts by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def budgets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``(_source, source_size, _rows)``: ``share`` of all words by weight, of which
    no source gets more than ``max_epochs`` times its size, the excess being shared again.

    Sources may be many: they are ranked and summed as a table, and each round of sharing brings
    two sums to the driver.
    """
    ranked = with_rank(sources, ["_source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = write_stage(ranked.withColumn("_weight", weight).withColumn(
        "_cap", F.col("source_size") * float(max_epochs)), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, level = share * total, 0.0
    while True:
        at = F.lit(level) * F.col("_weight")
        full, open_weight = table.agg(F.sum(F.when(at > F.col("_cap"), F.col("_cap"))),
                                      F.sum(F.when(at <= F.col("_cap"), F.col("_weight")))).first()
        if not open_weight:
            break
        higher = (left - (full or 0.0)) / open_weight
        if higher <= level:
            break
        level = higher
    return table.withColumn("target", F.least(F.lit(level) * F.col("_weight"), F.col("_cap")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs (doc_id, text, source)``.

    ``taken`` counts words over all epochs; within a source it sums to the target, rounded down to
    a whole word.
    """
    return _mix(docs, ["doc_id"], weights, share, max_epochs, seed)


def _mix(docs: DataFrame, ids: Sequence[str], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
         max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``mix`` with the columns ``ids``, by which rows of one key are ordered."""
    narrow = write_stage(docs.select(
        *ids, _source_key(F.col("source")).alias("_source"), word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 15), 16, 10)
        .cast("bigint").alias("_key")), "sizes")
    sources = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    told = write_stage(budgets(sources, weights, share, max_epochs).select(
        "_source", "source_size", "target",
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / RANGE_ROWS))).cast("int").alias("_bits")), "budgets")
    ranged = narrow.join(told, "_source").withColumn("_range", F.expr(f"shiftright(_key, {_KEY_BITS} - _bits)"))
    sums = ranged.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = write_stage(sums.select("_source", "_range", F.coalesce(
        F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")), "offsets")
    inside = Window.partitionBy("_source", "_range").orderBy("_key", *ids, "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["_source", "_range"])
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_offset")))
    return placed.select(*ids, "size", "source_size", "target",
                         (epochs * F.col("size") + part).cast("bigint").alias("taken"))


def _cut(text: Column, words: Column) -> Column:
    """The first words of a text, joined by single spaces."""
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(split, 1, words.cast("int")), " ")


def take(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document once per whole epoch, and the part of
    a last epoch, which only the document at its source's budget takes of in part.

    Rows are matched to their shares by a number that a written copy of ``docs`` gives them, so ids may
    repeat or be null. Columns of the names used here are carried in a struct and cannot clash.
    """
    numbered = write_stage(docs.select(
        F.struct(*docs.columns).alias("_all"), F.monotonically_increasing_id().alias("_row")), "numbered")
    narrow = numbered.select("_all.doc_id", "_all.text", "_all.source", "_row")
    shares = write_stage(_mix(narrow, ["doc_id", "_row"], **settings).filter("taken > 0").select(
        "_row", F.col("size").alias("_size"), F.col("taken").alias("_taken")), "shares")
    times = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(_taken - 1) div _size"))).alias("_time")
    spread = numbered.join(shares, "_row").select("_all", "_size", "_taken", times)
    left, text = F.col("_taken") - F.col("_time") * F.col("_size"), F.col("_all.text")
    cut = F.when(left >= F.col("_size"), text).otherwise(_cut(text, left)).alias("text")
    return spread.select(*[cut if c == "text" else F.col("_all").getField(c).alias(c) for c in docs.columns])
