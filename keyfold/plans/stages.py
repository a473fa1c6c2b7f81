"""The feature pipeline, stage by stage. Each function takes and returns DataFrames.

Aggregates are always taken over the stage that first holds their key columns, so every stage can
be run from the written result of the one before.

``in_a_row`` runs them all without writing the wide rows in between: what shuffles are narrow tables of
id and keys, whose features are written in buckets of the id, and all of these join there.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.features import catalog
from keyfold.features.engine import attach, attach_all, attach_stddev
from keyfold.features.spec import Feature
from keyfold.functions.scalar import calendar_parts, days_since
from keyfold.operators.enrich import left_lookup
from keyfold.session import freeing_shuffles, run_all, write_buckets

ID = "item_id"
ITEM_KEYS = [ID, "user_id", "region", "city", "parent_category_name", "category_name",
             "param_1", "param_2", "param_3", "user_type", "price"]
TAIL = ["image_top_1", "deal_probability"]
# Fixed value: first day of the data set the pipeline was written for.
ANCHOR = date(2017, 3, 15)
MACRO_COLUMNS = ["unemployment_rate", "GDP_PC_PPP", "HDI"]


def _names(features: Sequence[Feature]) -> list[str]:
    return [f.name for f in features]


def feature_table(source: DataFrame, features: Sequence[Feature], cell_columns: Sequence[str] = ()) -> DataFrame:
    """``(item_id, features)`` computed on rows of nothing but id and key columns.

    Many key sets mean many joins; leaving all other columns out keeps small what they shuffle.
    The result joins back once by id.
    """
    columns = sorted({c for f in features for c in (*f.keys, f.arg) if c})
    return attach_all(source.select(ID, *columns), features, cell_columns=cell_columns).select(ID, *_names(features))


def attach_base(items: DataFrame, features: Sequence[Feature], extra: Sequence[str] = ()) -> DataFrame:
    """The hand-picked aggregates on item rows. Most of them are led by the user and take one shuffle of the
    rows for all."""
    kept = [*ITEM_KEYS, *[c for c in extra if c not in ITEM_KEYS], *TAIL]
    rows = items.select(*kept, *[c for c in (catalog.DATE,) if c not in kept])
    return attach_all(rows, features).select(*kept, *_names(features))


def stage1(items: DataFrame) -> DataFrame:
    """The first nine aggregates."""
    out = attach_base(items, catalog.STAGE1_BASE)
    return out.withColumnRenamed("all_categ_minmax_diff", "diff").select(
        *ITEM_KEYS, "diff", *_names(catalog.STAGE1_BASE[1:]), *TAIL)


def stage2(items: DataFrame) -> DataFrame:
    """All eleven aggregates."""
    out = attach_base(items, catalog.BASE)
    return out.withColumnRenamed("all_categ_minmax_diff", "diff").select(
        *ITEM_KEYS, "diff", *_names(catalog.BASE[1:]), *TAIL)


def stage3_part1(items: DataFrame, anchor: date = ANCHOR, more: Sequence[Feature] = ()) -> DataFrame:
    """The eleven aggregates with month, day and days since the anchor date. ``more`` are features of later
    stages that share the shuffle of the rows."""
    when = F.col("activation_date")
    parts = [F.month(when).alias("month"), F.dayofmonth(when).alias("day"), days_since(when, anchor).alias("day_diff")]
    # The parts come from the date after the shuffle, which need not carry them.
    return attach_base(items, [*catalog.BASE, *more], [catalog.DATE]).select("*", *parts).select(
        *ITEM_KEYS, "month", "day", "day_diff", *_names(catalog.BASE), *_names(more), *TAIL)


def stage3_part2(part1: DataFrame) -> DataFrame:
    """Counts of singles and pairs led by city, category and span; month and day are not carried."""
    kept = [c for c in part1.columns if c not in ("month", "day", "deal_probability")]
    out = attach_all(part1, catalog.PART2, cell_columns=catalog.PAIR_CELLS)
    return out.select(*kept, *_names(catalog.PART2), "deal_probability")


def stage3_features(part1: DataFrame) -> DataFrame:
    """Per item: all counts of parts two and three, from the written part one."""
    return feature_table(part1, catalog.PART2 + catalog.PART3, catalog.PAIR_CELLS)


def ids_differ(rows: DataFrame) -> bool:
    """Whether every row has an id of its own. Ids are compared by 64 bits; two that agree in them count as one."""
    same = rows.groupBy(F.xxhash64(ID).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"), F.count(ID).alias("_ids"))
    with freeing_shuffles(rows.sparkSession):
        return same.filter((F.col("_n") > 1) | (F.col("_ids") < 1)).isEmpty()


def stage3(part1: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Parts two and three in one go, from the written part one; ``counted`` are its features, if written.

    Rows with ids of their own get their features where they are, so that nothing wide is shuffled to join
    them by the id; those of an id that comes twice are joined to each other.
    """
    dropped = {"month", "day", "deal_probability", *catalog.PART3_DROPS}
    kept = [c for c in [*part1.columns, *_names(catalog.PART2)] if c not in dropped]
    if counted is None and ids_differ(part1):
        out = attach_all(part1, catalog.PART2 + catalog.PART3, cell_columns=catalog.PAIR_CELLS)
    else:
        out = part1.join(stage3_features(part1) if counted is None else counted, ID, "left")
    return out.select(*kept, *_names(catalog.PART3), "deal_probability")


def stage4(stage3_rows: DataFrame, items: DataFrame, fill: bool = True) -> DataFrame:
    """Date spans of eleven single columns. ``fill=False`` gives the variant that keeps NULL.

    Spans that the rows have already, as of ``stage3_part1``'s ``more``, are left as they are.
    """
    spans = catalog.SPANS if fill else [Feature(f.name, f.keys, f.kind, f.arg) for f in catalog.SPANS]
    there = [f for f in spans if f.name in stage3_rows.columns]
    kept = [c for c in stage3_rows.columns if c not in _names(there)]
    return attach(stage3_rows, [f for f in spans if f not in there], source=items).select(*kept, *_names(spans))


def stage4_features(items: DataFrame) -> DataFrame:
    """Per item: the date spans of stage four."""
    return feature_table(items, catalog.SPANS)


def stage4_select(stage4_rows: DataFrame) -> DataFrame:
    """Leave out the day difference and everything counted over it."""
    kept = [c for c in stage4_rows.columns if "day_diff" not in c and c not in TAIL[1:]]
    return stage4_rows.select(*kept, "deal_probability")


def stage5_features(items: DataFrame) -> DataFrame:
    """Per item: 54 triple counts, 54 spans and 54 distinct counts over pairs."""
    return feature_table(items, catalog.STAGE5, catalog.TRIPLE_CELLS)


def stage5(stage4_rows: DataFrame, features: DataFrame) -> DataFrame:
    return stage4_rows.join(features, ID, "left")


def calendar(items: DataFrame) -> DataFrame:
    return items.select(ID, *calendar_parts())


def stage6(stage5_rows: DataFrame, calendar_rows: DataFrame) -> DataFrame:
    """Calendar rows on the left: an item without stage-5 row keeps its calendar and NULLs, id included."""
    features = stage5_rows.withColumn("_id", F.col(ID))
    joined = calendar_rows.select(F.col(ID).alias("_id"), "week", "dayofweek", "day").join(features, "_id", "left")
    return joined.select(*stage5_rows.columns, "week", "dayofweek", "day")


def stage7(stage6_rows: DataFrame) -> DataFrame:
    """Per item: standard deviations of price and image code over 13 partitions."""
    calendar_keys = ["week", "dayofweek", "day"]
    narrow = stage6_rows.select(ID, *catalog.STD_STRING_KEYS, "price", "image_top_1", *calendar_keys)
    by_text = attach_stddev(narrow, catalog.STD_BY_KEY)
    both = attach_stddev(by_text, catalog.STD_BY_ROUNDED_KEY, rounded=True)
    return both.select(ID, *_names(catalog.STD_BY_KEY), *_names(catalog.STD_BY_ROUNDED_KEY))


def stage7_calendar(stage6_rows: DataFrame) -> DataFrame:
    """Per item: standard deviations of the calendar parts per user, -1 for a single item."""
    narrow = stage6_rows.select(ID, "user_id", "week", "dayofweek", "day")
    return attach_stddev(narrow, catalog.STD_CALENDAR_BY_USER).select(ID, *_names(catalog.STD_CALENDAR_BY_USER))


def stage8(stage6_rows: DataFrame, population: DataFrame, macros: DataFrame) -> DataFrame:
    """Append population by item and macro figures by region.

    A population table with two rows for an item gives that item two rows, as a join does; use
    ``enrich.coalesce_lookup`` to build it without repeats.
    """
    out = left_lookup(stage6_rows, population, [ID], ["population"])
    return left_lookup(out, macros, ["region"], MACRO_COLUMNS)


def join_stages(items: DataFrame, part1: DataFrame, counted: DataFrame, spans: DataFrame, pairs: DataFrame,
                population: DataFrame, macros: DataFrame) -> DataFrame:
    """Stages three to eight from their written features. All tables but the last are in buckets of the id.

    The population joins before the calendar, beside which an item without features has no id to join by:
    it gets NULL either way, but here the rows still lie by their id.
    """
    stage5_rows = stage5(stage4_select(stage3(part1, counted).join(spans, ID, "left")), pairs)
    stage6_rows = stage6(left_lookup(stage5_rows, population, [ID], ["population"]), calendar(items))
    out = left_lookup(stage6_rows, macros, ["region"], MACRO_COLUMNS)
    return out.select(*stage5_rows.columns, "week", "dayofweek", "day", "population", *MACRO_COLUMNS)


def in_a_row(items: DataFrame, population: DataFrame, macros: DataFrame) -> DataFrame:
    """Stages three to eight. No two ``items`` share an id. Joins on the id are joins of buckets without a
    shuffle; only the calendar of items that are not in buckets themselves, id and date parts, is shuffled. The
    tables are built side by side, as each is a chain of jobs that leaves cores idle."""
    def stage3_tables():
        part1 = write_buckets(stage3_part1(items), "part1", ID)
        return part1, write_buckets(stage3_features(part1), "stage3_features", ID)

    # None reads what another one writes, so they run side by side.
    pairs, (part1, counted), spans, population = run_all(items.sparkSession, [
        lambda: write_buckets(stage5_features(items), "stage5_features", ID), stage3_tables,
        lambda: write_buckets(stage4_features(items), "stage4_features", ID),
        lambda: write_buckets(population, "population", ID)])
    return join_stages(items, part1, counted, spans, pairs, population, macros)
