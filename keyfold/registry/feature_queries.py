"""Queries on attached features and the pipeline stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.features import catalog, engine
from keyfold.features.spec import Feature
from keyfold.functions.scalar import calendar_parts
from keyfold.operators import enrich
from keyfold.plans import stages
from keyfold.registry.base import attach_sql, item_stage, query, r6, with_items
from keyfold.registry.row_queries import _CUSTOMERS_SQL, CALENDAR_SQL, macro_table, population_tables
from keyfold.session import write_stage

# --- single operators -------------------------------------------------------------------------------
_ATTACHED = {
    "count_1key": [Feature("category_name_count", ("category_name",), fill=0),
                   Feature("param_1_count", ("param_1",), fill=0)],
    "count_2key": [Feature("city_param_1_count", ("city", "param_1"), fill=0)],
    "count_3key": [Feature("user_id_city_param_1_count", ("user_id", "city", "param_1"), fill=0)],
    "count_5key": [f for f in catalog.BASE if f.name == "all_category_count"],
    "count_float_key": [Feature("price_count", ("price",), fill=0),
                        Feature("price_image_top_1_count", ("price", "image_top_1"), fill=0)],
    "count_of_column": [Feature("city_priced", ("city",), "count_col", "price", fill=0)],
    "minmax_fill_minus1": catalog.SPANS,
    "uq_span_attach": [Feature("uq", ("user_id", "param_3"), "distinct", "price", fill=0),
                       Feature("minmax_diff", ("user_id", "param_3"), "span", "activation_date", fill=0)],
}


def _columns(features):
    return sorted({k for f in features for k in f.keys} | {f.arg for f in features if f.arg})


def _register_attach(name, features):
    kept = sorted({k for f in features for k in f.keys})

    @query(name, with_items(attach_sql("items", features, columns=", ".join(f"t.{c}" for c in ["item_id", *kept]))))
    def run(spark, sf_dir):
        df = item_stage(spark, sf_dir, "item_id", *_columns(features))
        return engine.attach(df.select("item_id", *kept), features, source=df)


for _name, _features in _ATTACHED.items():
    _register_attach(_name, _features)

_SMALL_SETS = [f for f in catalog.PART2 + catalog.PART3
               if f.kind == "count" and set(f.keys) <= {"region", "city", "parent_category_name", "category_name",
                                                        "param_1", "user_type"}]


@query("count_grouping_sets", with_items(attach_sql("items", _SMALL_SETS, columns="t.item_id")))
def count_grouping_sets(spark, sf_dir):
    """The same counts from one GROUPING SETS pass."""
    df = item_stage(spark, sf_dir, "item_id", *_columns(_SMALL_SETS)).select("item_id", *_columns(_SMALL_SETS))
    return engine.attach_grouping_sets(df, _SMALL_SETS).select("item_id", *[f.name for f in _SMALL_SETS])


_USER_SETS = [Feature("user_id_count", ("user_id",), fill=0),
              Feature("user_id_city_count", ("user_id", "city"), fill=0),
              Feature("user_id_param_1_price_count", ("user_id", "param_1", "price"), fill=0),
              Feature("user_id_param_1_price_uq", ("user_id", "param_1"), "distinct", "price", fill=0),
              Feature("user_id_param_1_price_minmax_diff", ("user_id", "param_1"), "span", "activation_date", fill=0)]


@query("count_windows", with_items(attach_sql("items", _USER_SETS, columns="t.item_id")))
def count_windows(spark, sf_dir):
    """User features as windows that share one shuffle; heavy users take the join path."""
    df = item_stage(spark, sf_dir, "item_id", *_columns(_USER_SETS)).select("item_id", *_columns(_USER_SETS))
    return engine.attach_windows(df, _USER_SETS, "user_id").select("item_id", *[f.name for f in _USER_SETS])


_CELL_COLUMNS = {"city", "param_1", "param_2", "param_3", "category_name"}
_CELL_SETS = [f for f in catalog.STAGE5
              if set(f.keys) <= _CELL_COLUMNS and (f.kind != "distinct" or f.arg in _CELL_COLUMNS)]


@query("count_cells", with_items(attach_sql("items", _CELL_SETS, columns="t.item_id")))
def count_cells(spark, sf_dir):
    """Triples and pairs over five columns, computed on distinct cells and joined to the rows once."""
    df = item_stage(spark, sf_dir, "item_id", "activation_date", *_CELL_COLUMNS)
    narrow = df.select("item_id", "activation_date", *sorted(_CELL_COLUMNS))
    return engine.attach_through_cells(narrow, _CELL_SETS).select("item_id", *[f.name for f in _CELL_SETS])


# --- stages -------------------------------------------------------------------------------------------
_KEYS = ", ".join(f"t.{c}" for c in stages.ITEM_KEYS)
_TAIL = ", ".join(f"t.{c}" for c in stages.TAIL)


def stage_items(spark, sf_dir):
    """The columns of the items that the stages read."""
    return item_stage(spark, sf_dir, *stages.ITEM_KEYS, *stages.TAIL, catalog.DATE)


def _early_stage_sql(features):
    renamed = [Feature("diff", f.keys, f.kind, f.arg, f.fill) if f.name == "all_categ_minmax_diff" else f
               for f in features]
    return with_items(attach_sql("items", renamed, columns=f"{_KEYS}, {_TAIL}"))


@query("stage1_features", _early_stage_sql(catalog.STAGE1_BASE))
def stage1_features(spark, sf_dir):
    return stages.stage1(stage_items(spark, sf_dir))


@query("stage2_features", _early_stage_sql(catalog.BASE))
def stage2_features(spark, sf_dir):
    return stages.stage2(stage_items(spark, sf_dir))


_PART1_SQL = attach_sql("items", catalog.BASE, columns=(
    f"{_KEYS}, month(t.activation_date)::INTEGER AS month, day(t.activation_date)::INTEGER AS day, "
    f"date_diff('day', DATE '2017-03-15', t.activation_date) AS day_diff, {_TAIL}"))


def _cte(*named):
    return "".join(f",\n{name} AS MATERIALIZED ({body})" for name, body in named)


@query("stage3_part1", with_items(_PART1_SQL))
def stage3_part1(spark, sf_dir):
    return stages.stage3_part1(stage_items(spark, sf_dir))


_PART2_SQL = attach_sql("part1", catalog.PART2, "part1", "t.* EXCLUDE (month, day)")


@query("stage3_part2", with_items(_PART2_SQL, _cte(("part1", _PART1_SQL))))
def stage3_part2(spark, sf_dir):
    return stages.stage3_part2(write_stage(stages.stage3_part1(stage_items(spark, sf_dir)), "part1"))


_DROPPED = ", ".join(["month", "day", *catalog.PART3_DROPS])
_STAGE3_WIDE_SQL = attach_sql("part1", catalog.PART2 + catalog.PART3, "part1")
_STAGE3_SQL = f"SELECT * EXCLUDE ({_DROPPED}) FROM stage3_wide"
_STAGE3_CTES = [("part1", _PART1_SQL), ("stage3_wide", _STAGE3_WIDE_SQL)]


def written_stage3(spark, sf_dir, more=()):
    return stages.stage3(write_stage(stages.stage3_part1(stage_items(spark, sf_dir), more=more), "part1"))


@query("stage3_features", with_items(_STAGE3_SQL, _cte(*_STAGE3_CTES)))
def stage3_features(spark, sf_dir):
    return written_stage3(spark, sf_dir)


_STAGE4_SQL = attach_sql("stage3", catalog.SPANS)
_STAGE4_CTES = [*_STAGE3_CTES, ("stage3", _STAGE3_SQL)]
_DAY_DIFF = [f.name for f in catalog.PART2 + catalog.PART3 + catalog.SPANS
             if "day_diff" in f.name and f.name not in catalog.PART3_DROPS] + ["day_diff"]


@query("stage4_select", with_items(
    f"SELECT * EXCLUDE ({', '.join(_DAY_DIFF)}) FROM stage4", _cte(*_STAGE4_CTES, ("stage4", _STAGE4_SQL))))
def stage4_select(spark, sf_dir):
    # The spans share part one's pass over the rows, which are narrow there.
    items = stage_items(spark, sf_dir)
    return stages.stage4_select(stages.stage4(written_stage3(spark, sf_dir, catalog.SPANS), items))


@query("stage5_features", with_items(attach_sql("items", catalog.STAGE5, columns="t.item_id")))
def stage5_features(spark, sf_dir):
    return stages.stage5_features(stage_items(spark, sf_dir))


_CALENDAR_CTE = ("calendar", f"SELECT item_id, {CALENDAR_SQL} FROM items")


@query("calendar_attach", with_items(
    "SELECT f.item_id, f.user_id, f.price, t.week, t.dayofweek, t.day FROM calendar t "
    "LEFT JOIN (SELECT item_id, user_id, price FROM items WHERE image IS NOT NULL) f ON t.item_id = f.item_id",
    _cte(_CALENDAR_CTE)))
def calendar_attach(spark, sf_dir):
    """Stage six's orientation: calendar rows keep their place, features may be missing."""
    items = item_stage(spark, sf_dir, "item_id", "user_id", "price", "image", catalog.DATE)
    features = items.filter(F.col("image").isNotNull()).select("item_id", "user_id", "price")
    return stages.stage6(features, stages.calendar(items))


def _with_calendar(spark, sf_dir):
    items = item_stage(spark, sf_dir, "item_id", "user_id", "price", "image_top_1", catalog.DATE)
    return items.select("*", *calendar_parts())


def _std_sql(features, key=lambda k: k):
    parts = []
    for f in features:
        value = f"stddev_samp({f.arg}) OVER (PARTITION BY {key(f.keys[0])})"
        if f.fill is not None:
            value = f"coalesce({value}, {f.fill})"
        parts.append(f"round({value}, 6) AS {f.name}")
    return f"SELECT item_id, {', '.join(parts)} FROM items6"


_ITEMS6 = ",\nitems6 AS (SELECT *, " + CALENDAR_SQL + " FROM items)"


def _rounded(df, features):
    return df.select("item_id", *[r6(f.name) for f in features])


@query("std_by_key", with_items(_std_sql(catalog.STD_BY_KEY), _ITEMS6))
def std_by_key(spark, sf_dir):
    narrow = item_stage(spark, sf_dir, "item_id", *catalog.STD_STRING_KEYS, "price", "image_top_1").select("item_id", *catalog.STD_STRING_KEYS, "price", "image_top_1")
    return _rounded(engine.attach_stddev(narrow, catalog.STD_BY_KEY), catalog.STD_BY_KEY)


@query("std_by_rounded_key", with_items(
    _std_sql(catalog.STD_BY_ROUNDED_KEY, lambda k: f"CAST(round({k}) AS BIGINT)"), _ITEMS6))
def std_by_rounded_key(spark, sf_dir):
    narrow = _with_calendar(spark, sf_dir).select("item_id", "price", "image_top_1", "week", "dayofweek", "day")
    return _rounded(engine.attach_stddev(narrow, catalog.STD_BY_ROUNDED_KEY, rounded=True),
                    catalog.STD_BY_ROUNDED_KEY)


@query("std_calendar_by_user", with_items(_std_sql(catalog.STD_CALENDAR_BY_USER), _ITEMS6))
def std_calendar_by_user(spark, sf_dir):
    return _rounded(stages.stage7_calendar(_with_calendar(spark, sf_dir)), catalog.STD_CALENDAR_BY_USER)


PIPELINE_CTES = _CUSTOMERS_SQL + _cte(
    *_STAGE4_CTES, ("stage4", _STAGE4_SQL), _CALENDAR_CTE,
    ("stage5_new", attach_sql("items", catalog.STAGE5, columns="t.item_id")),
    ("stage5", f"SELECT s.* EXCLUDE ({', '.join(_DAY_DIFF)}), n.* EXCLUDE (item_id) FROM stage4 s "
               "LEFT JOIN stage5_new n ON s.item_id = n.item_id"),
    ("population", "SELECT t.item_id, coalesce(f.population, c.population) AS population FROM items t "
                   "LEFT JOIN region_city_population f ON t.city = f.city AND t.region = f.region "
                   "LEFT JOIN city_population c ON t.city = c.city"))
PIPELINE_SQL = ("SELECT f.*, c.week, c.dayofweek, c.day, p.population, m.unemployment_rate, m.GDP_PC_PPP, m.HDI "
                "FROM calendar c LEFT JOIN stage5 f ON c.item_id = f.item_id "
                "LEFT JOIN population p ON f.item_id = p.item_id LEFT JOIN region_macro m ON f.region = m.region")


@query("pipeline_all_stages", with_items(PIPELINE_SQL, PIPELINE_CTES))
def pipeline_all_stages(spark, sf_dir):
    """Stages three to eight in a row, on tables in buckets of the item id."""
    items = stage_items(spark, sf_dir)
    fine, coarse = population_tables(spark, sf_dir)
    population = enrich.coalesce_lookup(items.select("item_id", "region", "city"), fine, ["region", "city"],
                                        coarse, ["city"], "population").select("item_id", "population")
    return stages.in_a_row(items, population, macro_table(spark, sf_dir))
