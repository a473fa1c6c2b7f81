"""Queries on rows: union, split, profile, look-ups, encoders, fills, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyfold.features import catalog
from keyfold.functions import scalar
from keyfold.functions import text as T
from keyfold.operators import encode, enrich, profile, rows
from keyfold.plans import stages
from keyfold.registry.base import item_rows, item_stage, query, r6, with_items
from keyfold.session import stage_root, write_stage
from keyfold.sources.files import read_csv, write_csv
from keyfold.sources.items import ITEM_COLUMNS, read_table

ALL = ", ".join(ITEM_COLUMNS)


# --- union, split, eliminate ----------------------------------------------------------------------
@query("union_labelled_unlabelled", with_items(f"SELECT {ALL} FROM items"))
def union_labelled_unlabelled(spark, sf_dir):
    df = item_stage(spark, sf_dir)
    return rows.union_labelled(rows.labelled(df), rows.unlabelled(df).drop(rows.LABEL)).select(*ITEM_COLUMNS)


@query("split_labelled", with_items(f"SELECT {ALL} FROM items WHERE deal_probability IS NOT NULL"))
def split_labelled(spark, sf_dir):
    return rows.labelled(item_rows(spark, sf_dir)).select(*ITEM_COLUMNS)


@query("split_unlabelled", with_items(f"SELECT {ALL} FROM items WHERE deal_probability IS NULL"))
def split_unlabelled(spark, sf_dir):
    return rows.unlabelled(item_rows(spark, sf_dir)).select(*ITEM_COLUMNS)


@query("limit_sample", with_items("SELECT item_id, user_id, price FROM items ORDER BY item_id LIMIT 1000"))
def limit_sample(spark, sf_dir):
    return rows.limit_sample(item_stage(spark, sf_dir, "item_id", "user_id", "price").select("item_id", "user_id", "price"), 1000, ["item_id"])


@query("eliminate_ids", with_items(
    "SELECT item_id, user_id, deal_probability FROM items WHERE item_id NOT IN "
    "(SELECT item_id FROM items WHERE image IS NULL)"))
def eliminate_ids(spark, sf_dir):
    df = item_stage(spark, sf_dir, "item_id", "user_id", "deal_probability", "image")
    listed = df.filter(F.col("image").isNull()).select("item_id")
    return rows.eliminate(df.select("item_id", "user_id", "deal_probability"), listed)


# --- frequencies ----------------------------------------------------------------------------------
_BY_COLUMN = ["item_id", "user_type", "parent_category_name", "category_name", "region", "city",
              "param_1", "param_2", "param_3", "user_id"]


@query("freq_count_col", with_items(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, {c} AS value, count({c}) AS n FROM items GROUP BY {c}" for c in _BY_COLUMN)))
def freq_count_col(spark, sf_dir):
    df = item_stage(spark, sf_dir, *_BY_COLUMN)
    return rows.append([profile.frequency(df, [c], "n", of=c).select(
        F.lit(c).alias("col_name"), F.col(c).alias("value"), "n") for c in _BY_COLUMN])


_ORDERED = {
    "freq_user_type": (["user_type"], "user_type_count", "user_type", "asc"),
    "freq_city": (["city"], "city_count", "city", "desc"),
    "freq_user_id": (["user_id"], "user_id_count", "user_id", "desc"),
    "freq_item_seq_number": (["item_seq_number"], "item_seq_number_count", None, "desc"),
    "freq_image": (["image"], "image_count", None, "desc"),
    "freq_user_and_type": (["user_id", "user_type"], "user_id_count", "user_id", "desc"),
    "freq_category_path": (list(catalog.CATEGORY_PATH), "parent_child_param_1_2_3_count", None, "desc"),
    "freq_region_city": (["region", "city"], "region_city_count", None, "desc"),
    "freq_region_city_category": (["region", "city", *catalog.CATEGORY_PATH],
                                  "region_city_all_category_count", None, "desc"),
    "freq_user_category": (["user_id", *catalog.CATEGORY_PATH], "user_id_all_category_count", None, "desc"),
    "freq_user_region_city": (["user_id", "region", "city"], "user_id_region_city_count", None, "desc"),
    "freq_user_region_city_category": (
        ["user_id", "region", "city", "parent_category_name", "category_name"],
        "user_id_region_city_parent_child_category_count", None, "desc"),
    "freq_user_price": (["user_id", "price"], "user_id_price_count", None, None),
}


def _register_frequency(name, keys, alias, of, order):
    key_list = ", ".join(keys)

    @query(name, with_items(
        f"SELECT {key_list}, count({of or '*'}) AS {alias} FROM items GROUP BY {key_list}"))
    def run(spark, sf_dir):
        return profile.frequency(item_rows(spark, sf_dir), keys, alias, of, order)


for _name, _args in _ORDERED.items():
    _register_frequency(_name, *_args)


@query("freq_image_unlabelled", with_items(
    "SELECT image, count(*) AS image_count FROM items WHERE deal_probability IS NULL GROUP BY image"))
def freq_image_unlabelled(spark, sf_dir):
    return profile.frequency(rows.unlabelled(item_rows(spark, sf_dir)), ["image"], "image_count", order="desc")


_DISTINCT = {
    "distinct_category_by_parent": ("parent_category_name", "category_name", "category_name_unique", "cnt"),
    "distinct_city_by_region": ("region", "city", "city_unique", "region_count"),
    "distinct_price_by_user": ("user_id", "price", "user_id_price_unique", None),
}


def _register_distinct(name, key, of, alias, count_name):
    counts = f"count(*) AS {count_name}, " if count_name else ""

    @query(name, with_items(f"SELECT {key}, {counts}count(DISTINCT {of}) AS {alias} FROM items GROUP BY {key}"))
    def run(spark, sf_dir):
        return profile.distinct_values(item_rows(spark, sf_dir), [key], of, alias, count_name)


for _name, _args in _DISTINCT.items():
    _register_distinct(_name, *_args)

_SPAN_KEYS = ", ".join(catalog.ALL_CATEGORIES)


@query("span_9key", with_items(
    f"SELECT {_SPAN_KEYS}, count(*) AS user_id_region_city_parent_child_category_count, "
    f"date_diff('day', min(activation_date), max(activation_date)) AS diff FROM items GROUP BY {_SPAN_KEYS}"))
def span_9key(spark, sf_dir):
    return profile.date_span(item_rows(spark, sf_dir), list(catalog.ALL_CATEGORIES), "diff",
                             "user_id_region_city_parent_child_category_count")


@query("span_1key", with_items(" UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt, "
    f"date_diff('day', min(activation_date), max(activation_date)) AS minmax_diff FROM items GROUP BY {c}"
    for c in catalog.SPAN_COLUMNS)))
def span_1key(spark, sf_dir):
    df = item_stage(spark, sf_dir, *catalog.SPAN_COLUMNS, catalog.DATE)
    return rows.append([profile.date_span(df, [c], "minmax_diff", "cnt").select(
        F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value"), "cnt", "minmax_diff")
        for c in catalog.SPAN_COLUMNS])


@query("uq_span_pair", with_items(
    "SELECT user_id, city, count(DISTINCT category_name) AS uq, "
    "date_diff('day', min(activation_date), max(activation_date)) AS minmax_diff FROM items GROUP BY user_id, city"))
def uq_span_pair(spark, sf_dir):
    return profile.distinct_and_span(item_rows(spark, sf_dir), ["user_id", "city"], "category_name")


# --- dates ----------------------------------------------------------------------------------------
CALENDAR_SQL = ("month(activation_date)::INTEGER AS month, CAST(strftime(activation_date, '%U') AS INTEGER) AS week, "
                "(dayofweek(activation_date) + 1)::INTEGER AS dayofweek, day(activation_date)::INTEGER AS day")


@query("calendar_parts", with_items(f"SELECT item_id, {CALENDAR_SQL} FROM items"))
def calendar_parts(spark, sf_dir):
    return stages.calendar(item_rows(spark, sf_dir))


@query("day_diff_anchor", with_items(
    "SELECT item_id, date_diff('day', DATE '2017-03-15', activation_date) AS day_diff FROM items"))
def day_diff_anchor(spark, sf_dir):
    return item_rows(spark, sf_dir).select(
        "item_id", scalar.days_since("activation_date", stages.ANCHOR).alias("day_diff"))


@query("whole_days_between", "SELECT o_orderkey, l_linenumber, date_sub('day', o_orderdate, l_shipdate) AS days "
                             "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def whole_days_between(spark, sf_dir):
    joined = read_table(spark, sf_dir, "lineitem").join(
        read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("o_orderkey", "l_linenumber",
                         scalar.whole_days_between("o_orderdate", "l_shipdate").alias("days"))


# --- look-ups -------------------------------------------------------------------------------------
_CUSTOMERS_SQL = """,
customers AS (SELECT r_name AS region, n_name AS city, c_acctbal FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
region_city_population AS (SELECT region, city, count(*) AS population FROM customers
  GROUP BY region, city HAVING count(*) % 3 <> 0),
city_population AS (SELECT city, count(*) AS population FROM customers
  GROUP BY city HAVING count(*) % 2 = 0),
region_macro AS (SELECT region, round(avg(c_acctbal), 6) AS unemployment_rate, max(c_acctbal) AS GDP_PC_PPP,
  min(c_acctbal) AS HDI FROM customers GROUP BY region HAVING count(*) % 5 <> 0)"""


def customers(spark, sf_dir):
    return (read_table(spark, sf_dir, "customer")
            .join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("region"), F.col("n_name").alias("city"), "c_acctbal"))


def population_tables(spark, sf_dir):
    """Two population dimensions over all customers, each without some of its rows, by their own count,
    so that look-ups miss. They are written, so that their size is known when they are joined."""
    people, count = customers(spark, sf_dir), F.count(F.lit(1)).alias("population")
    fine = people.groupBy("region", "city").agg(count).filter("population % 3 <> 0")
    coarse = people.groupBy("city").agg(count).filter("population % 2 = 0")
    return write_stage(fine, "population_fine"), write_stage(coarse, "population_coarse")


def macro_table(spark, sf_dir):
    macros = customers(spark, sf_dir).groupBy("region").agg(
        F.round(F.avg("c_acctbal"), 6).alias("unemployment_rate"),
        F.max("c_acctbal").alias("GDP_PC_PPP"), F.min("c_acctbal").alias("HDI"), F.count(F.lit(1)).alias("_n"))
    return write_stage(macros.filter("_n % 5 <> 0").drop("_n"), "macros")


@query("population_union", with_items(
    "SELECT t.item_id, t.region, t.city, p.population FROM items t JOIN region_city_population p "
    "ON t.city = p.city AND t.region = p.region UNION ALL "
    "SELECT t.item_id, t.region, t.city, p.population FROM items t JOIN city_population p ON t.city = p.city",
    _CUSTOMERS_SQL))
def population_union(spark, sf_dir):
    return enrich.population_union(item_stage(spark, sf_dir, "item_id", "region", "city"), *population_tables(spark, sf_dir))


@query("population_lookup", with_items(
    "SELECT t.item_id, t.region, t.city, coalesce(f.population, c.population) AS population FROM items t "
    "LEFT JOIN region_city_population f ON t.city = f.city AND t.region = f.region "
    "LEFT JOIN city_population c ON t.city = c.city", _CUSTOMERS_SQL))
def population_lookup(spark, sf_dir):
    fine, coarse = population_tables(spark, sf_dir)
    return enrich.coalesce_lookup(item_rows(spark, sf_dir).select("item_id", "region", "city"),
                                  fine, ["region", "city"], coarse, ["city"], "population")


@query("region_macro_join", with_items(
    "SELECT t.item_id, t.region, m.unemployment_rate, m.GDP_PC_PPP, m.HDI FROM items t "
    "LEFT JOIN region_macro m ON t.region = m.region", _CUSTOMERS_SQL))
def region_macro_join(spark, sf_dir):
    return enrich.left_lookup(item_rows(spark, sf_dir).select("item_id", "region"), macro_table(spark, sf_dir),
                              ["region"], stages.MACRO_COLUMNS)


@query("text_concat_join", with_items(
    "SELECT r.item_id, r.uq_rate, tt.title || ' ' || tt.description AS title_desc FROM "
    "(SELECT item_id, image_top_1 / 100 AS uq_rate FROM items WHERE image IS NOT NULL) r "
    "LEFT JOIN items tt ON r.item_id = tt.item_id"))
def text_concat_join(spark, sf_dir):
    df = item_stage(spark, sf_dir, "item_id", "image", "image_top_1", "title", "description")
    rates = df.filter(F.col("image").isNotNull()).select("item_id", (F.col("image_top_1") / 100).alias("uq_rate"))
    texts = df.select("item_id", F.concat("title", F.lit(" "), "description").alias("title_desc"))
    return enrich.left_lookup(rates, texts, ["item_id"], ["title_desc"])


# --- encoders and fills -----------------------------------------------------------------------------
_CODED = ["user_id", "region", "city", "parent_category_name", "category_name", "param_1", "param_2", "param_3",
          "user_type"]
_PARAMS = ["param_1", "param_2", "param_3"]
# What stands in for a missing parameter and a missing image code.
NO_PARAMETER, NO_IMAGE_CODE = "no_description", -1.0


def _filled_param(c):
    return f"coalesce({c}, '{NO_PARAMETER}')" if c in _PARAMS else c


@query("label_encode", with_items("SELECT item_id, " + ", ".join(
    f"dense_rank() OVER (ORDER BY {_filled_param(c)}) - 1 AS {c}" for c in _CODED) + " FROM items"))
def label_encode(spark, sf_dir):
    filled = encode.fill_literals(item_stage(spark, sf_dir, "item_id", *_CODED).select("item_id", *_CODED),
                                  {p: NO_PARAMETER for p in _PARAMS})
    return encode.label_encode(filled, _CODED)


@query("fill_literal", with_items("SELECT item_id, " + ", ".join(
    f"{_filled_param(p)} AS {p}" for p in _PARAMS) + ", coalesce(image_top_1, -1) AS image_top_1 FROM items"))
def fill_literal(spark, sf_dir):
    df = item_rows(spark, sf_dir).select("item_id", *_PARAMS, "image_top_1")
    return encode.fill_literals(df, {**{p: NO_PARAMETER for p in _PARAMS}, "image_top_1": NO_IMAGE_CODE})


@query("fill_zero", with_items(
    "SELECT item_id, coalesce(price, 0) AS price, coalesce(image_top_1, 0) AS image_top_1 FROM items"))
def fill_zero(spark, sf_dir):
    return encode.fill_zero(item_rows(spark, sf_dir).select("item_id", "price", "image_top_1"),
                            ["price", "image_top_1"])


@query("mean_impute", with_items(
    "SELECT item_id, round(coalesce(price, (SELECT avg(price) FROM items)), 6) AS price, "
    "round(coalesce(image_top_1, (SELECT avg(image_top_1) FROM items)), 6) AS image_top_1 FROM items"))
def mean_impute(spark, sf_dir):
    columns = ["price", "image_top_1"]
    filled = encode.fill_mean(item_stage(spark, sf_dir, "item_id", *columns).select("item_id", *columns), columns)
    return filled.select("item_id", *[r6(c) for c in columns])


# --- scalars --------------------------------------------------------------------------------------
@query("clip_unit", with_items(
    "SELECT item_id, CASE WHEN image_top_1 IS NULL THEN NULL WHEN image_top_1 / 20 - 0.5 < 0 THEN 0.0::DOUBLE "
    "WHEN image_top_1 / 20 - 0.5 > 1 THEN 1.0::DOUBLE ELSE image_top_1 / 20 - 0.5 END AS clipped FROM items"))
def clip_unit(spark, sf_dir):
    return item_rows(spark, sf_dir).select(
        "item_id", scalar.clip_unit(F.col("image_top_1") / 20 - 0.5).alias("clipped"))


@query("log2_bucket", with_items("SELECT item_id, CAST(floor(log2(1 + price)) AS INTEGER) AS bucket FROM items"))
def log2_bucket(spark, sf_dir):
    return item_rows(spark, sf_dir).select("item_id", scalar.log2_bucket("price").alias("bucket"))


@query("log10_bucket", with_items("SELECT item_id, CAST(floor(log10(1 + price)) AS INTEGER) AS bucket FROM items"))
def log10_bucket(spark, sf_dir):
    return item_rows(spark, sf_dir).select("item_id", scalar.log10_bucket("price").alias("bucket"))


@query("text_default", with_items(
    f"SELECT item_id, coalesce(title || ' ' || description, '{T.NO_DESCRIPTION}') AS title_desc FROM items"))
def text_default(spark, sf_dir):
    return item_rows(spark, sf_dir).select("item_id", T.title_description().alias("title_desc"))


# --- files ----------------------------------------------------------------------------------------
_CSV_COLUMNS = ["item_id", *_PARAMS, "title", "description", "price", "image_top_1", "activation_date", "deal_probability"]


@query("csv_roundtrip", with_items(f"SELECT {', '.join(_CSV_COLUMNS)} FROM items"))
def csv_roundtrip(spark, sf_dir):
    """Write gzip shards, then read them by file-name pattern under a stated schema."""
    df = item_rows(spark, sf_dir).select(*_CSV_COLUMNS)
    path = f"{stage_root(spark)}/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"
    write_csv(df, path, gzip=True)
    return read_csv(spark, f"{path}/part-*.csv.gz", df.schema)
