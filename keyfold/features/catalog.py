"""The feature catalogue: every aggregate of the pipeline, built from rules where one exists."""

from __future__ import annotations

from itertools import combinations

from keyfold.features.spec import Feature

DATE = "activation_date"
CATEGORY_PATH = ("parent_category_name", "category_name", "param_1", "param_2", "param_3")
ALL_CATEGORIES = ("user_id", "region", "city", *CATEGORY_PATH, "user_type")

# --- fixed values: the eleven hand-picked aggregates of the first stage -----------------------
BASE = [
    Feature("all_categ_minmax_diff", ALL_CATEGORIES, "span", DATE, fill=0),
    Feature("category_name_unique", ("parent_category_name",), "distinct", "category_name"),
    Feature("all_category_count", CATEGORY_PATH, fill=0),
    Feature("city_unique", ("region",), "distinct", "city"),
    Feature("region_city_count", ("region", "city"), fill=0),
    Feature("region_city_all_category_count", ("region", "city", *CATEGORY_PATH), fill=0),
    Feature("user_id_all_category_count", ("user_id", *CATEGORY_PATH), fill=0),
    Feature("user_id_region_city_count", ("user_id", "region", "city"), fill=0),
    Feature("user_id_region_city_parent_child_category_count",
            ("user_id", "parent_category_name", "category_name", "region", "city"), fill=0),
    Feature("user_id_price_count", ("user_id", "price"), fill=0),
    Feature("user_id_price_unique", ("user_id",), "distinct", "price"),
]
# The first stage has the first nine of these, the second stage all eleven.
STAGE1_BASE = BASE[:9]

# --- counts over one and two of thirteen columns ----------------------------------------------
PAIR_COLUMNS = ("user_id", "region", "city", "parent_category_name", "category_name", "param_1", "param_2",
                "param_3", "user_type", "price", "day_diff", "all_categ_minmax_diff", "image_top_1")
# Sets the pipeline leaves out, and output names that do not follow the rule.
PAIRS_LEFT_OUT = {
    ("day_diff",), ("all_categ_minmax_diff",), ("region", "city"), ("user_id", "price"),
    ("city", "image_top_1"), ("parent_category_name", "day_diff"), ("param_2", "all_categ_minmax_diff"),
}
PAIR_NAMES = {
    ("city", "all_categ_minmax_diff"): "city_all_categ_minmax_diff_count_count",
    ("region", "all_categ_minmax_diff"): "region_all_categ_minmax_difff_count",
    ("region", "category_name"): "region_child_category_name_count",
    ("user_id", "category_name"): "user_id_child_category_name_count",
    ("parent_category_name", "category_name"): "parent_category_name_child_category_name_count",
}
# The counts led by these columns belong to the second part of stage three, the others to the third.
PART2_LEADERS = {"city", "category_name", "all_categ_minmax_diff"}


def _single_and_pair_counts() -> list[Feature]:
    key_sets = [k for size in (1, 2) for k in combinations(PAIR_COLUMNS, size) if k not in PAIRS_LEFT_OUT]
    features = [Feature(PAIR_NAMES.get(k, "_".join(k) + "_count"), k, fill=0) for k in key_sets]
    return sorted(features, key=lambda f: f.name)


PART2 = [f for f in _single_and_pair_counts() if f.keys[0] in PART2_LEADERS]
PART3 = sorted(
    [f for f in _single_and_pair_counts() if f.keys[0] not in PART2_LEADERS]
    + [
        Feature("parent_child_category_name_unique", ("parent_category_name",), "distinct", "category_name"),
        Feature("parent_child_param_1_2_3_count", CATEGORY_PATH, fill=0),
        Feature("region_city_unique", ("region",), "distinct", "city"),
    ],
    key=lambda f: f.name,
)
# Columns that the third part drops from the second.
PART3_DROPS = [
    "user_id_all_category_count", "user_id_region_city_count",
    "user_id_region_city_parent_child_category_count", "user_id_price_count", "user_id_price_unique",
    "category_name_day_diff_count", "category_name_param_1_count", "city_param_2_count",
]

# Columns of bounded domains, on whose distinct tuples these counts may be computed instead.
PAIR_CELLS = ("region", "city", *CATEGORY_PATH, "user_type")

# --- date spans over one column ---------------------------------------------------------------
SPAN_COLUMNS = ("category_name", "city", "image_top_1", "param_1", "param_2", "param_3",
                "parent_category_name", "price", "region", "user_id", "user_type")
SPANS = [Feature(f"{c}_minmax_diff", (c,), "span", DATE, fill=-1) for c in SPAN_COLUMNS]

# --- counts over triples; distinct counts and spans over pairs ---------------------------------
TRIPLE_COLUMNS = ("user_id", "city", "param_1", "param_2", "param_3", "category_name", "price", "image_top_1")
# Triples each family leaves out, and span names that do not follow the rule.
TRIPLES_LEFT_OUT = {("user_id", "category_name", "price"), ("param_1", "price", "image_top_1")}
UNIQUES_LEFT_OUT = {("city", "param_3", "price"), ("param_2", "param_3", "category_name")}
SPAN_NAMES = {
    ("param_1", "price", "image_top_1"): "param_1_price_image_top_1_diff",
    ("param_2", "category_name", "price"): "param_2_category_name_price_diff",
}


def _by_name(triples):
    return sorted(triples, key="_".join)


def _triples(left_out):
    return _by_name(t for t in combinations(TRIPLE_COLUMNS, 3) if t not in left_out)


TRIPLES = [Feature("_".join(t) + "_count", t, fill=0) for t in _triples(TRIPLES_LEFT_OUT)]
# The third column only names the span; it is the argument of the distinct count, never a key.
PAIR_SPANS = [Feature(SPAN_NAMES.get(t, "_".join(t) + "_minmax_diff"), t[:2], "span", DATE, fill=0)
              for t in _triples(UNIQUES_LEFT_OUT)]
PAIR_UNIQUES = [Feature("_".join(t) + "_uq", t[:2], "distinct", t[2], fill=0)
                for t in _triples(UNIQUES_LEFT_OUT)]
STAGE5 = TRIPLES + PAIR_SPANS + PAIR_UNIQUES

TRIPLE_CELLS = ("city", "param_1", "param_2", "param_3", "category_name")

# --- standard deviations over partitions --------------------------------------------------------
STD_STRING_KEYS = ("city", "user_id", "region", "parent_category_name", "category_name",
                   "param_1", "param_2", "param_3")
STD_BY_KEY = [Feature(f"std_{v}_by_{k}", (k,), "stddev", v)
              for k in STD_STRING_KEYS for v in ("price", "image_top_1")]
# Keys of this family are rounded to whole numbers first. Price by image_top_1 carries a name of
# its own here; the original note calls its former name a mistake.
STD_BY_ROUNDED_KEY = [
    Feature("std_image_top_1_by_price", ("price",), "stddev", "image_top_1"),
    Feature("std_price_by_image_top_1", ("image_top_1",), "stddev", "price"),
    *[Feature(f"std_{v}_by_{k}", (k,), "stddev", v)
      for k in ("week", "dayofweek", "day") for v in ("price", "image_top_1")],
]
STD_CALENDAR_BY_USER = [Feature(f"std_{v}_by_user_id", ("user_id",), "stddev", v, fill=-1)
                        for v in ("week", "dayofweek", "day")]
