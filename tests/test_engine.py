import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from keyfold.features.engine import (attach, attach_all, attach_grouping_sets, attach_stddev, attach_through_cells,
                                      attach_windows, null_safe_join, whole_number)
from keyfold.features import catalog, lattice
from keyfold.features.lattice import layers_of, needed_sets
from keyfold.features.spec import Feature
from keyfold.session import write_stage
from keyfold.sources.items import items as base_items

SCHEMA = "id int, user string, city string, param string, price double, d date"
COUNTS = [Feature("n_city", ("city",), fill=0), Feature("n_user_city", ("user", "city"), fill=0),
          Feature("n_user_param_price", ("user", "param", "price"), fill=0)]
OTHERS = [Feature("uq", ("user", "param"), "distinct", "price", fill=0),
          Feature("uq_open", ("city",), "distinct", "param"),
          Feature("span", ("user", "param"), "span", "d", fill=-1),
          Feature("priced", ("city",), "count_col", "price", fill=0)]


def make_rows(n=400):
    """Rows with NULLs in every key; one user and one city hold well over a third of them."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c", "d"])
        city = "big" if rng.random() < 0.4 else rng.choice([None, "x", "y"])
        rows.append((i, user, city, rng.choice([None, "p", "q"]), rng.choice([None, 0.5, 1.0, 2.5]),
                     date(2017, 1, 1) + timedelta(days=rng.randrange(90))))
    return rows


COLUMNS = ["id", "user", "city", "param", "price", "d"]


def brute(rows, feature):
    at = {c: i for i, c in enumerate(COLUMNS)}
    out = {}
    for row in rows:
        key = [row[at[k]] for k in feature.keys]
        if None in key:
            out[row[0]] = feature.fill
            continue
        group = [r for r in rows if [r[at[k]] for k in feature.keys] == key]
        values = [r[at[feature.arg]] for r in group if r[at[feature.arg]] is not None] if feature.arg else group
        out[row[0]] = {"count": lambda: len(group), "count_col": lambda: len(values),
                       "distinct": lambda: len(set(values)),
                       "span": lambda: (max(values) - min(values)).days}[feature.kind]()
    return out


def check(df, rows, features):
    got = {r["id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    for f in features:
        assert {i: r[f.name] for i, r in got.items()} == brute(rows, f), f.name


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("block", [2, 20])
def test_attach(frame, rows, block):
    check(attach(frame, COUNTS + OTHERS, large=("user",), block=block), rows, COUNTS + OTHERS)


def test_only_top_sets_read_the_rows(frame, rows):
    """Pairs come from triples and singles from pairs; one scan serves all top sets."""
    features = [Feature("n3", ("user", "city", "param"), fill=0), Feature("n2", ("city", "param"), fill=0), Feature("n1", ("city",), fill=0),
                Feature("uq", ("user", "city"), "distinct", "param", fill=0), Feature("uq1", ("city",), "distinct", "price", fill=0),
                Feature("span", ("param",), "span", "d", fill=0), Feature("own", ("price",), "distinct", "price", fill=0)]
    layers = layers_of(needed_sets(features))
    assert [sorted(map(sorted, layer)) for layer in layers] == [
        [["city", "param", "user"], ["city", "price"]], [["city", "param"], ["city", "user"], ["price"]], [["city"], ["param"]]]
    scans = []
    found = lattice._in_one_pass(frame, {s: i for i, s in enumerate(layers[0])}, [F.count(F.lit(1)).alias("n")])
    scans.append(found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
    assert scans == [1]
    check(attach(frame, features), rows, features)


@pytest.mark.parametrize("catalogue,tops", [(catalog.STAGE5, 3), (catalog.PART2 + catalog.PART3, 5), (catalog.BASE, 9)])
def test_catalogue_reads_rows_for_top_sets_only(catalogue, tops):
    sets = needed_sets(catalogue)
    first = layers_of(sets)[0]
    assert max(map(len, first)) == tops and len(layers_of(sets)) <= lattice.LAYERS + 1
    assert all(not any(s < t for t in sets) for s in first) and len(first) < len(sets)


def test_moments_of_many_partitions_in_one_pass(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], r[2], r[4], float(r[0] % 7)) for r in rows] + [(999, "alone", None, 3.0, None)],
                               "id int, user string, city string, price double, other double")
    features = [Feature(f"s_{v}_{k}", (k,), "stddev", v) for k in ("user", "city", "price") for v in ("price", "other")]
    got = {r["id"]: r for r in attach_stddev(df, features).collect()}
    data = [tuple(r) for r in df.collect()]
    at = {c: i for i, c in enumerate(df.columns)}
    for f in features:
        key, value = at[f.keys[0]], at[f.arg]
        for row in data:
            group = [r[value] for r in data if r[key] == row[key] and r[value] is not None]
            want = statistics.stdev(group) if len(group) > 1 else None
            assert got[row[0]][f.name] == (want if want is None else pytest.approx(want, abs=1e-9)), (f.name, row)


def test_attach_through_cells(frame, rows):
    check(attach_through_cells(frame, COUNTS + OTHERS), rows, COUNTS + OTHERS)


@pytest.mark.parametrize("cells", [(), ("city", "param"), ("city",)])
def test_attach_all_is_the_same_with_and_without_cells(frame, rows, cells):
    check(attach_all(frame, COUNTS + OTHERS, "user", cells), rows, COUNTS + OTHERS)


@pytest.mark.parametrize("max_rows", [10, 100, 1_000_000])
def test_attach_windows_with_light_and_heavy_users(frame, rows, max_rows):
    features = [f for f in COUNTS + OTHERS if "user" in f.keys]
    check(attach_windows(frame, features, "user", max_rows), rows, features)


def test_windows_without_special_users_share_one_shuffle(frame):
    features = [f for f in COUNTS + OTHERS if "user" in f.keys]
    clean = frame.filter("user is not null")
    plan = attach_windows(clean, features, "user")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(user") == 1


def test_windows_need_the_lead_column(frame):
    with pytest.raises(ValueError):
        attach_windows(frame, COUNTS, "user")


def test_attach_grouping_sets(frame, rows):
    check(attach_grouping_sets(frame, COUNTS), rows, COUNTS)


def test_source_may_differ_from_target(spark, frame):
    target = spark.createDataFrame([(1, "nowhere"), (2, "big"), (3, None)], "id int, city string")
    out = {r["id"]: (r["n_city"], r["uq_open"]) for r in
           attach(target, [COUNTS[0], OTHERS[1]], source=frame).collect()}
    assert out[1] == (0, None) and out[3] == (0, None) and out[2][0] > 100 and out[2][1] == 2


def test_float_keys(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, None), (4, float("nan")), (5, float("nan"))],
                               "id int, price double")
    out = attach(df, [Feature("n", ("price",), fill=0)])
    assert {r["id"]: r["n"] for r in out.collect()} == {1: 2, 2: 2, 3: 0, 4: 2, 5: 2}


def test_stddev_has_a_null_partition_and_null_for_one_row(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, None, 9.0), (5, "b", 7.0)],
                               "id int, k string, v double")
    plain = attach_stddev(df, [Feature("s", ("k",), "stddev", "v")])
    got = {r["id"]: r["s"] for r in plain.collect()}
    assert got[1] == pytest.approx(statistics.stdev([1, 3]))
    assert got[3] == got[4] == pytest.approx(statistics.stdev([5, 9]))
    assert got[5] is None
    filled = attach_stddev(df, [Feature("s", ("k",), "stddev", "v", fill=-1)])
    assert {r["id"]: r["s"] for r in filled.collect()}[5] == -1


def test_rounded_partition_keys(spark):
    df = spark.createDataFrame([(1, 2.5), (2, -2.5), (3, 0.5), (4, -0.5), (5, None)], "id int, x double")
    got = {r["id"]: r["k"] for r in df.select("id", whole_number("x").alias("k")).collect()}
    assert got == {1: 3, 2: -3, 3: 1, 4: -1, 5: None}


def test_null_safe_join(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, v int")
    assert {(r["id"], r["v"]) for r in null_safe_join(left, right, ["k"]).collect()} == {(1, 10), (2, None)}


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    saved = {}

    def put(**values):
        for key, value in values.items():
            key = "spark.sql." + key.replace("__", ".")
            saved.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield put
    for key, value in saved.items():
        spark.conf.set(key, value)


THIRDS = "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN id % 5000 END AS user"
HOT_CASES = {
    "one key": lambda df: attach(df, [Feature("n", ("user",), fill=0)]),
    "two keys": lambda df: attach(df, [Feature("n", ("user", "city"), fill=0)]),
    "stddev": lambda df: attach_stddev(df, [Feature("n", ("user",), "stddev", "v", fill=-1)]),
    "cells": lambda df: attach_through_cells(df, [Feature("n", ("user", "city"), fill=0)]),
    "hot in the target only": lambda df: attach(
        df, [Feature("n", ("user",), fill=0)], df.sparkSession.range(-1, 3).withColumn("user", F.col("id"))),
}


@pytest.mark.parametrize("case", HOT_CASES)
def test_heavy_and_null_keys_are_spread_over_the_shuffle(spark, settings, case):
    """A third of the rows under one key and a third under NULL: no task of the join gets a third."""
    settings(autoBroadcastJoinThreshold="-1", adaptive__coalescePartitions__enabled="false",
             adaptive__skewJoin__skewedPartitionThresholdInBytes="1k", adaptive__skewJoin__skewedPartitionFactor="1.2",
             adaptive__advisoryPartitionSizeInBytes="16k")
    df = write_stage(spark.range(0, 60_000, 1, 8).selectExpr("id", THIRDS, "'c' AS city", "rand(3) AS v"), "thirds")
    out = HOT_CASES[case](df)
    # The sum keeps the optimizer from leaving the join out.
    counted = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("id").alias("rows"), F.sum("n"))
    sizes = [r["rows"] for r in counted.collect()]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan
    assert sum(sizes) == 60_000 and max(sizes) < 60_000 / 5


def test_small_aggregates_do_not_shuffle_the_rows(spark, settings, frame):
    settings(autoBroadcastJoinThreshold="200k")
    rows = write_stage(frame, "rows")
    for out in (attach(rows, COUNTS + OTHERS, large=("user",)), attach_stddev(rows, [Feature("s", ("city",), "stddev", "price")])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_wide_stage_shuffles_rows_once(spark, settings):
    """All features of the widest stage: one shuffle by user, and broadcasts of written aggregates."""
    items = write_stage(base_items(spark, "/root/testdata/sf0.001"), "items")
    columns = sorted({c for f in catalog.STAGE5 for c in (*f.keys, f.arg) if c})
    led = [f for f in catalog.STAGE5 if "user_id" in f.keys]
    plan = attach_windows(items.select("item_id", *columns), led, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 1 and plan.count("Exchange") == 1
    plan = attach_all(items.select("item_id", *columns), catalog.STAGE5, cell_columns=catalog.TRIPLE_CELLS)
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_windows_sort_the_rows_once_for_all_key_sets(frame):
    features = [f for f in COUNTS + OTHERS if "user" in f.keys]
    plan = attach_windows(frame.filter("user is not null"), features, "user")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan


def test_standard_deviations_led_by_a_column(frame, rows):
    feature = Feature("s", ("user", "param"), "stddev", "price")
    got = {r["id"]: r["s"] for r in attach_windows(frame.filter("user is not null"), [feature], "user").collect()}
    want = {r["id"]: r["s"] for r in frame.filter("user is not null and param is not null").selectExpr(
        "id", "stddev_samp(price) over (partition by user, param) as s").collect()}
    assert all((v is None) == (want.get(i) is None) and (v is None or abs(v - want[i]) < 1e-9) for i, v in got.items())


def test_blocks_of_joins_carry_finished_columns_as_one(frame, rows, monkeypatch):
    from keyfold.features import engine
    written = []
    monkeypatch.setattr(engine, "write_stage", lambda df, name: written.append((name, df.columns)) or write_stage(df, name))
    check(attach(frame, COUNTS + OTHERS, block=1), rows, COUNTS + OTHERS)
    blocks = [columns for name, columns in written if name == "block"]
    assert blocks and all(len(c) == len(frame.columns) + i + 1 for i, c in enumerate(blocks))
