"""Stage tables in buckets: what joins there does not shuffle."""

import threading

import pytest
from pyspark.sql import functions as F

from keyfold.features import catalog
from keyfold.features.engine import attach, attach_windows
from keyfold.features.spec import Feature
from keyfold.plans import stages
from keyfold.session import run_all, write_buckets, write_stage
from keyfold.sources.items import items as base_items


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def with_numbers(df, names):
    return df.select("item_id", *[F.col("number").cast("bigint").alias(n) for n in names])


def test_buckets_keep_all_rows_and_join_without_shuffle(spark, no_broadcast):
    frame = spark.range(0, 5000, 1, 4).select(
        F.when(F.col("id") % 50 > 0, F.col("id") % 1700).alias("k"), F.col("id").alias("v"))
    left, right = write_buckets(frame, "left", "k"), write_buckets(frame.groupBy("k").agg(F.max("v").alias("w")), "right", "k")
    assert sorted(left.collect(), key=str) == sorted(frame.collect(), key=str)
    joined = left.join(right, "k", "left")
    assert "Exchange" not in plan(joined)
    expected = frame.join(frame.groupBy("k").agg(F.max("v").alias("w")), "k", "left")
    assert joined.exceptAll(expected).isEmpty() and joined.count() == 5000
    # The result lies as its inputs do, so that writing it again moves no rows either.
    assert "Exchange" not in plan(joined.join(right.withColumnRenamed("w", "x"), "k", "left"))


def test_empty_buckets(spark):
    empty = write_buckets(spark.createDataFrame([], "k bigint, v string"), "empty", "k")
    assert empty.count() == 0 and empty.columns == ["k", "v"]


def test_stages_join_by_id_without_shuffle(spark, no_broadcast):
    base = spark.range(40).select(F.format_string("i%02d", "id").alias("item_id"), F.col("id").alias("number"))
    keys = [c for c in stages.ITEM_KEYS if c != "item_id"]
    when = F.date_add(F.lit("2017-03-15").cast("date"), F.col("number").cast("int"))
    wide = base.select("item_id", *[F.col("number").cast("string").alias(c) for c in keys], when.alias("activation_date"),
                       *[F.col("number").alias(c) for c in ("month", "day", "day_diff", *[f.name for f in catalog.BASE], *stages.TAIL)])
    items = write_buckets(wide.select("item_id", *keys, "activation_date"), "items", "item_id")
    part1 = write_buckets(wide.drop("activation_date"), "part1", "item_id")
    # Some items lack their features, and one has none in the last tables.
    counted, spans, pairs = (
        write_buckets(with_numbers(base.filter(F.col("number") % n > 0), [f.name for f in features]), "features", "item_id")
        for n, features in ((7, catalog.PART2 + catalog.PART3), (5, catalog.SPANS), (3, catalog.STAGE5)))
    population = write_buckets(with_numbers(base.filter("number < 30"), ["population"]), "population", "item_id")
    macros = write_stage(base.filter("number > 10").select(
        F.col("number").cast("string").alias("region"), *[F.col("number").cast("double").alias(c) for c in stages.MACRO_COLUMNS]), "macros")
    out = stages.join_stages(items, part1, counted, spans, pairs, population, macros)
    # The two shuffles are those of the region look-up, a broadcast at its real size.
    text = plan(out)
    assert text.count("Exchange hashpartitioning(region") == 2 and text.count("Exchange") == 2
    found = {r["item_id"]: r for r in out.collect()}
    assert len(found) == 40
    pair, span, count = (
        next(f.name for f in features if "day_diff" not in f.name) for features in (catalog.STAGE5, catalog.SPANS, catalog.PART2))
    for i in range(40):
        row = found[f"i{i:02d}"]
        assert row[pair] == (i if i % 3 else None) and row[span] == (i if i % 5 else None) and row[count] == (i if i % 7 else None)
        assert row["population"] == (i if i < 30 else None) and row["HDI"] == (float(i) if i > 10 else None)


def test_windows_of_many_kinds_equal_joins(spark):
    """Counts, spans and distinct counts whose windows share an order, and those that do not."""
    df = write_stage(spark.range(3000).selectExpr(
        "id", "nullif(id % 41, 0) AS user_id", "nullif(id % 7, 3) AS a", "nullif(id % 5, 1) AS b",
        "date_add(date'2020-01-01', cast(id % 90 AS int)) AS d"), "kinds")
    features = [
        Feature("n", ("user_id",), fill=0), Feature("n_a", ("user_id", "a"), fill=0), Feature("n_ab", ("user_id", "a", "b")),
        Feature("a_uq", ("user_id",), "distinct", "a"), Feature("b_uq", ("user_id", "a"), "distinct", "b", fill=0),
        Feature("d_uq", ("user_id", "a"), "distinct", "d"), Feature("span", ("user_id", "a"), "span", "d", fill=-1),
        Feature("n_b", ("user_id", "b")), Feature("has_b", ("user_id",), "count_col", "b"), Feature("n_again", ("user_id", "a"))]
    names = ["id", *[f.name for f in features]]
    windows, joins = (sorted(how.select(*names).collect()) for how in (attach_windows(df, features, "user_id"), attach(df, features)))
    assert [tuple(r) for r in windows] == [tuple(r) for r in joins]


def test_item_queries_of_one_scan_write_nothing(spark, monkeypatch):
    """Nor do others write the columns that they do not read."""
    from keyfold.registry import base

    monkeypatch.setattr(base, "_STAGED", {})
    at = "/root/testdata/sf0.001"
    once = base.item_rows(spark, at).select("item_id", "price")
    assert not base._STAGED and "o_totalprice" not in plan(once)
    narrow = base.item_stage(spark, at, "price", "item_id")
    assert narrow.columns == ["item_id", "price"] and base.item_stage(spark, at, "item_id", "price") is narrow
    assert sorted(narrow.collect()) == sorted(once.collect())
    whole = base.item_stage(spark, at)
    assert base.item_stage(spark, at, "price") is whole and base.item_rows(spark, at) is whole


def test_early_stages_shuffle_the_rows_by_user_once(spark):
    items = write_stage(base_items(spark, "/root/testdata/sf0.001"), "items")
    for stage in (stages.stage1, stages.stage2, stages.stage3_part1):
        shown = plan(stage(items))
        assert shown.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(user_id" in shown


def test_spans_of_users_that_the_rows_have_are_kept(spark):
    from pyspark.testing import assertDataFrameEqual

    items = write_stage(base_items(spark, "/root/testdata/sf0.001"), "items")
    more = [f for f in catalog.SPANS if f.keys == ("user_id",)]
    plain, given = (stages.stage4(write_stage(stages.stage3_part1(items, more=m), "part1"), items) for m in ((), more))
    assert plain.columns == given.columns
    assertDataFrameEqual(plain, given)


def test_feature_tables_are_built_side_by_side(spark, monkeypatch):
    """Builders wait for each other, which they would in vain one after the other; results stay in place."""
    together = threading.Barrier(4, timeout=30)

    def build(df, name, key):
        if name != "stage3_features":
            together.wait()
        return name

    monkeypatch.setattr(stages, "write_buckets", build)
    for step in ("stage3_part1", "stage3_features", "stage4_features", "stage5_features"):
        monkeypatch.setattr(stages, step, lambda df: df)
    monkeypatch.setattr(stages, "join_stages", lambda *tables: tables[1:])
    found = stages.in_a_row(spark.range(1), None, "macros")
    assert found == ("part1", "stage3_features", "stage4_features", "stage5_features", "population", "macros")


def test_jobs_side_by_side_fail_as_one(spark):
    with pytest.raises(ZeroDivisionError):
        run_all(spark, [lambda: 1, lambda: 1 // 0])
    assert run_all(spark, [lambda n=n: n for n in range(6)], 2) == list(range(6))


def test_stage_three_shuffles_no_wide_rows_by_id_unless_ids_repeat(spark, no_broadcast):
    items = write_stage(base_items(spark, "/root/testdata/sf0.001").limit(500), "items")
    for rows, joins in ((items, 0), (items.unionByName(items.limit(3)), 1)):
        part1 = write_stage(stages.stage3_part1(rows), "part1")
        out = stages.stage3(part1)
        assert stages.ids_differ(part1) == (not joins) and plan(out).count("SortMergeJoin") == joins
        joined = part1.join(write_stage(stages.stage3_features(part1), "counted"), "item_id", "left")
        assert sorted(map(repr, out.collect())) == sorted(map(repr, joined.select(*out.columns).collect()))
