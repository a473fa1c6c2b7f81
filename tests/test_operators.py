import math

import pytest
from pyspark.sql import functions as F

from keyfold.operators import encode, enrich, ensemble, profile, rows
from keyfold.operators.crossfit import BoostingParams, assemble, boost, cross_fit, rounds_kept, top_importance
from keyfold.session import write_stage
from keyfold.operators.ranking import with_rank
from keyfold.plans import stages
from keyfold.sources.files import read_csv, read_vectors, write_csv, write_vectors


def test_union_and_split(spark):
    a = spark.createDataFrame([("1", 0.5)], "item_id string, deal_probability double")
    b = spark.createDataFrame([("2",)], "item_id string")
    both = rows.union_labelled(a, b)
    assert both.schema["deal_probability"].dataType.typeName() == "double"
    assert [r["item_id"] for r in rows.labelled(both).collect()] == ["1"]
    assert [r["item_id"] for r in rows.unlabelled(both).collect()] == ["2"]
    assert [r["item_id"] for r in rows.eliminate(both, a.select("item_id")).collect()] == ["2"]


def test_count_of_a_null_group_depends_on_what_is_counted(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    assert {r["k"]: r["n"] for r in profile.frequency(df, ["k"], "n", of="k").collect()} == {"a": 1, None: 0}
    assert {r["k"]: r["n"] for r in profile.frequency(df, ["k"], "n").collect()} == {"a": 1, None: 2}


def test_distinct_ignores_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    assert {r["k"]: r["u"] for r in profile.distinct_values(df, ["k"], "v", "u").collect()} == {"a": 1, "b": 0}


def test_population_in_both_tables_doubles_unless_coalesced(spark):
    items = spark.createDataFrame([("1", "r", "c"), ("2", "r", "d"), ("3", "s", "e")],
                                  "item_id string, region string, city string")
    fine = spark.createDataFrame([("r", "c", 10)], "region string, city string, population int")
    coarse = spark.createDataFrame([("c", 7), ("d", 8), ("d", 9)], "city string, population int")
    union = sorted((r["item_id"], r["population"]) for r in enrich.population_union(items, fine, coarse).collect())
    assert union == [("1", 7), ("1", 10), ("2", 8), ("2", 9)]
    single = enrich.coalesce_lookup(items, fine, ["region", "city"], coarse, ["city"], "population")
    assert {r["item_id"]: r["population"] for r in single.collect()} == {"1": 10, "2": 9, "3": None}
    assert single.count() == 3


def test_label_encode_ranks_sorted_values(spark):
    data = [("1", "b", "я"), ("2", "a", "z"), ("3", None, "A"), ("4", "b", "z")]
    df = spark.createDataFrame(data, "item_id string, x string, y string")
    got = {r["item_id"]: (r["x"], r["y"]) for r in encode.label_encode(df, ["x", "y"]).collect()}
    assert got == {"1": (1, 2), "2": (0, 1), "3": (None, 0), "4": (1, 1)}


def test_rank_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = with_rank(df, ["v"], "place").collect()
    assert len(got) == 1000 and all(r["v"] == r["place"] for r in got)


def test_fills(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, "a"), (None, "b")], "x double, s string")
    assert [r["x"] for r in encode.fill_mean(df, ["x"]).collect()] == [1.0, 3.0, 2.0]
    assert [r["x"] for r in encode.fill_zero(df, ["x"]).collect()] == [1.0, 3.0, 0.0]
    assert [r["s"] for r in encode.fill_literals(df, {"s": "no"}).collect()] == ["no", "a", "b"]


def test_stage6_keeps_calendar_rows_without_features(spark):
    features = spark.createDataFrame([("1", 5.0)], "item_id string, price double")
    calendar = spark.createDataFrame([("1", 2, 3, 4), ("9", 5, 6, 7)], "item_id string, week int, dayofweek int, day int")
    got = {(r["item_id"], r["price"], r["week"]) for r in stages.stage6(features, calendar).collect()}
    assert got == {("1", 5.0, 2), (None, None, 5)}


def test_folds_are_stable_and_near_equal(spark):
    df = spark.range(40_000).select(F.col("id").cast("string").alias("k"))
    sizes = [r["count"] for r in df.groupBy(ensemble.hash_fold("k").alias("f")).count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 800
    again = df.select(ensemble.hash_fold("k").alias("a"), ensemble.hash_fold("k", seed=42).alias("b")).collect()
    assert any(r["a"] != r["b"] for r in again)


def test_metrics_and_best_round(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0)], "prediction double, label double")
    r = df.agg(ensemble.rmse().alias("rmse"), ensemble.mae().alias("mae")).first()
    assert r["rmse"] == pytest.approx(math.sqrt(2.5)) and r["mae"] == pytest.approx(1.5)
    history = spark.createDataFrame([(0, 1, 0.3), (0, 2, 0.1), (0, 3, 0.1)], "fold int, epoch int, val_loss double")
    assert ensemble.best_round(history, ["fold"]).first()["best_round"] == 2


def test_submission_keeps_template_and_clips(spark):
    template = spark.createDataFrame([("1",), ("2",), ("3",)], "item_id string")
    predictions = spark.createDataFrame([("1", 1.5), ("3", -0.5)], "item_id string, deal_probability double")
    got = {r["item_id"]: r["deal_probability"] for r in ensemble.submission(template, predictions).collect()}
    assert got == {"1": 1.0, "2": None, "3": 0.0}


def test_csv_keeps_types_quotes_and_line_breaks(spark, tmp_path):
    data = [("1", 'say "hi", ok', 1.5), ("2", "two\nlines", None), ("3", "", 0.0), ("4", None, -1.0)]
    df = spark.createDataFrame(data, "item_id string, title string, price double")
    path = str(tmp_path / "csv")
    write_csv(df.repartition(2), path, gzip=True)
    back = read_csv(spark, f"{path}/part-*.csv.gz", df.schema)
    data[2] = ("3", None, 0.0)
    assert sorted(map(tuple, back.collect())) == sorted(data)


def test_vector_text(spark, tmp_path):
    lines = ["2 3", "слово 0.5 -1 x 2e-1", "a 1 2 3 ", "a 4 5 6"]
    (tmp_path / "v.vec").write_text("\n".join(lines), encoding="utf-8")
    got = {r["word"]: [round(v, 4) for v in r["vector"]] for r in read_vectors(spark, str(tmp_path / "v.vec")).collect()}
    assert got == {"2": [3.0], "слово": [0.5, -1.0, 0.2], "a": [4.0, 5.0, 6.0]}
    df = spark.createDataFrame([("w", [0.25, -3.0])], "word string, vector array<float>")
    write_vectors(df, str(tmp_path / "out"))
    assert read_vectors(spark, str(tmp_path / "out")).first()["vector"] == [0.25, -3.0]


def test_patience_outlasts_a_stall():
    stalls_then_falls = [5.0, 4.0, 4.0, 4.1, 4.0, 3.0, 3.5, 3.5, 3.5, 3.5]
    assert rounds_kept(stalls_then_falls, 4) == (6, True)
    assert rounds_kept(stalls_then_falls, 3) == (2, True)
    assert rounds_kept(stalls_then_falls, 30) == (6, False)


def test_boosting_is_cut_at_the_best_round(spark):
    df = spark.range(400).select(((F.col("id") * 7919) % 97 / 97.0).alias("x"), (F.col("id") % 3).cast("double").alias("z"),
                                 (F.col("id") % 4 == 0).alias("held"))
    df = assemble(df.withColumn("label", F.when(F.col("x") > 0.5, 1.0).otherwise(0.0) + F.col("z") * 0.3), ["x", "z"], ["label", "held"], {})
    df = write_stage(df, "boost")
    params = BoostingParams(rounds=6, patience=2, depth=2, min_leaf_rows=5, column_share=1.0, row_share=1.0, step=0.3)
    model, losses = boost(df.filter("NOT held"), df.filter("held"), params, 7)
    best, _ = rounds_kept(losses, 2)
    assert len(model.trees) == best and best > 1
    shown = model.transform(df.filter("held")).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), F.lit(2)))).first()[0]
    assert abs(shown - min(losses[:best])) < 1e-9


def test_cross_fit_with_seeds_and_ordered_levels(spark):
    """The label follows the level of a category with more codes than bins, in no order of the codes."""
    df = spark.range(900).select(
        F.col("id").cast("string").alias("item_id"), ((F.col("id") * 7919) % 40).cast("int").alias("level"), (F.col("id") % 5).cast("double").alias("noise"),
        F.when(F.col("id") < 800, F.pmod(F.hash((F.col("id") * 7919) % 40), F.lit(10)) / 10).alias("deal_probability"))
    result = cross_fit(rows.labelled(df), rows.unlabelled(df), ["level", "noise"], seeds=(1, 2), folds=2, categorical=["level"],
                       params=BoostingParams(rounds=3, patience=2, depth=3, min_leaf_rows=5, bins=16, column_share=1.0))
    oof = result.oof.collect()
    assert len(oof) == 1600 and {(r["seed"], r["fold"]) for r in oof} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert all(sum(r["seed"] == s and r["fold"] == f for r in oof) == 400 for s in (1, 2) for f in (0, 1))
    assert result.oof.agg(ensemble.rmse().alias("e")).first()["e"] < 0.12 and result.predictions.count() == 100
    best = ensemble.best_round(result.history, ["seed", "fold"]).collect()
    assert len(best) == 4 and all(r["best_round"] >= 1 for r in best)


def test_cross_fit_covers_each_labelled_id_once(spark):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("item_id"), (F.col("id") % 10).cast("double").alias("x"),
        (F.col("id") % 7).cast("double").alias("noise"),
        F.when(F.col("id") < 500, (F.col("id") % 10) / 10).alias("deal_probability"))
    result = cross_fit(rows.labelled(df), rows.unlabelled(df), ["x", "noise"],
                       params=BoostingParams(rounds=5, patience=5, depth=3, min_leaf_rows=5, column_share=1.0))
    oof = result.oof.collect()
    assert len(oof) == 500 and len({r["item_id"] for r in oof}) == 500 and {r["fold"] for r in oof} == {0, 1, 2, 3}
    assert result.predictions.count() == 100
    error = result.oof.agg(ensemble.rmse().alias("e")).first()["e"]
    assert error < 0.2
    assert top_importance(result.importance).first()["feature"] == "x"


def test_equal_counts_are_spread_over_the_ranges_of_the_sort(spark):
    """Sorted by the count alone, all tuples of one count would be one task's."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = profile.frequency(spark.range(20_000).withColumnRenamed("id", "k"), ["k"], "n", order="desc")
        sizes = [len(p) for p in out.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_folds_are_ranked_without_writing_hashes(spark, monkeypatch):
    from keyfold.operators import ensemble, ranking
    written, write = [], ranking.write_stage
    monkeypatch.setattr(ranking, "write_stage", lambda df, name: written.append(df.columns) or write(df, name))
    df = spark.range(9).selectExpr("cast(id AS string) AS item")
    assert sorted(r["n"] for r in ensemble.equal_folds(df, "item", 4, 7).groupBy("fold").agg({"*": "count"}).toDF("fold", "n").collect()) == [2, 2, 2, 3]
    assert written == [["item", "_id"]]


def test_models_without_ordered_categories_are_averaged_in_one_pass(spark, monkeypatch):
    from keyfold.operators import crossfit
    written, write = [], crossfit.write_stage
    monkeypatch.setattr(crossfit, "write_stage", lambda df, name: written.append(name) or write(df, name))
    df = spark.range(60).selectExpr("cast(id AS string) AS item_id", "cast(id % 7 AS double) AS x", "id % 7 / 7D AS deal_probability")
    params = crossfit.BoostingParams(rounds=2, patience=1, depth=2, min_leaf_rows=1)
    found = crossfit.cross_fit(df.filter("cast(item_id AS int) < 40"), df.filter("cast(item_id AS int) >= 40").unionByName(
        df.filter("item_id = 50")), ["x"], folds=2, seeds=(7,), params=params)
    rows = found.predictions.collect()
    assert sorted(r["item_id"] for r in rows) == sorted(str(i) for i in range(40, 60)) and found.oof.count() == 40
    assert len({round(r["prediction"], 9) for r in rows}) <= 7 and "test_fold" not in written and "oof" not in written


def test_registered_cross_fitting_boosts_as_the_original_run(spark, monkeypatch):
    from keyfold.registry import model_queries
    given, df = [], spark.createDataFrame([("a", "u", 1.0, 0.5), ("b", "u", 2.0, None)], "item_id string, user_id string, price double, deal_probability double")
    monkeypatch.setattr(model_queries, "_FITTED", {})
    monkeypatch.setattr(model_queries, "model_inputs", lambda spark, sf_dir: df)
    monkeypatch.setattr(model_queries.crossfit, "cross_fit", lambda *args, **settings: given.append((args[2], settings["params"])))
    model_queries.fitted(spark, "/nowhere")
    assert given == [(["price"], BoostingParams())] and given[0][1].rounds == 3000 and given[0][1].patience == 30
