"""Queries on folds, averaging, metrics, stacking, submission and cross-fitting.

Predictions come from columns of the items, so that each of these queries has an exact SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keyfold.features import catalog
from keyfold.features.engine import pack, unpack
from keyfold.functions.scalar import clip_unit
from keyfold.operators import crossfit, ensemble, rows
from keyfold.operators.encode import fill_literals, fill_mean, fill_zero, label_encode
from keyfold.plans import stages
from keyfold.registry.base import item_rows, item_stage, query, r6, staged_once, with_items
from keyfold.registry.feature_queries import PIPELINE_CTES, PIPELINE_SQL, pipeline_all_stages
from keyfold.session import run_all, write_buckets, write_stage

FOLDS, SEEDS = ensemble.FOLDS, ensemble.SEEDS


@query("kfold_assign", with_items(
    f"SELECT item_id, seed, CAST(CAST('0x' || substr(md5(item_id || ':' || seed), 1, 8) AS BIGINT) % {FOLDS} AS INTEGER) "
    f"AS fold FROM items, (SELECT unnest({list(SEEDS)}) AS seed)"))
def kfold_assign(spark, sf_dir):
    """The fold function of cross-fitting, for every seed."""
    df = item_stage(spark, sf_dir, "item_id")
    return rows.append([df.select("item_id", F.lit(s).alias("seed"), ensemble.hash_fold("item_id", FOLDS, s).alias("fold"))
                        for s in SEEDS])


def _predictions(df, **parts):
    """One frame per number, as separate models would leave them."""
    (name, numbers), = parts.items()
    return rows.append([df.select(
        "item_id", F.lit(n).alias(name), (F.col("image_top_1") / 50 + F.lit(n) / 100).alias("prediction"))
        for n in numbers])


def _mean_sql(numbers):
    return with_items("SELECT item_id, round(avg(image_top_1 / 50 + n / 100), 6) AS prediction FROM items, "
                      f"(SELECT unnest({list(numbers)}) AS n) WHERE deal_probability IS NULL GROUP BY item_id")


@query("fold_average", _mean_sql(range(FOLDS)))
def fold_average(spark, sf_dir):
    predictions = _predictions(rows.unlabelled(item_stage(spark, sf_dir, "item_id", "image_top_1", rows.LABEL)), fold=range(FOLDS))
    return ensemble.mean_by_id(predictions, ["item_id"]).select("item_id", r6("prediction"))


@query("seed_average", _mean_sql(SEEDS))
def seed_average(spark, sf_dir):
    predictions = _predictions(rows.unlabelled(item_stage(spark, sf_dir, "item_id", "image_top_1", rows.LABEL)), seed=SEEDS)
    return ensemble.mean_by_id(predictions, ["item_id"]).select("item_id", r6("prediction"))


def _scored(spark, sf_dir):
    return rows.labelled(item_rows(spark, sf_dir)).select(
        "item_id", (F.col("price") / 50).alias("prediction"), F.col("deal_probability").alias("label"))


@query("rmse", with_items("SELECT round(sqrt(avg(pow(price / 50 - deal_probability, 2))), 6) AS rmse FROM items "
                          "WHERE deal_probability IS NOT NULL"))
def rmse(spark, sf_dir):
    return _scored(spark, sf_dir).agg(r6(ensemble.rmse(), "rmse"))


@query("mae", with_items("SELECT round(avg(abs(price / 50 - deal_probability)), 6) AS mae FROM items "
                         "WHERE deal_probability IS NOT NULL"))
def mae(spark, sf_dir):
    return _scored(spark, sf_dir).agg(r6(ensemble.mae(), "mae"))


EPOCHS = [1, 2, 3, 4, 5]


@query("best_round", with_items(
    "SELECT fold, epoch AS best_round, val_loss AS best_loss FROM (SELECT *, row_number() OVER "
    "(PARTITION BY fold ORDER BY val_loss, epoch) AS rn FROM (SELECT param_2 AS fold, epoch, "
    "round(sqrt(avg(pow(price / (30 + 10 * epoch) - deal_probability, 2))), 6) AS val_loss FROM items, "
    f"(SELECT unnest({EPOCHS}) AS epoch) WHERE deal_probability IS NOT NULL GROUP BY param_2, epoch)) WHERE rn = 1"))
def best_round(spark, sf_dir):
    """Validation loss per group and epoch, of predictions that improve and then worsen again."""
    epochs = F.explode(F.array(*[F.lit(e) for e in EPOCHS])).alias("epoch")
    scored = rows.labelled(item_rows(spark, sf_dir)).select(
        F.col("param_2").alias("fold"), "price", F.col("deal_probability").alias("label"), epochs)
    history = (scored.withColumn("prediction", F.col("price") / (30 + 10 * F.col("epoch")))
               .groupBy("fold", "epoch").agg(r6(ensemble.rmse(), "val_loss")))
    return ensemble.best_round(history, ["fold"])


@query("oof_attach", with_items(
    "SELECT item_id, user_id, CASE WHEN deal_probability IS NOT NULL THEN price / 50 "
    "WHEN image IS NOT NULL THEN image_top_1 / 50 END AS oof FROM items"))
def oof_attach(spark, sf_dir):
    df = item_stage(spark, sf_dir, "item_id", "user_id", "price", "image", "image_top_1", rows.LABEL)
    oof = rows.labelled(df).select("item_id", (F.col("price") / 50).alias("deal_probability"))
    rest = rows.unlabelled(df).filter(F.col("image").isNotNull()).select(
        "item_id", (F.col("image_top_1") / 50).alias("deal_probability"))
    return ensemble.attach_first_level(df.select("item_id", "user_id"), oof, rest)


@query("submission", with_items(
    "SELECT item_id, CASE WHEN image IS NULL OR image_top_1 IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, "
    "least(1.0::DOUBLE, image_top_1 / 20 - 0.5)) END AS deal_probability FROM items WHERE deal_probability IS NULL"))
def submission(spark, sf_dir):
    template = rows.unlabelled(item_stage(spark, sf_dir, "item_id", "image", "image_top_1", rows.LABEL))
    predictions = template.filter(F.col("image").isNotNull()).select(
        "item_id", (F.col("image_top_1") / 20 - 0.5).alias("deal_probability"))
    return ensemble.submission(template, predictions)


# --- the model over the built features --------------------------------------------------------------
_CATEGORIES = ["region", "city", "parent_category_name", "category_name", "param_1", "param_2", "param_3", "user_type"]
_BY_KEY = [f.name for f in catalog.STD_BY_KEY + catalog.STD_BY_ROUNDED_KEY]
_BY_USER = [f.name for f in catalog.STD_CALENDAR_BY_USER]
_COUNTED = [f.name for f in catalog.STAGE5 if f.kind in ("distinct", "span")]
# What missing values become. The mean fills the price, 0 the distinct counts and spans.
_NO_TEXT, _NO_NUMBER = "no_description", -1.0
_ELIMINATE = 17

_STD_SQL = ", ".join(
    f"coalesce(round(stddev_samp({f.arg}) OVER (PARTITION BY {key(f.keys[0])}), 6), {_NO_NUMBER}) AS {f.name}"
    for features, key in ((catalog.STD_BY_KEY + catalog.STD_CALENDAR_BY_USER, str),
                          (catalog.STD_BY_ROUNDED_KEY, lambda k: f"CAST(round({k}) AS BIGINT)"))
    for f in features)
_FILLED_SQL = ", ".join(
    [f"dense_rank() OVER (ORDER BY coalesce({c}, '{_NO_TEXT}')) - 1 AS {c}" for c in _CATEGORIES]
    + ["round(coalesce(price, avg(price) OVER ()), 6) AS price", f"coalesce(image_top_1, {_NO_NUMBER}) AS image_top_1",
       f"coalesce(population, {int(_NO_NUMBER)}) AS population"]
    + [f"coalesce({c}, 0.0) AS {c}" for c in stages.MACRO_COLUMNS] + [f"coalesce({c}, 0) AS {c}" for c in _COUNTED])


def model_inputs(spark, sf_dir):
    """The last stage with standard deviations merged, missing values filled, categories coded and
    listed items left out; written once for the queries on it."""
    def build():
        staged = write_buckets(pipeline_all_stages(spark, sf_dir), "stage8", "item_id")
        by_item, by_user = run_all(spark, [
            lambda: write_buckets(stages.stage7(staged), "stage7", "item_id"),
            lambda: write_buckets(stages.stage7_calendar(staged), "stage7_calendar", "item_id")])
        merged = staged.join(by_item, "item_id", "left").join(by_user, "item_id", "left")
        filled = fill_zero(fill_literals(merged, {
            **{c: _NO_TEXT for c in _CATEGORIES}, "image_top_1": _NO_NUMBER, "population": int(_NO_NUMBER),
            **{c: _NO_NUMBER for c in _BY_KEY + _BY_USER}, **{c: 0.0 for c in stages.MACRO_COLUMNS}}), _COUNTED)
        # Only the categories are joined; all other columns go along as one.
        rest = [c for c in filled.columns if c not in ("item_id", "price", *_CATEGORIES)]
        packed = write_stage(pack(filled, rest, "_rest"), "filled")
        coded = label_encode(fill_mean(packed, ["price"]), _CATEGORIES)
        listed = coded.select("item_id").filter(
            F.conv(F.substring(F.md5("item_id"), 1, 6), 16, 10).cast("bigint") % _ELIMINATE == 0)
        return unpack(rows.eliminate(coded, write_stage(listed, "eliminated")), ["_rest"]).select(*filled.columns)
    return staged_once("model_inputs", sf_dir, spark, build)


@query("model_inputs", with_items(
    f"SELECT * FROM (SELECT * REPLACE ({_FILLED_SQL}), {_STD_SQL} FROM stage8) WHERE "
    f"CAST('0x' || substr(md5(item_id), 1, 6) AS INTEGER) % {_ELIMINATE} <> 0",
    PIPELINE_CTES + f",\nstage8 AS MATERIALIZED ({PIPELINE_SQL})"))
def model_inputs_query(spark, sf_dir):
    df = model_inputs(spark, sf_dir)
    return df.select(*[r6(c) if c in ("price", *_BY_KEY, *_BY_USER) else F.col(c) for c in df.columns])


# Four seeds of four folds on four features boost few shallow trees: only whose predictions they are is looked at.
QUERY_PARAMS = crossfit.BoostingParams(rounds=4, patience=2, depth=3, bins=32, step=0.3)


def fitted(spark, sf_dir):
    """Cross-fitting on all built features with the settings of the original run, once for the queries that look at it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        df = model_inputs(spark, sf_dir)
        predictors = [c for c in df.columns if c not in ("item_id", "user_id", rows.LABEL)]
        _FITTED[key] = crossfit.cross_fit(rows.labelled(df), rows.unlabelled(df), predictors, categorical=_CATEGORIES, params=crossfit.BoostingParams())
    return _FITTED[key]


_FITTED: dict[tuple[str, str], crossfit.CrossFit] = {}
_KEPT = f"CAST('0x' || substr(md5(item_id), 1, 6) AS INTEGER) % {_ELIMINATE} <> 0"


@query("crossfit_gbt", with_items(
    "SELECT item_id, deal_probability AS label, deal_probability IS NOT NULL AS is_oof, true AS in_range, CASE WHEN "
    "deal_probability IS NOT NULL THEN CAST((row_number() OVER (PARTITION BY deal_probability IS NULL ORDER BY "
    f"md5(item_id || ':7'), item_id) - 1) % {FOLDS} AS INTEGER) END AS fold FROM items WHERE {_KEPT}"))
def crossfit_gbt(spark, sf_dir):
    """One out-of-fold prediction per labelled row and one averaged one for the others. The numbers are
    the model's own; what can be checked of them is their ids, folds, labels and, clipped, their range."""
    result = fitted(spark, sf_dir)
    oof = result.oof.select("item_id", "label", F.lit(True).alias("is_oof"), "prediction", "fold")
    rest = ensemble.submission(result.predictions, result.predictions, value="prediction").select(
        "item_id", F.lit(None).cast("double").alias("label"), F.lit(False).alias("is_oof"), "prediction",
        F.lit(None).cast("int").alias("fold"))
    found = oof.withColumn("prediction", clip_unit("prediction")).unionByName(rest)
    return found.select("item_id", "label", "is_oof", F.col("prediction").between(0, 1).alias("in_range"), "fold")


@query("crossfit_error")
def crossfit_error(spark, sf_dir):
    """Out-of-fold error beside the spread of the labels, which is the error of their mean."""
    return fitted(spark, sf_dir).oof.agg(ensemble.rmse().alias("error"), F.stddev_pop("label").alias("spread"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """The two hundred most important of about three hundred features."""
    return crossfit.top_importance(fitted(spark, sf_dir).importance, 200)


@query("equal_folds", with_items(
    "SELECT item_id, CAST((row_number() OVER (ORDER BY md5(item_id || ':42'), item_id) - 1) "
    f"% {FOLDS} AS INTEGER) AS fold FROM items WHERE deal_probability IS NOT NULL"))
def equal_folds(spark, sf_dir):
    return ensemble.equal_folds(rows.labelled(item_stage(spark, sf_dir, "item_id", rows.LABEL)), "item_id", FOLDS, 42)


_LEVELS = ["city", "user_type"]


@query("level_means", with_items(
    "SELECT l.\"column\", f.seed, f.fold, l.code, round(avg(l.label), 6) AS mean FROM lv l JOIN (SELECT DISTINCT seed, fold FROM lv) f "
    "ON l.seed = f.seed AND l.fold <> f.fold GROUP BY ALL",
    f""",
coded AS (SELECT deal_probability AS label, {', '.join(f"dense_rank() OVER (ORDER BY coalesce({c}, '')) - 1 AS {c}" for c in _LEVELS)},
  CAST((row_number() OVER (ORDER BY md5(item_id || ':7'), item_id) - 1) % {FOLDS} AS INTEGER) AS fold
  FROM items WHERE deal_probability IS NOT NULL),
lv AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", 7 AS seed, fold, {c} AS code, label FROM coded" for c in _LEVELS)})"""))
def level_means(spark, sf_dir):
    """Mean labels of two categories' codes over the other folds, for each fold."""
    df = label_encode(rows.labelled(item_stage(spark, sf_dir, "item_id", *_LEVELS, rows.LABEL)).select(
        "item_id", F.col(rows.LABEL).alias("label"), *[F.coalesce(c, F.lit("")).alias(c) for c in _LEVELS]), _LEVELS)
    folded = df.join(ensemble.equal_folds(df, "item_id", FOLDS, 7), "item_id").withColumn(
        "folds", F.array(F.struct(F.lit(7).alias("seed"), "fold")))
    return crossfit.level_means(folded, _LEVELS).withColumn("mean", r6("mean"))


_SEED_PREDICTORS = ["price", "image_top_1", "city", "user_type"]


@query("crossfit_seeds", with_items(
    "SELECT item_id, CAST((row_number() OVER (PARTITION BY seed ORDER BY md5(item_id || ':' || seed), item_id) - 1) "
    f"% {FOLDS} AS INTEGER) AS fold, seed, deal_probability AS label, true AS has_prediction FROM items, "
    f"(VALUES {', '.join(f'({s})' for s in SEEDS)}) s(seed) WHERE deal_probability IS NOT NULL"))
def crossfit_seeds(spark, sf_dir):
    """Four seeds of four folds, fitted side by side on one table of vectors. What can be checked of
    the predictions is whose they are."""
    df = label_encode(item_stage(spark, sf_dir, "item_id", *_SEED_PREDICTORS, rows.LABEL).select(
        "item_id", rows.LABEL, *[F.coalesce(c, F.lit(_NO_NUMBER)).alias(c) for c in _SEED_PREDICTORS[:2]],
        *[F.coalesce(c, F.lit("")).alias(c) for c in _SEED_PREDICTORS[2:]]), _SEED_PREDICTORS[2:])
    df = write_stage(df, "seed_inputs")
    found = crossfit.cross_fit(rows.labelled(df), rows.unlabelled(df), _SEED_PREDICTORS, seeds=SEEDS, categorical=_SEED_PREDICTORS[2:],
                               params=QUERY_PARAMS)
    return found.oof.select("item_id", "fold", "seed", "label", F.col("prediction").isNotNull().alias("has_prediction"))
