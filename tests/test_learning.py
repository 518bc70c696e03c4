from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from pvlake.operators import splits
from pvlake.plans import build, forecast, learn
from pvlake.plans.trees import Forest
from pvlake.session import checkpoint_dir

from .conftest import at


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(5)
    rows = []
    for site in (1, 2):
        for slot in range(10 * 96):
            wave = math.sin(2 * math.pi * (slot % 96) / 96)
            rows.append((site, 1, at(slot), 5.0 * site + 3.0 * wave + float(rng.normal(0, 0.05)), 20.0 + wave, None))
    df = spark.createDataFrame(rows, "site_id long, campus_id long, timestamp timestamp_ntz, power double, temperature double, humidity double")
    return splits.chronological_split(build.build_features(df)).cache()


@pytest.fixture(scope="module")
def gbt(learnable):
    return learn.train_gbt(learnable, max_iter=20, max_depth=4)


def test_trees_beat_the_mean(learnable, gbt):
    test = gbt.predict(learnable).where(F.col("split") == "test")
    row = test.agg(F.avg(F.abs(F.col("prediction") - F.col("power"))).alias("mae")).first()
    assert row["mae"] < 0.4
    assert gbt.info["n_train_rows"] == 2 * 672 and gbt.info["best_iteration"] >= 1


def test_kept_rounds_are_the_best(learnable):
    fitted = learn.train_gbt(learnable, max_depth=3, step=0.3, patience=6)
    errors = fitted.info["val_errors"]
    best = fitted.info["best_iteration"]
    assert errors[best - 1] == min(errors) and len(fitted.forest.roots) == best
    assert best + 6 <= fitted.info["rounds"] == len(errors)
    val = fitted.predict(learnable).where((F.col("split") == "val") & F.col("power").isNotNull())
    mse = val.agg(F.avg((F.col("prediction") - F.col("power")) ** 2)).first()[0]
    assert abs(mse - min(errors)) < 1e-9  # the column expression scores as the library does


def test_tree_contributions_add_up(learnable, gbt):
    rows = learnable.where(F.col("split") == "test")
    parts = gbt.contributions(rows, ["site_id", "timestamp"])
    assert {r["feature"] for r in parts.select("feature").distinct().collect()} == set(gbt.names)
    total = parts.groupBy("site_id", "timestamp").agg((F.sum("contribution") + F.max("base_value")).alias("total"))
    worst = total.join(gbt.predict(rows), ["site_id", "timestamp"]).agg(F.max(F.abs(F.col("total") - F.col("prediction"))), F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] == rows.count()


def test_inputs_that_cannot_split_are_left_out_without_a_change(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(800):
        a, b = (None if i % 5 == 0 else float(rng.normal())), (None if i % 7 == 0 else float(rng.normal()))
        rows.append((i % 4, float(rng.normal()) + (a or 2.0) - (b or 1.0), "train" if i % 4 else "val", a, None if a is None else -a, b, 7, None, None if i % 10 < 2 else 1.0, None if i % 10 in (1, 2) else 1.0))
    df = spark.createDataFrame(rows, "site_id long, power double, split string, a double, like_a double, b double, always int, never double, some double, others double").coalesce(1)
    names = [*learn.SITE_INPUTS, *learn.feature_columns(df)["numeric"]]
    train = learn.encode_sites(df.where("split = 'train'")).join(df.where("split = 'train'"), ["site_id"], "left")
    asked = learn.telling(train, names)
    of = [n for c in names for n in (c, f"{c}__missing")]
    assert [of[i] for i in asked] == ["site_mean", "a", "a__missing", "like_a", "b", "b__missing", "some", "some__missing", "others", "others__missing"]

    fitted = learn.train_gbt(df, max_iter=8, max_depth=5)
    whole = train.select("power", array_to_vector(F.array(*learn.matrix_entries(F.col, names))).alias("x"))
    model = GBTRegressor(featuresCol="x", labelCol="power", maxIter=8, maxDepth=5, stepSize=0.05, subsamplingRate=0.9, minInstancesPerNode=5, maxBins=64, seed=42).fit(whole)
    every = Forest.of(model, spark, len(fitted.forest.roots), list(range(len(of))))
    for part in ("roots", "feature", "threshold", "child", "value", "rows", "gain"):
        assert np.array_equal(getattr(fitted.forest, part), getattr(every, part)), part


def test_batches_score_as_the_column_does(learnable, gbt):
    both = gbt.predict(learnable).select("*", F.col("prediction").alias("walked")).drop("prediction")
    got = gbt.placed(both).select("walked", gbt.prediction().alias("column"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert got.where(~F.col("walked").eqNullSafe(F.col("column"))).count() == 0 and got.where("walked is not null").count() == learnable.count()


def test_importance_lists_every_input(spark, gbt):
    rows = learn.feature_importance(gbt, spark).collect()
    assert {r["feature"] for r in rows} == set(gbt.inputs)
    assert abs(sum(r["gain"] for r in rows) - 1.0) < 1e-9
    assert all((r["weight"] > 0) == (r["cover"] > 0) for r in rows)


def test_feature_selection_is_by_role_and_type(spark):
    df = spark.createDataFrame([], "power double, month int, hour int, site_id long, season string, is_weekend boolean, power_lag_1 double, wind_direction double, temperature double")
    got = learn.feature_columns(df)
    assert got == {"categorical": ["site_id"], "numeric": ["hour", "is_weekend", "power_lag_1", "temperature"]}


def test_many_sites_use_the_same_encoding(spark):
    rows = [(site, at(slot), float(site % 7), "train" if slot < 3 else "val", float(slot)) for site in range(600) for slot in range(4)]
    df = spark.createDataFrame(rows, "site_id long, timestamp timestamp_ntz, power double, split string, hour double")
    few, many = (learn.train_gbt(part, max_iter=5, max_depth=3) for part in (df.where("site_id < 50"), df))
    assert few.inputs == many.inputs
    worst = many.predict(df).agg(F.max(F.abs(F.col("prediction") - F.col("power")))).first()[0]
    assert worst < 0.5
    assert many.predict(df.withColumn("site_id", F.lit(None).cast("long"))).count() == len(rows)


def test_linear_contributions_add_up(learnable):
    names = ["power_lag_1", "temperature", "humidity", "sin_hour"]
    model = learn.train_linear(learnable, names)
    assert model.names == ["power_lag_1", "temperature", "sin_hour"]  # nothing is known of humidity
    test = learnable.where(F.col("split") == "test")
    parts = model.contributions(test, ["site_id", "timestamp"]).groupBy("site_id", "timestamp").agg(
        (F.sum("contribution") + F.max("base_value")).alias("total"))
    worst = parts.join(test.withColumn("p", model.prediction()), ["site_id", "timestamp"]).agg(F.max(F.abs(F.col("total") - F.col("p")))).first()[0]
    assert worst < 1e-9


def test_persistence_forecast_keeps_missing_missing(spark):
    rows = [(1, 1, at(i), None if i == 3 else float(i)) for i in range(96) if i != 5]
    df = spark.createDataFrame(rows, "site_id long, campus_id long, timestamp timestamp_ntz, power double")
    got = [r["prediction"] for r in forecast.forecast_persistence(df, 96).orderBy("step").collect()]
    assert got == [None if i in (3, 5) else float(i) for i in range(96)]


def test_recursion_equals_batch_features_on_the_extended_series(spark, learnable):
    def predict(get):
        return get("power_lag_1") * 0.5 + get("power_rolling_mean_3600s") * 0.3 + get("power_rolling_std_86400s")

    base = learnable.select("site_id", "campus_id", "timestamp", "power", "temperature", "humidity")
    out = forecast.forecast_recursive(base, predict, 5).cache()
    extended = base.select("site_id", "timestamp", "power").unionByName(
        out.select("site_id", "timestamp", F.col("prediction").alias("power")))
    from pvlake.operators.time_features import add_time_features

    again = add_time_features(extended).select("site_id", "timestamp", predict(F.col).alias("p"))
    worst = out.join(again, ["site_id", "timestamp"]).agg(F.max(F.abs(F.col("prediction") - F.col("p"))), F.count("p")).first()
    assert worst[0] < 1e-9 and worst[1] == 10


def test_forecast_bounds_and_horizon(spark, learnable, gbt):
    base = learnable.select("site_id", "campus_id", "timestamp", "power", "temperature", "humidity")
    radii = spark.createDataFrame([("0.9", "global", 1.0), ("0.9", "night_lag", 2.0)], "level string, regime string, radius double")
    rows = forecast.forecast_recursive(base, gbt.prediction, 2, radii=radii, per_site=gbt.sites.table).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["regime"] == "night_lag" and abs(r["upper_bound"] - r["prediction"] - 2.0) < 1e-12
        assert r["confidence_level"] == 0.9
    with pytest.raises(ValueError):
        forecast.forecast_persistence(base, 97)


def test_checkpoint_folder_is_taken_from_the_session(spark):
    assert checkpoint_dir(spark)
