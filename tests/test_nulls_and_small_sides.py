"""Rows without a time or a key are kept, and a small side gives the same result however it is joined."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pvlake.operators import conformal, explain, joins, quantiles, splits, topk
from pvlake.operators.time_features import add_lags, add_time_features

from .conftest import at


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(1, at(i), float(i)) for i in range(8)] + [(2, None, 5.0), (2, at(0), 1.0), (None, at(3), 2.0), (None, at(4), 3.0)]
    return spark.createDataFrame(rows, "site_id long, timestamp timestamp_ntz, power double")


def test_no_row_is_lost(gappy):
    n = gappy.count()
    for out in (splits.chronological_split(gappy), splits.every_nth(gappy, 1), add_lags(gappy), add_time_features(gappy)):
        assert out.count() == n
    late = splits.chronological_split(gappy).where("site_id = 2").collect()
    assert {(r["timestamp"] is None, r["split"]) for r in late} == {(False, "train"), (True, "val")}


def test_features_of_a_row_without_time_are_null(gappy):
    out = add_time_features(gappy)
    row = out.where("timestamp IS NULL").first()
    assert all(row[c] is None for c in out.columns if "lag" in c or "rolling" in c)
    assert out.where("site_id IS NULL AND power = 3.0").first()["power_lag_1"] == 2.0


def test_order_statistics_keep_the_null_group(gappy):
    got = {r["site_id"]: r["m"] for r in quantiles.exact_quantiles(gappy, ["site_id"], "power", {"m": 0.5}).collect()}
    assert got == {1: 3.5, 2: 3.0, None: 2.5}


@pytest.mark.parametrize("limit", [100, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_small_side_is_the_same_broadcast_or_salted(spark, gappy, how, limit):
    small = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (9, "d")], "site_id long, label string")
    keys = small.select("site_id").distinct() if how in ("left_semi", "left_anti") else small
    got = joins.join_small(gappy, keys, ["site_id"], how, max_rows=limit)
    assert got.count() == {"inner": 18, "left": 20, "left_semi": 10, "left_anti": 2}[how]
    assert "_salt" not in got.columns and got.columns.count("site_id") == 1


def test_fitted_levels_are_applied(spark):
    rows = [("m", "day_lag", float(i), 0.0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "model string, regime string, power double, prediction double")
    out = conformal.apply_radii(df, conformal.fit(df, ["model"], {"0.95": 0.05}), ["model"])
    assert out.count() == 200 and out.where("confidence_level = 0.95 AND upper_bound IS NOT NULL").count() == 200
    unseen = df.withColumn("model", F.lit("other"))
    assert conformal.apply_radii(unseen, conformal.fit(df, ["model"]), ["model"]).where("lower_bound IS NULL").count() == 400


def test_zero_contributions_have_no_direction(spark):
    parts = spark.createDataFrame([(1, f"f{i}", v) for i, v in enumerate([0.5, -0.2, 0.0, 0.0])], "id long, feature string, contribution double")
    got = {(r["direction"], r["feature"]) for r in explain.strongest(parts, ["id"]).collect()}
    assert got == {("+", "f0"), ("-", "f1")}


def test_top_per_group_of_one_large_group(spark):
    df = spark.range(5000).withColumn("g", F.lit(1))
    got = [r["id"] for r in topk.top_per_group(df, ["g"], [F.col("id").desc()], 7, ["id"]).collect()]
    assert sorted(got) == list(range(4993, 5000))


def test_no_fact_is_dealt_out_by_a_tiny_key(spark, gappy):
    """The plan of a small-side join has no exchange on the facts."""
    coords = spark.createDataFrame([(1, 2.0)], "site_id long, latitude double")
    plan = joins.join_small(gappy, coords, ["site_id"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
