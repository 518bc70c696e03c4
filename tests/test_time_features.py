from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvlake.functions.clock import DAY_US, micros
from pvlake.operators import history
from pvlake.operators import time_features as TF

from .conftest import at


def brute(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, g in pdf.groupby("site_id"):
        g = g.sort_values("timestamp").set_index("timestamp")
        cols = {f"power_lag_{s}": g["power"].reindex(g.index - pd.Timedelta(minutes=15 * s)).to_numpy() for s in TF.LAG_STEPS}
        for w in TF.ROLLING_SECONDS:
            roll = g["power"].rolling(f"{w}s", closed="left", min_periods=1)
            for stat in TF.ROLLING_STATS:
                cols[f"power_rolling_{stat}_{w}s"] = getattr(roll, stat)().to_numpy()
        out.append(pd.DataFrame({"site_id": g["site_id"].to_numpy(), "timestamp": g.index, **cols}))
    return pd.concat(out).sort_values(["site_id", "timestamp"]).reset_index(drop=True)


@pytest.mark.parametrize("chunk_days", [1, 3, 28])
def test_features_equal_pandas_for_any_chunk(series, chunk_days):
    names = [*TF.lag_names(), *TF.rolling_names()]
    got = TF.add_time_features(series, chunk_us=chunk_days * DAY_US).select("site_id", "timestamp", *names).toPandas()
    got = got.sort_values(["site_id", "timestamp"]).reset_index(drop=True)
    want = brute(series.toPandas())
    assert len(got) == len(want)
    for c in names:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_lag_across_a_gap_is_null(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(2), 2.0)], "site_id long, timestamp timestamp_ntz, power double")
    rows = {r["timestamp"]: r for r in TF.add_lags(df, (1, 2)).collect()}
    assert rows[at(2)]["power_lag_1"] is None
    assert rows[at(2)]["power_lag_2"] == 1.0


def test_future_never_changes_past_features(spark, series):
    cut = at(5 * 96)
    broken = series.withColumn("power", F.when(F.col("timestamp") >= F.lit(cut), F.lit(9e9)).otherwise(F.col("power")))
    names = [*TF.lag_names(), *TF.rolling_names()]

    def past(df):
        return {(r["site_id"], r["timestamp"]): tuple(r[n] for n in names)
                for r in TF.add_time_features(df, chunk_us=2 * DAY_US).where(F.col("timestamp") <= F.lit(cut)).collect()}

    assert past(series) == past(broken)


def test_min_periods_and_std_need_enough_readings(spark):
    df = spark.createDataFrame([(1, at(i), float(i)) for i in range(4)], "site_id long, timestamp timestamp_ntz, power double")
    rows = TF.add_rolling(df, (3600,), min_periods=2).orderBy("timestamp").collect()
    assert rows[0]["power_rolling_mean_3600s"] is None and rows[1]["power_rolling_mean_3600s"] is None
    assert rows[2]["power_rolling_mean_3600s"] == 0.5
    one = TF.add_rolling(df, (3600,)).orderBy("timestamp").collect()
    assert one[1]["power_rolling_mean_3600s"] == 0.0 and one[1]["power_rolling_std_3600s"] is None


def test_carried_history_equals_batch_features(series):
    names = [*TF.lag_names(), *TF.rolling_names()]
    ahead = history.future_rows(series, 1, [])
    extended = series.unionByName(ahead.select(*series.columns))
    batch = TF.add_time_features(extended).join(ahead.select("site_id", "timestamp"), ["site_id", "timestamp"])
    joined = TF.lookback_at(series, ahead)
    past = series.withColumn("us", micros("timestamp")).groupBy("site_id").agg(
        F.collect_list(F.struct("us", F.col("power").alias("v"))).alias("past"))
    inside = TF.add_lookback(ahead.join(past, "site_id").withColumn("_us", micros("timestamp")), "past", "_us")
    want = {r["site_id"]: [r[n] for n in names] for r in batch.collect()}
    for other in (joined, inside):
        got = {r["site_id"]: [r[n] for n in names] for r in other.collect()}
        assert got.keys() == want.keys()
        for site, values in want.items():
            for name, a, b in zip(names, values, got[site]):
                assert (a is None) == (b is None), name
                assert a is None or abs(a - b) < 1e-9, name


def test_plan_has_one_shuffle_for_all_features(series):
    plan = TF.add_time_features(series)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
