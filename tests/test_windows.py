from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pvlake.operators import sequences
from pvlake.plans import windows

from .conftest import at

COLUMNS = ["ch_power", "ch_power_observed", "ch_temperature", "ch_constant"]
LOOKBACK = 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for site in (1, 2, None):
        for slot in range(260 if site == 1 else 70):
            power = None if rng.random() < 0.2 else float(rng.normal(3, 2))
            temperature = float(rng.normal(0, 1))
            out.append((site, "train" if slot < 200 else "val", at(slot + slot // 9), power, 0.0 if power is None else power / 2 + 0.1 * temperature,
                        float(power is not None), temperature, 0.25))
    out += [(9, "train", at(i), 1.0, 0.5, 1.0, 0.3, 0.25) for i in range(3)]  # too short for any window
    return spark.createDataFrame(out, "site_id long, split string, timestamp timestamp_ntz, power double, ch_power double, ch_power_observed double, ch_temperature double, ch_constant double")


def materialised(rows):
    kept = sequences.sliding_windows(rows, COLUMNS, LOOKBACK, by=("split",), kind="double", chunk_rows=64)
    return kept.withColumn("features", array_to_vector(F.flatten("window")))


@pytest.mark.parametrize("chunk", [8, 64, 4096])
def test_coefficients_equal_those_of_materialised_windows(rows, chunk):
    train = materialised(rows).where("split = 'train'")
    want = LinearRegression(featuresCol="features", labelCol="target", regParam=1e-3, solver="normal").fit(train)
    got = windows.fit_windows(rows.where("split = 'train'"), COLUMNS, LOOKBACK, by=("split",), chunk_rows=chunk)
    assert got.n == train.count()
    assert np.allclose(got.coefficients.ravel(), want.coefficients.toArray(), atol=1e-8) and abs(got.intercept - want.intercept) < 1e-8
    assert (got.coefficients[-1, :2] == 0).all() and (got.coefficients[:, 3] == 0).all()


def test_predictions_equal_those_of_materialised_windows(rows):
    model = windows.fit_windows(rows.where("split = 'train'"), COLUMNS, LOOKBACK, by=("split",))
    want = materialised(rows).withColumn("p", F.aggregate(
        F.zip_with(F.flatten("window"), F.array(*[F.lit(float(v)) for v in model.coefficients.ravel()]), lambda a, b: a * b), F.lit(model.intercept), lambda a, b: a + b))
    key = lambda r: (repr(r["site_id"]), r["split"], r["timestamp"])
    expected = {key(r): (r["target"], r["p"]) for r in want.collect()}
    got = {key(r): (r["target"], r["prediction"]) for r in model.predict(rows, by=("split",), chunk_rows=32).collect()}
    assert got.keys() == expected.keys() and len(got) > 250
    assert all(got[k][0] == expected[k][0] and abs(got[k][1] - expected[k][1]) < 1e-9 for k in got)


def test_lagged_moments_are_plain_sums(rows):
    got = {(r["lag"], r["channel"], r["earlier"]): r["moment"] for r in windows.lagged_moments(rows, COLUMNS, LOOKBACK, by=("split",), chunk_rows=16).collect()}
    series: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r["timestamp"]):
        series.setdefault((r["site_id"], r["split"]), []).append([r[c] for c in COLUMNS])
    for lag in range(LOOKBACK + 1):
        for a, ca in enumerate(COLUMNS):
            for b, cb in enumerate(COLUMNS):
                want = sum(s[i][a] * s[i - lag][b] for s in series.values() for i in range(lag, len(s)))
                assert abs(got[lag, ca, cb] - want) < 1e-8


def test_no_window_is_an_error(rows):
    with pytest.raises(ValueError):
        windows.fit_windows(rows.where("site_id = 9"), COLUMNS, LOOKBACK, by=("split",))
