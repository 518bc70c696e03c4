from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvlake.functions import clock as K
from pvlake.functions.solar import add_sun_utc
from pvlake.operators import sun
from pvlake.operators.weather import interpolate_short_gaps, join_weather

from .conftest import at

WX = "campus_id long, timestamp timestamp_ntz, temperature double"


def fill(spark, values, **options):
    df = spark.createDataFrame([(1, at(i), v) for i, v in enumerate(values)], WX)
    return [r["temperature"] for r in interpolate_short_gaps(df, **options).orderBy("timestamp").collect()]


def test_short_gap_is_linear_and_long_gap_fills_two(spark):
    assert fill(spark, [1.0, None, 3.0]) == [1.0, 2.0, 3.0]
    assert fill(spark, [1.0, None, None, None, None, 6.0]) == [1.0, 2.0, 3.0, None, None, 6.0]


def test_leading_stays_null_trailing_repeats_two(spark):
    assert fill(spark, [None, 2.0, None, None, None]) == [None, 2.0, 2.0, 2.0, None]


@pytest.mark.parametrize("chunk_hours", [1, 5, 700])
def test_filling_equals_pandas_across_chunks(spark, chunk_hours):
    rng = np.random.default_rng(3)
    rows = [(c, at(i), None if rng.random() < 0.45 else float(rng.normal())) for c in (1, 2, 3) for i in range(400) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, WX)
    got = interpolate_short_gaps(df, chunk_us=chunk_hours * K.HOUR_US).toPandas().sort_values(["campus_id", "timestamp"])
    parts = []
    for _, g in df.toPandas().sort_values(["campus_id", "timestamp"]).groupby("campus_id"):
        s = g.set_index("timestamp")["temperature"].interpolate(method="time", limit=2)
        parts.append(s)
    want = pd.concat(parts).to_numpy(dtype=float)
    np.testing.assert_allclose(got["temperature"].to_numpy(dtype=float), want, rtol=1e-9, atol=1e-12)


def test_weather_join_keeps_rows_with_and_without_salt(spark, series):
    wx = series.select("campus_id", "timestamp").distinct().withColumn("temperature", F.lit(5.0))
    for salts in (1, 4):
        joined = join_weather(series, wx, salts=salts)
        assert joined.count() == series.count()
        assert joined.where("temperature IS NULL").count() == 0


def test_solar_position_matches_published_example(spark):
    df = spark.createDataFrame([(dt.datetime(2003, 10, 17, 19, 30, 30), 39.742476, -105.1786)], "t timestamp_ntz, lat double, lon double")
    row = add_sun_utc(df, "t", "lat", "lon", 820.0, 11.0).first()
    assert abs(row["zenith_deg"] - 50.11162) < 2e-3
    assert abs(row["azimuth_deg"] - 194.34024) < 5e-3


def local_day(spark, day):
    rows = [(1, 1, day + dt.timedelta(minutes=15 * i)) for i in range(96)]
    return spark.createDataFrame(rows, "site_id long, campus_id long, timestamp timestamp_ntz")


def test_day_length_by_season_and_bounded_azimuth(spark):
    coords = spark.createDataFrame([(1, -36.1, 146.8)], "campus_id long, latitude double, longitude double")
    hours = {}
    for name, day in (("summer", dt.datetime(2021, 12, 21)), ("winter", dt.datetime(2021, 6, 21))):
        placed = sun.add_solar_position(local_day(spark, day), coords)
        assert placed.where("azimuth_deg < 0 OR azimuth_deg >= 360").count() == 0
        hours[name] = sun.day_length(placed).first()["day_length_hours"]
    assert hours == {"summer": 14.5, "winter": 9.75}


def test_repeated_hour_is_null_and_skipped_hour_moves_forward(spark):
    def utc(*times):
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        return [r["u"] for r in K.add_utc(df, "t", "Australia/Melbourne", "u").collect()]

    assert utc(dt.datetime(2021, 4, 4, 2, 30)) == [None]
    assert utc(dt.datetime(2021, 4, 4, 1, 30)) == [dt.datetime(2021, 4, 3, 14, 30)]
    assert utc(dt.datetime(2021, 10, 3, 2, 30), dt.datetime(2021, 10, 3, 3, 0)) == [dt.datetime(2021, 10, 2, 16, 0)] * 2


def test_rows_without_coordinates_are_night(spark):
    coords = spark.createDataFrame([(9, -36.1, 146.8)], "campus_id long, latitude double, longitude double")
    placed = sun.add_solar_position(local_day(spark, dt.datetime(2021, 12, 21)), coords)
    assert placed.where("is_daylight").count() == 0
    assert placed.where("solar_elevation_deg IS NOT NULL").count() == 0
    assert sun.campus_without_coordinates(placed, coords).count() == 96


def test_micros_round_trip_before_and_after_epoch(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 10, 2, 30, 0, 123456)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").withColumn("us", K.micros("t"))
    rows = df.withColumn("back", K.from_micros("us")).collect()
    assert [r["back"] for r in rows] == times
    assert rows[0]["us"] == -1


def test_repeated_weather_fails_at_once(spark):
    rows = spark.createDataFrame([(1, 1, at(0))], "site_id long, campus_id long, timestamp timestamp_ntz")
    wx = spark.createDataFrame([(1, at(0), 20.0), (1, at(0), 21.0), (2, at(0), 5.0)], "campus_id long, timestamp timestamp_ntz, temperature double")
    assert join_weather(rows, wx.where("temperature < 21")).count() == 1
    for salts in (1, 3):
        with pytest.raises(Exception, match="two rows for one place and time"):
            join_weather(rows, wx, salts=salts).collect()
