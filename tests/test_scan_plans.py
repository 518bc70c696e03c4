from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pvlake.operators import history, profiling, splits, sun
from pvlake.plans import forecast
from pvlake.sources import readers as R
from pvlake.sources import writers as W

from .conftest import at


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("months") / "t")
    rows = [(s, dt.datetime(2022, 11, 1) + dt.timedelta(days=3 * i), float(i)) for s in (1, 2) for i in range(150)]
    W.write_partitioned(spark.createDataFrame(rows, "site_id long, timestamp timestamp_ntz, power double"), root)
    return spark.read.parquet(root), rows


def test_a_range_reads_only_its_months(months):
    df, rows = months
    got = R.time_range(df, "2022-12-15 06:00:00", "2023-02-03")
    want = [r for r in rows if dt.datetime(2022, 12, 15, 6) <= r[1] <= dt.datetime(2023, 2, 3, 23, 59, 59)]
    assert sorted((r["site_id"], r["timestamp"], r["power"]) for r in got.collect()) == sorted(want)
    filters = plan(got).split("PartitionFilters: ")[1].split("],")[0]
    assert "year" in filters and "month" in filters
    assert len({f for r in got.select(F.input_file_name().alias("f")).distinct().collect() for f in [r["f"]]}) == 6  # three months of two sites


def test_a_site_history_reads_one_site_and_its_months(months):
    df, _ = months
    filters = plan(R.time_range(R.scan_site(df, 2), "2023-01-01", "2023-01-31")).split("PartitionFilters: ")[1].split("],")[0]
    assert all(c in filters for c in ("site_id", "year", "month"))


def test_recent_rows_are_cut_before_any_shuffle(spark, tmp_path):
    rows = [(s, 1, at(i), float(i)) for s in (1, 2, None) for i in range(600 if s == 1 else 500)]
    spark.createDataFrame(rows, "site_id long, campus_id long, timestamp timestamp_ntz, power double").write.parquet(f"{tmp_path}/g")
    df = spark.read.parquet(f"{tmp_path}/g")
    tail = history.recent(df, 86_400_000_000)
    assert "GreaterThanOrEqual(timestamp" in plan(tail).split("PushedFilters: ")[1] and "Exchange hashpartitioning" not in plan(tail)
    assert sorted((repr(r["site_id"]), r["timestamp"]) for r in tail.collect()) == sorted(
        (repr(s), t) for s, _, t, _ in rows if t >= at(599 if s == 1 else 499) - dt.timedelta(days=1))
    assert history.recent(df.limit(0), 1).count() == 0
    ahead = {(r["site_id"], r["step"]): r["prediction"] for r in forecast.forecast_persistence(df, 3).collect()}
    assert ahead[1, 1] == 504.0 and ahead[2, 3] == 406.0 and ahead[None, 1] == 404.0


def test_site_bounds_of_sparse_ids(spark):
    rng = random.Random(1)
    ids = [*{rng.randint(-(2**62), 2**62) for _ in range(3_000)}, None]
    sizes = {i: rng.randint(1, 3) for i in ids}
    df = spark.createDataFrame([(i,) for i in ids for _ in range(sizes[i])], "site_id long")
    got = {r["site_id"]: (r["start_row"], r["end_row"]) for r in splits.site_bounds(df).collect()}
    place = 0
    for i in [None, *sorted(i for i in ids if i is not None)]:
        assert got[i] == (place, place + sizes[i])
        place += sizes[i]


def test_categories_are_decided_by_exact_counts(spark):
    df = spark.range(4_000).select(
        F.col("id"), (F.col("id") % 50).alias("fifty"), (F.col("id") % 51).alias("one_more"), F.when(F.col("id") % 2 == 0, "x").alias("half"), F.lit(None).cast("string").alias("none"))
    got = profiling.categorical_summary(df, 50)
    assert {r["column_name"]: r["n_unique"] for r in got.collect()} == {"fifty": 50, "half": 1, "none": 0}
    assert {(r["value"], r["n"]) for r in got.where("column_name = 'half'").collect()} == {("x", 2000), (None, 2000)}
    assert "id" not in profiling.few_valued(df, 50) and "one_more" in profiling.few_valued(df, 50)


def test_zones_share_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, at(i), float(i % 96)) for i in range(300)], "campus_id long, timestamp timestamp_ntz, power double").write.parquet(f"{tmp_path}/g")
    coords = spark.createDataFrame([(1, -37.8, 145.0)], "campus_id long, latitude double, longitude double")
    scores = sun.score_zones(spark.read.parquet(f"{tmp_path}/g"), coords)
    assert plan(scores).count("FileScan parquet") == 1 and scores.count() == 2


def test_multiset_digest_counts_repeats_and_ignores_order(spark):
    rows = [(1, "a", 1.5, at(3)), (2, None, None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "i long, s string, d double, t timestamp_ntz")
    one = R.multiset_digest(df).first()
    assert one == R.multiset_digest(df.repartition(3).orderBy(F.desc("i"))).first()
    assert one["fingerprint"] != R.multiset_digest(df.distinct()).first()["fingerprint"]
    assert R.multiset_digest(df.limit(0)).first()["n_rows"] == 0
