from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pvlake import schema as S
from pvlake.operators import cleaning, explain, history, profiling, quality, reshape, sequences, splits
from pvlake.operators.timeline import add_position
from pvlake.functions.clock import DAY_US, micros
from pvlake.plans import build
from pvlake.sources import readers as R
from pvlake.sources import writers as W

from .conftest import at

GEN = "site_id long, timestamp timestamp_ntz, power double"


def test_text_cleaning_counts_and_keeps_rows(spark):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "1", "0.0"), ("2024-01-01 00:00:00", "1", "0.0"), ("31/12/2023 23:45", "1", "-5.0"),
                                 ("later", "1", None), ("2024-01-01T00:30:00", "1", "oops"), ("2024-01-02", "1", "NaN")],
                                "timestamp string, site_id string, power string")
    log = {r["operation"]: r["rows_affected"] for r in cleaning.cleaning_counts(raw, "generation", ["power"]).collect()}
    assert log == {"coerce_unparsable_timestamps_to_null": 1, "coerce_numeric:power": 2, "drop_exact_duplicate_rows": 1,
                   "null_impossible:negative_power": 1}
    clean = build.clean_table(raw, ["power"], ["site_id"])
    rows = clean.collect()
    assert len(rows) == 5 and sum(r["power"] is not None for r in rows) == 1
    assert sum(r["timestamp"] is None for r in rows) == 1


def test_impossible_rules_null_only_broken_values(spark):
    df = spark.createDataFrame([(-1.0, 150.0, -3.0, 400.0), (1.0, 50.0, 3.0, 359.0), (None, None, None, None)],
                               "power double, humidity double, wind_speed double, wind_direction double")
    assert [tuple(r) for r in cleaning.null_impossible(df).collect()] == [(None,) * 4, (1.0, 50.0, 3.0, 359.0), (None,) * 4]
    found = {r["rule"]: (r["n"], r["min_value"]) for r in quality.impossible_values(df).collect()}
    assert found == {"negative_power": (1, -1.0), "humidity_out_of_range": (1, 150.0), "negative_wind_speed": (1, -3.0),
                     "wind_direction_out_of_range": (1, 400.0)}


def test_gaps_and_missing_slots(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(1), 1.0), (1, at(4), 1.0), (2, at(7), 1.0)], GEN)
    gaps = {r["site_id"]: (r["expected_slots"], r["actual_rows"], r["missing_slots"]) for r in quality.gap_report(df, "site_id").collect()}
    assert gaps == {1: (5, 3, 2), 2: (1, 1, 0)}
    assert {(r["site_id"], r["timestamp"]) for r in quality.missing_slots(df, "site_id").collect()} == {(1, at(2)), (1, at(3))}


def test_off_grid_rows_fill_no_slot(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(0.5), 1.0), (1, at(2), 1.0)], GEN)
    r = quality.gap_report(df, "site_id").first()
    assert (r["expected_slots"], r["actual_rows"], r["missing_slots"]) == (3, 3, 1)


def test_duplicate_keys_and_guard(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(0), 2.0), (2, at(0), 3.0)], GEN)
    r = quality.duplicate_keys(df, ["site_id", "timestamp"], "site_id").first()
    assert (r["duplicate_key_rows"], r["affected_groups"]) == (2, 1)
    with pytest.raises(Exception, match="repeated key"):
        quality.require_unique(df, ["site_id", "timestamp"]).count()
    assert quality.require_unique(df.where("site_id = 2"), ["site_id", "timestamp"]).count() == 1


def test_missingness_timeline_across_months(spark):
    df = spark.createDataFrame([(1, at(31 * 96 - 2), 1.0), (1, at(31 * 96 + 1), 1.0)], GEN)
    rows = {r["month"]: (r["expected_slots"], r["actual_slots"]) for r in quality.missingness_timeline(df).collect()}
    assert rows == {"2024-01": (2, 1), "2024-02": (2, 1)}


def test_positions_and_split_do_not_depend_on_chunks(spark, series):
    want = None
    for width in (DAY_US, 3 * DAY_US, 60 * DAY_US):
        placed = add_position(series.withColumn("_us", micros("timestamp")), ["site_id"], "_us", width)
        got = {(r["site_id"], r["timestamp"]): (r["position"], r["n_rows"]) for r in placed.collect()}
        want = want or got
        assert got == want
    split = splits.chronological_split(series, chunk_us=DAY_US)
    for site in (1, 2):
        rows = [r["split"] for r in split.where(F.col("site_id") == site).orderBy("timestamp").collect()]
        n = len(rows)
        assert rows == ["train"] * round(n * 0.7) + ["val"] * (round(n * 0.85) - round(n * 0.7)) + ["test"] * (n - round(n * 0.85))


def test_cross_site_counts_disjoint_and_stable(spark):
    df = spark.createDataFrame([(s, at(i), 1.0) for s in range(1, 43) for i in range(20)], GEN)
    roles = {r["site_id"]: r["role"] for r in splits.site_roles(df).collect()}
    assert sorted(roles) == list(range(1, 43))
    assert {k: list(roles.values()).count(k) for k in ("train", "val", "test")} == {"train": 30, "val": 6, "test": 6}
    assert roles == {r["site_id"]: r["role"] for r in splits.site_roles(df.repartition(7)).collect()}
    framed = splits.cross_site_split(df)
    counts = {(r["protocol"], r["split"]): r["count"] for r in framed.groupBy("protocol", "split").count().collect()}
    assert counts == {("seen", "train"): 30 * 14, ("seen", "val"): 30 * 3, ("seen", "test"): 30 * 3, ("unseen", "val"): 120, ("unseen", "test"): 120}


def test_held_out_sites_must_leave_training_sites(spark):
    df = spark.createDataFrame([(1, at(0), 1.0), (2, at(0), 1.0)], GEN)
    with pytest.raises(Exception, match="training site"):
        splits.site_roles(df).collect()


def test_windows_align_mask_and_never_cross_sites(spark, series):
    ready = series.withColumn("ch_power", F.coalesce("power", F.lit(0.0))).withColumn(
        "ch_power_observed", F.col("power").isNotNull().cast("double")).withColumn("ch_x", F.col("site_id") * 1000.0)
    windows = sequences.sliding_windows(ready, ["ch_power", "ch_power_observed", "ch_x"], 4, chunk_rows=16).collect()
    pdf = ready.toPandas().sort_values(["site_id", "timestamp"])
    want = {}
    for site, g in pdf.groupby("site_id"):
        g = g.reset_index(drop=True)
        for i in range(4, len(g)):
            if g["power"].notna()[i]:
                want[(site, g["timestamp"][i].to_pydatetime())] = [*g["ch_power"][i - 4:i], 0.0]
    got = {(r["site_id"], r["timestamp"]): r["window"] for r in windows}
    assert got.keys() == want.keys()
    for key, w in got.items():
        assert len(w) == 5 and {step[2] for step in w} == {key[0] * 1000.0}
        assert w[-1][0] == 0.0 and w[-1][1] == 0.0
        assert [round(step[0], 4) for step in w] == [round(v, 4) for v in want[key]]


def test_night_spans_across_row_chunks(spark):
    flags = [False, False, True, True, False, True, False, False]
    df = spark.createDataFrame([(1, at(i), f) for i, f in enumerate(flags)], "site_id long, timestamp timestamp_ntz, is_daylight boolean")
    for chunk in (2, 3, 100):
        spans = [(r["from_ts"], r["to_ts"]) for r in history.night_spans(df, chunk_rows=chunk).orderBy("from_ts").collect()]
        assert spans == [(at(0), at(2)), (at(4), at(5)), (at(6), None)]


def test_history_range_resample_and_limit(spark, series):
    df = series.withColumn("is_daylight", F.hour("timestamp").between(6, 17))
    day = history.site_history(df, 1, "2024-01-02", "2024-01-02")
    rows = [r["timestamp"] for r in day.collect()]
    assert rows == sorted(rows) and rows[0] >= at(96) and rows[-1] <= at(191)
    daily = history.site_history(df, 1, "2024-01-02", "2024-01-03", "1D").collect()
    assert len(daily) == 2 and all(r["is_daylight"] for r in daily)
    assert [r["timestamp"] for r in history.site_history(df, 1, limit=3).collect()] == sorted(
        r["timestamp"] for r in df.where("site_id = 1").orderBy(F.desc("timestamp")).limit(3).collect())
    with pytest.raises(ValueError):
        history.site_history(df, 1, resolution="2h")


def test_sampling_frequency_ties_take_the_shortest(spark):
    df = spark.createDataFrame([(1, at(i), 1.0) for i in (0, 1, 2, 4, 6)] + [(2, at(0), 1.0), (2, at(0), 1.0)], GEN)
    gaps = profiling.within_group_gaps(df, "site_id", chunk_us=1_800_000_000)
    r = profiling.sampling_frequency(gaps, "site_id").first()
    assert (r["n_gaps"], r["mode_us"], r["min_us"], r["max_us"], r["median_us"]) == (5, 900_000_000, 0, 1_800_000_000, 900_000_000.0)


def test_unit_and_role_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "SiteKey long, `temp(C)` double, power_kW string").select("SiteKey", F.col("`temp(C)`").alias("temp_c"), "power_kW")
    roles = {r["column_name"]: r for r in profiling.column_roles(df, "t").collect()}
    assert roles["SiteKey"]["is_site"] and roles["SiteKey"]["has_id_suffix"] and roles["power_kW"]["is_target"]
    assert roles["power_kW"]["unit"] == "kw" and roles["temp_c"]["unit"] == "c" and roles["SiteKey"]["unit"] is None


def test_contributions_remainder_and_scenarios(spark):
    rows = [("s", f"f{i}", 1.0, (-1.0) ** i * i) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "scenario string, feature string, value double, contribution double")
    table = explain.contribution_table(df, ["scenario"], 2).orderBy("rank").collect()
    assert [(r["feature"], r["contribution"], r["direction"]) for r in table] == [
        ("f5", -5.0, "-"), ("f4", 4.0, "+"), ("<remaining 3 features>", -2.0, "-")]
    lists = explain.strongest_lists(explain.contribution_table(df, ["scenario"], 4), ["scenario"], 2).first()
    assert lists["top_positive"] == ["f4", "f2"] and lists["top_negative"] == ["f5", "f3"]
    importance = explain.global_importance(df).collect()
    assert [r["feature"] for r in importance] == ["f5", "f4", "f3", "f2", "f1"] and abs(sum(r["share_of_total"] for r in importance) - 1) < 1e-12


def test_raw_folder_round_trip(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / S.GENERATION_FILE).write_text("Extra,CampusKey,SiteKey,Timestamp,SolarGeneration\nz,1,7,2024-01-01 00:15:00,2.5\nz,1,7,2024-01-01 00:30:00,\n")
    (tmp_path / S.SITE_DETAILS_FILE).write_text("SiteKey,CampusKey,kWp,lat,Lon\n7,1,,-36.1,146.8\n")
    gen = build.clean_table(R.scan_generation(spark, root), ["power"], ["site_id", "campus_id"])
    assert sorted((r["site_id"], r["power"] or -1.0) for r in gen.collect()) == [(7, -1.0), (7, 2.5)]
    site = R.scan_site_details(spark, root).first()
    assert site["capacity_kwp"] is None and site["latitude"] == -36.1
    verdict = R.verify_columns(spark.read.option("header", True).csv(f"{root}/{S.SITE_DETAILS_FILE}"), "sites", ["SiteKey", "Panel"]).first()
    assert verdict["missing_columns"] == "Panel" and not verdict["ok"]


def test_calibration_document(spark, tmp_path):
    doc = {"run": "x", "calibration": {"gbt|mondrian|0.9": {"global_radius": 2.0, "regime_radii": {"day_lag": 3.0}, "n": {"global": 10, "day_lag": 4}},
                                       "gbt|global|0.9": {"global_radius": 2.5}}}
    path = tmp_path / "meta.json"
    path.write_text(json.dumps(doc, indent=2))
    rows = {(r["method"], r["regime"]): (r["radius"], r["n"]) for r in R.scan_calibration(spark, str(path)).collect()}
    assert rows == {("mondrian", "global"): (2.0, 10), ("mondrian", "day_lag"): (3.0, 4), ("global", "global"): (2.5, None)}


def test_partitioned_sink_is_idempotent_and_prunes(spark, series, tmp_path):
    path = str(tmp_path / "table")
    for _ in range(2):
        W.write_partitioned(series, path)
    back = spark.read.parquet(path)
    assert back.count() == series.count()
    plan = R.scan_site(back, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan
    assert R.file_fingerprint(back).first()["fingerprint"] == R.file_fingerprint(back).first()["fingerprint"]
    assert R.content_fingerprint(series).first() == R.content_fingerprint(series.repartition(3)).first()


def test_set_helpers(spark):
    a = spark.createDataFrame([(1, 2.0)], "k long, x double")
    b = spark.createDataFrame([(2, 3.0)], "k long, y double")
    assert sorted(tuple(r) for r in reshape.union_all(a, b).collect()) == [(1, 2.0, None), (2, None, 3.0)]
    assert reshape.keep_keys(a, b, ["k"]).count() == 0 and reshape.drop_keys(a, b, ["k"]).count() == 1
    long = reshape.unpivot(a, ["k"], ["x"])
    assert tuple(reshape.pivot(long, ["k"], "metric", "value", ["x"]).first()) == (1, 2.0)


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(at(0), None)], "timestamp timestamp_ntz, power double")
    assert W.rows_to_json(df).first()["json"] == '{"timestamp":"2024-01-01T00:00:00","power":null}'
