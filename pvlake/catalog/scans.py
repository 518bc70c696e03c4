"""Scans, sinks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import history
from ..operators.cleaning import coerce_numeric, parse_timestamps
from ..sources import driver_tables as D
from ..sources import readers as R
from ..sources import writers as W
from .registry import query, scratch

TEXT_TS = "yyyy-MM-dd HH:mm:ss"


def _raw(df, names):
    """Canonical table back to its raw CSV layout."""
    back = {new: raw for raw, new in names.items()}
    text = df.withColumn("timestamp", F.date_format("timestamp", TEXT_TS)) if "timestamp" in df.columns else df
    return text.withColumnsRenamed({c: back[c] for c in df.columns})


@query("scan_generation", "gen", "SELECT * FROM gen", "power")
def scan_generation(spark, folder):
    root = scratch(spark)
    W.write_csv(_raw(D.generation(spark, folder), S.GENERATION_NAMES), f"{root}/{S.GENERATION_FILE}")
    raw = R.scan_generation(spark, root)
    return coerce_numeric(coerce_numeric(parse_timestamps(raw), ["power"]), ["site_id", "campus_id"], "long")


WEATHER_DOUBLES = "temperature apparent_temperature dew_point_temperature humidity wind_speed wind_direction"


@query("scan_weather", "wx", "SELECT * FROM wx", WEATHER_DOUBLES)
def scan_weather(spark, folder):
    root = scratch(spark)
    W.write_csv(_raw(D.weather(spark, folder), S.WEATHER_NAMES), f"{root}/{S.WEATHER_FILE}")
    raw = R.scan_weather(spark, root)
    return coerce_numeric(coerce_numeric(parse_timestamps(raw), S.CARRIED_WEATHER), ["campus_id"], "long")


@query("scan_site_details", "sites", "SELECT * FROM sites", "capacity_kwp latitude longitude")
def scan_site_details(spark, folder):
    root = scratch(spark)
    W.write_csv(_raw(D.site_details(spark, folder), S.SITE_DETAILS_NAMES), f"{root}/{S.SITE_DETAILS_FILE}")
    return R.scan_site_details(spark, root)


@query("scan_multi_format", "gen", """
    SELECT k.kind, count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, count(power) AS n_observed
    FROM gen CROSS JOIN (VALUES ('csv'), ('tsv'), ('parquet')) k(kind) GROUP BY 1""")
def scan_multi_format(spark, folder):
    root = scratch(spark)
    gen = D.generation(spark, folder).withColumn("timestamp", F.date_format("timestamp", TEXT_TS))
    gen.write.option("header", True).csv(f"{root}/a/b")
    # files of the third kind carry their own suffix, so every kind is found by name below one root
    gen.write.option("header", True).option("sep", "\t").option("extension", "tsv").csv(f"{root}/c")
    gen.write.parquet(f"{root}/d/e")
    out = None
    for kind in ("csv", "tsv", "parquet"):
        one = R.scan_tabular(spark, root, kind).agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site_id").alias("n_sites"),
            F.count("power").alias("n_observed")).select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_parquet_full", "", "SELECT * FROM orders", "o_totalprice")
def scan_parquet_full(spark, folder):
    return D.table(spark, folder, "orders")


@query("scan_parquet_projected", "", "SELECT l_orderkey, l_shipdate FROM lineitem")
def scan_parquet_projected(spark, folder):
    return D.table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate")


@query("scan_partition_filtered", "gen", "SELECT site_id, timestamp, power FROM gen WHERE site_id = 1", "power")
def scan_partition_filtered(spark, folder):
    root = scratch(spark)
    W.write_partitioned(D.generation(spark, folder), root)
    return R.scan_site(spark.read.parquet(root), 1).select(F.col("site_id").cast("long").alias("site_id"), "timestamp", "power")


@query("scan_partition_range", "", """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1994-11-20' AND o_orderdate <= TIMESTAMP '1995-02-10 23:59:59'""", "o_totalprice")
def scan_partition_range(spark, folder):
    """A range over a many-year table in directories of months: only the months of the range are read."""
    root = scratch(spark)
    orders = W.add_partition_columns(D.table(spark, folder, "orders"), "o_orderdate")
    W.write_partitioned(orders, root, ("year", "month"), ("o_orderdate",))
    return R.time_range(spark.read.parquet(root), "1994-11-20", "1995-02-10", "o_orderdate").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("sink_partitioned_parquet", "gen", """
    SELECT site_id, year(timestamp) AS year, month(timestamp) AS month, count(*) AS n_rows, sum(power) AS energy
    FROM gen GROUP BY ALL""", "energy")
def sink_partitioned_parquet(spark, folder):
    root = scratch(spark)
    for _ in range(2):  # a second run must replace the first
        W.write_partitioned(D.generation(spark, folder), root)
    return spark.read.parquet(root).groupBy("site_id", "year", "month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("power").alias("energy"))


@query("sink_parquet", "wx", "SELECT * FROM wx", WEATHER_DOUBLES)
def sink_parquet(spark, folder):
    root = scratch(spark)
    W.write_parquet(D.weather(spark, folder), root)
    return spark.read.parquet(root)


@query("sink_csv", "sites", "SELECT site_id, campus_id, capacity_kwp FROM sites", "capacity_kwp")
def sink_csv(spark, folder):
    root = scratch(spark)
    W.write_csv(D.site_details(spark, folder).select("site_id", "campus_id", "capacity_kwp"), root)
    return spark.read.schema("site_id long, campus_id long, capacity_kwp double").option("header", True).csv(root)


@query("rows_to_json", "gen", r"""
    SELECT '{"site_id":' || site_id || ',"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '","observed":'
           || CASE WHEN power IS NULL THEN 'null' ELSE 'true' END || '}' AS json FROM gen""")
def rows_to_json(spark, folder):
    gen = D.generation(spark, folder)
    observed = F.when(F.col("power").isNotNull(), F.lit(True)).alias("observed")
    return W.rows_to_json(gen.select("site_id", "timestamp", observed))


@query("scan_nested_json", "", """
    WITH cal AS (
        SELECT 'm' || (user_id // 20) AS model, event_type AS regime, max(value) AS radius, count(*) AS n FROM events GROUP BY 1, 2),
    whole AS (SELECT 'm' || (user_id // 20) AS model, max(value) AS radius FROM events GROUP BY 1)
    SELECT model, 'mondrian' AS method, '0.9' AS level, regime, radius, n FROM cal
    UNION ALL SELECT model, 'mondrian', '0.9', 'global', radius, 0 FROM whole""")
def scan_nested_json(spark, folder):
    root = scratch(spark)
    model = F.concat(F.lit("m"), F.floor(F.col("user_id") / 20).cast("string"))
    per = D.table(spark, folder, "events").groupBy(model.alias("model"), F.col("event_type").alias("regime")).agg(
        F.max("value").alias("radius"), F.count(F.lit(1)).alias("n"))
    entry = per.groupBy("model").agg(
        F.max("radius").alias("global_radius"),
        F.map_from_entries(F.collect_list(F.struct("regime", "radius"))).alias("regime_radii"),
        F.map_from_entries(F.collect_list(F.struct("regime", "n"))).alias("n"))
    key = F.concat(F.col("model"), F.lit("|mondrian|0.9"))
    # one document per model, as one calibration file each
    entry.select(F.create_map(key, F.struct("global_radius", "regime_radii", "n")).alias("calibration")).write.json(root)
    # written one document per line; the reader for whole-file documents is exercised in the tests
    return R.scan_calibration(spark, root, multi_line=False).na.fill(0, ["n"])


@query("scan_metric_csvs", "board", """
    SELECT model, split, scope, coalesce(site_id::VARCHAR, '') AS site_id, n_eval::DOUBLE AS n_eval, mae FROM board""", "n_eval mae")
def scan_metric_csvs(spark, folder):
    from ..plans.evaluate import baseline_leaderboard

    root = scratch(spark)
    board = baseline_leaderboard(D.generation_daylit(spark, folder)).select("model", "split", "scope", "site_id", "n_eval", "mae")
    board.write.partitionBy("model").option("header", True).csv(root)
    models = ("zero", "mean_global", "mean_site", "persistence_24h")
    read = R.scan_metric_csvs(spark, {m: f"{root}/model={m}" for m in models})
    return read.withColumn("site_id", F.coalesce("site_id", F.lit("")))


@query("verify_required_columns", "", """
    SELECT 'orders' AS table_name, count(*) AS n_rows, 2::BIGINT AS n_required, '' AS missing_columns, true AS ok, 'columns ok' AS detail FROM orders
    UNION ALL SELECT 'events', count(*), 3, 'power,site_id', false, 'missing columns' FROM events
    UNION ALL SELECT 'inverters', NULL, 1, 'inverter_id', false, 'file not found'""")
def verify_required_columns(spark, folder):
    required = {"orders": ["o_orderkey", "o_orderdate"], "events": ["ts", "power", "site_id"], "inverters": ["inverter_id"]}
    return R.verify_files(spark, {t: f"{folder}/{t}.parquet" for t in required}, required)


_PRINT_TEXT = """
    coalesce(event_id::VARCHAR, '-') || '|' || coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '-') || '|' || coalesce(user_id::VARCHAR, '-')
    || '|' || coalesce(event_type, '-') || '|' || coalesce(value::DECIMAL(24, 6)::VARCHAR, '-')"""


@query("dataset_fingerprint", "", f"""
    SELECT count(*) AS n_rows, md5(coalesce(sum(('0x' || d[1:15])::BIGINT), 0)::VARCHAR || '|' || coalesce(sum(('0x' || d[16:30])::BIGINT), 0)::VARCHAR) AS fingerprint
    FROM (SELECT md5({_PRINT_TEXT}) AS d FROM events)""")
def dataset_fingerprint(spark, folder):
    return R.multiset_digest(D.table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value"))


@query("file_fingerprint")
def file_fingerprint(spark, folder):
    files = R.file_fingerprint(D.table(spark, folder, "events")).select(
        F.lit("files").alias("kind"), F.col("n_files").alias("n"), "fingerprint")
    rows = R.content_fingerprint(D.table(spark, folder, "events")).select(
        F.lit("rows").alias("kind"), F.col("n_rows").alias("n"), "fingerprint")
    return files.unionByName(rows)


# ---------------------------------------------------------------- filters

@query("filter_observed", "gen", "SELECT * FROM gen WHERE power IS NOT NULL", "power")
def filter_observed(spark, folder):
    return D.generation(spark, folder).where(F.col("power").isNotNull())


@query("filter_time_range", "gen", """
    SELECT * FROM gen WHERE timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59'""", "power")
def filter_time_range(spark, folder):
    return R.time_range(D.generation(spark, folder), "2024-01-05 06:00:00", "2024-01-20")


@query("filter_day_night", "day", """
    SELECT is_daylight, count(*) AS n, sum(power) AS energy FROM day WHERE power IS NOT NULL GROUP BY 1""", "energy")
def filter_day_night(spark, folder):
    from ..operators.explore import day_observed, night_observed

    df = D.generation_daylit(spark, folder)
    both = day_observed(df).unionByName(night_observed(df))
    return both.groupBy("is_daylight").agg(F.count(F.lit(1)).alias("n"), F.sum("power").alias("energy"))


SCENARIOS = """
    SELECT 'night_zero' AS scenario, * FROM panel WHERE NOT is_daylight AND power IS NOT NULL
    UNION ALL SELECT 'clear_noon_peak', * FROM panel
        WHERE is_daylight AND solar_elevation_deg > 45 AND hour(timestamp) BETWEEN 11 AND 14 AND power IS NOT NULL
    UNION ALL SELECT 'morning_ramp', * FROM panel
        WHERE is_daylight AND hour(timestamp) BETWEEN 6 AND 9 AND solar_elevation_deg BETWEEN 5 AND 25 AND power IS NOT NULL
    UNION ALL SELECT 'overcast_afternoon', * FROM panel
        WHERE is_daylight AND humidity > 80 AND hour(timestamp) >= 13 AND power IS NOT NULL"""


@query("filter_scenarios", "panel", f"SELECT scenario, site_id, timestamp, power FROM ({SCENARIOS})", "power")
def filter_scenarios(spark, folder):
    from ..operators.explain import tag_scenarios

    return tag_scenarios(D.panel(spark, folder)).select("scenario", "site_id", "timestamp", "power")


@query("filter_valid_pairs", "p24", """
    SELECT site_id, timestamp, power, p24 AS prediction FROM p24 WHERE power IS NOT NULL AND p24 IS NOT NULL""", "power prediction")
def filter_valid_pairs(spark, folder):
    from ..operators.baselines import predict_persistence
    from ..operators.conformal import valid_pairs

    return valid_pairs(predict_persistence(D.generation(spark, folder))).select("site_id", "timestamp", "power", "prediction")


@query("filter_windows_valid", "gen", """
    SELECT site_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS pos FROM gen)
    WHERE pos > 96 AND power IS NOT NULL""")
def filter_windows_valid(spark, folder):
    from ..functions.clock import micros
    from ..operators.timeline import add_position

    placed = add_position(D.generation(spark, folder).withColumn("_us", micros("timestamp")), ["site_id"], "_us")
    return placed.where((F.col("position") > 96) & F.col("power").isNotNull()).select("site_id", "timestamp")


@query("filter_drop_all_null_power", "gen", """
    SELECT site_id, date_trunc('hour', timestamp) AS timestamp, avg(power) AS power FROM gen GROUP BY 1, 2
    HAVING count(power) > 0""", "power")
def filter_drop_all_null_power(spark, folder):
    return history.resample(D.generation(spark, folder), "1h", ["site_id"])


@query("filter_threshold_months", "wx", """
    SELECT month, max_missing_pct FROM (
        SELECT strftime(timestamp, '%Y-%m') AS month, 100.0 * greatest(avg((temperature IS NULL)::INT), avg((humidity IS NULL)::INT),
               avg((wind_speed IS NULL)::INT)) AS max_missing_pct FROM wx GROUP BY 1) WHERE max_missing_pct > 40""", "max_missing_pct")
def filter_threshold_months(spark, folder):
    from ..operators.explore import months_with_weather_gaps

    return months_with_weather_gaps(D.weather(spark, folder), ["temperature", "humidity", "wind_speed"], 40.0)


@query("filter_threshold_sites", "gen", """
    SELECT *, CASE WHEN missing_pct = 0 THEN 'complete' WHEN missing_pct > 90 THEN 'dead' WHEN missing_pct > 50 THEN 'sparse'
              ELSE 'partial' END AS band
    FROM (SELECT site_id, 100.0 * avg((power IS NULL)::INT) AS missing_pct FROM gen GROUP BY 1)""", "missing_pct")
def filter_threshold_sites(spark, folder):
    from ..operators.explore import sites_by_missing

    return sites_by_missing(D.generation(spark, folder))
