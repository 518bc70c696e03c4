"""Time features, weather filling, splits, windows, history and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import clock as K
from ..operators import history, sequences, splits
from ..operators import time_features as TF
from ..operators.weather import filled_counts, interpolate_short_gaps
from ..plans import build, evaluate, forecast
from ..sources import driver_tables as D
from .columns import CHANNELS, channel_rows, ROLE_SQL, SUN_SQL, TRAIN_CHANNELS
from .registry import CTES, query
from .scans import TEXT_TS

# small chunks on the month-long test tables, so results cross many chunk borders
CHUNK = 3 * K.DAY_US

LAG_SQL = ", ".join(
    f"max(power) OVER (w RANGE BETWEEN INTERVAL {s * 15} MINUTE PRECEDING AND INTERVAL {s * 15} MINUTE PRECEDING) AS power_lag_{s}"
    for s in TF.LAG_STEPS)
_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
ROLL_SQL = ", ".join(
    f"{_AGG[stat]}(power) OVER (w RANGE BETWEEN INTERVAL {w} SECOND PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS power_rolling_{stat}_{w}s"
    for w in TF.ROLLING_SECONDS for stat in TF.ROLLING_STATS)
WINDOW = "WINDOW w AS (PARTITION BY site_id ORDER BY timestamp)"
LAGS, ROLLS = " ".join(TF.lag_names()), " ".join(TF.rolling_names())


@query("lags_calendar_exact", "gen", f"SELECT site_id, timestamp, {LAG_SQL} FROM gen {WINDOW}", LAGS)
def lags_calendar_exact(spark, folder):
    return TF.add_lags(D.generation(spark, folder), chunk_us=CHUNK).select("site_id", "timestamp", *TF.lag_names())


@query("rolling_left_closed", "gen", f"SELECT site_id, timestamp, {ROLL_SQL} FROM gen {WINDOW}", ROLLS)
def rolling_left_closed(spark, folder):
    return TF.add_rolling(D.generation(spark, folder), chunk_us=CHUNK).select("site_id", "timestamp", *TF.rolling_names())


@query("chronological_split", "timed", "SELECT site_id, timestamp, split FROM timed")
def chronological_split(spark, folder):
    return splits.chronological_split(D.generation(spark, folder), chunk_us=CHUNK).select("site_id", "timestamp", "split")


@query("split_info", "timed", """
    SELECT split, count(*) AS n_rows, count(power) AS n_observed, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM timed GROUP BY 1""")
def split_info(spark, folder):
    return splits.split_info(splits.chronological_split(D.generation(spark, folder)))


def _fill_sql(source: str) -> str:
    before = "OVER (PARTITION BY campus_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = "OVER (PARTITION BY campus_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near, out = [], []
    for c in S.INTERPOLATED:
        near += [f"last_value({c} IGNORE NULLS) {before} AS pv_{c}", f"first_value({c} IGNORE NULLS) {after} AS nv_{c}",
                 f"last_value(CASE WHEN {c} IS NOT NULL THEN us END IGNORE NULLS) {before} AS pt_{c}",
                 f"first_value(CASE WHEN {c} IS NOT NULL THEN us END IGNORE NULLS) {after} AS nt_{c}",
                 f"rn - last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {before} AS run_{c}"]
        out.append(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN run_{c} <= 2 THEN coalesce(pv_{c} + (nv_{c} - pv_{c}) * ((us - pt_{c}) / (nt_{c} - pt_{c})::DOUBLE), pv_{c}) END AS {c}")
    return f"""
        SELECT campus_id, timestamp, {", ".join(out)}, wind_direction FROM (SELECT *, {", ".join(near)} FROM (
            SELECT *, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY campus_id ORDER BY timestamp) AS rn FROM {source}))"""


CTES["filled"] = ("wx", _fill_sql("wx"))


@query("interpolate_time_limit", "filled", "SELECT * FROM filled", " ".join(S.CARRIED_WEATHER))
def interpolate_time_limit(spark, folder):
    return interpolate_short_gaps(D.weather(spark, folder), chunk_us=CHUNK)


@query("interpolation_log", "filled", " UNION ALL ".join(
    f"SELECT 'weather' AS dataset, 'interpolate_weather_{c}' AS operation, (SELECT count({c}) FROM filled) - (SELECT count({c}) FROM wx) AS rows_affected, 'limit=2 steps' AS detail"
    for c in S.INTERPOLATED))
def interpolation_log(spark, folder):
    wx = D.weather(spark, folder)
    return filled_counts(wx, interpolate_short_gaps(wx), S.INTERPOLATED)


_CLEAN = ", ".join(
    f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, lo, hi in (
        ("temperature", -30, 60), ("apparent_temperature", -30, 60), ("dew_point_temperature", -30, 60), ("humidity", 0, 100),
        ("wind_speed", 0, "1e308"), ("wind_direction", 0, 360)))
CTES["wxclean"] = ("wx", f"SELECT campus_id, timestamp, {_CLEAN} FROM wx")
CTES["wxfilled"] = ("wxclean", _fill_sql("wxclean"))


@query("build_processed", "gen sites wxfilled", """
    SELECT g.site_id, year(g.timestamp) AS year, month(g.timestamp) AS month, count(*) AS n_rows, count(g.power) AS n_observed,
           avg(w.temperature) AS mean_temperature, avg(w.humidity) AS mean_humidity, max(w.wind_speed) AS max_wind_speed
    FROM gen g LEFT JOIN wxfilled w USING (campus_id, timestamp) GROUP BY ALL""", "mean_temperature mean_humidity max_wind_speed")
def build_processed(spark, folder):
    """The whole raw-to-processed job on the derived raw tables, condensed per site and month."""
    gen = D.generation(spark, folder).withColumn("timestamp", F.date_format("timestamp", TEXT_TS))
    wx = D.weather(spark, folder).withColumn("timestamp", F.date_format("timestamp", TEXT_TS))
    done = build.build_processed(gen, wx, D.site_details(spark, folder))
    return done.groupBy("site_id", "year", "month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("power").alias("n_observed"),
        F.avg("temperature").alias("mean_temperature"), F.avg("humidity").alias("mean_humidity"), F.max("wind_speed").alias("max_wind_speed"))


RAW = ["campus_id", "power", "temperature", "apparent_temperature", "dew_point_temperature", "humidity", "wind_speed", "wind_direction", "solar_elevation_deg", "is_daylight"]
FEATURE_SQL = f"""
    SELECT site_id, timestamp, {", ".join(RAW)}, hour(timestamp) AS hour, minute(timestamp) AS minute, day(timestamp) AS day, isodow(timestamp) - 1 AS day_of_week,
           dayofyear(timestamp) AS day_of_year, week(timestamp) AS week_of_year, month(timestamp) AS month, quarter(timestamp) AS quarter,
           isodow(timestamp) >= 6 AS is_weekend, CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'summer' WHEN month(timestamp) <= 5 THEN 'autumn'
           WHEN month(timestamp) <= 8 THEN 'winter' ELSE 'spring' END AS season,
           sin(2 * pi() * (hour(timestamp) * 60 + minute(timestamp)) / 1440) AS sin_hour, cos(2 * pi() * (hour(timestamp) * 60 + minute(timestamp)) / 1440) AS cos_hour,
           sin(2 * pi() * dayofyear(timestamp) / 365.25) AS sin_day_of_year, cos(2 * pi() * dayofyear(timestamp) / 365.25) AS cos_day_of_year,
           sin(radians(wind_direction)) AS wind_dir_sin, cos(radians(wind_direction)) AS wind_dir_cos, {LAG_SQL}, {ROLL_SQL} FROM panel {WINDOW}"""
WHOLE = ["hour", "minute", "day", "day_of_week", "day_of_year", "week_of_year", "month", "quarter", "is_weekend", "season"]
FEATURES = [*RAW, *WHOLE, "sin_hour", "cos_hour", "sin_day_of_year", "cos_day_of_year", "wind_dir_sin", "wind_dir_cos", *TF.lag_names(), *TF.rolling_names()]
FEATURE_DOUBLES = " ".join(c for c in FEATURES if c not in (*WHOLE, "campus_id", "is_daylight"))


@query("feature_build", "panel", FEATURE_SQL, FEATURE_DOUBLES)
def feature_build(spark, folder):
    """Every column that the feature build makes."""
    return build.build_features(D.panel(spark, folder), chunk_us=CHUNK)


@query("feature_missing_pct", "panel", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, 100.0 * avg(({c} IS NULL)::INT) AS missing_pct FROM ({FEATURE_SQL})"
    for c in [*TF.lag_names(), *TF.rolling_names()]), "missing_pct")
def feature_missing_pct(spark, folder):
    built = build.build_features(D.panel(spark, folder))
    return build.feature_missing(built, [*TF.lag_names(), *TF.rolling_names()])


@query("build_features_solar", "gen sites", f"""
    WITH sun AS ({SUN_SQL}), lit AS (
        SELECT campus_id, date_trunc('day', timestamp) AS d, count(DISTINCT timestamp) * 0.25 AS hours FROM sun WHERE solar_elevation_deg > 0 GROUP BY 1, 2)
    SELECT s.site_id, count(*) AS n_rows, min(s.azimuth_deg) AS min_azimuth, max(s.azimuth_deg) AS max_azimuth,
           max(s.solar_elevation_deg) AS max_elevation, max(90 - s.solar_elevation_deg) AS max_zenith, avg(l.hours) AS mean_day_length
    FROM sun s LEFT JOIN lit l ON l.campus_id = s.campus_id AND l.d = date_trunc('day', s.timestamp) GROUP BY 1""",
       "min_azimuth max_azimuth max_elevation max_zenith mean_day_length")
def build_features_solar(spark, folder):
    """The full table with real solar geometry, condensed per site."""
    from ..operators.sun import campus_coordinates

    coords = campus_coordinates(D.site_details(spark, folder))
    built = build.build_features(D.panel(spark, folder), coords, "Etc/GMT-10")
    return built.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("azimuth_deg").alias("min_azimuth"), F.max("azimuth_deg").alias("max_azimuth"),
        F.max("solar_elevation_deg").alias("max_elevation"), F.max("zenith_deg").alias("max_zenith"),
        F.avg("day_length_hours").alias("mean_day_length"))


# ---------------------------------------------------------------- samples and splits

@query("cross_site_split", "gen", f"""
    SELECT site_id, timestamp, CASE WHEN role = 'train' THEN 'seen' ELSE 'unseen' END AS protocol,
           CASE WHEN role <> 'train' THEN role WHEN pos <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
                WHEN pos <= round_even(n * (0.7::DOUBLE + (1 - 0.7::DOUBLE) / 2), 0) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS pos, count(*) OVER (PARTITION BY site_id) AS n FROM gen)
    JOIN ({ROLE_SQL}) USING (site_id)""")
def cross_site_split(spark, folder):
    return splits.cross_site_split(D.generation(spark, folder)).select("site_id", "timestamp", "protocol", "split")


DIGEST = "md5('42|' || site_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S'))"


@query("sample_observed", "gen", f"""
    SELECT site_id, timestamp, power FROM gen WHERE power IS NOT NULL ORDER BY {DIGEST}, site_id, timestamp LIMIT 500""", "power")
def sample_observed(spark, folder):
    return splits.sample_observed(D.generation(spark, folder), 500).select("site_id", "timestamp", "power")


@query("sample_fraction", "gen", f"""
    SELECT site_id, timestamp FROM gen WHERE ('0x' || substr({DIGEST}, 1, 8))::BIGINT < 1073741824""")
def sample_fraction(spark, folder):
    return splits.sample_fraction(D.generation(spark, folder), 0.25).select("site_id", "timestamp")


@query("every_nth", "gen", """
    SELECT site_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS pos FROM gen) WHERE pos % 3 = 1""")
def every_nth(spark, folder):
    return splits.every_nth(D.generation(spark, folder), 3).select("site_id", "timestamp")


@query("site_bounds", "gen", """
    SELECT site_id, min(rn) - 1 AS start_row, max(rn) AS end_row FROM (SELECT site_id, row_number() OVER (ORDER BY site_id, timestamp) AS rn FROM gen) GROUP BY 1""")
def site_bounds(spark, folder):
    return splits.site_bounds(D.generation(spark, folder))


# ---------------------------------------------------------------- model windows

@query("channel_scaler_fit", "panel timed", " UNION ALL ".join(
    f"SELECT '{c}' AS channel, " + ("0.0::DOUBLE AS mean, 1.0::DOUBLE AS std" if c == "power_observed" else
                                    f"avg(ch_{c}) AS mean, greatest(stddev_pop(ch_{c}), 1e-6) AS std FROM {TRAIN_CHANNELS} WHERE split = 'train'")
    for c in CHANNELS), "mean std")
def channel_scaler_fit(spark, folder):
    return sequences.channel_scaler(evaluate.train_rows(splits.chronological_split(channel_rows(spark, folder))), CHANNELS)


@query("target_stats", "timed", """
    SELECT avg(power) AS y_mean, stddev_samp(power) AS y_std FROM timed WHERE split = 'train' AND power IS NOT NULL""", "y_mean y_std")
def target_stats(spark, folder):
    return sequences.target_stats(evaluate.train_rows(splits.chronological_split(D.generation(spark, folder))))


WIN = sequences.LOOKBACK
HUMIDITY = CHANNELS.index("humidity")


@query("sliding_windows", "panel timed", f"""
    SELECT site_id, split, timestamp, target, {WIN + 1}::BIGINT AS n_steps, w_power AS sum_power, w_humidity AS sum_humidity,
           0.0::DOUBLE AS last_power, 0.0::DOUBLE AS last_mask, ch_humidity AS last_humidity, first_power
    FROM (SELECT c.*, t.power AS target,
                 sum(ch_power) OVER (w ROWS BETWEEN {WIN} PRECEDING AND 1 PRECEDING) AS w_power,
                 sum(ch_humidity) OVER (w ROWS BETWEEN {WIN} PRECEDING AND CURRENT ROW) AS w_humidity,
                 lag(ch_power, {WIN}) OVER w AS first_power, row_number() OVER w AS pos
          FROM {TRAIN_CHANNELS} c JOIN gen t USING (site_id, timestamp) WINDOW w AS (PARTITION BY site_id, split ORDER BY timestamp))
    WHERE pos > {WIN} AND target IS NOT NULL""", "target sum_power sum_humidity last_power last_mask last_humidity first_power")
def sliding_windows(spark, folder):
    # double steps compare exactly; models store 32-bit ones
    timed = splits.chronological_split(channel_rows(spark, folder))
    ready = sequences.channel_matrix(timed, CHANNELS, keep=("site_id", "split", "timestamp", "power"))
    windows = sequences.sliding_windows(ready, [f"ch_{c}" for c in CHANNELS], WIN, by=("split",), chunk_rows=256, kind="double")

    def total(i):
        return F.aggregate("window", F.lit(0.0), lambda acc, step: acc + step[i])

    last, first = F.element_at("window", -1), F.element_at("window", 1)
    return windows.select(
        "site_id", "split", "timestamp", "target", F.size("window").alias("n_steps"), total(0).alias("sum_power"), total(HUMIDITY).alias("sum_humidity"),
        last[0].alias("last_power"), last[1].alias("last_mask"), last[HUMIDITY].alias("last_humidity"), first[0].alias("first_power"))


# ---------------------------------------------------------------- history

@query("resample_history", "day", """
    SELECT site_id, resolution, timestamp, power, is_daylight FROM (
        SELECT site_id, '1h' AS resolution, date_trunc('hour', timestamp) AS timestamp, avg(power) AS power, bool_or(is_daylight) AS is_daylight FROM day GROUP BY 1, 2, 3
        UNION ALL SELECT site_id, '1D', date_trunc('day', timestamp), avg(power), bool_or(is_daylight) FROM day GROUP BY 1, 2, 3) WHERE power IS NOT NULL""",
       "power")
def resample_history(spark, folder):
    day = D.generation_daylit(spark, folder).drop("solar_elevation_deg", "campus_id")
    hourly = history.resample(day, "1h", ["site_id"]).withColumn("resolution", F.lit("1h"))
    return hourly.unionByName(history.resample(day, "1D", ["site_id"]).withColumn("resolution", F.lit("1D")))


@query("site_history", "panel", """
    SELECT timestamp, power, is_daylight, temperature, humidity, wind_speed FROM (
        SELECT date_trunc('hour', timestamp) AS timestamp, avg(power) AS power, bool_or(is_daylight) AS is_daylight, avg(temperature) AS temperature,
               avg(humidity) AS humidity, avg(wind_speed) AS wind_speed
        FROM panel WHERE site_id = 1 AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-25 23:59:59' GROUP BY 1)
    WHERE power IS NOT NULL ORDER BY timestamp DESC LIMIT 50000""", "power temperature humidity wind_speed")
def site_history(spark, folder):
    return history.site_history(D.panel(spark, folder), 1, "2024-01-03", "2024-01-25", "1h")


@query("history_cap", "", "SELECT event_id, ts, value FROM events ORDER BY ts DESC LIMIT 1000", "value")
def history_cap(spark, folder):
    return history.latest_rows(D.table(spark, folder, "events").select("event_id", "ts", "value"), 1000, "ts")


@query("tail_per_site", "gen", """
    SELECT site_id, timestamp, power FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) AS rn FROM gen) WHERE rn <= 192""", "power")
def tail_per_site(spark, folder):
    return history.tail_per_site(D.generation(spark, folder)).select("site_id", "timestamp", "power")


@query("sites_listing", "sites", "SELECT site_id, campus_id, latitude, longitude FROM sites", "latitude longitude")
def sites_listing(spark, folder):
    return history.sites_listing(D.site_details(spark, folder))


@query("dataset_card", "gen", """
    SELECT count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, count(DISTINCT campus_id) AS n_campuses, 15::BIGINT AS cadence_minutes,
           'Australia/Melbourne' AS timezone FROM gen""")
def dataset_card(spark, folder):
    return history.dataset_card(D.generation(spark, folder), "Australia/Melbourne")


@query("latest_and_day_energy", "gen", """
    SELECT g.site_id, g.timestamp AS latest_ts, g.power AS latest_power, e.energy AS day_energy
    FROM gen g JOIN (SELECT site_id, max(timestamp) AS t FROM gen WHERE power IS NOT NULL GROUP BY 1) l ON l.site_id = g.site_id AND l.t = g.timestamp
    JOIN (SELECT site_id, date_trunc('day', timestamp) AS d, sum(power) AS energy FROM gen GROUP BY 1, 2) e
      ON e.site_id = g.site_id AND e.d = date_trunc('day', g.timestamp)""", "latest_power day_energy")
def latest_and_day_energy(spark, folder):
    return history.latest_and_day_energy(D.generation(spark, folder))


@query("night_spans", "day", """
    SELECT site_id, timestamp AS from_ts, nxt AS to_ts FROM (
        SELECT *, lead(timestamp) OVER (PARTITION BY site_id ORDER BY timestamp) AS nxt FROM (
            SELECT *, lag(is_daylight) OVER (PARTITION BY site_id ORDER BY timestamp) AS prev FROM day)
        WHERE prev IS NULL OR prev <> is_daylight) WHERE NOT is_daylight""")
def night_spans(spark, folder):
    return history.night_spans(D.generation_daylit(spark, folder), chunk_rows=50)


@query("incremental_history", "gen", f"""
    SELECT site_id, timestamp, {", ".join(TF.lag_names())}, {", ".join(TF.rolling_names())} FROM (
        SELECT *, {LAG_SQL}, {ROLL_SQL}, max(timestamp) OVER (PARTITION BY site_id) AS last FROM (
            SELECT site_id, timestamp, power FROM gen
            UNION ALL SELECT site_id, max(timestamp) + INTERVAL 15 MINUTE, NULL FROM gen GROUP BY 1) {WINDOW}) WHERE timestamp = last""", f"{LAGS} {ROLLS}")
def incremental_history(spark, folder):
    gen = D.generation(spark, folder)
    ahead = history.future_rows(gen, 1, [])
    return TF.lookback_at(gen, ahead).select("site_id", "timestamp", *TF.lag_names(), *TF.rolling_names())


LAST_WX = """
    SELECT g.site_id, g.campus_id, g.timestamp AS last_ts, w.temperature, w.humidity, w.wind_direction FROM gen g
    JOIN (SELECT site_id, max(timestamp) AS t FROM gen GROUP BY 1) l ON l.site_id = g.site_id AND l.t = g.timestamp
    LEFT JOIN wx w ON w.campus_id = g.campus_id AND w.timestamp = g.timestamp"""


@query("future_frame", "gen wx", f"""
    SELECT l.site_id, l.campus_id, l.last_ts + to_minutes(s.step * 15) AS timestamp, s.step, hour(l.last_ts + to_minutes(s.step * 15)) AS hour,
           l.temperature, l.humidity, cos(radians(l.wind_direction)) AS wind_dir_cos
    FROM ({LAST_WX}) l CROSS JOIN (SELECT unnest(generate_series(1, 96)) AS step) s""", "temperature humidity wind_dir_cos")
def future_frame(spark, folder):
    return forecast.future_frame(D.panel(spark, folder), 96).select(
        "site_id", "campus_id", "timestamp", "step", "hour", "temperature", "humidity", "wind_dir_cos")


@query("forecast_persistence", "gen", """
    SELECT l.site_id, s.step, l.t + to_minutes(s.step * 15) AS timestamp, h.power AS prediction
    FROM (SELECT site_id, max(timestamp) AS t FROM gen GROUP BY 1) l CROSS JOIN (SELECT unnest(generate_series(1, 96)) AS step) s
    LEFT JOIN gen h ON h.site_id = l.site_id AND h.timestamp = l.t + to_minutes(s.step * 15) - INTERVAL 24 HOUR""", "prediction")
def forecast_persistence(spark, folder):
    return forecast.forecast_persistence(D.generation(spark, folder), 96)


@query("sort_site_time", "gen", "SELECT * FROM gen ORDER BY site_id, timestamp", "power")
def sort_site_time(spark, folder):
    return D.generation(spark, folder).orderBy("site_id", "timestamp")
