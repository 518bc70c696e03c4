"""Projections, scalar functions, joins, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import calendar as C
from ..functions import clock as K
from ..functions.stats import signed_error
from ..operators import baselines, cleaning, conformal, explain, explore, reshape, sequences, splits, sun
from ..operators.time_features import lag_by_join
from ..operators.weather import join_weather
from ..plans import evaluate, learn
from ..sources import driver_tables as D
from ..sources.writers import add_partition_columns
from .registry import query


def site_text(df):
    """Site as text, empty for rows over all sites."""
    return df.withColumn("site_id", F.coalesce(F.col("site_id").cast("string"), F.lit("")))


@query("rename_canonical", "", """
    SELECT user_id AS site_id, event_id AS campus_id, ts AS timestamp, value AS power FROM events""", "power")
def rename_canonical(spark, folder):
    raw = D.table(spark, folder, "events").select(
        F.col("user_id").alias("SiteKey"), F.col("event_id").alias("CampusKey"),
        F.col("ts").alias("Timestamp"), F.col("value").alias("SolarGeneration"))
    return S.rename(raw, S.GENERATION_NAMES)


@query("parse_timestamps", "", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts)
           WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('minute', ts) END AS timestamp FROM events""")
def parse_timestamps(spark, folder):
    layouts = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd", "yyyy-MM-dd HH:mm"]
    kind = F.pmod(F.col("event_id"), F.lit(5))
    text = F.lit("not a time")
    for i, layout in enumerate(layouts):
        text = F.when(kind == i, F.date_format("ts", layout)).otherwise(text)
    return cleaning.parse_timestamps(D.table(spark, folder, "events").select("event_id", text.alias("timestamp")))


@query("coerce_numeric", "", """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS power FROM events""", "power")
def coerce_numeric(spark, folder):
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return cleaning.coerce_numeric(D.table(spark, folder, "events").select("event_id", text.alias("power")), ["power"])


@query("null_impossible", "wx", """
    SELECT campus_id, timestamp, CASE WHEN temperature BETWEEN -30 AND 60 THEN temperature END AS temperature,
           CASE WHEN apparent_temperature BETWEEN -30 AND 60 THEN apparent_temperature END AS apparent_temperature,
           CASE WHEN dew_point_temperature BETWEEN -30 AND 60 THEN dew_point_temperature END AS dew_point_temperature,
           CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END AS humidity, CASE WHEN wind_speed >= 0 THEN wind_speed END AS wind_speed,
           CASE WHEN wind_direction BETWEEN 0 AND 360 THEN wind_direction END AS wind_direction FROM wx""",
       "temperature apparent_temperature dew_point_temperature humidity wind_speed wind_direction")
def null_impossible(spark, folder):
    return cleaning.null_impossible(D.weather(spark, folder))


@query("temporal_calendar", "", """
    SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, day(ts) AS day, isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year,
           week(ts) AS week_of_year, month(ts) AS month, quarter(ts) AS quarter, isodow(ts) >= 6 AS is_weekend FROM events""")
def temporal_calendar(spark, folder):
    return D.table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in C.calendar_columns("ts").items()])


@query("temporal_season", "", """
    SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'summer' WHEN month(o_orderdate) <= 5 THEN 'autumn'
           WHEN month(o_orderdate) <= 8 THEN 'winter' ELSE 'spring' END AS season FROM orders""")
def temporal_season(spark, folder):
    return D.table(spark, folder, "orders").select("o_orderkey", C.season(F.month("o_orderdate")).alias("season"))


@query("temporal_cyclical", "", """
    SELECT event_id, sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS sin_hour, cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS cos_hour,
           sin(2 * pi() * dayofyear(ts) / 365.25) AS sin_day_of_year, cos(2 * pi() * dayofyear(ts) / 365.25) AS cos_day_of_year FROM events""",
       "sin_hour cos_hour sin_day_of_year cos_day_of_year")
def temporal_cyclical(spark, folder):
    return D.table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in C.cyclical_columns("ts").items()])


@query("wind_circular", "wx", """
    SELECT campus_id, timestamp, sin(radians(wind_direction)) AS wind_dir_sin, cos(radians(wind_direction)) AS wind_dir_cos FROM wx""",
       "wind_dir_sin wind_dir_cos")
def wind_circular(spark, folder):
    return C.add_wind(D.weather(spark, folder)).select("campus_id", "timestamp", "wind_dir_sin", "wind_dir_cos")


@query("available_weather", "wx", """
    SELECT v.variable, CASE v.variable WHEN 'temperature' THEN count(temperature) WHEN 'apparent_temperature' THEN count(apparent_temperature)
           WHEN 'dew_point_temperature' THEN count(dew_point_temperature) WHEN 'humidity' THEN count(humidity)
           WHEN 'wind_speed' THEN count(wind_speed) ELSE count(wind_direction) END AS n_observed
    FROM wx CROSS JOIN (VALUES ('temperature'), ('apparent_temperature'), ('dew_point_temperature'), ('humidity'), ('wind_speed'), ('wind_direction')) v(variable)
    GROUP BY v.variable""")
def available_weather(spark, folder):
    wx = D.weather(spark, folder)
    names = S.available_weather(wx)
    wide = wx.agg(*[F.count(c).alias(c) for c in names])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_observed")) for c in names])))


@query("partition_cols", "", "SELECT event_id, year(ts) AS year, month(ts) AS month FROM events")
def partition_cols(spark, folder):
    return add_partition_columns(D.table(spark, folder, "events"), "ts").select("event_id", "year", "month")


@query("localize_tz", "", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, local_ts, CASE
        WHEN (utc + INTERVAL 0 HOUR) IS NULL THEN NULL
        WHEN ((utc - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' = local_ts THEN NULL
        WHEN ((utc + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' = local_ts THEN NULL
        WHEN (utc AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' <> local_ts
            THEN timezone('UTC', timezone('Australia/Melbourne', date_trunc('hour', (utc AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne')))
        ELSE utc END AS utc_ts
    FROM (SELECT *, timezone('UTC', timezone('Australia/Melbourne', local_ts)) AS utc
          FROM (SELECT l_orderkey, l_linenumber, l_shipdate + to_minutes((l_partkey % 96) * 15) AS local_ts FROM lineitem))""")
def localize_tz(spark, folder):
    minutes = (F.pmod(F.col("l_partkey"), F.lit(96)) * 15).cast("int")
    local = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    rows = D.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", local.alias("local_ts"))
    return K.add_utc(rows, "local_ts", "Australia/Melbourne", "utc_ts")


SUN_SQL = """
    SELECT campus_id, site_id, timestamp, elev + CASE WHEN elev >= -(0.26667 + 0.5667) THEN 1013.25 / 1010.0 * 283.0 / (273.0 + 12.0) * 1.02 / 60.0
               / tan(radians(elev + 10.3 / (elev + 5.11))) ELSE 0 END AS solar_elevation_deg, az AS azimuth_deg
    FROM (SELECT *, degrees(asin(least(1, greatest(-1, sin(lat) * sin(decl) + cos(lat) * cos(decl) * cos(ha))))) AS elev,
                 fm(degrees(atan2(sin(ha), cos(ha) * sin(lat) - tan(decl) * cos(lat))) + 180.0, 360) AS az
    FROM (SELECT *, radians(fm(mins + eqt + 4 * longitude, 1440) / 4 - 180) AS ha
    FROM (SELECT *, 4 * degrees(y * sin(2 * l0) - 2 * ecc * sin(m) + 4 * ecc * y * sin(m) * cos(2 * l0) - 0.5 * y * y * sin(4 * l0)
                 - 1.25 * ecc * ecc * sin(2 * m)) AS eqt, asin(sin(ob) * sin(app)) AS decl
    FROM (SELECT *, tan(ob / 2) ** 2 AS y, radians(degrees(l0) + centre - 0.00569 - 0.00478 * sin(nd)) AS app
    FROM (SELECT *, sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 AS centre,
                 radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * cos(nd)) AS ob
    FROM (SELECT *, radians(fm(280.46646 + t * (36000.76983 + t * 0.0003032), 360)) AS l0,
                 radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS m, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS ecc,
                 radians(125.04 - 1934.136 * t) AS nd
    FROM (SELECT g.campus_id, g.site_id, g.timestamp, c.longitude, radians(c.latitude) AS lat,
                 (epoch(g.timestamp - INTERVAL 10 HOUR) - 946728000)::DOUBLE / (86400.0::DOUBLE * 36525) AS t,
                 epoch(g.timestamp - INTERVAL 10 HOUR)::BIGINT % 86400 / 60.0::DOUBLE AS mins
          FROM gen g JOIN (SELECT campus_id, median(latitude) AS latitude, median(longitude) AS longitude FROM sites GROUP BY 1) c USING (campus_id)
    )))))))"""


def _fm(sql: str) -> str:
    """Spell fm(x, n), a non-negative remainder, as plain SQL."""
    out, i = "", 0
    while True:
        j = sql.find("fm(", i)
        if j < 0:
            return out + sql[i:]
        depth, k = 1, j + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        x, n = sql[j + 3:k - 1].rsplit(",", 1)
        x = _fm(x)
        out += sql[i:j] + f"(({x}) - {n.strip()}::DOUBLE * floor(({x}) / {n.strip()}::DOUBLE))"
        i = k


SUN_SQL = _fm(SUN_SQL)


def _sunny(spark, folder):
    coords = sun.campus_coordinates(D.site_details(spark, folder))
    return sun.add_solar_position(D.generation(spark, folder), coords, "Etc/GMT-10")


@query("solar_position", "gen sites", SUN_SQL, "solar_elevation_deg azimuth_deg")
def solar_position(spark, folder):
    return _sunny(spark, folder).select("campus_id", "site_id", "timestamp", "solar_elevation_deg", "azimuth_deg")


@query("daylight_flag", "gen sites", f"SELECT site_id, timestamp, solar_elevation_deg > 0 AS is_daylight FROM ({SUN_SQL})")
def daylight_flag(spark, folder):
    return _sunny(spark, folder).select("site_id", "timestamp", "is_daylight")


REGIME_SQL = """
    SELECT d.*, CASE WHEN d.is_daylight THEN 'day' ELSE 'night' END || CASE WHEN h.power IS NULL THEN '_nolag' ELSE '_lag' END AS regime
    FROM day d LEFT JOIN gen h ON h.site_id = d.site_id AND h.timestamp = d.timestamp - INTERVAL 15 MINUTE"""


@query("regime_label", "day", f"SELECT site_id, timestamp, regime FROM ({REGIME_SQL})")
def regime_label(spark, folder):
    return evaluate.with_regime(D.generation_daylit(spark, folder)).select("site_id", "timestamp", "regime")


@query("time_slot", "", """
    SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS hour_of_day, hour(ts) * 4 + minute(ts) // 15 AS slot,
           strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%H:%M') AS label FROM events""", "hour_of_day")
def time_slot(spark, folder):
    rows = D.table(spark, folder, "events").select(
        "event_id", K.fractional_hour("ts").alias("hour_of_day"), K.slot_of_day("ts").alias("slot"))
    return rows.withColumn("label", K.slot_label("slot"))


@query("month_key", "", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_key(spark, folder):
    return D.table(spark, folder, "orders").select("o_orderkey", K.month_key("o_orderdate").alias("month"))


@query("select_feature_columns", "", """
    SELECT 'hour' AS feature, 'numeric' AS kind, count(*) AS n_rows FROM events UNION ALL SELECT 'minute', 'numeric', count(*) FROM events
    UNION ALL SELECT 'day', 'numeric', count(*) FROM events UNION ALL SELECT 'site_id', 'categorical', count(*) FROM events""")
def select_feature_columns(spark, folder):
    rows = D.events(spark, folder).select("site_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"),
                                          F.dayofmonth("ts").alias("day"), F.month("ts").alias("month"), F.col("value").alias("power"))
    chosen = learn.feature_columns(rows)
    names = [(c, kind) for kind, columns in chosen.items() for c in columns]
    wide = rows.agg(*[F.count(c).alias(c) for c, _ in names])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.col(c).alias("n_rows")) for c, kind in names])))


@query("prepare_matrix", "panel", """
    SELECT site_id::VARCHAR AS x_site_id, timestamp, coalesce(temperature, -1e6) AS x_temperature, (temperature IS NULL)::INT::DOUBLE AS x_temperature__missing,
           coalesce(humidity, -1e6) AS x_humidity, (humidity IS NULL)::INT::DOUBLE AS x_humidity__missing FROM panel""",
       "x_temperature x_temperature__missing x_humidity x_humidity__missing")
def prepare_matrix(spark, folder):
    rows = D.panel(spark, folder).select("site_id", "timestamp", "temperature", "humidity")
    return learn.prepare_matrix(rows, learn.feature_columns(rows)).drop("site_id", "temperature", "humidity")


CHANNELS = sequences.CHANNELS
CHANNEL_SQL = """
    SELECT site_id, timestamp, coalesce(power, 0) AS ch_power, (power IS NOT NULL)::INT::DOUBLE AS ch_power_observed,
           sin(2 * pi() * (hour(timestamp) * 60 + minute(timestamp)) / 1440) AS ch_sin_hour,
           cos(2 * pi() * (hour(timestamp) * 60 + minute(timestamp)) / 1440) AS ch_cos_hour,
           sin(2 * pi() * dayofyear(timestamp) / 365.25) AS ch_sin_day_of_year, cos(2 * pi() * dayofyear(timestamp) / 365.25) AS ch_cos_day_of_year,
           coalesce(temperature, 0) AS ch_temperature, coalesce(humidity, 0) AS ch_humidity, coalesce(wind_speed, 0) AS ch_wind_speed,
           coalesce(sin(radians(wind_direction)), 0) AS ch_wind_dir_sin, coalesce(cos(radians(wind_direction)), 0) AS ch_wind_dir_cos,
           solar_elevation_deg AS ch_solar_elevation_deg, 90 - solar_elevation_deg AS ch_zenith_deg FROM panel"""


def channel_rows(spark, folder):
    """The panel with every column a channel is made of."""
    return C.add_wind(C.add_calendar(D.panel(spark, folder))).withColumn("zenith_deg", F.lit(90.0) - F.col("solar_elevation_deg"))


CHANNEL_DOUBLES = " ".join(f"ch_{c}" for c in CHANNELS)


@query("channel_matrix", "panel", CHANNEL_SQL, CHANNEL_DOUBLES)
def channel_matrix(spark, folder):
    return sequences.channel_matrix(channel_rows(spark, folder), CHANNELS)


_STD = ", ".join(
    f"(c.ch_{c} - s.m_{c}) / s.s_{c} AS ch_{c}" if c != "power_observed" else "c.ch_power_observed" for c in CHANNELS)
_STATS = ", ".join(
    f"avg(ch_{c}) AS m_{c}, greatest(stddev_pop(ch_{c}), 1e-6) AS s_{c}" for c in CHANNELS if c != "power_observed")
TRAIN_CHANNELS = f"(SELECT c.*, t.split FROM ({CHANNEL_SQL}) c JOIN timed t USING (site_id, timestamp))"


@query("standardize", "panel timed", f"""
    SELECT c.site_id, c.timestamp, {_STD} FROM {TRAIN_CHANNELS} c
    CROSS JOIN (SELECT {_STATS} FROM {TRAIN_CHANNELS} WHERE split = 'train') s""", CHANNEL_DOUBLES)
def standardize(spark, folder):
    timed = splits.chronological_split(channel_rows(spark, folder))
    scaler = sequences.channel_scaler(evaluate.train_rows(timed), CHANNELS)
    return sequences.standardized(timed, scaler, CHANNELS)


@query("residual", "p24", """
    SELECT site_id, timestamp, p24 - power AS error, abs(p24 - power) AS abs_error, (p24 - power) ** 2 AS squared_error
    FROM p24 WHERE p24 - power IS NOT NULL""", "error abs_error squared_error")
def residual(spark, folder):
    rows = baselines.predict_persistence(D.generation(spark, folder)).withColumn("error", signed_error())
    return rows.where(F.col("error").isNotNull()).select(
        "site_id", "timestamp", "error", F.abs("error").alias("abs_error"), (F.col("error") * F.col("error")).alias("squared_error"))


@query("clip_lower_bound", "p24", """
    SELECT site_id, timestamp, CASE WHEN p24 IS NOT NULL THEN greatest(0, p24 - 5.0) END AS lower_bound FROM p24""", "lower_bound")
def clip_lower_bound(spark, folder):
    rows = baselines.predict_persistence(D.generation(spark, folder)).withColumn("lower_bound", F.col("prediction") - 5.0)
    return rows.select("site_id", "timestamp", conformal.clipped_lower().alias("lower_bound"))


@query("direction_sign", "p24", """
    SELECT site_id, timestamp, CASE WHEN p24 - power > 0 THEN '+' ELSE '-' END AS direction FROM p24""")
def direction_sign(spark, folder):
    rows = baselines.predict_persistence(D.generation(spark, folder))
    return rows.select("site_id", "timestamp", explain.direction(signed_error()).alias("direction"))


ROLE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


@query("name_role_regex", "", r"""
    SELECT table_name, column_name, n_values, regexp_matches(column_name, '(time|timestamp|date|datetime|utc|local)', 'i') AS is_timestamp,
           regexp_matches(column_name, '(site|plant|station|system|asset|location|loc)_?(id|name|code)?', 'i') AS is_site,
           regexp_matches(column_name, '(power|generation|generated|energy|yield|output|production|pv)', 'i') AS is_target,
           regexp_matches(column_name, '(key|id|code|num)$', 'i') AS has_id_suffix, NULL::VARCHAR AS unit
    FROM (""" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, name AS column_name, n_values FROM (UNPIVOT (SELECT count(COLUMNS('(.*)')) AS '\\1' FROM {t}) ON COLUMNS(*) INTO NAME name VALUE n_values)"
        for t in ROLE_TABLES) + ")")
def name_role_regex(spark, folder):
    from ..operators.profiling import column_roles

    return reshape.union_all(*[column_roles(D.table(spark, folder, n), n) for n in ROLE_TABLES])


@query("round_null_safe", "gen", """
    SELECT site_id, timestamp, round(power, 2) AS power_2 FROM gen""", "power_2")
def round_null_safe(spark, folder):
    return D.generation(spark, folder).select("site_id", "timestamp", F.round("power", 2).alias("power_2"))


@query("string_predicates", "gen", """
    SELECT DISTINCT 'site_' || site_id AS label, 'persistence|mondrian|' || site_id AS cal_key, campus_id = 1 AS first_campus FROM gen""")
def string_predicates(spark, folder):
    label = F.concat_ws("_", F.lit("site"), F.col("site_id").cast("string"))
    cal = F.concat_ws("|", F.lit("persistence"), F.lit("mondrian"), F.col("site_id").cast("string"))
    campus = F.format_string("campus-%d", F.col("campus_id"))
    rows = D.generation(spark, folder).select("site_id", "campus_id").distinct()
    return rows.select(label.alias("label"), cal.alias("cal_key"),
                       (campus.startswith("campus-1") & (F.split(campus, "-")[1] == "1")).alias("first_campus"))


# ---------------------------------------------------------------- joins

PANEL_DOUBLES = "power solar_elevation_deg temperature apparent_temperature dew_point_temperature humidity wind_speed wind_direction"


@query("join_campus_weather", "panel", "SELECT * FROM panel", PANEL_DOUBLES)
def join_campus_weather(spark, folder):
    return join_weather(D.generation_daylit(spark, folder), D.weather(spark, folder))


@query("join_solar_lookup", "gen sites", f"""
    SELECT g.site_id, g.timestamp, s.solar_elevation_deg, coalesce(s.solar_elevation_deg > 0, false) AS is_daylight
    FROM gen g LEFT JOIN ({SUN_SQL}) s USING (site_id, timestamp)""", "solar_elevation_deg")
def join_solar_lookup(spark, folder):
    return _sunny(spark, folder).select("site_id", "timestamp", "solar_elevation_deg", "is_daylight")


DAY_LENGTH = """
    SELECT campus_id, date_trunc('day', timestamp)::TIMESTAMP AS date, count(DISTINCT timestamp) * 0.25 AS day_length_hours
    FROM day WHERE solar_elevation_deg > 0 GROUP BY 1, 2"""


@query("join_day_length", "day", f"""
    SELECT d.site_id, d.timestamp, l.day_length_hours::DOUBLE AS day_length_hours FROM day d
    LEFT JOIN ({DAY_LENGTH}) l ON l.campus_id = d.campus_id AND l.date = date_trunc('day', d.timestamp)""", "day_length_hours")
def join_day_length(spark, folder):
    df = D.generation_daylit(spark, folder)
    return sun.join_day_length(df, sun.day_length(df)).select("site_id", "timestamp", "day_length_hours")


@query("lag_lookup_join", "gen", """
    SELECT g.site_id, g.timestamp, h.power AS power_lag_4 FROM gen g
    LEFT JOIN gen h ON h.site_id = g.site_id AND h.timestamp = g.timestamp - INTERVAL 60 MINUTE""", "power_lag_4")
def lag_lookup_join(spark, folder):
    gen = D.generation(spark, folder)
    return lag_by_join(gen, gen, 4 * K.SLOT_US, "power_lag_4").select("site_id", "timestamp", "power_lag_4")


@query("persistence_lookup", "timed", """
    SELECT t.site_id, t.timestamp, h.power AS prediction FROM timed t
    LEFT JOIN gen h ON h.site_id = t.site_id AND h.timestamp = t.timestamp - INTERVAL 24 HOUR WHERE t.split = 'test'""", "prediction")
def persistence_lookup(spark, folder):
    gen = D.generation(spark, folder)
    test = splits.chronological_split(gen).where(F.col("split") == "test")
    return baselines.persistence_lookup(test, gen).select("site_id", "timestamp", "prediction")


@query("map_lookup_fallback", "timed sitemean allmean", """
    SELECT t.site_id, t.timestamp, coalesce(s.m, (SELECT m FROM allmean)) AS prediction FROM timed t LEFT JOIN sitemean s USING (site_id)""",
       "prediction")
def map_lookup_fallback(spark, folder):
    timed = splits.chronological_split(D.generation(spark, folder))
    return baselines.predict_site_mean(timed, evaluate.train_rows(timed)).select("site_id", "timestamp", "prediction")


ROLE_SQL = """
    SELECT site_id, CASE WHEN pos <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'test'
           WHEN pos <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) + greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS role
    FROM (SELECT site_id, row_number() OVER (ORDER BY md5('42|' || site_id)) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT site_id FROM gen))"""


@query("semi_join_sites", "gen", f"""
    SELECT * FROM gen WHERE site_id IN (SELECT site_id FROM ({ROLE_SQL}) WHERE role = 'train')""", "power")
def semi_join_sites(spark, folder):
    gen = D.generation(spark, folder)
    return reshape.keep_keys(gen, splits.site_roles(gen).where(F.col("role") == "train"), ["site_id"])


@query("anti_join_missing", "gen", """
    SELECT b.site_id, s.slot AS timestamp FROM (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM gen GROUP BY 1) b,
         LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 15 MINUTE)) AS slot) s
    WHERE NOT EXISTS (SELECT 1 FROM gen g WHERE g.site_id = b.site_id AND g.timestamp = s.slot)""")
def anti_join_missing(spark, folder):
    from ..operators.quality import missing_slots

    return missing_slots(D.generation(spark, folder), "site_id")


@query("anti_join_campuses", "gen sites", """
    SELECT campus_id, count(*) AS n FROM gen WHERE campus_id NOT IN (SELECT campus_id FROM sites WHERE capacity_kwp > 90) GROUP BY 1""")
def anti_join_campuses(spark, folder):
    coords = D.site_details(spark, folder).where(F.col("capacity_kwp") > 90)
    return sun.campus_without_coordinates(D.generation(spark, folder), coords).groupBy("campus_id").agg(F.count(F.lit(1)).alias("n"))


@query("full_outer_actual_pred", "p24", """
    SELECT coalesce(a.site_id, p.site_id) AS site_id, coalesce(a.day, p.day) AS day, a.actual, p.predicted
    FROM (SELECT site_id, date_trunc('day', timestamp)::TIMESTAMP AS day, avg(power) AS actual FROM p24 WHERE power IS NOT NULL GROUP BY 1, 2) a
    FULL JOIN (SELECT site_id, date_trunc('day', timestamp)::TIMESTAMP AS day, avg(p24) AS predicted FROM p24 WHERE p24 IS NOT NULL GROUP BY 1, 2) p
    ON a.site_id = p.site_id AND a.day = p.day""", "actual predicted")
def full_outer_actual_pred(spark, folder):
    rows = baselines.predict_persistence(D.generation(spark, folder)).withColumn("day", K.floor_day("timestamp"))
    actual = rows.where(F.col("power").isNotNull()).groupBy("site_id", "day").agg(F.avg("power").alias("actual"))
    predicted = rows.where(F.col("prediction").isNotNull()).groupBy("site_id", "day").agg(F.avg("prediction").alias("predicted"))
    return explore.daily_outer(actual, predicted, ["site_id", "day"])


@query("dim_lookup_capacity", "gen sites", """
    SELECT g.site_id, g.energy, s.capacity_kwp FROM (SELECT site_id, sum(power) AS energy FROM gen GROUP BY 1) g LEFT JOIN sites s USING (site_id)""",
       "energy capacity_kwp")
def dim_lookup_capacity(spark, folder):
    energy = D.generation(spark, folder).groupBy("site_id").agg(F.sum("power").alias("energy"))
    return energy.join(D.site_details(spark, folder).select("site_id", "capacity_kwp"), "site_id", "left")


def _zone_sql(zone: str, hours: int) -> str:
    """All rows fall in one daylight-saving regime, so a civil clock is a fixed offset."""
    sunny = SUN_SQL.replace("INTERVAL 10 HOUR", f"INTERVAL {hours} HOUR")
    return f"""
        SELECT '{zone}' AS zone, coalesce(avg(g.power) FILTER (WHERE s.solar_elevation_deg > 0), 0) AS day_mean_power,
               coalesce(avg(g.power) FILTER (WHERE NOT s.solar_elevation_deg > 0), 0) AS night_mean_power,
               avg(CASE WHEN g.power > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT s.solar_elevation_deg > 0) AS night_nonzero_fraction,
               0::BIGINT AS unplaced_rows FROM gen g JOIN ({sunny}) s USING (site_id, timestamp)"""


ZONES_SQL = f"""
    SELECT *, CASE WHEN night_mean_power > 0 THEN day_mean_power / night_mean_power END AS contrast_ratio
    FROM ({_zone_sql("Etc/GMT-10", 10)} UNION ALL {_zone_sql("Australia/Melbourne", 11)})"""


@query("cross_candidates", "gen sites", ZONES_SQL, "day_mean_power night_mean_power night_nonzero_fraction contrast_ratio")
def cross_candidates(spark, folder):
    coords = sun.campus_coordinates(D.site_details(spark, folder))
    return sun.score_zones(D.generation(spark, folder), coords)


@query("choose_timezone", "gen sites", f"""
    SELECT zone AS chosen_zone FROM ({ZONES_SQL}) ORDER BY round(night_nonzero_fraction, 4), unplaced_rows LIMIT 1""")
def choose_timezone(spark, folder):
    coords = sun.campus_coordinates(D.site_details(spark, folder))
    return sun.choose_zone(sun.score_zones(D.generation(spark, folder), coords))


MONTH_SLOTS = """
    SELECT e.month, e.expected_slots, coalesce(a.actual_slots, 0) AS actual_slots, 100.0 * (1 - coalesce(a.actual_slots, 0) / e.expected_slots::DOUBLE) AS missing_slot_pct
    FROM (SELECT strftime(s.slot, '%Y-%m') AS month, count(*) AS expected_slots
          FROM (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM gen GROUP BY 1) b,
               LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 15 MINUTE)) AS slot) s GROUP BY 1) e
    LEFT JOIN (SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS actual_slots FROM gen GROUP BY 1) a USING (month)"""


@query("ratio_join_months", "gen", MONTH_SLOTS, "missing_slot_pct")
def ratio_join_months(spark, folder):
    from ..operators.quality import missingness_timeline

    return missingness_timeline(D.generation(spark, folder))


# ---------------------------------------------------------------- sets and reshapes

@query("union_all", "gen wx", """
    SELECT campus_id, timestamp, site_id IS NOT NULL AS from_site, power, temperature FROM (
        SELECT campus_id, timestamp, site_id, power, NULL AS temperature FROM gen
        UNION ALL SELECT campus_id, timestamp, NULL, NULL, temperature FROM wx)""", "power temperature")
def union_all(spark, folder):
    both = reshape.union_all(D.generation(spark, folder), D.weather(spark, folder).select("campus_id", "timestamp", "temperature"))
    return both.select("campus_id", "timestamp", F.col("site_id").isNotNull().alias("from_site"), "power", "temperature")


@query("drop_exact_duplicates", "", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem",
       "l_quantity l_extendedprice l_discount l_tax")
def drop_exact_duplicates(spark, folder):
    return cleaning.drop_exact_duplicates(D.table(spark, folder, "lineitem"))


@query("set_difference", "gen sites", "SELECT site_id FROM sites EXCEPT SELECT site_id FROM gen")
def set_difference(spark, folder):
    return D.site_details(spark, folder).select("site_id").subtract(D.generation(spark, folder).select("site_id"))


@query("index_union", "gen wx", """
    SELECT campus_id, timestamp FROM gen UNION SELECT campus_id, timestamp FROM wx""")
def index_union(spark, folder):
    return reshape.index_union(D.generation(spark, folder), D.weather(spark, folder), ["campus_id", "timestamp"])


@query("unpivot_metrics", "board", """
    SELECT model, split, coalesce(site_id::VARCHAR, '') AS site_id, metric, value FROM (
        SELECT model, split, site_id, 'mae' AS metric, mae AS value FROM board UNION ALL SELECT model, split, site_id, 'rmse', rmse FROM board
        UNION ALL SELECT model, split, site_id, 'n_eval', n_eval::DOUBLE FROM board)""", "value")
def unpivot_metrics(spark, folder):
    board = site_text(evaluate.baseline_leaderboard(D.generation_daylit(spark, folder)))
    return reshape.unpivot(board, ["model", "split", "site_id"], ["mae", "rmse", "n_eval"])


@query("pivot_metrics", "board", """
    SELECT split, coalesce(site_id::VARCHAR, '') AS site_id, max(mae) FILTER (WHERE model = 'zero') AS zero,
           max(mae) FILTER (WHERE model = 'persistence_24h') AS persistence_24h FROM board GROUP BY 1, 2""", "zero persistence_24h")
def pivot_metrics(spark, folder):
    board = site_text(evaluate.baseline_leaderboard(D.generation_daylit(spark, folder)))
    return reshape.pivot(board, ["split", "site_id"], "model", "mae", ["zero", "persistence_24h"])
