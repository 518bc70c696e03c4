"""Quality checks, cleaning log and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, profiling, quality, reshape, sun
from ..sources import driver_tables as D
from .registry import query


@query("duplicate_keys", "", """
    SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_key_rows, count(DISTINCT l_suppkey) AS affected_groups
    FROM (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 1""")
def duplicate_keys(spark, folder):
    return quality.duplicate_keys(D.table(spark, folder, "lineitem"), ["l_suppkey", "l_shipdate"], "l_suppkey")


GAPS = """
    SELECT b.site_id, count(*) AS expected_slots, any_value(b.n) AS actual_rows, count(*) - count(g.site_id) AS missing_slots,
           100.0 * (count(*) - count(g.site_id)) / count(*) AS missing_pct
    FROM (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi, count(DISTINCT timestamp) AS n FROM gen GROUP BY 1) b,
         LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 15 MINUTE)) AS slot) s
    LEFT JOIN gen g ON g.site_id = b.site_id AND g.timestamp = s.slot GROUP BY 1"""


@query("gap_report", "gen", GAPS, "missing_pct")
def gap_report(spark, folder):
    return quality.gap_report(D.generation(spark, folder), "site_id")


@query("worst_groups", "gen", f"SELECT * FROM ({GAPS}) ORDER BY missing_pct DESC, site_id LIMIT 10", "missing_pct")
def worst_groups(spark, folder):
    return quality.gap_report(D.generation(spark, folder), "site_id").orderBy(F.col("missing_pct").desc(), "site_id").limit(10)


WX_COLUMNS = ["temperature", "apparent_temperature", "dew_point_temperature", "humidity", "wind_speed", "wind_direction"]
PANEL_COLUMNS = ["power", *WX_COLUMNS]


def _null_union(columns, keys, source, group):
    key = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {key}'{c}' AS variable, 100.0 * avg(({c} IS NULL)::INT) AS missing_pct FROM {source} {group}" for c in columns)


@query("missing_by_variable", "panel", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, 100.0 * avg(({c} IS NULL)::INT) AS missing_pct FROM panel"
    for c in PANEL_COLUMNS), "missing_pct")
def missing_by_variable(spark, folder):
    return quality.missing_by_variable(D.panel(spark, folder).select(*PANEL_COLUMNS))


@query("missing_by_group", "panel", """
    SELECT site_id, 100.0 * avg((power IS NULL)::INT) AS power_pct, 100.0 * avg((humidity IS NULL)::INT) AS humidity_pct FROM panel
    GROUP BY 1 HAVING power_pct > 0 OR humidity_pct > 0""", "power_pct humidity_pct")
def missing_by_group(spark, folder):
    return quality.missing_by_group(D.panel(spark, folder), "site_id", ["power", "humidity"])


@query("missing_by_month", "panel", f"""
    SELECT * FROM ({_null_union(PANEL_COLUMNS, "strftime(timestamp, '%Y-%m') AS month", "panel", "GROUP BY 1")}) WHERE missing_pct > 0""", "missing_pct")
def missing_by_month(spark, folder):
    return quality.missing_by_month(D.panel(spark, folder), PANEL_COLUMNS)


RULES = [("humidity_out_of_range", "humidity", "humidity < 0 OR humidity > 100"), ("negative_wind_speed", "wind_speed", "wind_speed < 0"),
         ("wind_direction_out_of_range", "wind_direction", "wind_direction < 0 OR wind_direction > 360"),
         ("temperature_implausible", "temperature", "temperature < -30 OR temperature > 60"),
         ("apparent_temperature_implausible", "apparent_temperature", "apparent_temperature < -30 OR apparent_temperature > 60"),
         ("dew_point_implausible", "dew_point_temperature", "dew_point_temperature < -30 OR dew_point_temperature > 60")]


@query("impossible_values", "wx", " UNION ALL ".join(
    f"SELECT '{r}' AS rule, '{c}' AS column_name, count(*) AS n, min({c}) AS min_value, max({c}) AS max_value FROM wx WHERE {p} HAVING count(*) > 0"
    for r, c, p in RULES), "min_value max_value")
def impossible_values(spark, folder):
    return quality.impossible_values(D.weather(spark, folder))


@query("campus_coordinates", "sites", """
    SELECT campus_id, median(latitude) AS latitude, median(longitude) AS longitude FROM sites GROUP BY 1""", "latitude longitude")
def campus_coordinates(spark, folder):
    return sun.campus_coordinates(D.site_details(spark, folder))


@query("iqr_outliers", "day sites", """
    SELECT d.site_id, q.q1, q.q3, q.upper_fence, count(*) AS n_daylight, count(*) FILTER (WHERE d.power > q.upper_fence) AS n_outliers,
           max(d.power) AS max_power, any_value(s.capacity_kwp) AS capacity_kwp
    FROM day d JOIN (SELECT site_id, quantile_cont(power, 0.25) AS q1, quantile_cont(power, 0.75) AS q3, q3 + 3 * (q3 - q1) AS upper_fence
                     FROM day WHERE is_daylight AND power IS NOT NULL GROUP BY 1) q USING (site_id)
    LEFT JOIN sites s ON s.site_id = d.site_id WHERE d.is_daylight AND d.power IS NOT NULL GROUP BY 1, 2, 3, 4""",
       "q1 q3 upper_fence max_power capacity_kwp")
def iqr_outliers(spark, folder):
    return quality.iqr_outliers(D.generation_daylit(spark, folder), D.site_details(spark, folder))


@query("day_length", "day", """
    SELECT campus_id, date_trunc('day', timestamp)::TIMESTAMP AS date, (count(DISTINCT timestamp) * 0.25)::DOUBLE AS day_length_hours
    FROM day WHERE is_daylight GROUP BY 1, 2""", "day_length_hours")
def day_length(spark, folder):
    return sun.day_length(D.generation_daylit(spark, folder))


EXPECTED = "(date_diff('minute', min(timestamp), max(timestamp)) // 15 + 1)"


@query("site_summary", "day sites", f"""
    SELECT d.*, s.campus_id, s.latitude, s.longitude, s.capacity_kwp FROM (
        SELECT site_id, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS n_rows, {EXPECTED} AS expected_slots,
               100.0 * count(*) / {EXPECTED} AS row_availability_pct, 100.0 * count(power) / count(*) AS power_observed_pct,
               avg(power) FILTER (WHERE is_daylight) AS mean_daylight_kwh, max(power) FILTER (WHERE is_daylight) AS max_daylight_kwh
        FROM day GROUP BY 1) d JOIN sites s USING (site_id)""",
       "row_availability_pct power_observed_pct mean_daylight_kwh max_daylight_kwh latitude longitude capacity_kwp")
def site_summary(spark, folder):
    return quality.site_summary(D.generation_daylit(spark, folder), D.site_details(spark, folder))


@query("availability", "day", f"""
    SELECT site_id, 100.0 * count(*) / {EXPECTED} AS row_availability_pct,
           100.0 * count(power) FILTER (WHERE is_daylight) / count(*) FILTER (WHERE is_daylight) AS daylight_power_obs_pct
    FROM day GROUP BY 1""", "row_availability_pct daylight_power_obs_pct")
def availability(spark, folder):
    return quality.availability(D.generation_daylit(spark, folder))


@query("histogram_fixed", "day", """
    SELECT CASE WHEN grouping(site_id) = 1 THEN 'ALL' ELSE 'SITE' END AS scope, coalesce(site_id::VARCHAR, '') AS site_id, bin, count(*) AS n,
           printf('%.1f-%.1f', bin * 0.5, bin * 0.5 + 0.5) AS label
    FROM (SELECT site_id, least(floor(power / 0.5)::BIGINT, 19) AS bin FROM day WHERE is_daylight AND power BETWEEN 0 AND 10)
    GROUP BY GROUPING SETS ((site_id, bin), (bin))""")
def histogram_fixed(spark, folder):
    from .columns import site_text

    return site_text(quality.power_histogram(D.generation_daylit(spark, folder)))


@query("missingness_timeline", "gen", """
    SELECT month, missing_slot_pct FROM (
        SELECT e.month, 100.0 * (1 - coalesce(a.n, 0) / e.n::DOUBLE) AS missing_slot_pct FROM (
            SELECT strftime(s.slot, '%Y-%m') AS month, count(*) AS n
            FROM (SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM gen GROUP BY 1) b,
                 LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 15 MINUTE)) AS slot) s GROUP BY 1) e
        LEFT JOIN (SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS n FROM gen GROUP BY 1) a USING (month))""", "missing_slot_pct")
def missingness_timeline(spark, folder):
    return quality.missingness_timeline(D.generation(spark, folder)).select("month", "missing_slot_pct")


DIRTY = """
    SELECT CASE WHEN event_id % 50 = 3 THEN 'not a time' ELSE strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') END AS timestamp,
           user_id // 20 + 1 AS site_id, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN '-1.5' ELSE '2.5' END AS power
    FROM events"""


def dirty_generation(spark, folder):
    """Raw text rows with unreadable times, non-numbers, negatives and exact duplicates."""
    e = D.events(spark, folder)
    ts = F.when(F.pmod(F.col("event_id"), F.lit(50)) == 3, F.lit("not a time")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    power = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "-1.5").otherwise("2.5")
    return e.select(ts.alias("timestamp"), "site_id", power.alias("power"))


CLEAN_LOG = f"""
    SELECT 'generation' AS dataset, operation, rows_affected::BIGINT AS rows_affected, detail FROM (
        SELECT 'coerce_unparsable_timestamps_to_null' AS operation, count(*) FILTER (WHERE timestamp = 'not a time') AS rows_affected, '' AS detail FROM ({DIRTY})
        UNION ALL SELECT 'coerce_numeric:power', count(*) FILTER (WHERE power = 'n/a'), '' FROM ({DIRTY})
        UNION ALL SELECT 'drop_exact_duplicate_rows', (SELECT count(*) FROM ({DIRTY})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DIRTY}))), ''
        UNION ALL SELECT 'null_impossible:negative_power', count(*), 'column=power' FROM (SELECT DISTINCT * FROM ({DIRTY})) WHERE power = '-1.5')
    WHERE rows_affected > 0"""


@query("cleaning_log", "", CLEAN_LOG)
def cleaning_log(spark, folder):
    return cleaning.cleaning_counts(dirty_generation(spark, folder), "generation", ["power"])


ROLLUP = f"""
    SELECT 'duplicate_keys' AS metric, 0.0 AS value UNION ALL SELECT 'impossible_rules_broken', 0.0
    UNION ALL SELECT 'missing_slots', sum(missing_slots)::DOUBLE FROM ({GAPS})
    UNION ALL SELECT 'missing_slot_pct', 100.0 * sum(missing_slots) / sum(expected_slots) FROM ({GAPS})
    UNION ALL SELECT 'groups_checked', count(*)::DOUBLE FROM ({GAPS})
    UNION ALL SELECT 'power_missing_pct', 100.0 * avg((power IS NULL)::INT) FROM gen
    UNION ALL SELECT 'weather_missing_pct:' || variable, missing_pct FROM ({_null_union(WX_COLUMNS, "", "wx", "")})
    UNION ALL SELECT 'cleaning_operations', count(*)::DOUBLE FROM ({CLEAN_LOG})
    UNION ALL SELECT 'cleaned_values', sum(rows_affected)::DOUBLE FROM ({CLEAN_LOG})"""


@query("data_quality_rollup", "gen wx", ROLLUP, "value")
def data_quality_rollup(spark, folder):
    log = cleaning.cleaning_counts(dirty_generation(spark, folder), "generation", ["power"])
    return quality.quality_rollup(D.generation(spark, folder), D.weather(spark, folder), log)


# ---------------------------------------------------------------- profiles

SITE_GAPS = """
    SELECT site_id, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY site_id ORDER BY timestamp) AS gap_us FROM gen"""


@query("within_group_diff", "", """
    SELECT user_id, gap_us, count(*) AS n FROM (
        SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap_us FROM events)
    WHERE gap_us IS NOT NULL GROUP BY 1, 2""")
def within_group_diff(spark, folder):
    return profiling.within_group_gaps(D.table(spark, folder, "events"), "user_id", "ts").select(
        "user_id", "gap_us", "n")


@query("sampling_frequency", "gen", f"""
    SELECT n_gaps, mode_us, min_us, max_us, median_us, mode_n / n_gaps::DOUBLE AS mode_share, 1 - mode_n / n_gaps::DOUBLE AS irregular_share
    FROM (SELECT count(*) AS n_gaps, min(gap_us) AS min_us, max(gap_us) AS max_us, median(gap_us)::DOUBLE AS median_us FROM ({SITE_GAPS}) WHERE gap_us IS NOT NULL),
         (SELECT gap_us AS mode_us, count(*) AS mode_n FROM ({SITE_GAPS}) WHERE gap_us IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""",
       "median_us mode_share irregular_share")
def sampling_frequency(spark, folder):
    return profiling.sampling_frequency(profiling.within_group_gaps(D.generation(spark, folder), "site_id"), "site_id")


@query("sampling_frequency_groups", "", """
    SELECT o_custkey, mode_us FROM (SELECT o_custkey, gap_us AS mode_us, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, gap_us) AS rn FROM (
        SELECT o_custkey, epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS gap_us FROM orders)
        WHERE gap_us IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def sampling_frequency_groups(spark, folder):
    return profiling.group_modes(profiling.within_group_gaps(D.table(spark, folder, "orders"), "o_custkey", "o_orderdate"), "o_custkey")


@query("quick_profile", "gen", f"""
    SELECT (SELECT count(*) FROM gen) AS n_rows, (SELECT count(DISTINCT site_id) FROM gen) AS n_sites, (SELECT count(DISTINCT campus_id) FROM gen) AS n_campuses,
           (SELECT min(timestamp) FROM gen) AS start_ts, (SELECT max(timestamp) FROM gen) AS end_ts,
           (SELECT 100.0 * avg((power IS NULL)::INT) FROM gen) AS target_missing_pct,
           (SELECT gap_us // 60000000 FROM ({SITE_GAPS}) WHERE gap_us IS NOT NULL GROUP BY gap_us ORDER BY count(*) DESC, gap_us LIMIT 1) AS cadence_minutes""",
       "target_missing_pct")
def quick_profile(spark, folder):
    return profiling.quick_profile(D.generation(spark, folder))


CAT_TABLES = {"orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"],
              "customer": ["c_mktsegment", "c_nationkey"]}


@query("categorical_summary", "", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n, (SELECT count(DISTINCT {c}) FROM {t}) AS n_unique FROM {t} GROUP BY {c}"
    for t, cs in CAT_TABLES.items() for c in cs))
def categorical_summary(spark, folder):
    parts = []
    for t in CAT_TABLES:
        parts.append(profiling.categorical_summary(D.table(spark, folder, t)).withColumn("table_name", F.lit(t)))
    return reshape.union_all(*parts)


@query("duplicate_summary", "", """
    SELECT (SELECT count(*) FROM lineitem) AS total_rows,
           (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS fully_duplicated_rows,
           (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1)) AS duplicated_key_rows""")
def duplicate_summary(spark, folder):
    return profiling.duplicate_summary(D.table(spark, folder, "lineitem"), "l_suppkey", "l_shipdate")


@query("target_candidates", "gen", """
    SELECT 'power' AS column_name, min(power) AS min_value, max(power) AS max_value, avg(power) AS mean_value,
           avg(CASE WHEN power = 0 THEN 1.0 ELSE 0.0 END) AS zero_fraction FROM gen""", "min_value max_value mean_value zero_fraction")
def target_candidates(spark, folder):
    return profiling.target_candidates(D.generation(spark, folder))


@query("timestamp_candidates", "", """
    SELECT 'ts' AS column_name, 1.0::DOUBLE AS parse_success_rate, false AS matched_by_name, min(ts) AS min_ts, max(ts) AS max_ts FROM events
    UNION ALL SELECT 'when_text', avg(CASE WHEN event_id % 50 = 3 THEN 0.0 ELSE 1.0 END), false,
           min(date_trunc('second', ts)) FILTER (WHERE event_id % 50 <> 3), max(date_trunc('second', ts)) FILTER (WHERE event_id % 50 <> 3) FROM events
    UNION ALL SELECT 'utc_seconds', NULL, true, NULL, NULL""",
       "parse_success_rate")
def timestamp_candidates(spark, folder):
    text = F.when(F.pmod(F.col("event_id"), F.lit(50)) == 3, F.lit("?")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = D.table(spark, folder, "events").withColumn("when_text", text).withColumn("utc_seconds", F.unix_seconds(F.col("ts").cast("timestamp")))
    return profiling.timestamp_candidates(rows)


def _id_sql():
    parts = []
    for c, named, suffix, is_float in (("o_orderkey", 0, 1, 0), ("o_custkey", 0, 1, 0), ("o_orderstatus", 0, 0, 0),
                                       ("o_orderdate", 0, 0, 0), ("o_orderpriority", 0, 0, 0)):
        parts.append(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, {bool(named)} AS matched_by_name, {bool(suffix)} AS matched_by_id_suffix FROM orders")
    found = " UNION ALL ".join(parts)
    return f"""
        SELECT *, plausible_id_column AND n_unique = max(n_unique) FILTER (WHERE plausible_id_column) OVER () AS is_finest FROM (
            SELECT *, n_unique > 1 AND n_unique <= greatest(1000, (SELECT count(*) // 2 FROM orders)) AND (matched_by_name OR matched_by_id_suffix) AS plausible_id_column
            FROM ({found}) WHERE matched_by_name OR n_unique <= 500)"""


@query("id_candidates", "", _id_sql())
def id_candidates(spark, folder):
    return profiling.id_candidates(D.table(spark, folder, "orders"))


@query("head_tail_5", "", """
    (SELECT 'head' AS part, event_id, ts FROM events ORDER BY ts, event_id LIMIT 5)
    UNION ALL (SELECT 'tail', event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)""")
def head_tail_5(spark, folder):
    return profiling.head_and_tail(D.table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"])
