"""Exploratory and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore, splits
from ..operators.topk import top_per_group
from ..plans import evaluate
from ..sources import driver_tables as D
from .registry import query


@query("site_monthly_energy", "", """
    WITH obs AS (SELECT o_custkey // 50 + 1 AS site_id, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) / 997.0 * 0.25 AS kwh FROM orders GROUP BY 1, 2)
    SELECT s.site_id, s.site_id // 4 + 1 AS campus_id, m.month, o.kwh AS monthly_kwh FROM (SELECT DISTINCT site_id FROM obs) s
    CROSS JOIN (SELECT DISTINCT month FROM obs) m LEFT JOIN obs o ON o.site_id = s.site_id AND o.month = m.month""", "monthly_kwh")
def site_monthly_energy(spark, folder):
    rows, sites = order_series(spark, folder)
    return explore.site_monthly_energy(rows, sites)


def order_series(spark, folder):
    """Orders as a many-year series: fifty customers make a site, prices make power."""
    site = (F.floor(F.col("o_custkey") / 50) + 1).cast("long")
    rows = D.table(spark, folder, "orders").select(
        site.alias("site_id"), F.col("o_orderdate").alias("timestamp"), (F.col("o_totalprice") / 997.0).alias("power"))
    sites = rows.select("site_id").distinct().withColumn("campus_id", (F.floor(F.col("site_id") / 4) + 1).cast("long"))
    return rows, sites


@query("campus_monthly_mean", "", """
    WITH obs AS (SELECT o_custkey // 50 + 1 AS site_id, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) / 997.0 * 0.25 AS kwh FROM orders GROUP BY 1, 2)
    SELECT c.campus_id, n.n_sites, c.month, c.s / n.n_sites AS monthly_kwh_mean FROM (
        SELECT k.campus_id, m.month, sum(o.kwh) AS s FROM (SELECT DISTINCT site_id // 4 + 1 AS campus_id FROM obs) k
        CROSS JOIN (SELECT DISTINCT month FROM obs) m LEFT JOIN obs o ON o.site_id // 4 + 1 = k.campus_id AND o.month = m.month GROUP BY 1, 2) c
    JOIN (SELECT site_id // 4 + 1 AS campus_id, count(DISTINCT site_id) AS n_sites FROM obs GROUP BY 1) n USING (campus_id)""", "monthly_kwh_mean")
def campus_monthly_mean(spark, folder):
    return explore.campus_monthly_mean(explore.site_monthly_energy(*order_series(spark, folder)))


@query("hour_of_day_profile", "day", """
    SELECT CASE WHEN grouping(campus_id) = 1 THEN 'ALL' ELSE campus_id::VARCHAR END AS campus, slot,
           printf('%02d:%02d', (slot // 4)::INT, (slot % 4 * 15)::INT) AS label, avg(power) AS mean_power
    FROM (SELECT campus_id, hour(timestamp) * 4 + minute(timestamp) // 15 AS slot, power FROM day WHERE is_daylight AND power IS NOT NULL)
    GROUP BY GROUPING SETS ((slot), (campus_id, slot))""", "mean_power")
def hour_of_day_profile(spark, folder):
    return explore.hour_of_day_profile(D.generation_daylit(spark, folder))


@query("time_of_day_means", "gen", """
    SELECT campus_id, hour(timestamp) + minute(timestamp) / 60.0::DOUBLE AS hour_of_day, avg(power) AS mean_power FROM gen GROUP BY 1, 2""",
       "hour_of_day mean_power")
def time_of_day_means(spark, folder):
    return explore.time_of_day_means(D.generation(spark, folder))


@query("peak_time_of_day", "gen", """
    SELECT h AS peak_hour, m AS peak_power FROM (SELECT hour(timestamp) + minute(timestamp) / 60.0::DOUBLE AS h, avg(power) AS m FROM gen GROUP BY 1)
    WHERE m IS NOT NULL ORDER BY m DESC, h LIMIT 1""", "peak_hour peak_power")
def peak_time_of_day(spark, folder):
    return explore.peak_time_of_day(D.generation(spark, folder))


CAMPUS_VARS = ["temperature", "humidity"]
MATRIX_VARS = ["power", "solar_elevation_deg", "temperature", "apparent_temperature", "dew_point_temperature", "humidity", "wind_speed"]


@query("corr_by_campus", "panel", " UNION ALL ".join(
    f"SELECT campus_id, '{v}' AS variable, corr(power, {v}) AS r FROM panel WHERE is_daylight AND power IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL GROUP BY 1"
    for v in CAMPUS_VARS), "r")
def corr_by_campus(spark, folder):
    return explore.corr_by_campus(D.panel(spark, folder), CAMPUS_VARS)


@query("corr_matrix", "panel", " UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, corr({a}, {b}) AS r FROM panel" for a in MATRIX_VARS for b in MATRIX_VARS), "r")
def corr_matrix(spark, folder):
    return explore.corr_matrix(D.panel(spark, folder), MATRIX_VARS)


@query("corr_within_site", "panel", " UNION ALL ".join(
    f"SELECT '{v}' AS variable, avg(r) AS mean_r FROM (SELECT site_id, corr(power, {v}) AS r FROM panel WHERE is_daylight AND power IS NOT NULL GROUP BY 1) WHERE NOT isnan(r)"
    for v in MATRIX_VARS[1:]), "mean_r")
def corr_within_site(spark, folder):
    return explore.corr_within_site(D.panel(spark, folder), MATRIX_VARS[1:])


def test_predictions(spark, folder):
    df = evaluate.baseline_predictions(D.generation_daylit(spark, folder))
    return df.where((F.col("split") == "test") & F.col("model").isin("persistence_24h", "mean_site"))


TEST = "(SELECT * FROM scored WHERE split = 'test' AND model IN ('persistence_24h', 'mean_site'))"


@query("hourly_overlay", "scored", f"""
    WITH o AS (SELECT model, date_trunc('hour', timestamp) AS hour_ts, avg(power) AS actual, avg(prediction) AS predicted FROM {TEST} GROUP BY 1, 2),
    h AS (SELECT model, unnest(generate_series(min(hour_ts), max(hour_ts), INTERVAL 1 HOUR)) AS hour_ts FROM o GROUP BY 1)
    SELECT h.model, h.hour_ts, o.actual, o.predicted FROM h LEFT JOIN o USING (model, hour_ts)""", "actual predicted")
def hourly_overlay(spark, folder):
    return explore.hourly_overlay(test_predictions(spark, folder), ["model"])


@query("daily_by_site", "scored", f"""
    SELECT model, site_id, date_trunc('day', timestamp)::TIMESTAMP AS day, avg(power) AS actual, avg(prediction) AS predicted FROM {TEST} GROUP BY 1, 2, 3""",
       "actual predicted")
def daily_by_site(spark, folder):
    return explore.daily_by_site(test_predictions(spark, folder), ["model"])


@query("residual_histogram", "scored", f"""
    SELECT model, bin, count(*) AS n, bin * 0.5::DOUBLE - 10.0 AS left_edge FROM (
        SELECT model, least(floor((prediction - power + 10) / 0.5)::BIGINT, 39) AS bin FROM {TEST} WHERE prediction - power BETWEEN -10 AND 10) GROUP BY 1, 2""",
       "left_edge")
def residual_histogram(spark, folder):
    return explore.residual_histogram(test_predictions(spark, folder), ["model"])


@query("scatter_sample", "scored", f"""
    SELECT model, site_id, timestamp, power, prediction FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5('0|' || site_id || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S')), site_id, timestamp) AS rn
        FROM {TEST} WHERE power IS NOT NULL) WHERE rn <= 2000 AND prediction IS NOT NULL""", "power prediction")
def scatter_sample(spark, folder):
    rows = test_predictions(spark, folder).where(F.col("power").isNotNull())
    keyed = rows.withColumn("_d", splits.seeded_hash("site_id", "timestamp", seed=0))
    order = [F.col("_d"), F.col("site_id"), F.col("timestamp")]
    picked = top_per_group(keyed, ["model"], order, 2000, ["site_id", "timestamp"])
    return picked.where(F.col("prediction").isNotNull()).select("model", "site_id", "timestamp", "power", "prediction")


@query("power_describe", "day", """
    SELECT count(*) AS n, median(power) AS median_power, quantile_cont(power, 0.99) AS p99_power, avg(power) AS mean_power, max(power) AS max_power,
           avg((power < 1)::INT) AS share_below_1 FROM day WHERE is_daylight AND power IS NOT NULL""",
       "median_power p99_power mean_power max_power share_below_1")
def power_describe(spark, folder):
    return explore.power_describe(D.generation_daylit(spark, folder))


@query("twilight_share", "day", """
    SELECT count(*) AS n_night_observed, 100.0 * avg((hour(timestamp) BETWEEN 16 AND 21)::INT) AS twilight_pct FROM day WHERE NOT is_daylight AND power IS NOT NULL""",
       "twilight_pct")
def twilight_share(spark, folder):
    return explore.twilight_share(D.generation_daylit(spark, folder))


MONTHS = "SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice / 997.0) / 1000 AS energy_mwh FROM orders GROUP BY 1"


@query("monthly_energy", "", MONTHS, "energy_mwh")
def monthly_energy(spark, folder):
    return explore.monthly_energy(order_series(spark, folder)[0])


@query("monthly_energy_extrema", "", f"""
    SELECT max_by(month, energy_mwh) AS best_month, min_by(month, energy_mwh) AS worst_month, max(energy_mwh) AS best_mwh, min(energy_mwh) AS worst_mwh FROM ({MONTHS})""",
       "best_mwh worst_mwh")
def monthly_energy_extrema(spark, folder):
    return explore.monthly_energy_extrema(order_series(spark, folder)[0])


@query("seasonality", "", "SELECT month(o_orderdate) AS month, avg(o_totalprice / 997.0) AS mean_power FROM orders GROUP BY 1", "mean_power")
def seasonality(spark, folder):
    return explore.seasonality(order_series(spark, folder)[0])


@query("site_mean_rank", "day sites", """
    SELECT d.*, s.capacity_kwp FROM (SELECT site_id, avg(power) AS mean_power, count(*) AS n FROM day WHERE is_daylight AND power IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC LIMIT 5) d LEFT JOIN sites s USING (site_id)""", "mean_power capacity_kwp")
def site_mean_rank(spark, folder):
    return explore.site_means_ranked(D.generation_daylit(spark, folder), D.site_details(spark, folder), 5)


@query("daily_energy_site", "day", """
    SELECT site_id, date_trunc('day', timestamp)::TIMESTAMP AS day, sum(power) AS energy FROM day WHERE power IS NOT NULL AND site_id = (
        SELECT site_id FROM day WHERE is_daylight AND power IS NOT NULL GROUP BY 1 ORDER BY avg(power) DESC, site_id LIMIT 1) GROUP BY 1, 2""", "energy")
def daily_energy_site(spark, folder):
    return explore.daily_energy_top_site(D.generation_daylit(spark, folder))
