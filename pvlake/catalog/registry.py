"""Named queries and the ANSI SQL that states the same result.

The SQL is written from the definition of each operator, not from the Spark plan,
so both sides check each other.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("scans", "columns", "quality", "features", "evaluation", "exploration", "learning")

# Shared definitions: name -> (names it builds on, text)
CTES: dict[str, tuple[str, str]] = {
    "gen": ("", """
        SELECT user_id // 20 + 1 AS site_id, (user_id // 20) // 4 + 1 AS campus_id,
               time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp,
               sum(value) FILTER (WHERE event_type <> 'error') / 9.973 AS power
        FROM events GROUP BY ALL"""),
    "wx": ("", """
        SELECT (user_id // 20) // 4 + 1 AS campus_id, time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp,
               avg(value) FILTER (WHERE event_type = 'click') / 3.989 AS temperature,
               avg(value) FILTER (WHERE event_type = 'purchase') / 4.013 AS apparent_temperature,
               avg(value) FILTER (WHERE event_type = 'error') / 5.003 AS dew_point_temperature,
               avg(value) FILTER (WHERE event_type = 'view') / 0.997 AS humidity,
               avg(value) FILTER (WHERE event_type = 'signup') / 10.007 AS wind_speed,
               ((max(event_id) * 37) % 400)::DOUBLE AS wind_direction
        FROM events GROUP BY ALL"""),
    "sites": ("", """
        SELECT s_suppkey + 1 AS site_id, s_suppkey // 4 + 1 AS campus_id,
               CASE WHEN s_acctbal > 0 THEN s_acctbal / 99.7 END AS capacity_kwp,
               -30.0::DOUBLE - ((s_suppkey // 4 + 1) % 13) * 0.7::DOUBLE - s_nationkey * 0.001::DOUBLE AS latitude,
               140.0::DOUBLE + ((s_suppkey // 4 + 1) % 11) * 0.9::DOUBLE + s_nationkey * 0.001::DOUBLE AS longitude
        FROM supplier"""),
    "day": ("gen", """
        SELECT *, sin((hour(timestamp) * 60 + minute(timestamp) + 7.5 - 360.0) * (3.141592653589793::DOUBLE / 720.0)) * 60.0 AS solar_elevation_deg,
               hour(timestamp) BETWEEN 6 AND 17 AS is_daylight
        FROM gen"""),
    "panel": ("day wx", """
        SELECT d.*, w.temperature, w.apparent_temperature, w.dew_point_temperature, w.humidity, w.wind_speed, w.wind_direction
        FROM day d LEFT JOIN wx w USING (campus_id, timestamp)"""),
    "timed": ("day", """
        SELECT * EXCLUDE (pos, n), CASE WHEN pos <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
               WHEN pos <= round_even(n * (0.7::DOUBLE + 0.15::DOUBLE), 0) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS pos,
                     count(*) OVER (PARTITION BY site_id) AS n FROM day)"""),
    "p24": ("timed", """
        SELECT t.*, h.power AS p24 FROM timed t
        LEFT JOIN gen h ON h.site_id = t.site_id AND h.timestamp = t.timestamp - INTERVAL 24 HOUR"""),
    "sitemean": ("timed", "SELECT site_id, avg(power) AS m FROM timed WHERE split = 'train' GROUP BY 1"),
    "allmean": ("timed", "SELECT avg(power) AS m FROM timed WHERE split = 'train'"),
    "scored": ("p24 sitemean allmean", """
        SELECT p.*, k.model, CASE k.model WHEN 'zero' THEN 0.0 WHEN 'mean_global' THEN (SELECT m FROM allmean)
               WHEN 'mean_site' THEN coalesce(s.m, (SELECT m FROM allmean)) ELSE p.p24 END AS prediction
        FROM p24 p LEFT JOIN sitemean s USING (site_id)
        CROSS JOIN (VALUES ('zero'), ('mean_global'), ('mean_site'), ('persistence_24h')) k(model)"""),
    "ranges": ("timed", """
        SELECT CASE WHEN grouping(site_id) = 1 THEN 'ALL' ELSE 'SITE' END AS scope, site_id,
               nullif(max(power) - min(power), 0) AS denominator
        FROM timed WHERE split = 'train' AND power IS NOT NULL GROUP BY GROUPING SETS ((), (site_id))"""),
}


def metric_sql(source: str, by: str, denominator: str) -> str:
    """Grouping-sets metrics over ``source(by…, site_id, power, is_daylight, prediction)``."""
    return f"""
        SELECT {by}, scope, site_id, n_eval, n_missing, mae, rmse, CASE WHEN sst > 0 THEN 1 - sse / sst END AS r2,
               rmse / den AS nrmse, daylight_n, daylight_mae, drmse / den AS daylight_nrmse
        FROM (SELECT g.*, {denominator} AS den FROM (
            SELECT {by}, CASE WHEN grouping(site_id) = 1 THEN 'ALL' ELSE 'SITE' END AS scope, site_id,
                   count(prediction - power) AS n_eval, count(*) - count(prediction - power) AS n_missing,
                   avg(abs(prediction - power)) AS mae, sqrt(avg((prediction - power) ** 2)) AS rmse,
                   sum((prediction - power) ** 2) AS sse,
                   var_pop(power) FILTER (WHERE prediction IS NOT NULL) * count(prediction - power) AS sst,
                   count(prediction - power) FILTER (WHERE is_daylight) AS daylight_n,
                   avg(abs(prediction - power)) FILTER (WHERE is_daylight) AS daylight_mae,
                   sqrt(avg((prediction - power) ** 2) FILTER (WHERE is_daylight)) AS drmse
            FROM {source} GROUP BY GROUPING SETS (({by}), ({by}, site_id))) g)"""


OWN_RANGE = ("(SELECT r.denominator FROM ranges r WHERE r.scope = g.scope "
             "AND (g.scope = 'ALL' OR r.site_id = g.site_id))")
POOLED_RANGE = "(SELECT denominator FROM {ranges} WHERE scope = 'ALL')"
METRIC_DOUBLES = "mae rmse r2 nrmse daylight_mae daylight_nrmse"

CTES["board"] = ("scored ranges", metric_sql("(SELECT * FROM scored WHERE split IN ('val', 'test'))", "model, split", OWN_RANGE))


def with_ctes(names: str, body: str, doubles: str = "") -> str:
    """A full statement: the needed definitions, the body, doubles rounded like the Spark side."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in CTES[name][0].split():
            visit(parent)
        order.append(name)

    for name in names.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    rounded = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
    outer = f"SELECT * REPLACE ({rounded}) FROM ({body})" if rounded else body
    return (f"WITH {head}\n" if head else "") + outer


def query(name: str, ctes: str = "", sql: str | None = None, doubles: str = ""):
    """Register a query; results are rounded and whole numbers widened for comparison."""
    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: tidy(function(spark, folder))
        if sql is not None:
            SQL[name] = with_ctes(ctes, sql, doubles)
        return function

    return register


def tidy(df: DataFrame) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            # adding zero turns -0.0 into 0.0
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            c = c.cast("long")
        columns.append(c.alias(name))
    return df.select(*columns)


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint folder, for queries about sinks."""
    return f"{checkpoint_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
