"""The canonical model derived from the tables in the test-data folders.

Everything is computed from whole tables and grows with them: twenty consecutive
users of ``events`` act as one site, four sites share a campus, and every supplier
is a row of the site dimension. The divisors turn values into plausible units;
being primes over powers of ten they keep averages off decimal ties, so rounded
results agree across engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import floor_slot

USERS_PER_SITE = 20
SITES_PER_CAMPUS = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("long")


def _site_and_campus(site_index: Column) -> list[Column]:
    return [(site_index + 1).alias("site_id"), (_div(site_index, SITES_PER_CAMPUS) + 1).alias("campus_id")]


def events(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event with its site, campus and 15-minute slot."""
    raw = table(spark, folder, "events")
    return raw.select(
        *_site_and_campus(_div(F.col("user_id"), USERS_PER_SITE)),
        floor_slot("ts").alias("timestamp"),
        "event_id", "event_type", "value", "ts",
    )


def _of(kind: str) -> Column:
    return F.when(F.col("event_type") == kind, F.col("value"))


def generation(spark: SparkSession, folder: str) -> DataFrame:
    """``site_id, campus_id, timestamp, power``: unique keys; power is null when only errors came in."""
    good = F.when(F.col("event_type") != "error", F.col("value"))
    return (
        events(spark, folder)
        .groupBy("site_id", "campus_id", "timestamp")
        .agg((F.sum(good) / 9.973).alias("power"))
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """``campus_id, timestamp`` and six variables with gaps and impossible readings."""
    return (
        events(spark, folder)
        .groupBy("campus_id", "timestamp")
        .agg(
            (F.avg(_of("click")) / 3.989).alias("temperature"),
            (F.avg(_of("purchase")) / 4.013).alias("apparent_temperature"),
            (F.avg(_of("error")) / 5.003).alias("dew_point_temperature"),
            (F.avg(_of("view")) / 0.997).alias("humidity"),
            (F.avg(_of("signup")) / 10.007).alias("wind_speed"),
            F.pmod(F.max("event_id") * 37, F.lit(400)).cast("double").alias("wind_direction"),
        )
    )


def site_details(spark: SparkSession, folder: str) -> DataFrame:
    """``site_id, campus_id, capacity_kwp, latitude, longitude`` for every supplier."""
    s = table(spark, folder, "supplier")
    campus = _div(F.col("s_suppkey"), SITES_PER_CAMPUS) + 1
    nation = F.col("s_nationkey").cast("double")
    return s.select(
        *_site_and_campus(F.col("s_suppkey")),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 99.7).alias("capacity_kwp"),
        (F.lit(-30.0) - F.pmod(campus, F.lit(13)) * 0.7 - nation * 0.001).alias("latitude"),
        (F.lit(140.0) + F.pmod(campus, F.lit(11)) * 0.9 + nation * 0.001).alias("longitude"),
    )


def mock_elevation(ts: str = "timestamp") -> Column:
    """A half sine over the day that any SQL engine evaluates alike; the real geometry is tested apart."""
    middle_of_slot = F.hour(ts) * 60 + F.minute(ts) + F.lit(7.5)
    return F.sin((middle_of_slot - 360.0) * F.lit(3.141592653589793 / 720.0)) * 60.0


def daylit(df: DataFrame) -> DataFrame:
    elevation = df.withColumn("solar_elevation_deg", mock_elevation())
    return elevation.withColumn("is_daylight", F.col("solar_elevation_deg") > 0)


def generation_daylit(spark: SparkSession, folder: str) -> DataFrame:
    return daylit(generation(spark, folder))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Generation with daylight and its campus weather at the same slot."""
    return generation_daylit(spark, folder).join(weather(spark, folder), ["campus_id", "timestamp"], "left")
