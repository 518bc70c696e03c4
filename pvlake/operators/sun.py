"""Solar position, daylight, day length and the empirical choice of the civil clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import floor_day
from ..functions.solar import DEFAULT_ZONE, SLOT_HOURS, ZONE_CANDIDATES, add_sun_local, daylight
from .joins import join_small, null_safe_join
from .quantiles import exact_quantiles


def campus_coordinates(sites: DataFrame) -> DataFrame:
    """Median latitude and longitude per campus; campuses without any stay with null."""
    lat = exact_quantiles(sites, ["campus_id"], "latitude", {"latitude": 0.5}).drop("n")
    lon = exact_quantiles(sites, ["campus_id"], "longitude", {"longitude": 0.5}).drop("n")
    return null_safe_join(null_safe_join(sites.select("campus_id").distinct(), lat, ["campus_id"], "left"), lon, ["campus_id"], "left")


def add_solar_position(df: DataFrame, coords: DataFrame, zone: str = DEFAULT_ZONE, ts: str = "timestamp") -> DataFrame:
    """Elevation, azimuth, zenith and daylight per row from its campus coordinates.

    Rows of campuses without coordinates keep null positions and count as night.
    """
    placed = join_small(df, coords.select("campus_id", "latitude", "longitude"), ["campus_id"], "left")
    out = add_sun_local(placed, ts, "latitude", "longitude", zone).drop("latitude", "longitude")
    return out.withColumn("is_daylight", daylight())


def day_length(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hours of light per campus and civil date: lit grid slots times a quarter hour."""
    lit = df.where(F.col("solar_elevation_deg") > 0).select("campus_id", F.col(ts).alias("_ts")).distinct()
    return lit.groupBy("campus_id", floor_day("_ts").alias("date")).agg(
        (F.count(F.lit(1)) * SLOT_HOURS).alias("day_length_hours"))


def grid_day_length(df: DataFrame, coords: DataFrame, zone: str = DEFAULT_ZONE, ts: str = "timestamp") -> DataFrame:
    """Day length from the distinct campus times of ``df``: the sun is placed once per campus and slot."""
    grid = df.select("campus_id", ts).distinct()
    return day_length(add_solar_position(grid, coords, zone, ts), ts)


def join_day_length(df: DataFrame, lengths: DataFrame, ts: str = "timestamp") -> DataFrame:
    return join_small(df.withColumn("date", floor_day(ts)), lengths, ["campus_id", "date"], "left").drop("date")


def campus_without_coordinates(df: DataFrame, coords: DataFrame) -> DataFrame:
    known = coords.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return join_small(df, known.select("campus_id"), ["campus_id"], "left_anti")


def score_zones(gen: DataFrame, coords: DataFrame, zones=ZONE_CANDIDATES, ts: str = "timestamp") -> DataFrame:
    """How well each candidate clock separates day output from night output.

    Generation is scanned once: readings are summed per campus and slot, each candidate's sun is placed on those sums side by
    side, and one aggregate scores them all. The best has the least generation at night, then the fewest unplaceable rows.
    """
    cells = gen.groupBy("campus_id", ts).agg(
        F.sum("power").alias("_sum"), F.count("power").alias("_n"), F.count_if(F.col("power") > 0).alias("_positive"), F.count(F.lit(1)).alias("_rows"))
    placed = join_small(cells, coords.select("campus_id", "latitude", "longitude"), ["campus_id"], "left")
    for i, zone in enumerate(zones):
        held = placed.columns
        placed = add_sun_local(placed, ts, "latitude", "longitude", zone).select(*held, F.col("solar_elevation_deg").alias(f"_sun{i}"))
    aggregates = []
    for i in range(len(zones)):
        day = daylight(f"_sun{i}")
        aggregates += [F.sum(F.when(lit, F.col(c))).alias(f"{name}{i}") for lit, side in ((day, "day"), (~day, "night")) for c, name in (
            ("_sum", f"{side}_sum"), ("_n", f"{side}_n"), ("_positive", f"{side}_positive"), ("_rows", f"{side}_rows"))]
        aggregates.append(F.coalesce(F.sum(F.when(F.col(f"_sun{i}").isNull(), F.col("_rows"))), F.lit(0)).alias(f"unplaced{i}"))

    def mean(side: str, i: int) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{side}_sum{i}"), F.col(f"{side}_n{i}")), F.lit(0.0))

    scores = [F.struct(F.lit(zone).alias("zone"), mean("day", i).alias("day_mean_power"), mean("night", i).alias("night_mean_power"),
                       F.try_divide(F.col(f"night_positive{i}").cast("double"), F.col(f"night_rows{i}")).alias("night_nonzero_fraction"),
                       F.col(f"unplaced{i}").alias("unplaced_rows")) for i, zone in enumerate(zones)]
    return placed.agg(*aggregates).select(F.inline(F.array(*scores))).withColumn(
        "contrast_ratio",
        F.when(F.col("night_mean_power") > 0, F.col("day_mean_power") / F.col("night_mean_power")))


def choose_zone(scores: DataFrame) -> DataFrame:
    ranking = F.struct(F.round("night_nonzero_fraction", 4), F.col("unplaced_rows"))
    return scores.agg(F.min_by("zone", ranking).alias("chosen_zone"))
