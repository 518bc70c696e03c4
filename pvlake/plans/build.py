"""Raw tables to the processed table to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.calendar import add_calendar, add_wind
from ..functions.solar import DEFAULT_ZONE
from ..operators import cleaning, sun
from ..operators.joins import null_safe_join
from ..operators.time_features import add_time_features
from ..operators.weather import interpolate_short_gaps, join_weather
from ..session import cut_lineage
from ..sources.writers import add_partition_columns


def clean_table(raw: DataFrame, numeric: list[str], keys: list[str]) -> DataFrame:
    """Parse, type, drop exact duplicates, null impossible readings."""
    typed = cleaning.coerce_numeric(cleaning.parse_timestamps(raw), numeric)
    typed = cleaning.coerce_numeric(typed, keys, "long") if keys else typed
    return cleaning.null_impossible(cleaning.drop_exact_duplicates(typed))


def build_processed(generation: DataFrame, weather: DataFrame, sites: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Clean generation with sun position, daylight and gap-filled campus weather.

    Weather is filled at its own, much smaller grain before the join, so the limit
    counts time steps whatever the number of sites of a campus. The sun is placed at that grain too, once per campus
    and slot, and reaches the site rows in the same join.
    """
    gen = clean_table(generation, ["power"], ["site_id", "campus_id"])
    variables = [c for c in S.CARRIED_WEATHER if c in weather.columns]
    wx = clean_table(weather, variables, ["campus_id"])
    wx = interpolate_short_gaps(wx.where(F.col("timestamp").isNotNull()))
    gen = cut_lineage(gen)  # read for the slots of each campus and for the rows
    grid = sun.add_solar_position(gen.select("campus_id", "timestamp").distinct(), sun.campus_coordinates(sites), zone)
    return add_partition_columns(null_safe_join(gen, join_weather(grid, wx), ["campus_id", "timestamp"], "left"))


def build_features(processed: DataFrame, coords: DataFrame | None = None, zone: str = DEFAULT_ZONE, **options) -> DataFrame:
    """Every engineered column; the lag and rolling columns share one shuffle on (site, time chunk).

    Without coordinates the solar columns are left as they are in the input. With them,
    the two look-up tables (places, day lengths) are written to the checkpoint folder
    and broadcast if their counted size allows; larger ones are joined under salts.
    """
    out = processed
    if coords is not None:
        coords = cut_lineage(coords)
        lengths = sun.grid_day_length(processed, coords, zone)
        out = sun.join_day_length(sun.add_solar_position(out, coords, zone), lengths)
    # joins come first, on narrow rows: after the windows the wide rows are never shuffled again
    return add_wind(add_calendar(add_time_features(out, **options)))


def feature_missing(features: DataFrame, columns: list[str]) -> DataFrame:
    from ..operators.quality import missing_by_variable

    return missing_by_variable(features.select(*columns))
