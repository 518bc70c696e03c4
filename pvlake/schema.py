"""The canonical data model: raw layouts, names and plausibility rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: raw file names, raw column names and their canonical names
GENERATION_FILE = "Solar_Energy_Generation.csv"
WEATHER_FILE = "Weather_Data_reordered_all.csv"
SITE_DETAILS_FILE = "Solar_Site_Details.csv"

GENERATION_NAMES = {
    "SiteKey": "site_id",
    "CampusKey": "campus_id",
    "Timestamp": "timestamp",
    "SolarGeneration": "power",
}
WEATHER_NAMES = {
    "CampusKey": "campus_id",
    "Timestamp": "timestamp",
    "AirTemperature": "temperature",
    "ApparentTemperature": "apparent_temperature",
    "DewPointTemperature": "dew_point_temperature",
    "RelativeHumidity": "humidity",
    "WindSpeed": "wind_speed",
    "WindDirection": "wind_direction",
}
SITE_DETAILS_NAMES = {
    "SiteKey": "site_id",
    "CampusKey": "campus_id",
    "kWp": "capacity_kwp",
    "Number of panels": "n_panels",
    "Panel": "panel_model",
    "Inverter": "inverter",
    "Optimizers": "optimizers",
    "Metric": "metric_unit",
    "lat": "latitude",
    "Lon": "longitude",
}
REQUIRED = {
    GENERATION_FILE: list(GENERATION_NAMES),
    WEATHER_FILE: list(WEATHER_NAMES),
    SITE_DETAILS_FILE: ["SiteKey", "CampusKey", "kWp", "lat", "Lon"],
}
# weather variables in canonical order; the first five are filled over short gaps
WEATHER_VARIABLES = [
    "temperature", "apparent_temperature", "dew_point_temperature",
    "humidity", "wind_speed", "wind_direction", "pressure", "cloud_cover",
]
INTERPOLATED = WEATHER_VARIABLES[:5]
CARRIED_WEATHER = WEATHER_VARIABLES[:6]

KEY_COLUMNS = {"site_id", "campus_id"}
Rule = tuple[str, Callable[[Column], Column]]


def _outside(low: float, high: float) -> Callable[[Column], Column]:
    return lambda c: (c < low) | (c > high)


def _negative(c: Column) -> Column:
    return c < 0


# fixed values: physically impossible readings per canonical column
RULES: dict[str, Rule] = {
    "power": ("negative_power", _negative),
    "humidity": ("humidity_out_of_range", _outside(0, 100)),
    "wind_speed": ("negative_wind_speed", _negative),
    "wind_direction": ("wind_direction_out_of_range", _outside(0, 360)),
    "temperature": ("temperature_implausible", _outside(-30, 60)),
    "apparent_temperature": ("apparent_temperature_implausible", _outside(-30, 60)),
    "dew_point_temperature": ("dew_point_implausible", _outside(-30, 60)),
}


def text_schema(names: dict[str, str]) -> T.StructType:
    """Raw CSV layout: every field is read as text and typed by the cleaning rules."""
    return T.StructType([T.StructField(raw, T.StringType()) for raw in names])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({raw: new for raw, new in names.items() if raw in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: make it null once, at ingest, so every aggregate skips it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df


def available_weather(df: DataFrame) -> list[str]:
    """Known weather variables present in the frame, in canonical order."""
    return [c for c in WEATHER_VARIABLES if c in df.columns]
