"""Calendar, season, cyclical and wind encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clock import col

# fixed values: southern-hemisphere meteorological seasons by calendar month
SEASONS = {
    "summer": (12, 1, 2),
    "autumn": (3, 4, 5),
    "winter": (6, 7, 8),
    "spring": (9, 10, 11),
}
DAYS_PER_YEAR = 365.25
MINUTES_PER_DAY = 1440


def season(month: Column | str) -> Column:
    month = col(month)
    expr = None
    for name, months in SEASONS.items():
        hit = month.isin(*months)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """Whole-number calendar parts; Monday is day 0, weeks are ISO weeks."""
    ts = col(ts)
    return {
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.weekday(ts),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "is_weekend": F.weekday(ts) >= 5,
    }


def cyclical_columns(ts: Column | str) -> dict[str, Column]:
    ts = col(ts)
    day_angle = (F.hour(ts) * 60 + F.minute(ts)) * F.lit(2.0 * math.pi / MINUTES_PER_DAY)
    year_angle = F.dayofyear(ts) * F.lit(2.0 * math.pi / DAYS_PER_YEAR)
    return {
        "sin_hour": F.sin(day_angle),
        "cos_hour": F.cos(day_angle),
        "sin_day_of_year": F.sin(year_angle),
        "cos_day_of_year": F.cos(year_angle),
    }


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """All time-only features in one projection."""
    return df.withColumns({**calendar_columns(ts), "season": season(F.month(ts)), **cyclical_columns(ts)})


def wind_columns(direction: Column | str = "wind_direction") -> dict[str, Column]:
    angle = F.radians(col(direction))
    return {"wind_dir_sin": F.sin(angle), "wind_dir_cos": F.cos(angle)}


def add_wind(df: DataFrame) -> DataFrame:
    """Circular wind encoding; a frame without wind direction passes unchanged."""
    return df.withColumns(wind_columns()) if "wind_direction" in df.columns else df
