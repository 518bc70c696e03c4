"""Solar geometry as column expressions.

Sources: Jean Meeus, "Astronomical Algorithms" (low-accuracy solar position, as
used by the NOAA solar calculator), and the refraction term of Reda & Andreas,
"Solar Position Algorithm for Solar Radiation Applications", NREL/TP-560-34302.
Everything stays inside code generation; nothing is looked up or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clock import DAY_US, SLOTS_PER_DAY, add_utc, col, computed, micros

DAYLIGHT_ELEVATION_DEG = 0.0
# fixed values: candidate civil clocks of the fleet
ZONE_CANDIDATES = ("Etc/GMT-10", "Australia/Melbourne")
DEFAULT_ZONE = "Australia/Melbourne"
SLOT_HOURS = 24.0 / SLOTS_PER_DAY
J2000_US = 946_728_000_000_000  # 2000-01-01 12:00
SUN_COLUMNS = ("solar_elevation_deg", "azimuth_deg", "zenith_deg")


def add_sun_utc(df: DataFrame, utc: Column | str, latitude: Column | str, longitude: Column | str,
                pressure_hpa: float = 1013.25, temperature_c: float = 12.0) -> DataFrame:
    """Add apparent elevation, azimuth (clockwise from north) and apparent zenith, in degrees.

    The formula is laid out in steps so each intermediate is one column: written
    as a single expression the shared terms would be repeated many times over.
    Steps are joined by :func:`computed`, so a later filter on the elevation
    is not unfolded into the whole formula.
    """
    c = F.col
    before = df.columns
    refraction = pressure_hpa / 1010.0 * 283.0 / (273.0 + temperature_c) * 1.02 / 60.0
    barriers = {0, 5, 9}
    steps: list[dict[str, Column]] = [
        {"_us": micros(utc), "_lat": F.radians(col(latitude)), "_lon": col(longitude)},
        {"_t": (c("_us") - F.lit(J2000_US)) / F.lit(float(DAY_US) * 36525.0)},
        {
            "_long": F.pmod(F.lit(280.46646) + c("_t") * (F.lit(36000.76983) + c("_t") * 0.0003032), F.lit(360.0)),
            "_anom": F.radians(F.lit(357.52911) + c("_t") * (F.lit(35999.05029) - c("_t") * 0.0001537)),
            "_ecc": F.lit(0.016708634) - c("_t") * (F.lit(0.000042037) + c("_t") * 0.0000001267),
            "_node": F.radians(F.lit(125.04) - c("_t") * 1934.136),
            "_seconds": F.lit(21.448) - c("_t") * (F.lit(46.815) + c("_t") * (F.lit(0.00059) - c("_t") * 0.001813)),
        },
        {
            "_centre": F.sin(c("_anom")) * (F.lit(1.914602) - c("_t") * (F.lit(0.004817) + c("_t") * 0.000014))
            + F.sin(c("_anom") * 2) * (F.lit(0.019993) - c("_t") * 0.000101)
            + F.sin(c("_anom") * 3) * 0.000289,
            "_tilt": F.radians(F.lit(23.0) + (F.lit(26.0) + c("_seconds") / 60.0) / 60.0 + F.cos(c("_node")) * 0.00256),
            "_lrad": F.radians(c("_long")),
        },
        {
            "_app": F.radians(c("_long") + c("_centre") - 0.00569 - F.sin(c("_node")) * 0.00478),
            "_y": F.pow(F.tan(c("_tilt") / 2.0), F.lit(2.0)),
        },
        {
            "_decl": F.asin(F.sin(c("_tilt")) * F.sin(c("_app"))),
            "_eqt": F.degrees(
                c("_y") * F.sin(c("_lrad") * 2)
                - c("_ecc") * F.sin(c("_anom")) * 2
                + c("_ecc") * c("_y") * F.sin(c("_anom")) * F.cos(c("_lrad") * 2) * 4
                - c("_y") * c("_y") * F.sin(c("_lrad") * 4) * 0.5
                - c("_ecc") * c("_ecc") * F.sin(c("_anom") * 2) * 1.25
            ) * 4.0,
        },
        {
            "_ha": F.radians(
                F.pmod(F.pmod(c("_us"), F.lit(DAY_US)) / F.lit(60_000_000.0) + c("_eqt") + c("_lon") * 4.0,
                       F.lit(1440.0)) / 4.0 - 180.0),
        },
        {
            "_sine": F.sin(c("_lat")) * F.sin(c("_decl")) + F.cos(c("_lat")) * F.cos(c("_decl")) * F.cos(c("_ha")),
            "azimuth_deg": F.pmod(
                F.degrees(F.atan2(
                    F.sin(c("_ha")),
                    F.cos(c("_ha")) * F.sin(c("_lat")) - F.tan(c("_decl")) * F.cos(c("_lat")))) + 180.0,
                F.lit(360.0)),
        },
        # rounding may leave [-1, 1]; a null (no place, no instant) must stay null, which least/greatest would drop
        {"_true": F.degrees(F.asin(F.when(c("_sine") > 1.0, 1.0).when(c("_sine") < -1.0, -1.0).otherwise(c("_sine"))))},
        # no refraction once the whole disc is below the horizon: sun radius plus horizon refraction
        {
            "solar_elevation_deg": c("_true") + F.when(
                c("_true") >= -(0.26667 + 0.5667),
                F.lit(refraction) / F.tan(F.radians(c("_true") + F.lit(10.3) / (c("_true") + 5.11))),
            ).otherwise(0.0),
        },
        {"zenith_deg": F.lit(90.0) - c("solar_elevation_deg")},
    ]
    out = df.drop(*SUN_COLUMNS)
    for i, step in enumerate(steps):
        out = computed(out, step) if i in barriers else out.withColumns(step)
    kept = [n for n in before if n not in SUN_COLUMNS]
    return out.select(*kept, *SUN_COLUMNS)


def add_sun_local(df: DataFrame, ts: str, latitude: Column | str, longitude: Column | str,
                  zone: str = DEFAULT_ZONE) -> DataFrame:
    """As :func:`add_sun_utc` for a civil wall clock; ambiguous times give null."""
    placed = add_utc(df.drop(*SUN_COLUMNS), ts, zone, "_instant")
    return add_sun_utc(placed, "_instant", latitude, longitude).drop("_instant")


def daylight(elevation: Column | str = "solar_elevation_deg") -> Column:
    """Above the horizon; unknown elevation counts as night."""
    return F.coalesce(col(elevation) > DAYLIGHT_ELEVATION_DEG, F.lit(False))
