"""Model-ready channels and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import micros
from .timeline import WEEK_US, add_position, drop_halo, halo_window, with_halo

# fixed values: channel layout, power and its mask first
CHANNELS = (
    "power", "power_observed",
    "sin_hour", "cos_hour", "sin_day_of_year", "cos_day_of_year",
    "temperature", "humidity", "wind_speed", "wind_dir_sin", "wind_dir_cos",
    "solar_elevation_deg", "zenith_deg",
)
MASK = "power_observed"
LOOKBACK = 96
STD_FLOOR = 1e-6


def channel_columns(channels=CHANNELS) -> dict[str, Column]:
    """Channels with gaps as 0; the mask tells an observed target from a filled one."""
    observed = F.col("power").isNotNull().cast("double")
    return {c: observed if c == MASK else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in channels}


def channel_matrix(df: DataFrame, channels=CHANNELS, keep=("site_id", "timestamp")) -> DataFrame:
    columns = channel_columns(channels)
    return df.select(*keep, *[columns[c].alias(f"ch_{c}") for c in channels])


def channel_scaler(train: DataFrame, channels=CHANNELS) -> DataFrame:
    """``channel, mean, std`` on training rows; population deviation with a floor, the mask untouched."""
    columns = channel_columns(channels)
    scaled = [c for c in channels if c != MASK]
    wide = train.agg(*[a for c in scaled for a in (
        F.avg(columns[c]).alias(f"{c}_m"), F.greatest(F.stddev_pop(columns[c]), F.lit(STD_FLOOR)).alias(f"{c}_s"))])
    entries = [F.struct(F.lit(c).alias("channel"),
                        (F.lit(0.0) if c == MASK else F.col(f"{c}_m")).alias("mean"),
                        (F.lit(1.0) if c == MASK else F.col(f"{c}_s")).alias("std")) for c in channels]
    return wide.select(F.inline(F.array(*entries)))


def target_stats(train: DataFrame) -> DataFrame:
    return train.where(F.col("power").isNotNull()).agg(F.avg("power").alias("y_mean"), F.stddev_samp("power").alias("y_std"))


def standardized(df: DataFrame, scaler: DataFrame, channels=CHANNELS, keep=("site_id", "timestamp")) -> DataFrame:
    """Channels in training units; the scaler enters as one scalar subquery of a small map."""
    stats = scaler.agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "std")))).alias("m")).scalar()
    columns = channel_columns(channels)
    with_stats = df.withColumn("_m", stats)
    return with_stats.select(*keep, *[
        ((columns[c] - F.col("_m")[c]["mean"]) / F.col("_m")[c]["std"]).alias(f"ch_{c}") for c in channels])


def unstandardized(prediction: Column, y_mean: Column, y_std: Column) -> Column:
    return prediction * y_std + y_mean


def sliding_windows(df: DataFrame, channels: list[str], lookback: int = LOOKBACK, *, key: str = "site_id",
                    ts: str = "timestamp", target: str = "power", by: tuple[str, ...] = (),
                    power: str = "ch_power", mask: str = f"ch_{MASK}", chunk_rows: int = 2048, kind: str = "float") -> DataFrame:
    """``key, ts, target, window``: (lookback + 1) steps of channels ending at the row.

    Windows count rows, never cross a series (``by`` adds e.g. the split to its
    identity), exist only for observed targets with a full look-back, and have the
    last step's power and mask zeroed so the target cannot leak. Row chunks with a
    look-back halo bound what one task sorts.
    """
    series = [key, *by]
    placed = add_position(df.withColumn("_us", micros(ts)), series, "_us", 4 * WEEK_US, "_pos", "_total")
    split = with_halo(placed.withColumn("_pos", F.col("_pos").cast("long")), "_pos", max(chunk_rows, lookback), lookback)
    zero = F.lit(0.0).cast(kind)
    step = F.array(*[F.coalesce(F.col(c).cast(kind), zero) for c in channels])
    frame = halo_window(series, "_pos").rowsBetween(-lookback, 0)
    windows = split.withColumn("_w", F.collect_list(step).over(frame))
    current = F.array(*[zero if c in (power, mask) else F.coalesce(F.col(c).cast(kind), zero) for c in channels])
    ready = drop_halo(windows).where((F.col("_pos") > lookback) & F.col(target).isNotNull())
    return ready.select(
        *series, ts, F.col(target).alias("target"),
        F.concat(F.slice("_w", 1, lookback), F.array(current)).alias("window"))
