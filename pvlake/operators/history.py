"""History look-ups an analyst or a dashboard asks for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SLOT_US, SLOTS_PER_DAY, floor_day, floor_hour, from_micros, micros
from ..sources.readers import scan_site, time_range
from .joins import SmallSide
from .timeline import WEEK_US, add_position, drop_halo, halo_window, with_halo
from .topk import top_per_group

# fixed values: served columns, resolutions and the row limit of one answer
HISTORY_COLUMNS = ("timestamp", "campus_id", "power", "is_daylight", "temperature", "humidity", "wind_speed")
RESOLUTIONS = ("15min", "1h", "1D")
MAX_HISTORY_ROWS = 50_000
EPOCH = dt.datetime(1970, 1, 1)
NOT_AVERAGED = {"timestamp", "is_daylight", "campus_id", "site_id"}


def bucket_start(ts: str, resolution: str) -> Column:
    if resolution == "1h":
        return floor_hour(ts)
    if resolution == "1D":
        return floor_day(ts)
    raise ValueError(f"resolution must be one of {RESOLUTIONS}")


def resample(df: DataFrame, resolution: str, keys: list[str] | None = None, ts: str = "timestamp") -> DataFrame:
    """Mean of numeric columns and any-daylight per bucket; buckets without power are dropped."""
    keys = keys or []
    numeric = [n for n, t in df.dtypes if n not in NOT_AVERAGED and n not in keys and t in ("double", "float", "int", "bigint")]
    aggregates = [F.avg(c).alias(c) for c in numeric]
    if "is_daylight" in df.columns:
        aggregates.append(F.max("is_daylight").alias("is_daylight"))
    out = df.groupBy(*keys, bucket_start(ts, resolution).alias(ts)).agg(*aggregates)
    return out.na.drop(subset=["power"]) if "power" in numeric else out


def site_history(df: DataFrame, site_id: int, start: str | None = None, end: str | None = None,
                 resolution: str = "15min", limit: int = MAX_HISTORY_ROWS) -> DataFrame:
    """One site's rows in a time range at a resolution, the latest ``limit`` of them in time order."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"resolution must be one of {RESOLUTIONS}")
    rows = time_range(scan_site(df, site_id), start, end).select(*[c for c in HISTORY_COLUMNS if c in df.columns])
    if resolution != "15min":
        rows = resample(rows, resolution)
    return latest_rows(rows, limit).orderBy("timestamp")


def latest_rows(df: DataFrame, limit: int, ts: str = "timestamp") -> DataFrame:
    return df.orderBy(F.col(ts).desc()).limit(limit)


def tail_per_site(df: DataFrame, rows: int = 2 * SLOTS_PER_DAY, ts: str = "timestamp") -> DataFrame:
    """The last rows of every site; Spark drops older rows inside each map task already."""
    return top_per_group(df, ["site_id"], [F.col(ts).desc()], rows, ["site_id", ts])


def recent(df: DataFrame, span_us: int, ts: str = "timestamp") -> DataFrame:
    """The rows of every site that are at most ``span_us`` older than its last one.

    Two phases: the last time per site is aggregated first. The earliest of them bounds what the scan must give, and
    the join with the (counted, expected small) table of last times comes before any shuffle of rows.
    """
    last = SmallSide.of(df.groupBy("site_id").agg(F.max(micros(ts)).alias("_last")))
    first = last.table.agg(F.min("_last")).first()[0]
    if first is None:
        return df.limit(0)
    bounded = df.where(F.col(ts) >= F.lit(EPOCH + dt.timedelta(microseconds=first - span_us)).cast("timestamp_ntz"))
    return last.join(bounded, ["site_id"]).where(micros(ts) >= F.col("_last") - F.lit(span_us)).drop("_last")


def head_per_group(df: DataFrame, keys: list[str], order: list[str], rows: int = 2) -> DataFrame:
    return top_per_group(df, keys, [F.col(c) for c in order], rows, order)


def sites_listing(sites: DataFrame) -> DataFrame:
    return sites.select("site_id", "campus_id", "latitude", "longitude").orderBy("site_id")


def dataset_card(df: DataFrame, zone: str, cadence_minutes: int = SLOT_US // 60_000_000) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("site_id").alias("n_sites"),
        F.countDistinct("campus_id").alias("n_campuses"),
    ).withColumns({"cadence_minutes": F.lit(cadence_minutes).cast("long"), "timezone": F.lit(zone)})


def latest_and_day_energy(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per site: last observed reading and the energy of its last observed day.

    Energy is first summed per site and day, so the final pick is over days.
    """
    observed = df.where(F.col("power").isNotNull())
    days = observed.groupBy("site_id", floor_day(ts).alias("day")).agg(
        F.max(ts).alias("latest_ts"), F.max_by("power", ts).alias("latest_power"), F.sum("power").alias("day_energy"))
    pick = F.max(F.struct("day", "latest_ts", "latest_power", "day_energy")).alias("p")
    return days.groupBy("site_id").agg(pick).select("site_id", "p.latest_ts", "p.latest_power", "p.day_energy")


def night_spans(df: DataFrame, *, key: str = "site_id", ts: str = "timestamp", chunk_rows: int = 4096) -> DataFrame:
    """Runs of night rows as spans [from, to): ``to`` is the next daylight row, null for an open run.

    Only rows where the flag changes matter; they are found with a one-row halo
    between row chunks, and pairing runs over the few changes per day that remain.
    """
    placed = add_position(df.select(key, ts, "is_daylight").withColumn("_us", micros(ts)), [key], "_us", 4 * WEEK_US, "_pos", "_total")
    split = with_halo(placed.withColumn("_pos", F.col("_pos").cast("long")), "_pos", chunk_rows, 1)
    before = F.lag("is_daylight").over(halo_window([key], "_pos"))
    changes = drop_halo(split.withColumn("_before", before)).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("is_daylight")))
    closing = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    return changes.withColumn("to_ts", closing).where(~F.col("is_daylight")).select(
        key, F.col(ts).alias("from_ts"), "to_ts")


def future_rows(tail: DataFrame, horizon: int, carried: list[str], ts: str = "timestamp") -> DataFrame:
    """``horizon`` future slots per site, each carrying the site's last row of weather."""
    last = tail.groupBy("site_id").agg(F.max(F.struct(micros(ts).alias("_us"), "campus_id", *carried)).alias("l"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    wide = last.select("site_id", "l.*", steps)
    return wide.select(
        "site_id", "campus_id", from_micros(F.col("_us") + F.col("step").cast("long") * F.lit(SLOT_US).cast("long")).alias(ts),
        F.lit(None).cast("double").alias("power"), *carried, "step")
