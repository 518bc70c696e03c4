"""Calendar-exact lags and left-closed rolling statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SLOT_US, from_micros, micros
from ..functions.stats import let
from .joins import SmallSide, null_safe_join
from .timeline import WEEK_US, drop_halo, halo_window, with_halo

# fixed values: look-back steps (15 minutes each), windows in seconds, statistics
LAG_STEPS = (1, 2, 4, 8, 24, 48, 96)
ROLLING_SECONDS = (3_600, 21_600, 86_400)
ROLLING_STATS = ("mean", "std", "min", "max")
_STAT = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_names(steps=LAG_STEPS, value: str = "power") -> list[str]:
    return [f"{value}_lag_{s}" for s in steps]


def rolling_names(seconds=ROLLING_SECONDS, stats=ROLLING_STATS, value: str = "power") -> list[str]:
    return [f"{value}_rolling_{stat}_{w}s" for w in seconds for stat in stats]


def add_time_features(df: DataFrame, *, keys: tuple[str, ...] = ("site_id",), ts: str = "timestamp",
                      value: str = "power", lag_steps=LAG_STEPS, rolling_seconds=ROLLING_SECONDS,
                      rolling_stats=ROLLING_STATS, min_periods: int = 1, chunk_us: int = 4 * WEEK_US) -> DataFrame:
    """Every lag and rolling column from one shuffle and one sort.

    A lag is the value at exactly ``t - k`` steps, null when that slot is absent.
    A rolling window is ``[t - W, t)``; null readings do not count and a standard
    deviation needs two. A repeated ``(keys, ts)`` fails at once. A row without a time stays, all its
    features null; rows without a key are one series.
    """
    lags = {name: s * SLOT_US for name, s in zip(lag_names(lag_steps, value), lag_steps)}
    spans = sorted(w * 1_000_000 for w in rolling_seconds)
    halo = max([*lags.values(), *spans], default=0)
    split = with_halo(df.withColumn("_us", micros(ts)), "_us", max(chunk_us, halo), halo)
    ordered = halo_window(list(keys), "_us")
    timed = F.col("_us").isNotNull()
    columns: dict[str, Column] = {
        name: F.when(timed, F.max(value).over(ordered.rangeBetween(-d, -d))) for name, d in lags.items()
    }
    # in the same sort: the halo holds each row once per chunk, so a second row at one time is a repeated key
    repeated = timed & (F.count(F.lit(1)).over(ordered.rangeBetween(0, 0)) > 1)
    columns["_repeated"] = F.when(repeated, F.raise_error(F.lit("a series has two rows at one time")).cast("int"))
    if spans:
        split = _centred(split, list(keys), value)
        columns |= _ring_sums(ordered, spans, value)
    out = split.withColumns(columns)
    if spans:
        stats = {n: F.when(timed, c) for n, c in _rolling_columns(rolling_seconds, rolling_stats, spans, value, min_periods).items()}
        out = out.withColumns(stats).drop("_centre", "_d", "_dd", *_ring_names(spans))
    return drop_halo(out.where(F.col("_repeated").isNull())).drop("_us", "_repeated")


def _centred(split: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Readings relative to one reading of their chunk, so sums of squares do not cancel."""
    # ordered like the rings, so both windows use one sort
    whole = halo_window(keys, "_us").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centre = F.min(value).over(whole)
    near = split.withColumn("_centre", centre).withColumn("_d", F.col(value) - F.col("_centre"))
    return near.withColumn("_dd", F.col("_d") * F.col("_d"))


_RING = {"n": lambda v: F.count(v), "s": lambda v: F.sum("_d"), "q": lambda v: F.sum("_dd"), "lo": lambda v: F.min(v), "hi": lambda v: F.max(v)}


def _ring_names(spans: list[int]) -> list[str]:
    return [f"_{part}_{d}" for d in spans for part in _RING]


def _ring_sums(ordered, spans: list[int], value: str) -> dict[str, Column]:
    """Mergeable aggregates of the disjoint rings [t - W1, t), [t - W2, t - W1), …

    Nested windows share their inner rings, so every reading is visited once per row.
    """
    columns: dict[str, Column] = {}
    inner = 0
    for d in spans:
        frame = ordered.rangeBetween(-d, -inner - 1)
        columns |= {f"_{part}_{d}": make(value).over(frame) for part, make in _RING.items()}
        inner = d
    return columns


def _rolling_columns(rolling_seconds, stats, spans: list[int], value: str, min_periods: int) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    for w in rolling_seconds:
        rings = [d for d in spans if d <= w * 1_000_000]

        def total(part: str) -> Column:
            return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_{part}_{d}"), F.lit(0)) for d in rings])

        def extreme(part: str, pick) -> Column:
            cells = [F.col(f"_{part}_{d}") for d in rings]
            return pick(*cells) if len(cells) > 1 else cells[0]

        n, low, high = total("n"), extreme("lo", F.least), extreme("hi", F.greatest)
        # equal readings have no spread at all; otherwise rounding may leave a tiny negative
        squares = F.greatest(total("q") - total("s") * total("s") / n, F.lit(0.0))
        results = {
            "mean": F.col("_centre") + total("s") / n,
            "std": F.when(n > 1, F.when(low == high, F.lit(0.0)).otherwise(F.sqrt(squares / (n - 1)))),
            "min": low,
            "max": high,
        }
        for stat in stats:
            columns[f"{value}_rolling_{stat}_{w}s"] = F.when(n >= max(1, min_periods), results[stat])
    return columns


def add_lags(df: DataFrame, steps=LAG_STEPS, **options) -> DataFrame:
    return add_time_features(df, lag_steps=steps, rolling_seconds=(), **options)


def add_rolling(df: DataFrame, seconds=ROLLING_SECONDS, stats=ROLLING_STATS, **options) -> DataFrame:
    return add_time_features(df, lag_steps=(), rolling_seconds=seconds, rolling_stats=stats, **options)


def lag_by_join(df: DataFrame, history: DataFrame, delta_us: int, name: str, *, key: str = "site_id",
                ts: str = "timestamp", value: str = "power") -> DataFrame:
    """Exact look-up of another series at ``t - delta``: for histories that are not ``df`` itself."""
    shifted = history.select(key, from_micros(micros(ts) + F.lit(delta_us)).alias(ts), F.col(value).alias(name))
    return df.join(shifted, [key, ts], "left")


def lookback_at(history: DataFrame, targets: DataFrame, *, key: str = "site_id", ts: str = "timestamp",
                value: str = "power", lag_steps=LAG_STEPS, rolling_seconds=ROLLING_SECONDS) -> DataFrame:
    """The same features for one new row per site, from its last day of history.

    ``targets`` holds at most one row per site. The earliest of them bounds what the scan of the history gives, the
    join is on the site and cuts to the look-back; everything then is one aggregate with
    map-side combine, so no site is gathered anywhere.
    """
    deepest = max([s * SLOT_US for s in lag_steps] + [w * 1_000_000 for w in rolling_seconds])
    wanted = SmallSide.of(targets.select(key, micros(ts).alias("_t")))
    first = wanted.table.agg(F.min("_t")).first()[0]
    bounded = history if first is None else history.where(F.col(ts) >= from_micros(F.lit(first - deepest)))
    past = (
        bounded.select(key, micros(ts).alias("_us"), F.col(value).alias("_v"))
        .transform(wanted.join, [key])
        .withColumn("_age", F.col("_t") - F.col("_us"))
        .where((F.col("_age") > 0) & (F.col("_age") <= deepest))
    )
    aggregates = [
        F.max(F.when(F.col("_age") == s * SLOT_US, F.col("_v"))).alias(name)
        for name, s in zip(lag_names(lag_steps, value), lag_steps)
    ]
    for w in rolling_seconds:
        inside = F.when(F.col("_age") <= w * 1_000_000, F.col("_v"))
        aggregates += [_STAT[stat](inside).alias(f"{value}_rolling_{stat}_{w}s") for stat in ROLLING_STATS]
    return null_safe_join(targets, past.groupBy(key).agg(*aggregates), [key], "left")


def with_lookback(past: Column, now: Column, body: Callable[[Callable[[str], Column]], Column], *, value: str = "power",
                  lag_steps=LAG_STEPS, rolling_seconds=ROLLING_SECONDS) -> Column:
    """``body`` of the same features from a short history carried inside the row: no shuffle, and usable inside array functions.

    ``past`` is an array of (us, v) pairs, at most a day of slots; ``now`` is the row's own time in
    microseconds. ``body`` gets a function that gives a feature by name. Each stage is evaluated once.
    """
    def readings(span: int) -> Column:
        recent = F.filter(past, lambda p: (p["us"] >= now - span) & (p["us"] < now) & p["v"].isNotNull())
        return F.transform(recent, lambda p: p["v"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def spread(values: Column, mean: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))

    def names(stat: str, w: int) -> str:
        return f"{value}_rolling_{stat}_{w}s"

    series = F.map_from_entries(past)
    first = F.struct(series.alias("series"), *[readings(w * 1_000_000).alias(f"v_{w}") for w in rolling_seconds])

    def second(h: Column) -> Column:
        return F.struct(
            *[F.try_element_at(h["series"], now - s * SLOT_US).alias(n) for n, s in zip(lag_names(lag_steps, value), lag_steps)],
            *[F.when(F.size(h[f"v_{w}"]) > 0, total(h[f"v_{w}"]) / F.size(h[f"v_{w}"])).alias(names("mean", w)) for w in rolling_seconds],
            *[F.array_min(h[f"v_{w}"]).alias(names("min", w)) for w in rolling_seconds],
            *[F.array_max(h[f"v_{w}"]).alias(names("max", w)) for w in rolling_seconds])

    def third(h: Column, m: Column) -> Column:
        return F.struct(F.lit(True).alias("_"), *[F.when(F.size(h[f"v_{w}"]) > 1, F.sqrt(spread(h[f"v_{w}"], m[names("mean", w)]) / (F.size(h[f"v_{w}"]) - 1))).alias(names("std", w))
                                                  for w in rolling_seconds])

    deviations = [names("std", w) for w in rolling_seconds]
    return let(first, lambda h: let(second(h), lambda m: let(third(h, m), lambda d: body(lambda n: d[n] if n in deviations else m[n]))))


def add_lookback(df: DataFrame, past: str, now: str, *, value: str = "power", lag_steps=LAG_STEPS, rolling_seconds=ROLLING_SECONDS) -> DataFrame:
    wanted = [*lag_names(lag_steps, value), *rolling_names(rolling_seconds, ROLLING_STATS, value)]
    every = with_lookback(F.col(past), F.col(now), lambda get: F.struct(*[get(n).alias(n) for n in wanted]),
                          value=value, lag_steps=lag_steps, rolling_seconds=rolling_seconds)
    return df.withColumn("_look", every).select("*", "_look.*").drop("_look")
