"""Exact order statistics and quantiles that never sort a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the
values are first counted (map-side combined, keyed by group *and* value), then
located in three steps: logarithmic buckets are accumulated per group (a few
thousand at most, whatever the row count), the buckets holding a wanted rank are
cut into even slices and accumulated again, and only the hit slices are ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import null_safe_join

BUCKETS_PER_OCTAVE = 256
SLICES = 4_096
_ORIGIN = 2_000 * BUCKETS_PER_OCTAVE  # past the smallest double exponent


def log_bucket(value: Column) -> Column:
    """Monotone bucket id with 0.3 % relative width."""
    level = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_OCTAVE).cast("long") + _ORIGIN
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, level).otherwise(-level)


def _ranks_between(ranks: Column, low: Column, high: Column) -> Column:
    return F.filter(ranks, lambda h: (h["rank"] > low) & (h["rank"] <= high))


def order_statistics(df: DataFrame, keys: list[str], value: str,
                     ranks: dict[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """The values at given 1-based ranks per group, one column per entry of ``ranks``.

    Each entry maps the group's count of non-null values to a rank. The result has
    the keys (null is a group like any other), ``n`` and one double per rank.
    """
    keyed = df if keys else df.withColumn("_all", F.lit(1))
    groups = keys or ["_all"]
    count = F.sum(weight) if weight else F.count(F.lit(1))
    freq = (
        keyed.where(F.col(value).isNotNull())
        .select(*groups, F.col(value).cast("double").alias("_v"), *([weight] if weight else []))
        .groupBy(*groups, "_v")
        .agg(count.alias("_f"))
        .withColumn("_b", log_bucket(F.col("_v")))
    )
    freq = cut_lineage(freq)  # the input is read once; buckets, hits and slices all start from its counts
    by_group = Window.partitionBy(*groups)
    buckets = (
        freq.groupBy(*groups, "_b")
        .agg(F.sum("_f").alias("_bf"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        .withColumns({
            "_upto": F.sum("_bf").over(by_group.orderBy("_b")),
            "_n": F.sum("_bf").over(by_group),
        })
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank"))
        for name, rank in ranks.items()
    ])
    before = F.col("_upto") - F.col("_bf")
    hits = (
        buckets.withColumn("_hits", _ranks_between(wanted, before, F.col("_upto")))
        .where(F.size("_hits") > 0)
        .select(*groups, "_b", "_n", before.alias("_before"), "_hits", "_min", "_max")
    )
    # values may crowd into one bucket (a large offset with small differences), so it is cut once more, evenly
    place = F.floor((F.col("_v") - F.col("_min")) / F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0)) * SLICES)
    near = null_safe_join(freq, hits, [*groups, "_b"]).withColumn("_s", F.coalesce(F.least(place, F.lit(SLICES - 1)), F.lit(0)))
    in_bucket = Window.partitionBy(*groups, "_b").orderBy("_s")
    slices = near.groupBy(*groups, "_b", "_s").agg(
        F.sum("_f").alias("_sf"), F.first("_before").alias("_base"), F.first("_hits").alias("_all_hits"))
    upto = F.col("_base") + F.sum("_sf").over(in_bucket)
    hit_slices = (
        slices.withColumn("_sliceupto", upto)
        .withColumn("_slicehits", _ranks_between(F.col("_all_hits"), F.col("_sliceupto") - F.col("_sf"), F.col("_sliceupto")))
        .where(F.size("_slicehits") > 0)
        .select(*groups, "_b", "_s", (F.col("_sliceupto") - F.col("_sf")).alias("_slicebefore"), "_slicehits")
    )
    inside = Window.partitionBy(*groups, "_b", "_s").orderBy("_v")
    located = (
        null_safe_join(near, hit_slices, [*groups, "_b", "_s"])
        .withColumn("_hi", F.col("_slicebefore") + F.sum("_f").over(inside))
        .withColumn("_hit", F.explode("_slicehits"))
        .where((F.col("_hit.rank") > F.col("_hi") - F.col("_f")) & (F.col("_hit.rank") <= F.col("_hi")))
    )
    out = located.groupBy(*groups).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("_hit.name") == name, F.col("_v"))).alias(name) for name in ranks],
    )
    return out if keys else out.drop("_all")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    weight: str | None = None) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, one column per entry of ``probs``."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1
        ranks[f"{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1
    found = order_statistics(df, keys, value, ranks, weight)
    columns = []
    for name, p in probs.items():
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        place = (F.col("n") - 1) * F.lit(p)
        columns.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.select(*keys, "n", *columns)
