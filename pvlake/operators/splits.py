"""Leakage-safe splits and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import micros
from ..session import cut_lineage
from .joins import join_small
from .timeline import WEEK_US, add_position, global_position

RATIOS = (0.70, 0.15, 0.15)
SEED = 42


def cut_label(position: Column, total: Column, ratios=RATIOS) -> Column:
    """train / val / test by row position; cut points round half to even."""
    if len(ratios) != 3 or min(ratios) <= 0 or abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must be three positive fractions that sum to 1")
    first = F.rint(total * F.lit(ratios[0]))
    second = F.rint(total * F.lit(ratios[0] + ratios[1]))
    return F.when(position <= first, "train").when(position <= second, "val").otherwise("test")


def chronological_split(df: DataFrame, ratios=RATIOS, *, key: str = "site_id", ts: str = "timestamp",
                        chunk_us: int = 4 * WEEK_US) -> DataFrame:
    """Add ``split``: every site contributes its early rows to train and its late rows to test."""
    placed = add_position(df.withColumn("_us", micros(ts)), [key], "_us", chunk_us, "_pos", "_total")
    return placed.withColumn("split", cut_label(F.col("_pos"), F.col("_total"), ratios)).drop("_us", "_pos", "_total")


def seeded_hash(*columns: str, seed: int = SEED) -> Column:
    """Hex digest of the seed and the columns: a stable random order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def site_roles(df: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, seed: int = SEED,
               key: str = "site_id") -> DataFrame:
    """``key, role`` with role train, val or test; held-out counts are rounded, at least one each.

    Sites are ordered by a seeded digest. Positions are counted in 4,096 digest
    buckets, so even very many sites are never sorted in one task.
    """
    if not (0 < val_frac < 1 and 0 < test_frac < 1 and val_frac + test_frac < 1):
        raise ValueError("site fractions must be in (0, 1) and leave training sites")
    sites = df.select(key).distinct().withColumn("_digest", seeded_hash(key, seed=seed))
    placed = global_position(sites, "_digest", F.substring("_digest", 1, 3), "_pos", "_sites")
    n_test = F.greatest(F.lit(1.0), F.rint(F.col("_sites") * F.lit(test_frac)))
    n_val = F.greatest(F.lit(1.0), F.rint(F.col("_sites") * F.lit(val_frac)))
    role = F.when(F.col("_pos") <= n_test, "test").when(F.col("_pos") <= n_test + n_val, "val").otherwise("train")
    enough = F.assert_true(n_val + n_test < F.col("_sites"), "held-out sites leave no training site")
    return placed.where(enough.isNull()).select(key, role.alias("role"))


def cross_site_split(df: DataFrame, val_frac: float = 0.15, test_frac: float = 0.15, seed: int = SEED,
                     train_ratio: float = 0.70, *, key: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """Add ``protocol`` (seen / unseen) and ``split``.

    Training sites are cut in time; the full history of every held-out site is
    unseen and carries its role as the split.
    """
    rest = (1.0 - train_ratio) / 2.0
    timed = chronological_split(df, (train_ratio, rest, 1.0 - train_ratio - rest), key=key, ts=ts)
    roles = site_roles(df, val_frac, test_frac, seed, key)
    seen = F.col("role") == "train"
    return join_small(timed, roles, [key]).withColumns({
        "protocol": F.when(seen, "seen").otherwise("unseen"),
        "split": F.when(seen, F.col("split")).otherwise(F.col("role")),
    }).drop("role")


def sample_observed(df: DataFrame, n: int, seed: int = SEED, keys=("site_id", "timestamp")) -> DataFrame:
    """``n`` observed rows in seeded order; every task keeps only its own first ``n``."""
    digest = seeded_hash(*keys, seed=seed)
    return df.where(F.col("power").isNotNull()).withColumn("_d", digest).orderBy("_d", *keys).limit(n).drop("_d")


def sample_fraction(df: DataFrame, fraction: float, seed: int = SEED, keys=("site_id", "timestamp")) -> DataFrame:
    """Seeded share of rows by hash threshold: no shuffle, the same rows on every run."""
    head = F.conv(F.substring(seeded_hash(*keys, seed=seed), 1, 8), 16, 10).cast("long")
    return df.where(head < F.lit(int(fraction * (1 << 32))))


def every_nth(df: DataFrame, n: int, *, key: str = "site_id", ts: str = "timestamp",
              chunk_us: int = 4 * WEEK_US) -> DataFrame:
    """Systematic sample: rows 1, n + 1, 2n + 1, … of every series."""
    placed = add_position(df.withColumn("_us", micros(ts)), [key], "_us", chunk_us, "_pos", "_total")
    return placed.where(F.pmod(F.col("_pos") - 1, F.lit(n)) == 0).drop("_us", "_pos", "_total")


def split_info(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("power").alias("n_observed"),
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def site_bounds(df: DataFrame, key: str = "site_id") -> DataFrame:
    """Contiguous [start, end) row spans of the sites in a table sorted by site and time, the null site first.

    Sites are dealt out by ranges of their rank, whatever their ids are like. Sums run inside a range, and over one
    total per range, so no task sees more sites than its range.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(sizes.repartitionByRange(F.col(key).asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.sum("n").alias("_total"))
    before = parts.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_before"))  # a row per range
    end = F.col("_before") + F.sum("n").over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first()))
    return placed.join(F.broadcast(before), "_part").withColumn("end_row", end).select(
        key, (F.col("end_row") - F.col("n")).alias("start_row"), "end_row")
