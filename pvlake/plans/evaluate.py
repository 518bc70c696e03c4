"""Evaluation protocols on split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines, conformal, metrics, splits
from ..operators.time_features import add_lags
from ..session import cut_lineage

EVALUATED = ("val", "test")


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def baseline_predictions(df: DataFrame) -> DataFrame:
    """Split the table in time and predict every row with the four baselines."""
    return baselines.predict_all(splits.chronological_split(df))


def baseline_leaderboard(df: DataFrame) -> DataFrame:
    """Four baselines × val/test × all sites and each site, in one grouping-sets pass."""
    timed = cut_lineage(splits.chronological_split(df))  # read for ranges, means and predictions
    scored = baselines.predict_wide(timed).where(F.col("split").isin(*EVALUATED))
    return metrics.metrics_all_and_site(scored, ["split"], metrics.train_range(train_rows(timed)), models=baselines.WIDE)


def model_leaderboard(scored: DataFrame, timed: DataFrame) -> DataFrame:
    """As above for any long predictions ``model, split, site_id, power, is_daylight, prediction``."""
    return metrics.metrics_all_and_site(
        scored.where(F.col("split").isin(*EVALUATED)), ["model", "split"], metrics.train_range(train_rows(timed)))


def cross_site_leaderboard(df: DataFrame, **options) -> DataFrame:
    """The baselines on seen and unseen sites; one pooled range scales every row."""
    framed = cut_lineage(splits.cross_site_split(df, **options))
    scored = baselines.predict_wide(framed).where(F.col("split").isin(*EVALUATED))
    return metrics.metrics_all_and_site(
        scored, ["protocol", "split"], metrics.train_range(train_rows(framed)), pooled_only=True, models=baselines.WIDE)


def with_regime(df: DataFrame) -> DataFrame:
    return add_lags(df, (1,)).withColumn("regime", conformal.regime()).drop("power_lag_1")


def regime_predictions(timed: DataFrame) -> DataFrame:
    """Baseline predictions with the row's regime; both lags they need come from one shuffle."""
    timed = cut_lineage(timed)  # read for the means and for the lags
    lagged = add_lags(timed, (1, baselines.DAY_STEPS)).withColumn("regime", conformal.regime()).drop("power_lag_1")
    return baselines.predict_all(lagged, persistence=f"power_lag_{baselines.DAY_STEPS}")


def conformal_intervals(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calibrate on val, attach intervals to test: every method and level, long.

    Predictions and calibration are kept as written tables, so nothing is predicted twice and
    the plans that read the intervals do not carry their derivation along.
    """
    by = by or ["model"]
    scored = cut_lineage(scored.where(F.col("split").isin(*EVALUATED)))  # for the calibration and for what it is applied to
    radii = cut_lineage(conformal.fit(scored.where(F.col("split") == "val"), by))
    return conformal.apply_radii(scored.where(F.col("split") == "test"), radii, by)
