"""Reference forecasts every learned model must beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY_US, SLOT_US
from .joins import join_small
from .time_features import add_lags, lag_by_join

DAY_STEPS = DAY_US // SLOT_US
BASELINES = ("zero", "mean_global", "mean_site", "persistence_24h")


def zero() -> Column:
    return F.lit(0.0)


def global_mean(train: DataFrame) -> Column:
    """Mean of the observed training target as a scalar subquery: one row, no join."""
    return train.agg(F.avg("power").alias("m")).scalar()


def site_means(train: DataFrame) -> DataFrame:
    return train.groupBy("site_id").agg(F.avg("power").alias("site_mean"))


def predict_site_mean(df: DataFrame, train: DataFrame, name: str = "prediction") -> DataFrame:
    """The site's training mean, the global one for sites without training rows."""
    return (
        join_small(df, site_means(train), ["site_id"], "left")
        .withColumn(name, F.coalesce("site_mean", global_mean(train)))
        .drop("site_mean")
    )


def predict_persistence(df: DataFrame, name: str = "prediction", **options) -> DataFrame:
    """The value exactly 24 h earlier in the same series; null when that slot is absent or empty."""
    return add_lags(df, (DAY_STEPS,), **options).withColumnRenamed(f"power_lag_{DAY_STEPS}", name)


def persistence_lookup(df: DataFrame, history: DataFrame, name: str = "prediction") -> DataFrame:
    """Persistence against a separate history table."""
    return lag_by_join(df, history, DAY_US, name)


def predict_wide(df: DataFrame, persistence: str | None = None) -> DataFrame:
    """The predictions of the four baselines as one column each, named as in :data:`WIDE`.

    Persistence looks back over the full series, so it is computed before any
    split is selected; a caller that has the 24 h lag already names its column. The
    rest are constants per row.
    """
    train = df.where(F.col("split") == "train")
    lagged = df.withColumnRenamed(persistence, "_p24") if persistence else predict_persistence(df, "_p24")
    return predict_site_mean(lagged, train, "_psite").withColumns({"_pall": global_mean(train), "_pzero": zero()})


#: Columns of :func:`predict_wide` by model.
WIDE = {"zero": "_pzero", "mean_global": "_pall", "mean_site": "_psite", "persistence_24h": "_p24"}


def predict_all(df: DataFrame, persistence: str | None = None) -> DataFrame:
    """As :func:`predict_wide`, long: a row per row and model."""
    entries = F.array(*[F.struct(F.lit(model).alias("model"), F.col(c).alias("prediction")) for model, c in WIDE.items()])
    return predict_wide(df, persistence).select(*[c for c in df.columns if c != persistence], F.inline(entries))
