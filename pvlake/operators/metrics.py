"""Regression metrics, leaderboards and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import signed_error

METRICS = ("n_eval", "n_missing", "mae", "rmse", "r2", "nrmse", "daylight_n", "daylight_mae", "daylight_nrmse")
HIGHER_IS_BETTER = ("r2",)


def train_range(train: DataFrame, key: str = "site_id") -> DataFrame:
    """Observed training range, pooled (null site) and per site; a zero range is null."""
    spread = F.nullif(F.max("power") - F.min("power"), F.lit(0.0))
    return (
        train.where(F.col("power").isNotNull())
        .groupingSets([[], [key]], F.col(key))
        .agg(spread.alias("denominator"), F.grouping(key).cast("int").alias("_all"))
        .select(F.when(F.col("_all") == 1, "ALL").otherwise("SITE").alias("scope"), key, "denominator")
    )


def metric_columns(pred: str = "prediction", truth: str = "power", daylight: str | None = "is_daylight") -> dict[str, Column]:
    """All error aggregates of one group in one pass; pairs with a missing side only count as missing."""
    error = signed_error(pred, truth)
    y = F.when(error.isNotNull(), F.col(truth))
    squares, spread = F.sum(error * error), F.var_pop(y) * F.count(error)
    lit = F.when(F.col(daylight), error) if daylight else F.when(F.lit(False), error)
    return {
        "n_eval": F.count(error),
        "n_missing": F.count(F.lit(1)) - F.count(error),
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(spread > 0, F.lit(1.0) - F.try_divide(squares, spread)),
        "daylight_n": F.count(lit),
        "daylight_mae": F.avg(F.abs(lit)),
        "_daylight_rmse": F.sqrt(F.avg(lit * lit)),
    }


def _with_denominator(df: DataFrame, denominator: Column) -> DataFrame:
    return df.withColumns({
        "nrmse": F.try_divide(F.col("rmse"), denominator),
        "daylight_nrmse": F.try_divide(F.col("_daylight_rmse"), denominator),
    }).drop("_daylight_rmse")


def regression_metrics(df: DataFrame, by: list[str], denominator: Column | float | None = None, **columns) -> DataFrame:
    grouped = df.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns(**columns).items()])
    value = F.lit(None).cast("double") if denominator is None else (
        F.lit(float(denominator)) if isinstance(denominator, (int, float)) else denominator)
    return _with_denominator(grouped, value).select(*by, *METRICS)


def metrics_all_and_site(df: DataFrame, by: list[str], ranges: DataFrame, pooled_only: bool = False, models: dict[str, str] | None = None) -> DataFrame:
    """Metrics over all sites and per site from one grouping-sets pass.

    ALL rows divide by the pooled training range, SITE rows by their own, or all by
    the pooled one (``pooled_only``, as the cross-site protocol does). ``models`` maps each model to the column of its
    predictions: they are aggregated side by side and become rows (``model``) afterwards.
    """
    sets = [[*by], [*by, "site_id"]]
    made = {m: metric_columns(pred=c) for m, c in (models or {None: "prediction"}).items()}
    grouped = df.groupingSets(sets, *[F.col(c) for c in [*by, "site_id"]]).agg(
        F.grouping("site_id").cast("int").alias("_all"),
        *[c.alias(f"{m}|{n}" if models else n) for m, columns in made.items() for n, c in columns.items()],
    )
    scoped = grouped.withColumn("scope", F.when(F.col("_all") == 1, "ALL").otherwise("SITE"))
    pooled = ranges.where(F.col("scope") == "ALL").select("denominator").scalar()
    if pooled_only:
        denominator = pooled
    else:
        own = ranges.where(F.col("scope") == "SITE").select("site_id", F.col("denominator").alias("_own"))
        scoped = scoped.join(own, "site_id", "left")
        denominator = F.when(F.col("scope") == "ALL", pooled).otherwise(F.col("_own"))
    if models:
        names = list(next(iter(made.values())))
        held = scoped.withColumn("_denominator", denominator)
        stacked = F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"`{m}|{n}`").alias(n) for n in names]) for m in made])
        scoped, denominator = held.select(*by, "scope", "site_id", "_denominator", F.inline(stacked)), F.col("_denominator")
    return _with_denominator(scoped, denominator).select(*(["model"] if models else []), *by, "scope", "site_id", *METRICS)


def per_site_spread(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Best and worst site per model."""
    return metrics.where(F.col("scope") == "SITE").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sites"),
        F.min("mae").alias("min_mae"), F.max("mae").alias("max_mae"),
        F.min("r2").alias("min_r2"), F.max("r2").alias("max_r2"),
        F.count_if(F.col("r2") < 0).alias("n_negative_r2"))


def rank_models(metrics: DataFrame, metric: str = "mae") -> DataFrame:
    """Leaderboard of the ALL rows: test first, best first; larger is better only for R²."""
    value = F.col(metric)
    order = value.desc_nulls_last() if metric in HIGHER_IS_BETTER else value.asc_nulls_last()
    board = metrics.where(F.col("scope") == "ALL")
    test_first = F.when(F.col("split") == "test", 0).otherwise(1)
    # one row per model and split
    return board.withColumn("rank", F.row_number().over(Window.partitionBy("split").orderBy(order, F.col("model")))).orderBy(
        test_first, F.col("split"), F.col("rank"))


def worst_sites(metrics: DataFrame, n: int = 14, split: str = "test") -> DataFrame:
    """Sites with the largest error of one split; unknown errors come last."""
    rows = metrics.where((F.col("scope") == "SITE") & (F.col("split") == split))
    return rows.orderBy(F.coalesce("mae", F.lit(-1.0)).desc(), "site_id").limit(n)


def mae_delta(metrics: DataFrame, reference: str, split: str = "test") -> DataFrame:
    """Model error minus the reference model's error."""
    board = metrics.where((F.col("scope") == "ALL") & (F.col("split") == split))
    base = board.where(F.col("model") == reference).select("mae").scalar()
    return board.select("model", "mae", (F.col("mae") - base).alias("mae_delta"))


def generalisation_gap(metrics: DataFrame, by: list[str], metric: str = "mae", split: str = "test") -> DataFrame:
    """Relative change from seen to unseen sites in percent."""
    def side(protocol: str) -> Column:
        return F.max(F.when(F.col("protocol") == protocol, F.col(metric)))

    board = metrics.where((F.col("scope") == "ALL") & (F.col("split") == split))
    wide = board.groupBy(*by).agg(side("seen").alias("seen"), side("unseen").alias("unseen"))
    return wide.withColumn("gap_pct", F.try_divide((F.col("unseen") - F.col("seen")) * 100.0, F.col("seen")))


def cross_site_rollup(metrics: DataFrame) -> DataFrame:
    """Per model: seen-validation and unseen-test rows side by side, and how many unseen sites there are with their R² summed up.

    :func:`unseen_sites` has the sites themselves, one row each.
    """
    def grab(protocol: str, split: str, metric: str) -> Column:
        hit = (F.col("protocol") == protocol) & (F.col("split") == split) & (F.col("scope") == "ALL")
        return F.max(F.when(hit, F.col(metric)))

    wide = {f"{label}_{m}": grab(protocol, split, m)
            for label, protocol, split in (("seen_val", "seen", "val"), ("unseen_test", "unseen", "test"))
            for m in ("mae", "rmse", "r2", "nrmse")}
    return metrics.groupBy("model").agg(
        *[c.alias(n) for n, c in wide.items()], F.count_if(_unseen()).alias("n_unseen_sites"), F.sum(F.when(_unseen(), F.col("r2"))).alias("sum_unseen_r2"))


def _unseen() -> Column:
    return (F.col("protocol") == "unseen") & (F.col("split") == "test") & (F.col("scope") == "SITE")


def unseen_sites(metrics: DataFrame) -> DataFrame:
    """``model, site_id, mae, r2`` of each held-out test site."""
    return metrics.where(_unseen()).select("model", "site_id", "mae", "r2")


def model_metrics(metrics: DataFrame, model: str) -> DataFrame:
    """The test row over all sites for one model."""
    return metrics.where((F.col("model") == model) & (F.col("split") == "test") & (F.col("scope") == "ALL"))
