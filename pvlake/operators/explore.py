"""Exploratory aggregates behind the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import floor_day, floor_hour, fractional_hour, month_key, slot_label, slot_of_day
from ..functions.stats import histogram_bin, pearson, signed_error
from .joins import null_safe_join
from .quantiles import exact_quantiles

KWH_PER_SLOT = 0.25  # parity factor of the monthly energy report
TWILIGHT_HOURS = (16, 21)


def day_observed(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_daylight") & F.col("power").isNotNull())


def night_observed(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_daylight") & F.col("power").isNotNull())


def site_monthly_energy(df: DataFrame, sites: DataFrame, factor: float = KWH_PER_SLOT, ts: str = "timestamp") -> DataFrame:
    """Dense site × month table: every month seen anywhere, null where a site has no reading.

    The month list is one small array (an entry per calendar month of the data set)
    that each site expands, so no cross join is planned.
    """
    monthly = (
        df.where(F.col("power").isNotNull()).groupBy("site_id", month_key(ts).alias("month"))
        .agg((F.sum("power") * factor).alias("monthly_kwh"))
    )
    months = monthly.agg(F.array_sort(F.collect_set("month")).alias("m")).scalar()
    dense = monthly.select("site_id").distinct().withColumn("month", F.explode(months))
    campus = sites.select("site_id", "campus_id")
    return dense.join(monthly, ["site_id", "month"], "left").join(campus, "site_id").select(
        "site_id", "campus_id", "month", "monthly_kwh")


def campus_monthly_mean(site_months: DataFrame) -> DataFrame:
    """Monthly energy of a campus divided by all its reporting sites."""
    sizes = site_months.groupBy("campus_id").agg(F.countDistinct("site_id").alias("n_sites"))
    sums = site_months.groupBy("campus_id", "month").agg(F.sum("monthly_kwh").alias("_s"))
    return sums.join(sizes, "campus_id").select(
        "campus_id", "n_sites", "month", (F.col("_s") / F.col("n_sites")).alias("monthly_kwh_mean"))


def hour_of_day_profile(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Mean daylight power per 15-minute slot, per campus and over all; sums merge, so one pass serves both."""
    slots = day_observed(df).select("campus_id", slot_of_day(ts).alias("slot"), "power")
    grouped = slots.groupingSets([["slot"], ["campus_id", "slot"]], F.col("campus_id"), F.col("slot")).agg(
        F.grouping("campus_id").cast("int").alias("_all"), F.avg("power").alias("mean_power"))
    return grouped.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("campus_id").cast("string")).alias("campus"),
        "slot", slot_label("slot").alias("label"), "mean_power")


def time_of_day_means(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Mean of all observed power per campus and fractional hour."""
    return df.groupBy("campus_id", fractional_hour(ts).alias("hour_of_day")).agg(F.avg("power").alias("mean_power"))


def peak_time_of_day(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    means = df.groupBy(fractional_hour(ts).alias("hour_of_day")).agg(F.avg("power").alias("mean_power"))
    order = F.struct(F.round("mean_power", 9), -F.col("hour_of_day"))
    return means.where(F.col("mean_power").isNotNull()).agg(
        F.max_by("hour_of_day", order).alias("peak_hour"), F.max("mean_power").alias("peak_power"))


def _long(df: DataFrame, keys: list[str], names: list[str], label: str, value: str) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(label), F.col(c).alias(value)) for c in names])))


def corr_by_campus(df: DataFrame, variables: list[str]) -> DataFrame:
    """Correlation of power with each variable on complete daylight rows."""
    rows = day_observed(df).na.drop(subset=variables)
    wide = rows.groupBy("campus_id").agg(*[pearson("power", v).alias(v) for v in variables])
    return _long(wide, ["campus_id"], variables, "variable", "r")


def corr_matrix(df: DataFrame, variables: list[str]) -> DataFrame:
    """All pairwise correlations (pairwise-complete rows) from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]
    wide = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = [F.struct(F.lit(x).alias("var_x"), F.lit(y).alias("var_y"), F.col(f"`{a}|{b}`").alias("r"))
               for a, b in pairs for x, y in sorted({(a, b), (b, a)})]
    return wide.select(F.inline(F.array(*entries)))


def corr_within_site(df: DataFrame, variables: list[str]) -> DataFrame:
    """Mean over sites of the per-site daylight correlation."""
    per = day_observed(df).groupBy("site_id").agg(*[pearson("power", v).alias(v) for v in variables])
    return _long(per.agg(*[F.avg(v).alias(v) for v in variables]), [], variables, "variable", "mean_r")


def hourly_overlay(df: DataFrame, by: list[str], ts: str = "timestamp") -> DataFrame:
    """Hourly mean of observed power and of the prediction, every hour from a series' first to its last; empty hours are null."""
    means = df.groupBy(*by, floor_hour(ts).alias("hour_ts")).agg(
        F.avg("power").alias("actual"), F.avg("prediction").alias("predicted"))
    spans = means.groupBy(*by).agg(F.min("hour_ts").alias("_first"), F.max("hour_ts").alias("_last"))
    hours = spans.select(*by, F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 HOUR"))).alias("hour_ts"))
    return null_safe_join(hours, means, [*by, "hour_ts"], "left")


def daily_by_site(df: DataFrame, by: list[str], ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*by, "site_id", floor_day(ts).alias("day")).agg(
        F.avg("power").alias("actual"), F.avg("prediction").alias("predicted"))


def daily_outer(actual: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of separately kept daily actuals and predictions."""
    return actual.join(predicted, keys, "full_outer")


def residual_histogram(df: DataFrame, by: list[str], low: float = -10.0, width: float = 0.5, bins: int = 40) -> DataFrame:
    binned = df.select(*by, histogram_bin(signed_error(), low, width, bins).alias("bin")).where(F.col("bin").isNotNull())
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "left_edge", F.col("bin") * F.lit(width) + F.lit(low))


def power_describe(df: DataFrame) -> DataFrame:
    """Median, mean, p99, maximum and share below 1 of observed daylight power."""
    day = day_observed(df)
    q = exact_quantiles(day, [], "power", {"median_power": 0.5, "p99_power": 0.99})
    facts = day.agg(F.count(F.lit(1)).alias("n"), F.avg("power").alias("mean_power"), F.max("power").alias("max_power"),
                    F.avg((F.col("power") < 1).cast("double")).alias("share_below_1"))
    median, p99 = (q.select(c).scalar() for c in ("median_power", "p99_power"))
    return facts.withColumns({"median_power": median, "p99_power": p99})


def twilight_share(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    night = night_observed(df)
    return night.agg(
        F.count(F.lit(1)).alias("n_night_observed"),
        (F.avg(F.hour(ts).between(*TWILIGHT_HOURS).cast("double")) * 100.0).alias("twilight_pct"))


def monthly_energy(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col("power").isNotNull()).groupBy(month_key(ts).alias("month")).agg(
        (F.sum("power") / 1000.0).alias("energy_mwh"))


def monthly_energy_extrema(df: DataFrame) -> DataFrame:
    def pick(how, sign: int) -> Column:
        return how("month", F.struct(F.round("energy_mwh", 9), F.col("month")))

    m = monthly_energy(df)
    return m.agg(pick(F.max_by, 1).alias("best_month"), pick(F.min_by, 1).alias("worst_month"),
                 F.max("energy_mwh").alias("best_mwh"), F.min("energy_mwh").alias("worst_mwh"))


def seasonality(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col("power").isNotNull()).groupBy(F.month(ts).alias("month")).agg(F.avg("power").alias("mean_power"))


def site_means_ranked(df: DataFrame, sites: DataFrame, n: int | None = None) -> DataFrame:
    """Mean daylight power and count per site with its capacity, best first."""
    means = day_observed(df).groupBy("site_id").agg(F.avg("power").alias("mean_power"), F.count(F.lit(1)).alias("n"))
    order = [F.round("mean_power", 9).desc(), F.col("site_id")]
    ranked = means.orderBy(*order).limit(n) if n else means
    out = ranked.join(sites.select("site_id", "capacity_kwp"), "site_id", "left")
    return out.orderBy(*order)


def daily_energy_top_site(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Daily energy of the site with the highest mean daylight power."""
    means = day_observed(df).groupBy("site_id").agg(F.avg("power").alias("m"))
    best = means.agg(F.min_by("site_id", F.struct(-F.round("m", 9), F.col("site_id"))).alias("s")).scalar()
    return df.where((F.col("site_id") == best) & F.col("power").isNotNull()).groupBy(
        "site_id", floor_day(ts).alias("day")).agg(F.sum("power").alias("energy"))


def sites_by_missing(df: DataFrame) -> DataFrame:
    """Missing share per site and the bands it falls in."""
    per = df.groupBy("site_id").agg((F.avg(F.col("power").isNull().cast("double")) * 100.0).alias("missing_pct"))
    return per.withColumn("band", F.when(F.col("missing_pct") == 0, "complete").when(F.col("missing_pct") > 90, "dead")
                          .when(F.col("missing_pct") > 50, "sparse").otherwise("partial"))


def months_with_weather_gaps(df: DataFrame, columns: list[str], threshold: float = 80.0, ts: str = "timestamp") -> DataFrame:
    per = df.groupBy(month_key(ts).alias("month")).agg(
        *[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in columns])
    worst = F.greatest(*[F.col(c) for c in columns])
    return per.select("month", worst.alias("max_missing_pct")).where(F.col("max_missing_pct") > threshold)
