"""Data-quality checks: pure aggregates, nothing is changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.clock import DAY_US, SLOT_US, from_micros, micros, month_key
from ..functions.stats import histogram_bin, pct_missing
from ..session import cut_lineage
from .joins import join_small
from .quantiles import exact_quantiles


def duplicate_keys(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Rows in duplicated keys and the number of groups they touch."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return repeated.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("duplicate_key_rows"),
        F.countDistinct(group).alias("affected_groups"),
    )


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unchanged, failing at run time when a key repeats.

    The check is a plan, not an extra job: a time look-up on a table with repeated
    keys would silently pick one of the copies.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).limit(1)
    verdict = repeated.agg(F.count(F.lit(1)).alias("bad")).select(
        F.assert_true(F.col("bad") == 0, f"repeated key ({', '.join(keys)})").isNull().alias("ok"))
    return df.where(verdict.scalar())


def gap_report(df: DataFrame, group: str, ts: str = "timestamp", step_us: int = SLOT_US) -> DataFrame:
    """Expected and missing grid slots per group between its first and last row.

    The grid starts at the group's first timestamp; off-grid rows count as actual
    rows but fill no slot. Rows are counted per phase of the grid first, so a large
    group is combined map-side and never joined or gathered.
    """
    rows = df.where(F.col(ts).isNotNull()).select(group, micros(ts).alias("_us")).distinct()
    phases = rows.groupBy(group, F.pmod(F.col("_us"), F.lit(step_us)).alias("_phase")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    per_group = phases.groupBy(group).agg(
        (F.floor((F.max("_hi") - F.min("_lo")) / F.lit(step_us)) + 1).alias("expected_slots"),
        F.sum("_n").alias("actual_rows"),
        F.min_by("_n", "_lo").alias("_on_grid"),
    )
    missing = F.col("expected_slots") - F.col("_on_grid")
    return per_group.select(
        group, "expected_slots", "actual_rows", missing.alias("missing_slots"),
        (missing * 100.0 / F.col("expected_slots")).alias("missing_pct"),
    )


def expected_grid(df: DataFrame, group: str, ts: str = "timestamp", step_us: int = SLOT_US) -> DataFrame:
    """Every grid slot of every group, generated day by day so no row holds a whole series."""
    us = micros(ts)
    bounds = df.groupBy(group).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    step = F.lit(step_us).cast("long")
    per_day = F.lit((DAY_US // step_us) * step_us).cast("long")
    days = bounds.withColumn("_day", F.explode(F.sequence("_lo", "_hi", per_day)))
    last = F.least(F.col("_hi"), F.col("_day") + per_day - step)
    slots = days.select(group, F.explode(F.sequence(F.col("_day"), last, step)).alias("_slot"))
    return slots.select(group, from_micros("_slot").alias(ts))


def missing_slots(df: DataFrame, group: str, ts: str = "timestamp") -> DataFrame:
    """Grid slots that have no row."""
    return expected_grid(df, group, ts).join(df.select(group, ts), [group, ts], "left_anti")


def _long(df: DataFrame, keys: list[str], columns: list[str], label: str, value: str, of) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias(label), of(c).alias(value)) for c in columns])
    return df.select(*keys, F.inline(entries))


def missing_by_variable(df: DataFrame) -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    out = _long(wide, ["_n"], df.columns, "variable", "n_missing", F.col)
    return out.select("variable", "n_missing", F.try_divide(F.col("n_missing") * 100.0, F.col("_n")).alias("missing_pct"))


def missing_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Missing share of each variable per group, only groups with any gap."""
    per = df.groupBy(group).agg(*[pct_missing(c).alias(f"{c}_pct") for c in columns])
    return per.where(F.greatest(*[F.col(f"{c}_pct") for c in columns], F.lit(0.0)) > 0)


def missing_by_month(df: DataFrame, columns: list[str], ts: str = "timestamp") -> DataFrame:
    """Long form ``month, variable, missing_pct`` with zero shares left out."""
    per = df.groupBy(month_key(ts).alias("month")).agg(*[pct_missing(c).alias(c) for c in columns])
    return _long(per, ["month"], columns, "variable", "missing_pct", F.col).where(F.col("missing_pct") > 0)


def impossible_values(df: DataFrame, rules: dict[str, S.Rule] | None = None, ts: str = "timestamp") -> DataFrame:
    """Findings per broken rule with count and range, plus unreadable timestamps."""
    present = {c: r for c, r in (rules or S.RULES).items() if c in df.columns}
    aggregates: list[Column] = []
    entries: list[Column] = []
    null = F.lit(None).cast("double")

    def entry(rule: Column, column: Column, count: Column, low: Column, high: Column) -> Column:
        return F.struct(rule.alias("rule"), column.alias("column_name"), count.alias("n"),
                        low.alias("min_value"), high.alias("max_value"))

    for i, (c, (name, broken)) in enumerate(present.items()):
        bad = F.when(broken(F.col(c)), F.col(c).cast("double"))
        aggregates += [F.count(bad).alias(f"n{i}"), F.min(bad).alias(f"lo{i}"), F.max(bad).alias(f"hi{i}")]
        entries.append(entry(F.lit(name), F.lit(c), F.col(f"n{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")))
    if ts in df.columns:
        aggregates.append(F.count_if(F.col(ts).isNull()).alias("nts"))
        entries.append(entry(F.lit("invalid_timestamps"), F.lit(ts), F.col("nts"), null, null))
    return df.agg(*aggregates).select(F.inline(F.array(*entries))).where(F.col("n") > 0)


def iqr_outliers(df: DataFrame, sites: DataFrame, fence: float = 3.0) -> DataFrame:
    """Daylight readings above ``Q3 + fence * IQR`` per site, next to the site's capacity."""
    day = df.where(F.col("is_daylight") & F.col("power").isNotNull()).select("site_id", "power")
    quartiles = exact_quantiles(day, ["site_id"], "power", {"q1": 0.25, "q3": 0.75})
    upper = F.col("q3") + (F.col("q3") - F.col("q1")) * fence
    limits = quartiles.select("site_id", "q1", "q3", upper.alias("upper_fence"))
    counted = join_small(day, limits, ["site_id"]).groupBy("site_id", "q1", "q3", "upper_fence").agg(
        F.count(F.lit(1)).alias("n_daylight"),
        F.count_if(F.col("power") > F.col("upper_fence")).alias("n_outliers"),
        F.max("power").alias("max_power"),
    )
    return counted.join(sites.select("site_id", "capacity_kwp"), "site_id", "left")


def availability(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Share of grid slots with a row and share of daylight rows with a reading, per site."""
    us = micros(ts)
    lit_rows = F.when(F.col("is_daylight"), F.col("power").isNotNull().cast("double"))
    expected = F.floor((F.max(us) - F.min(us)) / F.lit(SLOT_US)) + 1
    return df.groupBy("site_id").agg(
        (F.count(F.lit(1)) * 100.0 / expected).alias("row_availability_pct"),
        (F.avg(lit_rows) * 100.0).alias("daylight_power_obs_pct"),
    )


def site_summary(df: DataFrame, sites: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One card per site that has rows: span, availability and daylight output."""
    us = micros(ts)
    lit = F.when(F.col("is_daylight"), F.col("power"))
    expected = F.floor((F.max(us) - F.min(us)) / F.lit(SLOT_US)) + 1
    facts = df.groupBy("site_id").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"), expected.alias("expected_slots"),
        (F.count(F.lit(1)) * 100.0 / expected).alias("row_availability_pct"),
        (F.count("power") * 100.0 / F.count(F.lit(1))).alias("power_observed_pct"),
        F.avg(lit).alias("mean_daylight_kwh"), F.max(lit).alias("max_daylight_kwh"),
    )
    dims = sites.select("site_id", "campus_id", "latitude", "longitude", "capacity_kwp")
    return dims.join(facts, "site_id")


def power_histogram(df: DataFrame, low: float = 0.0, width: float = 0.5, bins: int = 20) -> DataFrame:
    """Daylight power per fixed bin, for every site and for all sites together."""
    binned = (
        df.where(F.col("is_daylight") & F.col("power").isNotNull())
        .select("site_id", histogram_bin("power", low, width, bins).alias("bin"))
        .where(F.col("bin").isNotNull())
    )
    counted = binned.groupBy("site_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_site = counted.select(F.lit("SITE").alias("scope"), F.col("site_id"), "bin", "n")
    total = counted.groupBy("bin").agg(F.sum("n").alias("n")).select(
        F.lit("ALL").alias("scope"), F.lit(None).cast("long").alias("site_id"), "bin", "n")
    edge = F.col("bin") * F.lit(width) + F.lit(low)
    return per_site.unionByName(total).withColumn(
        "label", F.format_string("%.1f-%.1f", edge, edge + F.lit(width)))


def missingness_timeline(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Share of each month's expected grid slots without a row, over all sites.

    Expected slots per site and month come from interval arithmetic on the month
    borders, so the grid itself is never generated.
    """
    us = micros(ts)
    bounds = df.groupBy("site_id").agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    first = F.trunc(from_micros("_lo").cast("date"), "month")
    last = F.trunc(from_micros("_hi").cast("date"), "month")
    months = bounds.withColumn("_m", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    begin = micros(F.col("_m").cast("timestamp_ntz"))
    end = micros(F.add_months("_m", 1).cast("timestamp_ntz"))
    step = F.lit(SLOT_US)
    # grid slots lo + k * step in [begin, end) and not after hi
    low = F.greatest(F.lit(0), F.ceil((begin - F.col("_lo")) / step))
    high = F.least(F.floor((F.col("_hi") - F.col("_lo")) / step), F.ceil((end - F.col("_lo")) / step) - 1)
    expected = months.groupBy(F.date_format("_m", "yyyy-MM").alias("month")).agg(
        F.sum(high - low + 1).cast("long").alias("expected_slots"))
    actual = df.groupBy(month_key(ts).alias("month")).agg(F.count(F.lit(1)).alias("actual_slots"))
    joined = expected.join(actual, "month", "left").withColumn(
        "actual_slots", F.coalesce("actual_slots", F.lit(0).cast("long")))
    return joined.where(F.col("expected_slots") > 0).withColumn(
        "missing_slot_pct", (F.lit(1.0) - F.col("actual_slots") / F.col("expected_slots")) * 100.0)


def quality_rollup(gen: DataFrame, weather: DataFrame, log: DataFrame) -> DataFrame:
    """One card ``metric, value`` from the separate checks; generation is derived once and written for all of them."""
    gen = cut_lineage(gen)
    gaps = gap_report(gen, "site_id")
    parts = [
        duplicate_keys(gen, ["site_id", "timestamp"], "site_id").select(
            F.lit("duplicate_keys").alias("metric"), F.col("duplicate_key_rows").cast("double").alias("value")),
        impossible_values(gen).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("impossible_rules_broken").alias("metric"), "value"),
        gaps.agg(F.sum("missing_slots").alias("m"), F.sum("expected_slots").alias("e"),
                 F.count(F.lit(1)).alias("g")).select(F.inline(F.array(
                     F.struct(F.lit("missing_slots").alias("metric"), F.col("m").cast("double").alias("value")),
                     F.struct(F.lit("missing_slot_pct").alias("metric"), F.try_divide(F.col("m") * 100.0, F.col("e")).alias("value")),
                     F.struct(F.lit("groups_checked").alias("metric"), F.col("g").cast("double").alias("value"))))),
        gen.agg(pct_missing("power").alias("value")).select(
            F.lit("power_missing_pct").alias("metric"), "value"),
        missing_by_variable(weather.select(*S.available_weather(weather))).select(
            F.concat(F.lit("weather_missing_pct:"), "variable").alias("metric"), F.col("missing_pct").alias("value")),
        log.agg(F.count(F.lit(1)).cast("double").alias("a"),
                F.coalesce(F.sum("rows_affected"), F.lit(0)).cast("double").alias("b")).select(F.inline(F.array(
                    F.struct(F.lit("cleaning_operations").alias("metric"), F.col("a").alias("value")),
                    F.struct(F.lit("cleaned_values").alias("metric"), F.col("b").alias("value"))))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
