"""Profiles of unknown tables: cadence, keys, categories, candidate columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import micros
from ..functions.stats import pct_missing
from ..session import cut_lineage
from .cleaning import parsed_timestamp
from .quantiles import exact_quantiles
from .timeline import WEEK_US, add_previous

# fixed values: name patterns of column roles and units
TIMESTAMP_NAME = r"(time|timestamp|date|datetime|utc|local)"
SITE_NAME = r"(site|plant|station|system|asset|location|loc)_?(id|name|code)?"
TARGET_NAME = r"(power|generation|generated|energy|yield|output|production|pv)"
ID_SUFFIX = r"(key|id|code|num)$"
UNIT_IN_NAME = (
    r"[\(_\-\s]("
    r"k?W(?:h)?|M?Wh|mwh|kw|w|"
    r"celsius|fahrenheit|deg[cfk]|c|f|"
    r"kpa|hpa|pa|mbar|bar|mm|cm|km|h|kmh|km/h|mph|ms|deg|%"
    r")[\)\]_\-\s]?$"
)
MIN_PARSE_RATE = 0.9
MAX_CATEGORIES = 50
SKETCH_ERROR = 0.05
MAX_ID_CANDIDATES = 500


def _is(t: T.DataType, *kinds) -> bool:
    return isinstance(t, kinds)


def column_roles(df: DataFrame, table: str) -> DataFrame:
    """Name-based role, unit and number of values of every column of a table."""
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in df.columns])
    name = F.col("column_name")
    unit = F.regexp_extract(name, f"(?i){UNIT_IN_NAME}", 1)
    return wide.select(F.inline(entries)).select(
        F.lit(table).alias("table_name"), "column_name", "n_values",
        name.rlike(f"(?i){TIMESTAMP_NAME}").alias("is_timestamp"),
        name.rlike(f"(?i){SITE_NAME}").alias("is_site"),
        name.rlike(f"(?i){TARGET_NAME}").alias("is_target"),
        name.rlike(f"(?i){ID_SUFFIX}").alias("has_id_suffix"),
        F.lower(F.nullif(unit, F.lit(""))).alias("unit"),
    )


def within_group_gaps(df: DataFrame, group: str, ts: str = "timestamp", chunk_us: int = 4 * WEEK_US) -> DataFrame:
    """``group, gap_us, n``: frequencies of the time between neighbouring rows of a group.

    Equal timestamps are counted first, so the ordered work is over distinct times
    and a repeated time adds zero gaps by arithmetic.
    """
    distinct = (
        df.where(F.col(ts).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, micros(ts).alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
    )
    linked = add_previous(distinct, [group], "_us", chunk_us, "_prev")
    gaps = F.array(
        F.when(F.col("_prev").isNotNull(), F.struct((F.col("_us") - F.col("_prev")).alias("gap_us"), F.lit(1).cast("long").alias("n"))),
        F.when(F.col("_n") > 1, F.struct(F.lit(0).cast("long").alias("gap_us"), (F.col("_n") - 1).alias("n"))),
    )
    return (
        linked.select(group, F.explode(F.array_compact(gaps)).alias("g"))
        .groupBy(group, F.col("g.gap_us").alias("gap_us")).agg(F.sum("g.n").alias("n"))
    )


def _mode(gap: str = "gap_us", n: str = "n") -> Column:
    """Most frequent gap, the shortest among equals."""
    return F.min_by(gap, F.struct(-F.col(n), F.col(gap)))


def sampling_frequency(gaps: DataFrame, group: str) -> DataFrame:
    """Median, modal, smallest and largest gap, with the share of modal and irregular gaps."""
    pooled = gaps.groupBy("gap_us").agg(F.sum("n").alias("n"))
    facts = pooled.agg(
        F.sum("n").alias("n_gaps"), _mode().alias("mode_us"), F.max("n").alias("_mode_n"),
        F.min("gap_us").alias("min_us"), F.max("gap_us").alias("max_us"))
    median = exact_quantiles(pooled, [], "gap_us", {"median_us": 0.5}, weight="n").select("median_us").scalar()
    share = F.try_divide(F.col("_mode_n").cast("double"), F.col("n_gaps"))
    return facts.select(
        "n_gaps", "mode_us", "min_us", "max_us", median.alias("median_us"),
        share.alias("mode_share"), (F.lit(1.0) - share).alias("irregular_share"))


def group_modes(gaps: DataFrame, group: str) -> DataFrame:
    return gaps.groupBy(group).agg(_mode().alias("mode_us"))


def quick_profile(df: DataFrame, ts: str = "timestamp", group: str = "site_id") -> DataFrame:
    """Rows, sites, campuses, span, cadence and missing target share in one row."""
    gaps = within_group_gaps(df, group, ts).groupBy("gap_us").agg(F.sum("n").alias("n"))
    cadence = gaps.agg(_mode().alias("m")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site_id").alias("n_sites"),
        F.countDistinct("campus_id").alias("n_campuses"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
        pct_missing("power").alias("target_missing_pct"),
    ).withColumn("_cadence", cadence).select(
        "*", F.when(F.col("_cadence") > 0, F.floor(F.col("_cadence") / F.lit(60_000_000))).alias("cadence_minutes")
    ).drop("_cadence")


def few_valued(df: DataFrame, limit: int, columns: list[str] | None = None) -> list[str]:
    """The columns that may have at most ``limit`` distinct values: one scan of mergeable sketches.

    A sketch only ever leaves out a column that it puts at twice the limit, twenty deviations off; all others are
    counted exactly afterwards.
    """
    columns = columns or df.columns
    row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), SKETCH_ERROR).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[str(i)] <= 2 * max(limit, 1) + 8]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, value, n`` of the given columns, null being a value: one scan, values combined before the shuffle."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct non-null values per column, one row per column that has any: one scan of the given columns."""
    found = value_counts(df, columns or df.columns).where(F.col("value").isNotNull())
    return found.groupBy("column_name").agg(F.count("value").alias("n_unique"))


def categorical_summary(df: DataFrame, limit: int = MAX_CATEGORIES) -> DataFrame:
    """Value counts of every column with at most ``limit`` distinct values; null is a value, but not counted as distinct.

    Only columns that a sketch can't rule out are counted, and the exact count decides.
    """
    counts = cut_lineage(value_counts(df, few_valued(df, limit)))
    unique = counts.groupBy("column_name").agg(F.count("value").alias("n_unique")).where(F.col("n_unique") <= limit)
    return counts.join(F.broadcast(unique), "column_name").select("column_name", "value", "n", "n_unique")  # a row per column


def duplicate_summary(df: DataFrame, group: str, ts: str) -> DataFrame:
    """Fully repeated rows and rows whose (group, time) key repeats."""
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("total_rows"), F.sum(F.col("_n") - 1).alias("fully_duplicated_rows"))
    keyed = df.groupBy(group, ts).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return whole.withColumn(
        "duplicated_key_rows", F.coalesce(keyed.agg(F.sum("_n").alias("k")).scalar(), F.lit(0)).cast("long"))


def target_candidates(df: DataFrame) -> DataFrame:
    """Range, mean and zero share of numeric columns whose name suggests the target."""
    names = [f.name for f in df.schema.fields if _is(f.dataType, T.NumericType) and re.search(TARGET_NAME, f.name, re.I)]
    return _numeric_facts(df, names)


def _numeric_facts(df: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, min_value double, max_value double, mean_value double, zero_fraction double")
    wide = df.agg(*[agg for c in names for agg in (
        F.min(c).cast("double").alias(f"{c}_a"), F.max(c).cast("double").alias(f"{c}_b"),
        F.avg(c).alias(f"{c}_c"), F.avg(F.coalesce((F.col(c) == 0).cast("double"), F.lit(0.0))).alias(f"{c}_d"))])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{c}_a").alias("min_value"), F.col(f"{c}_b").alias("max_value"),
        F.col(f"{c}_c").alias("mean_value"), F.col(f"{c}_d").alias("zero_fraction")) for c in names])))


def timestamp_candidates(df: DataFrame) -> DataFrame:
    """Columns of which at least 90 % of the values are (or parse as) timestamps, over all rows, and numeric columns named like one."""
    entries, aggregates = [], []
    for f in df.schema.fields:
        if _is(f.dataType, T.TimestampNTZType, T.TimestampType, T.DateType):
            parsed = F.col(f.name).cast("timestamp_ntz")
        elif _is(f.dataType, T.StringType):
            parsed = parsed_timestamp(f.name)
        elif _is(f.dataType, T.NumericType) and re.search(TIMESTAMP_NAME, f.name, re.I):
            parsed = None  # an epoch, perhaps: listed by its name, with nothing parsed
        else:
            continue
        if parsed is None:
            none = F.lit(None)
            entries.append(F.struct(F.lit(f.name).alias("column_name"), none.cast("double").alias("parse_success_rate"), F.lit(True).alias("matched_by_name"),
                                    none.cast("timestamp_ntz").alias("min_ts"), none.cast("timestamp_ntz").alias("max_ts"), F.lit(True).alias("_listed")))
            continue
        i = len(entries)
        aggregates += [
            F.try_divide(F.count(parsed).cast("double"), F.count(F.col(f.name))).alias(f"r{i}"),
            F.min(parsed).alias(f"a{i}"), F.max(parsed).alias(f"b{i}")]
        entries.append(F.struct(
            F.lit(f.name).alias("column_name"), F.col(f"r{i}").alias("parse_success_rate"),
            F.lit(bool(re.search(TIMESTAMP_NAME, f.name, re.I))).alias("matched_by_name"),
            F.col(f"a{i}").alias("min_ts"), F.col(f"b{i}").alias("max_ts"), F.lit(False).alias("_listed")))
    if not entries:
        return df.sparkSession.createDataFrame(
            [], "column_name string, parse_success_rate double, matched_by_name boolean, min_ts timestamp_ntz, max_ts timestamp_ntz")
    found = df.agg(F.count(F.lit(1)).alias("_n"), *aggregates).select(F.inline(F.array(*entries)))
    return found.where(F.col("_listed") | (F.col("parse_success_rate") >= MIN_PARSE_RATE)).drop("_listed")


def id_candidates(df: DataFrame) -> DataFrame:
    """Possible grouping columns with their cardinality; the finest plausible one is marked.

    A name match qualifies a column; others need at most 500 values and no fraction.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    named_columns = [c for c in df.columns if re.search(SITE_NAME, c, re.I)]
    few = few_valued(df, MAX_ID_CANDIDATES, [c for c in df.columns if c not in named_columns]) if len(named_columns) < len(df.columns) else []
    unique = distinct_counts(df, [c for c in df.columns if c in (*named_columns, *few)])
    floats = [f.name for f in df.schema.fields if _is(f.dataType, T.DoubleType, T.FloatType)]
    name = F.col("column_name")
    named, suffixed = name.rlike(f"(?i){SITE_NAME}"), name.rlike(f"(?i){ID_SUFFIX}")
    low = (F.col("n_unique") > 1) & (F.col("n_unique") <= F.greatest(F.lit(1000), F.floor(rows * 0.5)))
    found = unique.where(named | ((F.col("n_unique") <= MAX_ID_CANDIDATES) & ~name.isin(*floats, ""))).select(
        "column_name", "n_unique", named.alias("matched_by_name"), suffixed.alias("matched_by_id_suffix"),
        (low & (named | suffixed)).alias("plausible_id_column"))
    best = found.where("plausible_id_column").agg(
        F.min_by("column_name", F.struct(-F.col("n_unique"), F.col("column_name"))).alias("c")).scalar()
    return found.withColumn("is_finest", F.coalesce(F.col("column_name") == best, F.lit(False)))


def head_and_tail(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First and last rows of a profile."""
    first = df.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)
