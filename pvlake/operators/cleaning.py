"""Typing and nulling rules. Only exact duplicates are ever removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

# fixed values: accepted timestamp layouts, tried in this order
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
)
LOG_COLUMNS = ("dataset", "operation", "rows_affected", "detail")


def parsed_timestamp(c: Column | str, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """Text in any accepted layout to TIMESTAMP_NTZ; anything else is null."""
    c = F.col(c) if isinstance(c, str) else c
    tries = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def parse_timestamps(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Type a text timestamp column; frames without one pass unchanged."""
    if ts not in df.columns or not isinstance(df.schema[ts].dataType, T.StringType):
        return df
    return df.withColumn(ts, parsed_timestamp(ts))


def coerce_numeric(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Type text columns as numbers; failures and NaN become null."""
    present = [c for c in columns if c in df.columns]
    typed = df.withColumns({c: F.col(c).try_cast(kind) for c in present})
    return S.nan_to_null(typed)


def null_impossible(df: DataFrame, rules: dict[str, S.Rule] | None = None) -> DataFrame:
    """Null readings that break a rule; every row survives."""
    rules = rules or S.RULES
    return df.withColumns({
        c: F.when(~broken(F.col(c)), F.col(c)) for c, (_, broken) in rules.items() if c in df.columns
    })


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def cleaning_counts(raw: DataFrame, dataset: str, numeric: list[str], ts: str = "timestamp",
                    rules: dict[str, S.Rule] | None = None) -> DataFrame:
    """The cleaning log of one raw table: one row per operation that changed something.

    All counters of the typing and nulling rules come from a single aggregate over
    the raw rows; duplicates add one hash aggregate keyed by the whole row.
    """
    rules = rules or S.RULES
    typed = coerce_numeric(parse_timestamps(raw, ts), numeric)
    before = raw.select(*[F.col(c).alias(f"raw_{c}") for c in raw.columns],
                        *[typed_column(raw, c, numeric, ts).alias(c) for c in raw.columns])
    counters: dict[str, tuple[Column, str]] = {}
    if ts in raw.columns:
        counters["coerce_unparsable_timestamps_to_null"] = (
            F.count_if(F.col(f"raw_{ts}").isNotNull() & F.col(ts).isNull()), "")
    for c in numeric:
        if c in raw.columns and isinstance(raw.schema[c].dataType, T.StringType):
            counters[f"coerce_numeric:{c}"] = (F.count_if(F.col(f"raw_{c}").isNotNull() & F.col(c).isNull()), "")
    counts = _unpivot_counts(before, counters, dataset)

    distinct = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("_n"))
    present = {c: rule for c, rule in rules.items() if c in typed.columns}
    after: dict[str, tuple[Column, str]] = {
        "drop_exact_duplicate_rows": (F.sum(F.col("_n") - 1), ""),
        **{f"null_impossible:{name}": (F.count_if(broken(F.col(c))), f"column={c}")
           for c, (name, broken) in present.items()},
    }
    later = _unpivot_counts(distinct, after, dataset)
    return counts.unionByName(later).where(F.col("rows_affected") > 0)


def typed_column(raw: DataFrame, c: str, numeric: list[str], ts: str) -> Column:
    text = isinstance(raw.schema[c].dataType, T.StringType)
    if c == ts and text:
        return parsed_timestamp(c)
    if c in numeric:
        number = F.col(c).try_cast("double")
        return F.when(~F.isnan(number), number)
    return F.col(c)


def _unpivot_counts(df: DataFrame, counters: dict[str, tuple[Column, str]], dataset: str) -> DataFrame:
    wide = df.agg(*[expr.alias(f"c{i}") for i, (expr, _) in enumerate(counters.values())])
    entries = F.array(*[
        F.struct(F.lit(name).alias("operation"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("rows_affected"),
                 F.lit(detail).alias("detail"))
        for i, (name, (_, detail)) in enumerate(counters.items())
    ])
    return wide.select(F.inline(entries)).withColumn("dataset", F.lit(dataset)).select(*LOG_COLUMNS)
