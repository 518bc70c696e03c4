"""Sinks. Overwrites are idempotent, so a lost job can simply run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITION_KEYS = ("site_id", "year", "month")


def add_partition_columns(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def write_partitioned(df: DataFrame, path: str, keys: tuple[str, ...] = PARTITION_KEYS,
                      order: tuple[str, ...] = ("site_id", "timestamp"), clustered: bool = False) -> None:
    """Partitioned Parquet, sorted by site and time.

    Rows are shuffled by the directory keys, one file per directory: month is among
    them, so a large site is spread over as many tasks as it has months. A
    ``clustered`` table, such as features fresh from windows over (site, chunk of
    weeks), is written as it lies: two or three files per directory, no shuffle.
    """
    ready = df if all(k in df.columns for k in keys) else add_partition_columns(df)
    placed = ready if clustered else ready.repartition(*keys)
    (
        placed.sortWithinPartitions(*dict.fromkeys([*keys, *order]))
        .write.mode("overwrite").partitionBy(*keys).parquet(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def rows_to_json(df: DataFrame, ts_format: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    """One JSON document per row: nulls kept, timestamps in ISO form without a zone."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": ts_format, "timestampFormat": ts_format}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("json"))
