"""Small set and reshape helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_small


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts by column name; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return join_small(df, keys.select(*on).distinct(), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return join_small(df, keys.select(*on).distinct(), on, "left_anti")


def unpivot(df: DataFrame, keys: list[str], values: list[str], label: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(v).cast("double") for v in values]).unpivot(keys, values, label, value)


def pivot(df: DataFrame, keys: list[str], label: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide for a known list of labels, so no pass is spent on finding them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == n, F.col(value))).alias(n) for n in names])


def index_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()
