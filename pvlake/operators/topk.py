"""Top-k reports that stay distributed when one group is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  spread: list[str], rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per group in ``order``.

    Rows are first ranked in ``SALTS`` slices of a group (by a hash of the ``spread``
    columns, which should identify a row), so a group never reaches one task with
    more than ``SALTS * k`` rows, however many tasks have read it.
    """
    slice_ = Window.partitionBy(*keys, "_salt").orderBy(*order)
    out = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS))).withColumn(
        "_rank", F.row_number().over(slice_)).where(F.col("_rank") <= k).drop("_salt", "_rank")
    name = rank or "_rank"
    whole = Window.partitionBy(*keys).orderBy(*order)
    out = out.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= k)
    return out if rank else out.drop(name)
