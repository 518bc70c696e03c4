"""Small aggregate expressions with null-safe rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def share(condition: Column) -> Column:
    """Fraction of rows where ``condition`` holds; null counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def pct_missing(c: Column | str) -> Column:
    return F.avg(col(c).isNull().cast("double")) * 100.0


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over complete pairs; null when a side is constant.

    ``corr`` raises on zero variance under ANSI rules, hence the guarded form.
    """
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def signed_error(pred: Column | str = "prediction", truth: Column | str = "power") -> Column:
    return col(pred) - col(truth)


def histogram_bin(value: Column | str, low: float, width: float, bins: int) -> Column:
    """0-based bin of a fixed histogram: right edge closed in the last bin, outside is null."""
    value = col(value)
    high = low + width * bins
    index = F.floor((value - F.lit(low)) / F.lit(width)).cast("int")
    return F.when((value >= low) & (value < high), index).when(value == high, F.lit(bins - 1))
