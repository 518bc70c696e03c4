"""Ordered work on long series without giving one series to one task.

A site (or campus) may hold a large part of all rows, so no window here is
partitioned by the site alone. A series is cut into fixed chunks of its ordering
value and windows run inside ``(key, chunk)``:

* :func:`with_halo` copies the last stretch of a chunk into the next one, which
  is exact for every look-back of bounded length (lags, rolling statistics).
* :func:`chunk_context` summarises every chunk into one row and carries running
  facts (rows so far, last timestamp) over that much smaller table, which is
  exact for unbounded look-back (row positions, previous row, gap filling).

No row is lost: a null ordering value has its own chunk at the end of its series, and a null
key is a series like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY_US
from .joins import null_safe_join

CHUNK = "_chunk"
CORE = "_core"
WEEK_US = 7 * DAY_US
LAST_CHUNK = 2**62  # of rows with a null ordering value
BEFORE = Window.unboundedPreceding


def chunk_of(order: Column | str, width: int) -> Column:
    """The chunk of an ordering value; rows without one have a chunk of their own, after all others."""
    order = F.col(order) if isinstance(order, str) else order
    return F.coalesce(order - F.pmod(order, F.lit(width).cast("long")), F.lit(LAST_CHUNK).cast("long"))


def with_halo(df: DataFrame, order: str, width: int, halo: int) -> DataFrame:
    """Tag rows with their chunk and copy each chunk's last ``halo`` units into the next.

    Copies have ``_core`` false; a caller computes its window over
    ``(key, _chunk)`` and then keeps the core rows.
    """
    if halo > width:
        raise ValueError("a halo must not be longer than a chunk")
    own = chunk_of(order, width)
    following = chunk_of(F.col(order) + F.lit(halo).cast("long"), width)
    homes = F.when(own == following, F.array(own)).otherwise(F.array(own, following))
    return df.withColumn(CHUNK, F.explode(homes)).withColumn(CORE, F.col(CHUNK) == own)


def halo_window(keys: list[str], order: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(CORE).drop(CHUNK, CORE)


def chunk_context(df: DataFrame, keys: list[str], order: str, width: int,
                  carried: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """One row per ``(keys, _chunk)``: rows before it, rows in all, and carried facts.

    ``carried`` maps a name to ``(aggregate over the chunk, direction)``; direction
    ``"last"`` brings the latest non-null value of earlier chunks forward and
    ``"next"`` the earliest non-null value of later chunks back.
    """
    carried = carried or {}
    sizes = (
        df.withColumn(CHUNK, chunk_of(order, width))
        .groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_rows"), *[agg.alias(name) for name, (agg, _) in carried.items()])
    )
    series = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = series.rowsBetween(BEFORE, -1)
    later = series.rowsBetween(1, Window.unboundedFollowing)
    columns = {
        "_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        "_rows_total": F.sum("_rows").over(Window.partitionBy(*keys)),
    }
    for name, (_, direction) in carried.items():
        columns[name] = (
            F.last(name, ignorenulls=True).over(earlier)
            if direction == "last"
            else F.first(name, ignorenulls=True).over(later)
        )
    return sizes.withColumns(columns).drop("_rows")


def add_position(df: DataFrame, keys: list[str], order: str, width: int = 4 * WEEK_US,
                 position: str = "position", total: str = "n_rows") -> DataFrame:
    """1-based row position inside each series and the series length; rows without an ordering value come last."""
    context = chunk_context(df, keys, order, width)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order)
    return (
        df.withColumn(CHUNK, chunk_of(order, width))
        .transform(null_safe_join, context, [*keys, CHUNK])
        .withColumn(position, F.col("_rows_before") + F.row_number().over(inside))
        .withColumnRenamed("_rows_total", total)
        .drop(CHUNK, "_rows_before")
    )


def add_previous(df: DataFrame, keys: list[str], order: str, width: int = 4 * WEEK_US,
                 name: str = "previous") -> DataFrame:
    """The ordering value of the row before, across chunk borders."""
    context = chunk_context(df, keys, order, width, {"_carry": (F.max(order), "last")})
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order)
    return (
        df.withColumn(CHUNK, chunk_of(order, width))
        .transform(null_safe_join, context.select(*keys, CHUNK, "_carry"), [*keys, CHUNK])
        .withColumn(name, F.when(F.col(order).isNotNull(), F.coalesce(F.lag(order).over(inside), F.col("_carry"))))
        .drop(CHUNK, "_carry")
    )


def global_position(df: DataFrame, order: str, bucket: Column, position: str = "position",
                    total: str | None = None) -> DataFrame:
    """1-based position over the whole table for a ``bucket`` that never decreases with ``order``."""
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket: the ordering over all rows is never sorted in one task
    running = sizes.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    out = (
        null_safe_join(keyed, running, ["_bucket"])
        .withColumn(position, F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy(order)))
        .drop("_bucket", "_before")
    )
    return out.withColumnRenamed("_total", total) if total else out.drop("_total")
