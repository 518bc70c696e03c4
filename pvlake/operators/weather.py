"""Campus weather: short-gap filling and the join onto site rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.clock import micros
from .timeline import CHUNK, WEEK_US, chunk_of

MAX_FILLED_STEPS = 2


def interpolate_short_gaps(df: DataFrame, columns: list[str] | None = None, *, key: str = "campus_id",
                           ts: str = "timestamp", limit: int = MAX_FILLED_STEPS,
                           chunk_us: int = 4 * WEEK_US) -> DataFrame:
    """Time-linear filling of the first ``limit`` missing readings of every gap.

    Leading gaps stay null; a gap at the end repeats the last reading for up to
    ``limit`` rows; of a long gap only the first rows are filled, on the line to its
    far end. The neighbours are searched inside ``(key, chunk)`` and, when they
    lie in another chunk, come from the per-chunk summary.
    """
    columns = columns if columns is not None else [c for c in S.INTERPOLATED if c in df.columns]
    if not columns:
        return df
    inside = Window.partitionBy(key, CHUNK).orderBy("_us")
    ranked = (
        df.withColumn("_us", micros(ts))
        .withColumn(CHUNK, chunk_of("_us", chunk_us))
        .withColumn("_in", F.row_number().over(inside))
    )
    context = _readings_around(ranked, key, columns)
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.rowsBetween(0, Window.unboundedFollowing)
    placed = ranked.join(context, [key, CHUNK]).withColumn("_pos", F.col("_rows_before") + F.col("_in"))

    neighbours: dict[str, Column] = {}
    for c in columns:
        here = _reading(c, "_pos")
        neighbours[f"_{c}_prev"] = F.coalesce(F.last(here, ignorenulls=True).over(sofar), F.col(f"_{c}_last"))
        neighbours[f"_{c}_next"] = F.coalesce(F.first(here, ignorenulls=True).over(ahead), F.col(f"_{c}_first"))
    filled: dict[str, Column] = {}
    for c in columns:
        before, after = F.col(f"_{c}_prev"), F.col(f"_{c}_next")
        place = (F.col("_us") - before["us"]) / (after["us"] - before["us"])
        line = before["v"] + (after["v"] - before["v"]) * place
        near = F.col("_pos") - before["pos"] <= limit
        filled[c] = F.coalesce(F.col(c), F.when(near & after.isNull(), before["v"]).when(near, line))
    return placed.withColumns(neighbours).withColumns(filled).select(*df.columns)


def _reading(c: str, position: str) -> Column:
    """Time, value and row position of a non-null reading."""
    return F.when(F.col(c).isNotNull(), F.struct(
        F.col("_us").alias("us"), F.col(c).alias("v"), F.col(position).cast("long").alias("pos")))


def _readings_around(ranked: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per chunk: rows before it, the last reading before it and the first reading after it.

    One row per chunk, so the running windows over a series stay small.
    """
    ends = ranked.groupBy(key, CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max(_reading(c, "_in")).alias(f"_{c}_last") for c in columns],
        *[F.min(_reading(c, "_in")).alias(f"_{c}_first") for c in columns],
    )
    series = Window.partitionBy(key).orderBy(CHUNK)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    later = series.rowsBetween(1, Window.unboundedFollowing)
    counted = ends.withColumn("_rows_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    # in-chunk positions become positions in the series
    shifted = counted.withColumns({
        f"_{c}_{side}": F.when(F.col(f"_{c}_{side}").isNotNull(), F.struct(
            F.col(f"_{c}_{side}.us").alias("us"), F.col(f"_{c}_{side}.v").alias("v"),
            (F.col(f"_{c}_{side}.pos") + F.col("_rows_before")).alias("pos")))
        for c in columns for side in ("last", "first")
    })
    return shifted.withColumns({
        **{f"_{c}_last": F.last(f"_{c}_last", ignorenulls=True).over(earlier) for c in columns},
        **{f"_{c}_first": F.first(f"_{c}_first", ignorenulls=True).over(later) for c in columns},
    }).drop("_rows")


def filled_counts(before: DataFrame, after: DataFrame, columns: list[str], *, keys=("campus_id", "timestamp")) -> DataFrame:
    """Cleaning-log rows for the filling: null readings before minus after, per variable."""
    def nulls(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("variable"), F.col(c).alias(name)) for c in columns])))

    both = nulls(before, "b").join(nulls(after, "a"), "variable")
    return both.select(
        F.lit("weather").alias("dataset"),
        F.concat(F.lit("interpolate_weather_"), "variable").alias("operation"),
        (F.col("b") - F.col("a")).alias("rows_affected"),
        F.lit(f"limit={MAX_FILLED_STEPS} steps").alias("detail"),
    )


def join_weather(rows: DataFrame, weather: DataFrame, keys=("campus_id", "timestamp"), salts: int = 1) -> DataFrame:
    """Campus weather onto every site row. A repeated weather key fails at once, so rows never multiply.

    The key is (campus, slot), so even a campus with a third of all sites is spread
    over as many tasks as there are slots; a slot holds one row per site of a
    campus. ``salts`` > 1 splits such a slot further when a campus is very wide.
    """
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys))  # dealt and sorted like the join
    repeated = F.when(same > 1, F.raise_error(F.lit("weather has two rows for one place and time"))).cast("int")
    weather = weather.withColumn("_repeated", repeated).where(F.col("_repeated").isNull()).drop("_repeated")
    if salts <= 1:
        return rows.join(weather, list(keys), "left")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("site_id"), F.lit(salts)))
    right = weather.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
