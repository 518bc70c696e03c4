"""Linear models on sliding windows, fitted from lagged moments: no window is ever a row.

A window of L + 1 steps of C channels has K = (L + 1) * C inputs. Summed over *all* positions of a series, with zeros
beyond its ends, the K x K products of inputs depend on the difference of two steps only, so (L + 1) * C * C sums of
a channel times an earlier one hold them all. Positions that are no training windows (the first L, L beyond the
end, those without a target) are subtracted, each by its own products. Products with the target and plain sums
are lagged sums too. What a task holds is one chunk and these sums, whatever the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import micros
from ..operators.sequences import LOOKBACK, MASK
from ..operators.timeline import CORE, WEEK_US, add_position, halo_window, with_halo

CHUNK_ROWS = 4_096
LEAST_VARIANCE = 1e-10


@dataclass
class WindowRegression:
    """Coefficients by step (the last is the row itself) and channel."""

    channels: list[str]
    lookback: int
    coefficients: np.ndarray
    intercept: float
    n: int

    def predict(self, df: DataFrame, by: tuple[str, ...] = (), **options) -> DataFrame:
        """``site_id, by…, timestamp, target, prediction`` for every row with an observed target and a full look-back."""
        rows = _ordered(df, self.channels, self.lookback, by, **options)
        series, weights, channels, lookback, intercept = ["site_id", *by], self.coefficients.ravel(), self.channels, self.lookback, self.intercept
        schema = T.StructType([*[rows.schema[c] for c in (*series, "timestamp")], T.StructField("target", T.DoubleType()), T.StructField("prediction", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _chunks(batches):
                chunk = _Chunk(table, channels, lookback)
                core = table.filter(table.column(CORE)).filter(pa.array(chunk.valid))
                values = chunk.windows(chunk.valid) @ weights + intercept
                out = core.select([*series, "timestamp"]).append_column("target", core.column("target")).append_column("prediction", pa.array(values))
                yield from out.cast(pa.schema([*[out.schema.field(c) for c in out.schema.names]])).to_batches()

        return rows.mapInArrow(run, schema)


def _ordered(df: DataFrame, channels: list[str], lookback: int, by: tuple[str, ...], target: str = "power", ts: str = "timestamp",
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of each chunk of a series next to each other and in order, the chunk's look-back in front, its first row marked."""
    series = ["site_id", *by]
    placed = add_position(df.withColumn("_us", micros(ts)), series, "_us", 4 * WEEK_US, "_pos", "_total")
    split = with_halo(placed.withColumn("_pos", F.col("_pos").cast("long")), "_pos", max(chunk_rows, lookback), lookback)
    first = F.row_number().over(halo_window(series, "_pos")) == 1
    return split.select(*series, F.col(ts).alias("timestamp"), F.col(target).cast("double").alias("target"), "_pos", "_total", CORE, first.alias("_first"),
                        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in channels])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per chunk that has rows of its own; a chunk's rows follow each other and may spread over batches."""
    held: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        if table.column(CORE).to_numpy().any():  # else all are copies of the chunk before, which was a series' last
            yield table

    for batch in batches:
        starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False)).tolist()
        at = 0
        for start in starts:
            if start > at:
                held.append(batch.slice(at, start - at))
            if held:
                yield from whole()
            held, at = [], start
        held.append(batch.slice(at))
    if held:
        yield from whole()


class _Chunk:
    """A chunk's channels with zeros where the series has no row, and which of its positions are windows."""

    def __init__(self, table: pa.Table, channels: list[str], lookback: int):
        core = table.column(CORE).to_numpy()
        position, total = table.column("_pos").to_numpy()[core], int(table.column("_total")[0].as_py())
        values = np.column_stack([table.column(c).to_numpy() for c in channels])
        ahead = int((~core).sum())
        self.last = position[-1] == total
        self.z = np.ascontiguousarray(np.concatenate([np.zeros((lookback - ahead, len(channels))), values, np.zeros((lookback, len(channels)))]))
        self.lookback, self.n = lookback, len(position)
        target = table.column("target").to_numpy(zero_copy_only=False)[core].astype(float)
        self.valid = (position > lookback) & ~np.isnan(target)
        self.target = np.where(self.valid, target, 0.0)

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """The windows that end at chosen positions, flattened."""
        step = self.z.strides[0]
        wide = (self.lookback + 1) * self.z.shape[1]
        every = np.lib.stride_tricks.as_strided(self.z, (len(self.z) - self.lookback, wide), (step, self.z.strides[1]), writeable=False)
        return every[np.flatnonzero(chosen)]


def _sums(batches: Iterator[pa.RecordBatch], channels: list[str], lookback: int) -> Iterator[pa.RecordBatch]:
    """One row per block of sums and task: products to subtract by step, then lagged products, then those with the target."""
    c, k = len(channels), (lookback + 1) * len(channels)
    away, lagged, others = np.zeros((k, k)), np.zeros((c, k)), np.zeros(2 * k + 3)
    for table in _chunks(batches):
        chunk = _Chunk(table, channels, lookback)
        core = np.arange(len(chunk.z) - lookback) < chunk.n
        every = chunk.windows(core)
        lagged += every[:, -c:].T @ every
        valid = chunk.valid.astype(float)
        others += np.concatenate([chunk.target @ every, valid @ every, [valid.sum(), chunk.target.sum(), chunk.target @ chunk.target]])
        none = every[~chunk.valid]
        away += none.T @ none
        if chunk.last:
            beyond = chunk.windows(~core)
            away += beyond.T @ beyond
    blocks = [*away.reshape(lookback + 1, -1), lagged.ravel(), others]
    for i, block in enumerate(blocks):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block.tolist()], pa.list_(pa.float64()))], ["block", "sums"])


def window_moments(df: DataFrame, channels: list[str], lookback: int = LOOKBACK, by: tuple[str, ...] = (), **options) -> dict[int, np.ndarray]:
    """The sums of all tasks. They are added up inside Spark, so the driver gets one array per block: its size is the model's."""
    rows = _ordered(df, channels, lookback, by, **options)
    parts = rows.mapInArrow(lambda batches: _sums(batches, channels, lookback), "block int, sums array<double>")
    total = parts.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    return {r["block"]: np.array(r["sums"]) for r in total.collect()}


def lagged_moments(df: DataFrame, channels: list[str], lookback: int = LOOKBACK, by: tuple[str, ...] = (), **options) -> DataFrame:
    """``lag, channel, earlier, moment``: sums over all rows of a channel times a channel ``lag`` rows before, within a series."""
    sums, c = window_moments(df, channels, lookback, by, **options), len(channels)
    cube = sums[lookback + 1].reshape(c, lookback + 1, c) if sums else np.zeros((c, lookback + 1, c))
    return df.sparkSession.createDataFrame(
        [(lookback - step, channels[a], channels[b], float(cube[a, step, b])) for a in range(c) for step in range(lookback + 1) for b in range(c)],
        "lag int, channel string, earlier string, moment double")


def fit_windows(df: DataFrame, channels: list[str], lookback: int = LOOKBACK, by: tuple[str, ...] = (), ridge: float = 1e-3,
                hidden: tuple[str, ...] = ("ch_power", f"ch_{MASK}"), **options) -> WindowRegression:
    """Ridge regression of the target on the windows of ``df``: rows with an observed target and a full look-back.

    Inputs and target are scaled to unit variance for the penalty. The row's own ``hidden`` channels are no
    inputs, so the target cannot leak; inputs without variance get no weight.
    """
    sums, c, k = window_moments(df, channels, lookback, by, **options), len(channels), (lookback + 1) * len(channels)
    if not sums or not sums[lookback + 2][2 * k]:
        raise ValueError("no row has an observed target and a full look-back")
    away = np.concatenate([sums[i] for i in range(lookback + 1)]).reshape(k, k)
    cube, others = sums[lookback + 1].reshape(c, lookback + 1, c), sums[lookback + 2]
    products = np.empty((lookback + 1, c, lookback + 1, c))
    for i in range(lookback + 1):
        for j in range(i + 1):  # step i is i - j rows after step j
            products[i, :, j, :] = cube[:, lookback - (i - j), :]
            products[j, :, i, :] = products[i, :, j, :].T
    products = products.reshape(k, k) - away
    n, mean_y = others[2 * k], others[2 * k + 1] / others[2 * k]
    mean = others[k:2 * k] / n
    spread = products / n - np.outer(mean, mean)
    std_y = max(others[2 * k + 2] / n - mean_y**2, 0.0) ** 0.5
    variance = np.diag(spread)
    used = (variance > LEAST_VARIANCE) & ~np.array([step == lookback and name in hidden for step in range(lookback + 1) for name in channels])
    std = np.sqrt(variance[used])
    scaled = spread[np.ix_(used, used)] / np.outer(std, std) + np.eye(len(std)) * (ridge / (std_y or 1.0))
    with_y = (others[:k][used] / n - mean[used] * mean_y) / std
    weights = np.zeros(k)
    weights[used] = np.linalg.solve(scaled, with_y) / std
    return WindowRegression(channels, lookback, weights.reshape(lookback + 1, c), float(mean_y - weights @ mean), int(n))


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
