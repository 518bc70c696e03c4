"""Learned forecasters on MLlib, their importances and additive attributions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import let
from ..operators.joins import SmallSide
from .trees import Forest

TARGET = "power"
#: What the columns of a feature table that are no inputs are to a model; any other number or flag the feature operators produce is an input.
ROLES = {
    TARGET: "target", "site_id": "series", "campus_id": "key", "timestamp": "time", "year": "time", "month": "time", "season": "label",
    "is_daylight": "label", "split": "label", "wind_direction": "angle", "capacity_kwp": "place", "latitude": "place", "longitude": "place",
}
SITE_INPUTS = ("site_mean", "site_rows")
SENTINEL = -1e6  # stands for a missing value, below every real one
ROWS_PER_TASK = 20_000  # training rows below which a task costs more to schedule than to run


def feature_columns(df: DataFrame) -> dict[str, list[str]]:
    """The inputs a table offers, by kind: the series a row belongs to, and its numbers in table order."""
    def is_input(f: T.StructField) -> bool:
        return f.name not in ROLES and not f.name.startswith("_") and isinstance(f.dataType, (T.NumericType, T.BooleanType))

    return {"categorical": [c for c in df.columns if ROLES.get(c) == "series"], "numeric": [f.name for f in df.schema.fields if is_input(f)]}


def _number(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    return F.col(c).try_cast("double") if isinstance(kind, T.StringType) else F.col(c).cast("double")


def matrix_entries(get: Callable[[str], Column], names: list[str], sentinel: float = SENTINEL) -> list[Column]:
    """Per numeric input its value and its 0/1 flag for a missing one; ``get`` gives a column by name."""
    return [c for n in names for c in (F.coalesce(get(n).cast("double"), F.lit(sentinel)), get(n).isNull().cast("double"))]


def prepare_matrix(df: DataFrame, columns: dict[str, list[str]], sentinel: float = SENTINEL, suffix: str = "x_") -> DataFrame:
    """Numeric inputs as doubles with a sentinel and a 0/1 flag for missing values.

    MLlib trees take no nulls; a value below every real one plus the flag lets a
    split send missing rows to either side.
    """
    inputs: dict[str, Column] = {}
    for c in columns["numeric"]:
        inputs[f"{suffix}{c}"] = F.coalesce(_number(df, c), F.lit(sentinel))
        inputs[f"{suffix}{c}__missing"] = F.col(c).isNull().cast("double")
    for c in columns["categorical"]:
        inputs[f"{suffix}{c}"] = F.col(c).cast("string")
    return df.withColumns(inputs)


def telling(train: DataFrame, names: list[str]) -> list[int]:
    """Places in :func:`matrix_entries` that can split ``train``: entries that vary, and of flags that are alike in all rows the first.

    Trees never ask the others: a constant has no split, and of equal gains the first input is taken. So a fit on
    these entries gives the same trees. ``train`` is read once, and again if flags agree in their counts.
    """
    def present(n: str) -> Column:
        return F.col(f"`{n}`")

    facts = [f(present(n)) for n in names for f in (F.count, F.min, F.max)]
    n, *found = train.agg(F.count(F.lit(1)), *[c.alias(f"_{i}") for i, c in enumerate(facts)]).first()
    counts, lows, highs = found[::3], found[1::3], found[2::3]
    firsts: dict[int, list[int]] = {}
    for i, c in enumerate(counts):
        if 0 < c < n:
            firsts.setdefault(c, []).append(i)
    pairs = [(a, b) for same in firsts.values() for k, b in enumerate(same) for a in same[:k]]
    apart = train.agg(*[F.max(present(names[a]).isNull() != present(names[b]).isNull()).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    again = {b for (_, b), differ in zip(pairs, apart) if not differ}
    values = [2 * i for i, c in enumerate(counts) if 0 < c < n or c and lows[i] != highs[i]]
    return sorted([*values, *[2 * i + 1 for i, c in enumerate(counts) if 0 < c < n and i not in again]]) or [0]


def encode_sites(train: DataFrame) -> SmallSide:
    """What identifies a site to a model: mean and count of its observed training readings.

    The same encoding for any number of sites; rows of the null site are a site of their own.
    """
    return SmallSide.of(train.groupBy("site_id").agg(F.avg(TARGET).alias("site_mean"), F.count(TARGET).cast("double").alias("site_rows")))


@dataclass
class GbtForecaster:
    """Fitted trees with the inputs and the site encoding they were fitted with, and the error after each round."""

    forest: Forest
    numeric: list[str]
    sites: SmallSide
    info: dict

    @property
    def names(self) -> list[str]:
        return [*SITE_INPUTS, *self.numeric]

    @property
    def inputs(self) -> list[str]:
        return [n for c in self.names for n in (c, f"{c}__missing")]

    def prediction(self, get: Callable[[str], Column] = F.col) -> Column:
        """The prediction for inputs that ``get`` finds by name, those of the site included; usable inside array functions."""
        return let(F.array(*matrix_entries(get, self.names)), self.forest.score)

    def placed(self, df: DataFrame) -> DataFrame:
        return self.sites.join(df.drop(*SITE_INPUTS), ["site_id"], "left")

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """As :meth:`prediction`, rows walked through the trees by Arrow batches."""
        return self.placed(df).select(*df.columns, self.forest.scores(F.array(*matrix_entries(F.col, self.names))).alias(name))

    def contributions(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Long ``keys…, base_value, feature, value, contribution``: along each tree's path the change of the mean counts
        for the input that was asked; a row's contributions and base add up to its prediction."""
        names = self.names
        return self.forest.contributions(self.placed(df), keys, F.array(*matrix_entries(F.col, names)), names, [i // 2 for i in range(2 * len(names))], [F.col(n) for n in names])


def train_gbt(df: DataFrame, *, max_iter: int = 2000, max_depth: int = 8, step: float = 0.05, subsample: float = 0.9,
              min_instances: int = 5, patience: int = 50, seed: int = 42) -> GbtForecaster:
    """Boosted trees on observed train rows; of all rounds those up to the least error on the val rows are kept.

    Rounds are added until the error has not fallen for ``patience`` of them. MLlib fits a given number of rounds and
    the same seed gives the same first ones, so the number starts at twice the patience and is doubled while
    the best round is too near the end; one pass over the val rows gives the error after every round.
    Without val rows all rounds are kept.

    The site enters as the mean and count of its own training readings, at any number of sites. Inputs that no tree can
    ask (:func:`telling`) are left out of the rows MLlib reads.
    """
    numeric = feature_columns(df)["numeric"]
    names = [*SITE_INPUTS, *numeric]
    observed = df.where(F.col(TARGET).isNotNull() & F.col("split").isin("train", "val"))
    sites = encode_sites(observed.where(F.col("split") == "train"))
    placed = sites.join(observed.select(TARGET, "site_id", "split", *numeric), ["site_id"], "left")
    entries, asked = matrix_entries(F.col, names), telling(placed.where(F.col("split") == "train"), names)
    # every boosting round reads these rows again
    rows = placed.select(TARGET, "split", array_to_vector(F.array(*[entries[i] for i in asked])).alias("_features")).persist()
    try:
        counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        # each task sends the sums of all nodes on every level, so there are no more of them than cores
        tasks = min(-(-counts.get("train", 0) // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
        train, val = rows.where(F.col("split") == "train").coalesce(max(tasks, 1)), rows.where(F.col("split") == "val")
        rounds = min(max_iter, 2 * patience) if counts.get("val") else max_iter
        while True:
            model = GBTRegressor(featuresCol="_features", labelCol=TARGET, maxIter=rounds, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample,
                                 minInstancesPerNode=min_instances, maxBins=64, seed=seed).fit(train)
            errors = model.evaluateEachIteration(val, "squared") if counts.get("val") else []
            best = min(range(len(errors)), key=errors.__getitem__) + 1 if errors else rounds
            if rounds >= max_iter or best + patience <= rounds:
                break
            rounds = min(max_iter, 2 * rounds)
    finally:
        rows.unpersist()
    info = {"best_iteration": best, "rounds": rounds, "val_errors": errors, "n_train_rows": counts.get("train", 0), "n_val_rows": counts.get("val", 0)}
    return GbtForecaster(Forest.of(model, df.sparkSession, best, asked), numeric, sites, info)


def feature_importance(fitted: GbtForecaster, spark) -> DataFrame:
    """Gain, split count and covered rows per input of the kept trees; unused inputs show zero.

    A split's gain counts by its rows and is a share of its tree's; trees count alike. All figures come from the
    table of nodes, not of data rows.
    """
    forest = fitted.forest
    tree = np.repeat(np.arange(len(forest.roots)), np.diff(np.append(forest.roots, len(forest.feature))))
    worth = forest.gain * forest.rows
    total = np.bincount(tree, worth, len(forest.roots))
    worth = np.divide(worth, total[tree], out=np.zeros_like(worth), where=total[tree] > 0)
    n, inner = len(fitted.inputs), forest.inner
    gain, weight, cover = (np.bincount(forest.feature[inner], w[inner], n) for w in (worth, np.ones_like(worth), forest.rows.astype(float)))
    gain = gain / gain.sum() if gain.sum() else gain
    return spark.createDataFrame([(c, float(g), int(w), float(k)) for c, g, w, k in zip(fitted.inputs, gain, weight, cover)], "feature string, gain double, weight long, cover double")


@dataclass
class LinearForecaster:
    """Coefficients with the training means of their inputs: additive by construction."""

    names: list[str]
    coefficients: list[float]
    means: list[float]
    intercept: float

    def _filled(self) -> list[Column]:
        return [F.coalesce(F.col(n).cast("double"), F.lit(m)) for n, m in zip(self.names, self.means)]

    def prediction(self) -> Column:
        total = F.lit(self.intercept)
        for c, w in zip(self._filled(), self.coefficients):
            total = total + c * F.lit(w)
        return total

    @property
    def base_value(self) -> float:
        return self.intercept + sum(w * m for w, m in zip(self.coefficients, self.means))

    def contributions(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Long ``keys…, base_value, feature, value, contribution``; a row's contributions and base add up to its prediction."""
        entries = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                            ((c - F.lit(m)) * F.lit(w)).alias("contribution"))
                   for n, c, w, m in zip(self.names, self._filled(), self.coefficients, self.means)]
        return df.select(*keys, F.lit(self.base_value).alias("base_value"), F.inline(F.array(*entries)))


def train_linear(df: DataFrame, names: list[str], ridge: float = 1e-3) -> LinearForecaster:
    """Ridge regression on observed train rows, gaps at the training mean."""
    train = df.where(F.col(TARGET).isNotNull() & (F.col("split") == "train"))
    row = train.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names]).first()
    names = [n for n in names if row[n] is not None]
    means = [float(row[n]) for n in names]
    filled = train.select(TARGET, *[F.coalesce(F.col(n).cast("double"), F.lit(m)).alias(n) for n, m in zip(names, means)])
    ready = VectorAssembler(inputCols=names, outputCol="_features").transform(filled)
    model = LinearRegression(featuresCol="_features", labelCol=TARGET, regParam=ridge, solver="normal").fit(ready)
    return LinearForecaster(names, [float(c) for c in model.coefficients], means, float(model.intercept))
