"""Boosted trees: fitted on all labelled rows, scored as plain columns."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MIN_LEAF = 10  # so that no branch is made for a few rows with wrong labels
WHOLE = 10_000  # rows up to which MLlib takes its split points from all of them
BINS = 32  # quantiles of a feature, of the rows and again of the distinct values
ACCURACY = 10_000
ROWS_PER_TASK = 50_000


def bounded_sample(labelled: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows of each label, chosen by a hash of ``key``: the same rows at any partitioning, written once.

    Each label is ordered on its own and cut by a top-k, which is a bounded heap per task.
    """
    order = F.xxhash64(key, F.lit(17))
    picked = [labelled.where(F.col("label") == y).withColumn("_llm_order", order).orderBy("_llm_order", key).limit(limit).drop("_llm_order") for y in (0.0, 1.0)]
    return cut_lineage(picked[0].unionByName(picked[1]))


def in_hash_order(labelled: DataFrame, key: Column) -> DataFrame:
    """All rows, those of each label in order of a hash of ``key``, written once: sums, and so the trees, hang less on how rows were dealt before."""
    order = F.xxhash64(key, F.lit(17))
    sides = [labelled.where(F.col("label") == y).withColumn("_llm_order", order).orderBy("_llm_order", key).drop("_llm_order") for y in (0.0, 1.0)]
    return cut_lineage(sides[0].unionByName(sides[1]))


class Trees(NamedTuple):
    """Boosted trees, and per feature the ascending values at which its bins begin; without ``cuts`` the trees compare plain values."""

    model: GBTClassificationModel
    cuts: list[list[float]] | None


def _cuts(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Per feature the values at which a bin begins: quantiles of all rows and of the distinct values, so that rare values have bins of their own."""
    levels = [i / BINS for i in range(1, BINS)] + [1.0]
    values = rows.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("i", "x"))
    found: list[set[float]] = [set() for _ in features]
    for some in (values, values.distinct()):
        for r in some.groupBy("i").agg(F.percentile_approx("x", levels, ACCURACY).alias("q")).collect():  # features x BINS numbers
            found[r["i"]].update(r["q"])
    return [sorted(f) for f in found]


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of ``cuts`` are not above ``value``."""
    return F.array_size(F.filter(F.lit(cuts), lambda cut: cut <= value)).cast("double")


def fit_trees(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 4, seed: int = 7) -> Trees | None:
    """Boosted trees on ``features`` and ``label`` (0.0 or 1.0) of all ``rows``; None if they lack one of the two labels.

    MLlib looks for split points in all rows up to ``WHOLE``, in a sample beyond. So beyond it the values are first replaced
    by their bins, cut at quantiles of all rows, and MLlib is asked for so many bins that it again reads every row.
    ``rows`` are read more than once; write them first.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    n, cuts, bins = sum(counts.values()), None, 32
    if n > WHOLE:
        cuts = _cuts(rows, features)
        rows, bins = rows.select("label", *[_bin(F.col(f), c).alias(f) for f, c in zip(features, cuts)]), math.isqrt(n) + 1
    vectors = VectorAssembler(inputCols=features, outputCol="_llm_features").transform(rows.coalesce(max(1, n // ROWS_PER_TASK)))
    return Trees(GBTClassifier(featuresCol="_llm_features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=bins, minInstancesPerNode=MIN_LEAF,
                               stepSize=0.2, seed=seed).fit(vectors), cuts)


def _tree_columns(text: str, features: list[Column], cuts: list[list[float]] | None = None) -> list[Column]:
    """One expression per tree of a model's description: nested comparisons that end in a prediction."""
    lines = iter([x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node() -> Column:
        line = next(lines)
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        index, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        value, limit = features[int(index)], float(threshold)
        low = node()
        next(lines)  # Else
        # bin j holds the values from its j-th cut on, below the next
        return F.when(value <= limit if cuts is None else value < cuts[int(index)][math.floor(limit)], low).otherwise(node())

    return [node() for _ in range(len(re.findall(r"^\s*Tree \d+", text, re.M)))]


def tree_score(trees: Trees, features: list[Column]) -> Column:
    """Probability of label 1.0, as MLlib defines it from the summed margins; usable inside array functions."""
    margin = F.lit(0.0)
    for weight, tree in zip(trees.model.treeWeights, _tree_columns(trees.model.toDebugString, features, trees.cuts)):
        margin = margin + F.lit(float(weight)) * tree
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def row_score(trees: Trees, features: list[str]) -> Column:
    """:func:`tree_score` of a row's columns, evaluated as an array function: hundreds of nested branches exceed what one generated method may hold."""
    row = F.struct(*[F.col(f).alias(f) for f in features])
    return F.transform(F.array(row), lambda r: tree_score(trees, [r[f] for f in features]))[0]


def calibrated_threshold(scored: DataFrame, score: str, precision: float, bins: int = 1000) -> float:
    """The lowest score, 0.5 at least, at and above which held-out rows (``label``) keep ``precision``; above 1 if none does.

    Where no held-out score lies between one that keeps it and one that doesn't, their middle counts.
    A histogram of ``bins`` rows is all that reaches the driver.
    """
    counts = {r["b"]: (r["n"], r["good"]) for r in scored.groupBy(F.floor(F.col(score) * bins).cast("int").alias("b")).agg(
        F.count("*").alias("n"), F.sum("label").alias("good")).collect()}
    observed = sorted(counts, reverse=True)
    best, n, good = 2.0, 0, 0.0
    for b, lower in zip(observed, [*observed[1:], 0]):
        n, good = n + counts[b][0], good + counts[b][1]
        if good >= precision * n:
            best = max(0.5, (b + lower) / 2 / bins)
    return best
