"""Quality rules: text statistics, fixed rules, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .text import BLANK, computed, text_of, without, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: The statistic vector, each with the least standard deviation that an estimate may have: the unit below which differences are not taken for signs of bad text.
VECTOR = {"_llm_x0": 0.05, "_llm_x1": 0.03, "_llm_x2": 0.12, "_llm_x3": 0.12}
P = len(VECTOR)
CORE = 0.75  # share of a group's rows that the determinant is minimised over
STEPS = 5  # concentration steps; each lowers the determinant
#: Added to the number of characters, lines and words that shares are taken of: a few counts in a short text are chance, in a long one they are not.
CHANCE = {"chars": 100, "lines": 8, "words": 20}
TAIL = 1e-4  # share of normal vectors beyond the cutoff
MIN_GROUP = 50  # groups with fewer rows are judged together
LEVELS = 500  # distance bins per unit of ln(1 + d^2)


def _chi2_below(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, dof) < q else (low, mid)
    return high


CUTOFF = _chi2_quantile(1.0 - TAIL, P)
#: Makes the covariance of the central share consistent for normal vectors.
CONSISTENT = CORE / _chi2_below(_chi2_quantile(CORE, P), P + 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: str) -> Column:
    """Words inside three-word windows that occur more than once, the first occurrence included."""
    n = F.size(w)
    word = F.col(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, i: F.coalesce(
            (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])), F.lit(False))))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x))

    return F.when(n < 3, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds the counts and ``base_failed`` to each document, in one narrow pass.

    ``n_words`` runs outside white space, ``word_chars`` code points in them, ``n_symbols`` of
    ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an earlier line, ``n_repeat_words`` words
    in three-word windows found twice or more. A null or empty text has zeros, and fails.
    """
    t = text_of(text_column)
    held = computed(without(docs, *COUNTS, "base_failed"), {"_llm_words": words(t)})
    full = F.filter(F.split(t, "\n"), lambda x: F.char_length(F.btrim(x, F.lit(BLANK))) > 0)
    counted = computed(held, {
        "n_words": F.size("_llm_words").cast("long"), "word_chars": F.char_length(F.array_join("_llm_words", "")).cast("long"),
        "n_symbols": F.when(t.rlike(r"[#*$%&|<>]"), F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).otherwise(0).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "_llm_lines": F.greatest(F.size(full), F.lit(1)), "n_repeat_words": _repeat_words("_llm_words")})
    x = [F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))), F.sqrt(F.col("n_symbols") / (F.col("word_chars") + CHANCE["chars"])),
         F.sqrt(F.col("n_dup_lines") / (F.col("_llm_lines") + CHANCE["lines"])), F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + CHANCE["words"]))]
    return counted.withColumns(dict(zip(VECTOR, x))).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_llm_words", "_llm_lines")


def _grouped(measured: DataFrame, keys: list[str]) -> DataFrame:
    return measured.withColumn("_llm_group", F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)])))


def _distance() -> Column:
    """Squared Mahalanobis distance to ``_llm_m*`` under the Cholesky factor ``_llm_l*``, rounded against the order of sums."""
    z: list[Column] = []
    for i, x in enumerate(VECTOR):
        rest = F.col(x) - F.col(f"_llm_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_llm_l{i}{j}") * z[j]
        z.append(rest / F.col(f"_llm_l{i}{i}"))
    return F.round(sum((v * v for v in z), F.lit(0.0)), 6)


def _factor(df: DataFrame, mean: list[Column], cov: list[list[Column]]) -> DataFrame:
    """Means and Cholesky factor as columns, one row per group."""
    out = df.select("_llm_group", *[m.alias(f"_llm_m{i}") for i, m in enumerate(mean)],
                    *[cov[i][j].alias(f"_llm_c{i}{j}") for i in range(P) for j in range(i + 1)])
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"_llm_c{i}{j}")
            for k in range(j):
                value = value - F.col(f"_llm_l{i}{k}") * F.col(f"_llm_l{j}{k}")
            out = out.withColumn(f"_llm_l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"_llm_l{j}{j}"))
    return cut_lineage(out.select("_llm_group", *[f"_llm_m{i}" for i in range(P)], *[f"_llm_l{i}{j}" for i in range(P) for j in range(i + 1)]))


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and median absolute deviations per group, from counted bins."""
    def medians(stacked: DataFrame) -> DataFrame:
        """stacked: group, dimension, value -> group and one median per dimension."""
        bins = stacked.groupBy("_llm_group", "i", F.round(F.col("v") * 2000).cast("long").alias("b")).agg(F.count("*").alias("n"))
        by = Window.partitionBy("_llm_group", "i")
        running = bins.withColumns({"upto": F.sum("n").over(by.orderBy("b")), "all": F.sum("n").over(by)})
        return running.where(F.col("upto") * 2 >= F.col("all")).groupBy("_llm_group").agg(
            *[(F.min(F.when(F.col("i") == i, F.col("b"))) / 2000).alias(f"q{i}") for i in range(P)])

    def stacked(df: DataFrame, values: list[Column]) -> DataFrame:
        return df.select("_llm_group", F.posexplode(F.array(*values)).alias("i", "v"))

    middle = cut_lineage(medians(stacked(vectors, [F.col(x) for x in VECTOR])))
    apart = vectors.join(broadcast_if_small(middle), "_llm_group")
    spread = medians(stacked(apart, [F.abs(F.col(x) - F.col(f"q{i}")) for i, x in enumerate(VECTOR)]))
    both = middle.join(spread.select("_llm_group", *[F.col(f"q{i}").alias(f"s{i}") for i in range(P)]), "_llm_group")
    cov = [[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(f)) ** 2 if i == j else F.lit(0.0) for j in range(P)] for i, f in enumerate(VECTOR.values())]
    return _factor(both, [F.col(f"q{i}") for i in range(P)], cov)


def _concentrate(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of each group's closest ``CORE`` of rows.

    Moments are summed per group and distance bin, so the bound and the moments below it come from the
    same pass, combined before the shuffle; a group is some thousand bins however many rows it has.
    """
    names = list(VECTOR)
    placed = vectors.join(broadcast_if_small(estimate), "_llm_group").withColumn("_llm_bin", F.floor(F.log1p(_distance()) * LEVELS))
    sums = {"n": F.count("*")} | {f"s{i}": F.sum(x) for i, x in enumerate(names)} | {
        f"s{i}{j}": F.sum(F.col(names[i]) * F.col(names[j])) for i in range(P) for j in range(i + 1)}
    bins = placed.groupBy("_llm_group", "_llm_bin").agg(*[c.alias(n) for n, c in sums.items()])
    by = Window.partitionBy("_llm_group")
    running = bins.withColumn("all", F.sum("n").over(by)).select(
        "_llm_group", "_llm_bin", "all", *[F.sum(n).over(by.orderBy("_llm_bin")).alias(n) for n in sums])
    best = running.where(F.col("n") >= CORE * F.col("all")).withColumn("_llm_first", F.min("_llm_bin").over(by)).where(F.col("_llm_bin") == F.col("_llm_first"))
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    floors = list(VECTOR.values())
    cov = [[(F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j]) * CONSISTENT + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0)) for j in range(i + 1)] for i in range(P)]
    return _factor(best, mean, cov)


def fit(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum-covariance-determinant estimates per group of ``keys``: one row each, written once.

    Fitted on all rows that pass the base rules, by concentration steps from medians and median
    deviations. Groups below ``MIN_GROUP`` rows share one estimate, under the group ``*``. A floor is
    added to each variance, so a statistic that is the same in nearly all rows gives no false alarm.
    """
    vectors = _grouped(measured.where(~F.col("base_failed")), keys).select("_llm_group", *VECTOR)
    sizes = vectors.groupBy("_llm_group").agg(F.count("*").alias("_llm_n"))
    large = cut_lineage(sizes.where(F.col("_llm_n") >= MIN_GROUP).select("_llm_group", F.lit(True).alias("_llm_own")))
    vectors = cut_lineage(vectors.join(broadcast_if_small(large), "_llm_group", "left").select(
        F.when(F.col("_llm_own"), F.col("_llm_group")).otherwise("*").alias("_llm_group"), *VECTOR))
    estimate = _start(vectors)
    for _ in range(STEPS):
        estimate = _concentrate(vectors, estimate)
    return estimate


def judge(measured: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``distance`` (squared, null for rows that fail the base rules) and ``kept``."""
    packed = [c for c in estimate.columns if c != "_llm_group"]
    own = _grouped(measured, keys).join(broadcast_if_small(estimate.where("_llm_group <> '*'")), "_llm_group", "left")
    # the shared estimate is one row at most; without it and without an own one nothing is known against a row
    shared = estimate.where("_llm_group = '*'").first()
    rest = {c: F.coalesce(F.col(c), F.lit(shared[c] if shared else None).cast("double")) for c in packed}
    known = own.withColumns(rest).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return known.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False))).drop("_llm_group", *packed, *VECTOR)

