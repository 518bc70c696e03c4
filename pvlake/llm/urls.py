"""URL filter: rules first, then boosted trees on lexical features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import cut_lineage
from .text import ascii_lower, computed, without
from .trees import calibrated_threshold, fit_trees, in_hash_order, row_score

FEATURES = ("length", "host_length", "labels", "depth", "longest_part", "digit_ratio", "mark_ratio", "entropy", "parameters", "query_length",
            "fragment", "secure", "suffix_rate", "suffix_count", "lead_rate", "lead_count", "end_rate", "end_count")
PRIOR = 20.0  # pseudo-counts of a smoothed blocking rate
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (host, path, verdict) that fits, as host and path joined; else null."""
    fits = F.lit(None).cast("string")
    for name, prefix, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = F.when(((host == name) | host.endswith("." + name)) & path.startswith(prefix), F.lit(name + prefix)).otherwise(fits)
    return fits


def _lexical(df: DataFrame, url: str) -> DataFrame:
    """Lexical columns of each URL; null counts as empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    counts = F.transform(F.array_distinct(F.split(u, "")), lambda c: F.char_length(u) - F.char_length(F.replace(u, c, F.lit(""))))
    entropy = -F.aggregate(F.transform(counts, lambda c: c / n), F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    part = F.aggregate(F.split(u, r"[/?#&=.\-_]"), F.lit(0), lambda acc, x: F.greatest(acc, F.char_length(x)))
    return computed(df, {
        "_llm_length": n, "_llm_host_length": F.char_length("host").cast("double"),
        "_llm_labels": F.size(F.split("host", r"\.")).cast("double"),
        "_llm_depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"), "_llm_longest_part": part.cast("double"),
        "_llm_digit_ratio": (F.char_length(u) - F.char_length(F.translate(u, "0123456789", ""))) / n,
        "_llm_mark_ratio": F.char_length(F.regexp_replace(u, r"[A-Za-z0-9/:.]", "")) / n, "_llm_entropy": F.coalesce(entropy, F.lit(0.0)),
        "_llm_parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "_llm_query_length": F.char_length(query).cast("double"), "_llm_fragment": F.instr(u, "#").cast("boolean").cast("double"),
        "_llm_secure": u.startswith("https://").cast("double"),
        "_llm_suffix": F.substring_index("host", ".", -2), "_llm_lead": ascii_lower(F.regexp_extract("path", "^/([^/]*)", 1)),
        "_llm_end": ascii_lower(F.regexp_extract("path", r"(/|\.[A-Za-z0-9]+)$", 1)),
        "_llm_bucket": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"),
    })


def _rates(known: DataFrame, part: str) -> DataFrame:
    """Smoothed blocking rate and count of each value of ``part``: for every fold of hosts from the other folds, for fold null from all."""
    tallies = known.groupBy(f"_llm_{part}", "_llm_bucket").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    folds = F.array(*[F.lit(i) for i in range(FOLDS)], F.lit(None).cast("int"))
    return tallies.withColumn("_llm_fold", F.explode(folds)).where(F.col("_llm_fold").isNull() | (F.col("_llm_fold") != F.col("_llm_bucket"))).groupBy(
        f"_llm_{part}", "_llm_fold").agg(((F.sum("bad") + PRIOR / 2) / (F.sum("n") + PRIOR)).alias(f"_llm_{part}_rate"), F.log1p(F.sum("n")).alias(f"_llm_{part}_count"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: DataFrame | None = None, url: str = "url",
               precision: float = 0.95) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits), ``score`` and ``verdict`` (allow or block) to each page.

    A rule (host, path prefix, verdict) fits its host and all subdomains; the longest wins. Where none
    fits, boosted trees decide: they are fitted on ``labelled`` (``url``, ``label`` 1.0 for block), by default
    the distinct URLs of ``pages`` that a rule has judged, on all of four in five hosts. On all of the fifth left out the
    threshold is set: the lowest score that keeps ``precision`` there.

    Beside plain lexical features there are statistics (smoothed blocking rate and count) of the host's last two labels, the
    path's first part and its ending, counted over all labelled URLs but those of the row's own fold of hosts: no row
    sees its own label or its host's. Where the labels come from rules, those of the host's last labels are left out:
    a rule labels a part of a domain, which says nothing about the rest of it.

    Scores are plain column arithmetic in the scan's stage; the tables of statistics are broadcast up to a counted size,
    beyond that joined by value and salt. A null URL, or one without ``://``, has an empty host and path and so
    never fits a rule; repeated URLs are judged alike. Without labels of both kinds every URL that no rule fits is allowed.
    """
    def parts(df: DataFrame) -> DataFrame:
        return computed(df, {"host": host_of(F.col(url)), "path": path_of(F.col(url))})

    verdicts = {name + prefix: verdict for name, prefix, verdict in rules}
    ruled = F.lit(None).cast("string")
    for key, verdict in verdicts.items():
        ruled = F.when(F.col("rule") == key, F.lit(verdict)).otherwise(ruled)
    judged = computed(parts(without(pages, "host", "path", "rule", "score", "verdict")), {
        "rule": rule_of(F.col("host"), F.col("path"), rules)}).withColumn("_llm_ruled", ruled)
    if labelled is None:
        known = judged.where(F.col("_llm_ruled").isNotNull()).select(url, (F.col("_llm_ruled") == "block").cast("double").alias("label"))
    else:
        known = labelled.select(F.col("url").alias(url), F.col("label").cast("double"))
    known = cut_lineage(_lexical(parts(known.distinct()), url))
    counted = ("lead", "end") if labelled is None else ("suffix", "lead", "end")
    names = [f"_llm_{f}" for f in FEATURES if f.split("_")[0] in counted or not f.endswith(("_rate", "_count"))]
    rates = {part: cut_lineage(_rates(known, part)) for part in counted}

    def described(df: DataFrame, fold: bool) -> DataFrame:
        for part, table in rates.items():
            small = table.where(F.col("_llm_fold").isNotNull()) if fold else table.where(F.col("_llm_fold").isNull()).drop("_llm_fold")
            df = join_small(df, small, [f"_llm_{part}", "_llm_fold"] if fold else [f"_llm_{part}"], "left")
        return df.fillna({f"_llm_{part}_rate": 0.5 for part in counted} | {f"_llm_{part}_count": 0.0 for part in counted})

    own = described(known.withColumn("_llm_fold", F.col("_llm_bucket")), True)
    chosen = in_hash_order(own.select(url, "label", "_llm_bucket", *names), F.col(url))
    model = fit_trees(chosen.where("_llm_bucket <> 0"), names)
    if model is None:
        scored = judged.withColumn("score", F.lit(None).cast("double"))
        threshold = 2.0
    else:
        score = row_score(model, names)
        threshold = calibrated_threshold(chosen.where("_llm_bucket = 0").withColumn("score", score), "score", precision)
        scored = described(_lexical(judged, url), False).withColumn("score", score)
    by_trees = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("_llm_ruled", by_trees)).select(
        *[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")], "host", "path", "rule", "score", "verdict")
