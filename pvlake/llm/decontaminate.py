"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .quality import let
from .text import ascii_lower, computed, text_of, without, words

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 20  # bits of 64 within which every fingerprint is found
BLOCKS = 8
BITS = 64 // BLOCKS


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes, repeats included: a bit is set if more than half set it."""
    def bit(h: Column, b: Column) -> Column:
        ones = F.aggregate(h, F.lit(0), lambda acc, x: acc + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: bit(hashes, b)), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Hashes of all word shingles; of fewer words, of the whole sequence; none of none."""
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
        F.size(w) < width, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(width)), " "))))


def weighted(hashes: Column) -> Column:
    """A multiset of hashes as a set: each with the number of its occurrence, so set sizes weigh repeats."""
    return let(F.array_sort(hashes), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x).cast("int"))))


def _described(df: DataFrame, w: str) -> DataFrame:
    """Adds the fingerprint and the weighted shingles of the words in ``w``."""
    held = computed(df, {"_llm_h": shingle_hashes(F.col(w))})
    return held.select("*", simhash(F.col("_llm_h")).alias("_llm_print"), weighted(F.col("_llm_h")).alias("_llm_set")).drop("_llm_h")


def _blocks(fingerprint: Column) -> list[Column]:
    return [F.shiftrightunsigned(fingerprint, b * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") for b in range(BLOCKS)]


def _near_blocks() -> list[int]:
    """Changes of a block that a pair within the radius may show in its closest block."""
    return [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS), n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               item_column: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc, _llm_row, item_id, similarity, start_word, n_words)`` for each document and benchmark item it holds.

    ``_llm_row`` is a hash of the text, so that rows which repeat an id are told apart.

    Windows are as long as an item, in words (shorter at the document's end). They are placed where a run
    of five-word shingles shared with an item of that length starts: once so that the shared words stand where
    they stand in the item, and once from the run on. A window without a shared shingle cannot reach the
    similarity. Each window's SimHash is looked up in a
    multi-index: 64 bits in eight blocks, items filed under all values of each block within two bits of
    theirs, which finds every item fingerprint within 20 bits. The radius is not lossless: by simulation up to
    0.03% of windows just at the similarity differ in more bits, and 0.8% where an item of nine words is cut short
    at a document's end. What is that close and as long is verified:
    weighted Jaccard similarity of the five-word shingles, repeats counted, of ``similarity`` or more. The
    best window is returned.

    Documents are read once and only windows leave the scan, so a passage in a third of all documents
    is a row in each. The benchmark side is broadcast only after counting its rows.

    Words are lower-cased in A-Z. A null or empty text has no leaks, a null or empty item is in no
    text. Items under five words are compared as a whole sequence. Repeated items are found each.
    """
    items = computed(benchmark.select(F.col(item_column).alias("item_id"), text_of(item_text).alias("_llm_text")), {
        "_llm_w": words(ascii_lower(F.col("_llm_text")))}).where(F.size("_llm_w") > 0).drop("_llm_text")
    items = cut_lineage(items.withColumn("_llm_len", F.size("_llm_w")))
    widths = [r[0] for r in items.select(F.least(F.col("_llm_len"), F.lit(WIDTH))).distinct().collect()]  # five values at most
    # rows that repeat an id are told apart by their text
    read = computed(docs.select(F.col(id_column).alias("doc"), text_of(text_column).alias("_llm_text")), {
        "_llm_w": words(ascii_lower(F.col("_llm_text"))), "_llm_row": F.xxhash64("_llm_text")}).drop("_llm_text")

    def seeded(width: int) -> DataFrame:
        """Windows aligned on the first shingle of each run of shared shingles."""
        own = items.where(F.least(F.col("_llm_len"), F.lit(WIDTH)) == width)
        seeds = own.select("_llm_len", "_llm_w", F.explode(F.sequence(F.lit(0), F.col("_llm_len") - width)).alias("_llm_at")).select(
            F.xxhash64(*[F.get("_llm_w", F.col("_llm_at") + k) for k in range(width)]).alias("_llm_seed"), "_llm_len", "_llm_at",
            F.when(F.col("_llm_at") > 0, F.get("_llm_w", F.greatest(F.col("_llm_at") - 1, F.lit(0)))).alias("_llm_before")).distinct()
        placed = read.where(F.size("_llm_w") >= width).select(
            "doc", "_llm_row", "_llm_w", F.explode(F.sequence(F.lit(0), F.size("_llm_w") - width)).alias("_llm_pos"))
        hits = placed.withColumn("_llm_seed", F.xxhash64(*[F.get("_llm_w", F.col("_llm_pos") + k) for k in range(width)])).join(
            broadcast_if_small(seeds), "_llm_seed")
        before = F.when(F.col("_llm_pos") > 0, F.get("_llm_w", F.greatest(F.col("_llm_pos") - 1, F.lit(0))))
        starts = hits.where(F.coalesce(before != F.col("_llm_before"), F.lit(True)))  # else the shingle before is shared too
        aligned = F.greatest(F.col("_llm_pos") - F.col("_llm_at"), F.lit(0))
        ways = starts.select("doc", "_llm_row", "_llm_w", "_llm_len", F.explode(F.array_distinct(F.array(aligned, F.col("_llm_pos")))).alias("start_word"))
        return ways.select("doc", "_llm_row", "start_word", "_llm_len", F.slice("_llm_w", F.col("start_word") + 1, F.col("_llm_len")).alias("_llm_window"))

    windows = seeded(widths[0]) if widths else read.select("doc", "_llm_row", F.lit(0).alias("start_word"), F.lit(0).alias("_llm_len"), F.col("_llm_w").alias("_llm_window")).limit(0)
    for width in widths[1:]:
        windows = windows.unionByName(seeded(width))
    windows = _described(windows, "_llm_window").drop("_llm_window")
    probes = windows.select("*", F.posexplode(F.array(*_blocks(F.col("_llm_print")))).alias("_llm_block", "_llm_value"))
    filed = _described(items, "_llm_w").select(
        "item_id", "_llm_len", F.col("_llm_print").alias("_llm_item_print"), F.col("_llm_set").alias("_llm_item_set"),
        F.posexplode(F.array(*_blocks(F.col("_llm_print")))).alias("_llm_block", "_llm_own")).select(
        "item_id", "_llm_len", "_llm_item_print", "_llm_item_set", "_llm_block",
        F.explode(F.array(*[F.lit(m) for m in _near_blocks()])).alias("_llm_change"), "_llm_own").withColumn(
        "_llm_value", F.col("_llm_own").bitwiseXOR(F.col("_llm_change"))).drop("_llm_own", "_llm_change")
    near = probes.join(broadcast_if_small(filed), ["_llm_len", "_llm_block", "_llm_value"]).where(
        F.bit_count(F.col("_llm_print").bitwiseXOR(F.col("_llm_item_print"))) <= RADIUS)
    likeness = F.size(F.array_intersect("_llm_set", "_llm_item_set")) / F.size(F.array_union("_llm_set", "_llm_item_set"))
    return near.withColumn("similarity", likeness).where(F.col("similarity") >= similarity).groupBy("doc", "_llm_row", "item_id").agg(
        F.max("similarity").alias("similarity"), F.min_by("start_word", F.struct(-F.col("similarity"), F.col("start_word"))).cast("long").alias("start_word"),
        F.first("_llm_len").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, see :func:`find_leaks`. Other rows and columns stay as they are."""
    leaks = cut_lineage(find_leaks(docs, benchmark, id_column, text_column, **options).select("doc", "_llm_row").distinct())
    keyed = without(docs, "_llm_row").withColumn("_llm_row", F.xxhash64(text_of(text_column)))
    small = broadcast_if_small(leaks.withColumnRenamed("_llm_row", "_llm_leak"))
    return keyed.join(small, keyed[id_column].eqNullSafe(small["doc"]) & (keyed["_llm_row"] == small["_llm_leak"]), "left_anti").drop("_llm_row")
