"""Line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .text import BLANK, ascii_lower, text_of, without

NO_ID = -(2**63)  # stands for a null id while counting and joining


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough; the key is carried as two independent 64-bit hashes."""
    key = ascii_lower(F.col("_llm_line"))
    return (
        docs.select("_llm_doc", "_llm_row", F.posexplode(F.split("_llm_text", "\n")).alias("_llm_pos", "_llm_raw"))
        .select("_llm_doc", "_llm_row", "_llm_pos", F.btrim("_llm_raw", F.lit(BLANK)).alias("_llm_line"))
        .where(F.char_length("_llm_line") >= min_chars)
        .select("_llm_doc", "_llm_row", "_llm_pos", F.xxhash64(key).alias("_llm_h1"), F.xxhash64(F.lit(1), key).alias("_llm_h2"))
    )


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, but in the largest id that holds them.

    A line's key is the line without white space at its ends and with A-Z lower-cased; shorter keys
    than ``min_chars`` code points are never dropped. Adds ``n_lines`` (before dropping) and
    ``n_dropped``; the text is replaced by its other lines.

    Only hashes are shuffled to count. The distinct count goes over (hash, document) first, so a line
    that most documents share is spread over all tasks. The lines to drop are written before the join back: up to a
    counted size they are broadcast, beyond it the join has exchanges of its own that adaptive
    execution can split. Texts are shuffled once, to meet the positions to drop.

    A null or empty text is one empty line. A null id counts as one document, below all others. Rows
    that repeat an id count as one document and are each treated by their own text.
    """
    # the join back is by id and a hash of the text: rows that repeat an id keep their own positions
    keyed = without(docs, "n_lines", "n_dropped").withColumns({
        "_llm_doc": F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), "_llm_row": F.xxhash64(text_of(text_column)), "_llm_text": text_of(text_column)})
    lines = _long_lines(keyed, min_chars)
    common = broadcast_if_small(cut_lineage(lines.groupBy("_llm_h1", "_llm_h2").agg(
        F.count_distinct("_llm_doc").alias("_llm_docs"), F.max("_llm_doc").alias("_llm_keep")).where(F.col("_llm_docs") >= min_docs).drop("_llm_docs")))
    drops = (
        lines.join(common, ["_llm_h1", "_llm_h2"]).where(F.col("_llm_doc") != F.col("_llm_keep"))
        .groupBy("_llm_doc", "_llm_row").agg(F.collect_set("_llm_pos").alias("_llm_drop"))
    )
    split = keyed.join(drops, ["_llm_doc", "_llm_row"], "left").withColumn("_llm_lines", F.split("_llm_text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_llm_lines") - 1), F.col("_llm_drop"))
    kept = F.when(F.col("_llm_drop").isNull(), F.col("_llm_text")).otherwise(
        F.array_join(F.transform(left, lambda p: F.get(F.col("_llm_lines"), p)), "\n"))
    return split.withColumns({
        text_column: kept, "n_lines": F.size("_llm_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_llm_drop"), F.lit(0)).cast("long"),
    }).select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
