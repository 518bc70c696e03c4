"""Column expressions on texts, and span arithmetic in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import computed

BLANK = " \t\n\x0b\x0c\r"  # the characters \x20 and \x09-\x0D
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 256
CONTEXT = 32
ROWS_PER_BATCH = 1_000

__all__ = ["BLANK", "BLANKS", "ascii_lower", "bounded_batches", "computed", "digest", "find_spans", "running", "span_list", "text_of", "words", "without"]


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand Python workers no more rows at a time than fit memory when all texts are long."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= ROWS_PER_BATCH:
        df.sparkSession.conf.set(setting, str(ROWS_PER_BATCH))
    return df


def text_of(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add."""
    return df.drop(*names)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; pure ASCII takes the fast path with the same result."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Maximal runs of characters outside ``[\\x20\\x09-\\x0D]``; an empty text has none."""
    return F.array_remove(F.split(c, BLANKS), "")


def digest(c: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def running(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """Exclusive prefix results of an associative ``step`` over an array of longs.

    Appending to an array copies it, so steps run inside blocks and then over blocks:
    near-linear for any length that fits a cell.
    """
    start = F.lit(zero).cast("bigint")

    def scan(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(F.array().cast("array<bigint>").alias("before"), start.alias("total")),
            lambda acc, n: F.struct(F.concat(acc["before"], F.array(acc["total"])).alias("before"), step(acc["total"], n.cast("bigint")).alias("total")))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / F.lit(float(BLOCK))).cast("int") - 1),
                         lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    both = F.transform(F.array(F.transform(blocks, scan)), lambda s: F.struct(s.alias("s"), scan(F.transform(s, lambda x: x["total"]))["before"].alias("at")))
    whole = F.transform(both, lambda x: F.flatten(F.zip_with(x["s"], x["at"], lambda s, at: F.transform(s["before"], lambda v: step(at, v)))))[0]
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(whole)


def find_spans(df: DataFrame, columns: dict[str, str], text: str) -> DataFrame:
    """Leftmost non-overlapping matches as arrays of (start, end, value, before), offsets in code points, end exclusive;
    ``before`` are the last characters between it and the match before.

    ``columns`` maps a new column to a Java pattern that never matches the empty string.
    The pieces between the matches carry the offsets: split and extract walk the text alike.
    """
    def placed(found: Column) -> Column:
        """``found``: struct of the pieces between matches and the matches."""
        sizes = F.transform(F.array(found), lambda f: F.struct(f["hits"].alias("hits"), f["gaps"].alias("gaps"), F.flatten(F.zip_with(
            f["gaps"], f["hits"], lambda g, h: F.array(F.char_length(g), F.coalesce(F.char_length(h), F.lit(0))))).alias("lengths")))
        at = F.transform(sizes, lambda p: F.struct(p["hits"].alias("hits"), p["gaps"].alias("gaps"), running(p["lengths"], 0, lambda a, n: a + n).alias("at")))
        return F.transform(at, lambda a: F.transform(a["hits"], lambda h, i: F.struct(
            a["at"][i * 2 + 1].alias("start"), (a["at"][i * 2 + 1] + F.char_length(h)).alias("end"), h.alias("value"),
            F.substring(a["gaps"][i], -CONTEXT, CONTEXT).alias("before"))))[0]

    t = F.col(text)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    hits = computed(df, {f"_llm_{n}_hits": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for n, p in columns.items()})
    found = hits.select("*", *[
        F.when(F.size(f"_llm_{n}_hits") > 0, F.struct(F.split(t, p, -1).alias("gaps"), F.col(f"_llm_{n}_hits").alias("hits"))).alias(f"_llm_{n}_found")
        for n, p in columns.items()])
    return computed(found, {n: F.when(F.col(f"_llm_{n}_found").isNull(), none).otherwise(placed(F.col(f"_llm_{n}_found"))) for n in columns}).drop(
        *[f"_llm_{n}_{k}" for n in columns for k in ("hits", "found")])


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of an array of structs in its own order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
