"""Joins that are safe for null keys, and joins of a fact table with a small one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage

SALTS = 32


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join by name where null equals null; the key columns appear once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    matches: Column = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in on])
    return left.join(renamed, matches, how).drop(*[f"_right_{k}" for k in on])


@dataclass(frozen=True)
class SmallSide:
    """A table written once and counted, to be joined with many fact tables."""

    table: DataFrame
    broadcast: bool

    @classmethod
    def of(cls, df: DataFrame, max_rows: int = BROADCAST_ROWS) -> SmallSide:
        held = cut_lineage(df)
        return cls(held, held.limit(max_rows + 1).count() <= max_rows)

    def join(self, fact: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """Broadcast if the count allows. Otherwise each of its rows is repeated under ``SALTS`` salts and the facts
        are dealt by key and salt, so no key is one task. The result is the same either way; null equals null.
        """
        if self.broadcast:
            return null_safe_join(fact, F.broadcast(self.table), on, how)
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in fact.dtypes if "map<" not in kind]), F.lit(SALTS)).cast("int")
        return null_safe_join(fact.withColumn("_salt", salt), self.table.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")


def join_small(fact: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a fact table with a table that is expected to be small, without dealing the facts out by a few keys.

    ``how`` is any join that keeps or matches rows of ``fact``; see :class:`SmallSide`.
    """
    return SmallSide.of(small, max_rows).join(fact, on, how)
