"""Merkle manifest of a dataset, and membership proofs fetched as one multiproof per leaf partition."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.joins import join_small
from ..session import cut_lineage

BLOCK_LEVELS = 12  # a leaf partition holds 2**12 consecutive leaves at most
TOP = -1  # number of the tree above all trees
NODE = "tree long, level int, idx long, digest string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``_llm_rank``, the row's place from 0 in the whole order.

    Rows are dealt out by ranges and sorted inside their range; only a count per range is summed up, so no
    task holds more than its range. Rows that tie in all of ``order`` are told apart by where they were
    read, so a large group of equal rows is cut into ranges like any other.
    """
    held = cut_lineage(df).withColumn("_llm_tie", F.monotonically_increasing_id())
    placed = held.repartitionByRange(*order, F.col("_llm_tie")).sortWithinPartitions(*order, "_llm_tie").drop("_llm_tie")
    # the id counts from 0 in each range, with the range's number in the bits above
    placed = cut_lineage(placed.withColumn("_llm_at", F.monotonically_increasing_id())).withColumns({
        "_llm_part": F.shiftright("_llm_at", 33), "_llm_at": F.col("_llm_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_llm_part").agg(F.count("*").alias("_llm_n"))
    before = counts.select("_llm_part", (F.sum("_llm_n").over(Window.orderBy("_llm_part")) - F.col("_llm_n")).alias("_llm_before"))
    # as many rows as there are ranges
    return placed.join(F.broadcast(before), "_llm_part").withColumn("_llm_rank", F.col("_llm_before") + F.col("_llm_at")).drop("_llm_part", "_llm_at", "_llm_before")


def number_leaves(leaves: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """Adds ``tree`` (place of the row's group among the groups, null first, by UTF-8 bytes), ``idx`` (place of the leaf in it),
    ``n`` (its leaves) and ``trees`` (how many trees there are). In a group leaves ascend by ``order``, null first, then by digest."""
    by_group = F.col(group).asc_nulls_first()
    placed = ranked(leaves, by_group, F.col(order).asc_nulls_first(), F.col(digest))
    groups = placed.groupBy(group).agg(F.min("_llm_rank").alias("_llm_first"), F.count("*").alias("n"))
    trees = ranked(groups, by_group).withColumnRenamed("_llm_rank", "tree")
    numbered = join_small(placed, trees, [group]).withColumn("idx", F.col("_llm_rank") - F.col("_llm_first")).drop("_llm_rank", "_llm_first")
    return numbered.withColumn("trees", F.lit(trees.count()).cast("long"))


def _block(levels: int) -> Column:
    return F.shiftright("idx", levels).alias("block")


def _raise_block(base: int, levels: int):
    """Nodes of the next ``levels`` levels above one block of consecutive nodes of level ``base``."""
    def up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, block, n = key[0].as_py(), key[1].as_py(), table.column("n")[0].as_py()
        row = table.sort_by("idx").column("digest").to_pylist()
        out_level, out_idx, out = [], [], []
        for level in range(base + 1, min(base + levels, height(n)) + 1):
            row = [sha("".join(row[i:i + 2])) for i in range(0, len(row), 2)]
            start = block << (base + levels - level)
            out_level += [level] * len(row)
            out_idx += range(start, start + len(row))
            out += row
        return pa.table([pa.array([tree] * len(out), pa.int64()), pa.array(out_level, pa.int32()), pa.array(out_idx, pa.int64()), pa.array(out, pa.string()),
                         pa.array([n] * len(out), pa.int64())], ["tree", "level", "idx", "digest", "n"])

    return up


def raise_trees(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """All nodes ``(tree, level, idx, digest, n)`` over ``leaves(tree, idx, digest, n)``, leaves (level 0) included.

    One round lifts every block of ``2**levels`` consecutive nodes by as many levels in one task, so the rounds are
    few (three for 10^10 leaves) and each is read from a written table.
    """
    row = cut_lineage(leaves.select("tree", F.lit(0).alias("level"), "idx", "digest", "n"))
    most = row.agg(F.max("n")).first()[0] or 0
    nodes, base = row, 0
    while height(max(most, 1)) > base:
        built = cut_lineage(row.groupBy("tree", _block(levels)).applyInArrow(_raise_block(base, levels), NODE + ", n long"))
        nodes, base = nodes.unionByName(built), base + levels
        row = built.where(F.col("level") == base)
    return nodes


def missing(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The fewest nodes (level, idx) of a tree of ``n`` leaves from which, with the leaves ``known``, its root follows."""
    known, out = np.unique(known), []
    for level in range(height(n)):
        beside = known ^ 1
        need = beside[(beside < -(-n >> level)) & ~np.isin(beside, known)]
        out += [(level, int(i)) for i in need]
        known = np.unique(known >> 1)
    return out


def _ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The multiproof of a leaf partition: the coordinates it lacks in its own tree and in the one above."""
    tree, block = key[0].as_py(), key[1].as_py()
    own = missing(table.column("idx").to_numpy(), table.column("n")[0].as_py())
    top = missing(np.array([tree]), table.column("trees")[0].as_py())
    rows = [(tree, *x) for x in own] + [(TOP, *x) for x in top]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array([tree] * len(rows), pa.int64()), pa.array([block] * len(rows), pa.int64()),
                     pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
                    ["for_tree", "for_block", "tree", "level", "idx"])


def _expand(key: tuple[pa.Scalar, ...], mine: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of a partition, from its own leaves and what was fetched."""
    if not mine.num_rows:
        return mine.append_column("proof", pa.array([], pa.list_(pa.string()))).append_column("folded_root", pa.array([], pa.string()))
    tree, n, trees = (mine.column(c)[0].as_py() for c in ("tree", "n", "trees"))
    got = dict(zip(zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx"))), fetched.column("digest").to_pylist()))
    index = mine.column("idx").to_pylist()
    nodes = [dict(zip(index, mine.column("leaf").to_pylist()))]
    for level in range(height(n)):  # interior nodes that the partition's leaves share are derived once
        here = nodes[-1]
        for i in list(here):
            if (i ^ 1) not in here and (tree, level, i ^ 1) in got:
                here[i ^ 1] = got[tree, level, i ^ 1]
        nodes.append({i: sha(here[2 * i] + here.get(2 * i + 1, "")) for i in {j >> 1 for j in here}})
    above = [got.get((TOP, level, (tree >> level) ^ 1)) for level in range(height(trees))]
    proofs, roots = [], []
    for i, claimed in zip(index, mine.column("claimed").to_pylist()):
        steps = [(i >> level & 1, nodes[level].get((i >> level) ^ 1)) for level in range(height(n))]
        steps += [(tree >> level & 1, sibling) for level, sibling in enumerate(above)]
        for odd, sibling in steps:
            claimed = sha(claimed if sibling is None else sibling + claimed if odd else claimed + sibling)
        proofs.append([sibling for _, sibling in steps if sibling is not None])
        roots.append(claimed)
    return mine.append_column("proof", pa.array(proofs, pa.list_(pa.string()))).append_column("folded_root", pa.array(roots, pa.string()))


def build_manifest(docs: DataFrame, fields: list[str], group: str = "lang", order: str = "doc_id", claimed: Column | None = None,
                   levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame]:
    """``(leaves, nodes)`` of the Merkle trees of ``docs``: a tree per value of ``group``, and a tree over their roots.

    A leaf is the digest of a row's ``fields``; ``leaves`` has ``id``, ``group``, ``leaf``, ``claimed`` (a second digest
    to be verified later, the leaf itself if not given), ``tree``, ``idx``, ``n`` and ``trees``. ``nodes`` has every
    node's tree (``TOP``: the one above), level, index and digest. Texts are read once and only digests are shuffled.

    Null fields and groups, empty texts, repeated rows (each is a leaf) and an empty table (no leaves, no nodes) are
    allowed; columns beside ``fields`` are not part of the manifest, whatever their names.
    """
    leaf = leaf_digest(*[F.col(f"`{c}`") for c in fields])
    read = docs.select(F.col(f"`{order}`").alias("id"), F.col(f"`{group}`").cast("string").alias("group"), leaf.alias("leaf"),
                       (leaf if claimed is None else claimed).alias("claimed"))
    leaves = cut_lineage(number_leaves(read, "group", "id", "leaf"))
    nodes = raise_trees(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), levels)
    subroots = nodes.where(F.col("level") == _height(F.col("n")))
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(subroots.count()).cast("long").alias("n"))
    return leaves, nodes.unionByName(raise_trees(tops, levels))


def _height(n: Column) -> Column:
    """:func:`height` of a column: the bits of n - 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def prove(leaves: DataFrame, nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Membership proofs of ``leaves``, all or any of those of :func:`build_manifest`, against its ``nodes``.

    Adds ``proof`` (digests of the siblings, from the leaf up through its tree and the one above), ``folded_root``
    (the root that ``claimed`` and the proof lead to), ``subroot``, ``root`` and ``verified``.

    Leaves of a block make a partition. It works out the least union of coordinates that its leaves lack, which are
    fetched in one join, derives the interior nodes they share once and expands each leaf's proof by itself. A node
    near the root is asked for once per partition, not per leaf.
    """
    mine = leaves.groupBy("tree", _block(levels))
    asked = mine.applyInArrow(_ask, "for_tree long, for_block long, tree long, level int, idx long")
    fetched = asked.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    schema = T.StructType([*leaves.schema.fields, T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("folded_root", T.StringType())])
    proved = mine.cogroup(fetched.groupBy(F.col("for_tree"), F.col("for_block"))).applyInArrow(_expand, schema)
    ends = nodes.where(F.col("level") == _height(F.col("n")))
    subroots = ends.where(F.col("tree") != TOP).select("tree", F.col("digest").alias("subroot"))
    root = ends.where(F.col("tree") == TOP).first()  # one row, none of an empty table
    out = join_small(proved, subroots, ["tree"]).withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
