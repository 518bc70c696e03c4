"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .components import connected_components
from .text import ascii_lower, bounded_batches, text_of, without, words

SEED = 42
BITS = 64
GROUP_LIMIT = 20_000  # fingerprints of a block compared in one task; larger blocks are split further
# near_copies
WIDTH, SIMILARITY = 5, 0.8
SKETCH = 512  # bits: the parities of a text's shingles, dealt by hash
FIRST, NEXT, MATES = 8, 8, 4  # first shingles under which mates are looked for, neighbours tried under each, closest ones verified first
LOW = 0.28  # share of all hashes by which texts are judged first; any share gives the same links
PAIRS = 1_000_000  # candidate pairs put out at a time
ROWS = 200_000  # rows of blocks, or of shingles, handled at a time


def fingerprint(text: str | None, width: int) -> int:
    """Signed 64-bit SimHash over XXH64 of all word shingles, repeats included; a bit is set if more than half the hashes set it."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z, and the white space \\x20 and \\x09-\\x0D
    if not parts:
        return 0
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= width:
        return int(np.uint64(hashed(joined, SEED)).astype(np.int64))
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_column: str = "text", width: int = 3) -> DataFrame:
    """Adds ``fingerprint`` (long): a narrow pass, one batch at a time."""
    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, width) for t in batch], dtype="int64")

    return without(bounded_batches(docs), "fingerprint").withColumn("fingerprint", simhash(F.col(text_column)))


def _masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all choices of ``blocks - distance`` blocks: fingerprints within ``distance`` agree on one choice at least."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _block_keys(distinct: DataFrame, blocks: int, distance: int) -> DataFrame:
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(blocks, distance)])
    return distinct.select("fingerprint", F.posexplode(masks).alias("choice", "mask")).select(
        "fingerprint", "choice", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"))


def _linked(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links (value, smallest value of its component) of 64-bit values within ``distance`` bits of each other.

    A search from each component's first value; every value is compared with those not yet reached, so
    memory is linear and the links put out are fewer than the values.
    """
    left, links = np.unique(values).view(np.uint64), []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                links += [(int(v.astype(np.int64)), int(root.astype(np.int64))) for v in left[near]]
                queue.extend(left[near])
                left = left[~near]
    return links


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in order of (choice, key) as arrays (choice, key, fingerprint) that never part a group, about ``ROWS`` rows at a time."""
    held: list[pd.DataFrame] = []

    def arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return frame["choice"].to_numpy(), frame["key"].to_numpy(), frame["fingerprint"].to_numpy()

    limit, rows = ROWS, 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= limit:
            joined = pd.concat(held, ignore_index=True)
            choice, key, _ = arrays(joined)
            other = np.flatnonzero((choice != choice[-1]) | (key != key[-1]))  # the last group may go on
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield arrays(joined.iloc[:cut])
            held, rows = [joined.iloc[cut:]], len(joined) - cut
            limit = max(ROWS, 2 * rows)
    if rows:
        yield arrays(pd.concat(held, ignore_index=True))


def near_links(distinct: DataFrame, distance: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links ``(a, b)`` that connect the same fingerprints as all pairs within ``distance`` bits do.

    Pigeonhole: 64 bits are cut into twice as many blocks as bits may differ; two fingerprints so close
    agree on half the blocks, so they meet under one of the choices. Each meeting is verified on the
    whole fingerprints, and a group puts out spanning links only, never its pairs. A task walks many groups, in order
    of their keys, so a small group costs microseconds. Groups are counted
    first: those above ``group_limit`` are cut again under 16 blocks, whose groups hold 4,096
    fingerprints at most by construction, so no group is unbounded and none is dropped.
    """
    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for choice, key, values in _whole_groups(frames):
            edges = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]), True]).tolist()
            found = [pair for a, b in zip(edges, edges[1:]) for pair in _linked(values[a:b], distance)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def linked(groups: DataFrame) -> DataFrame:
        # a given number of tasks: groups are small in bytes, but costly to compare
        tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return groups.select("choice", "key", "fingerprint").repartition(tasks, "choice", "key").sortWithinPartitions("choice", "key").mapInPandas(
            link, "a long, b long")

    keys = _block_keys(distinct, 2 * distance, distance)
    # written first, so that the join is not dealt like the count and a large block can be split
    sizes = broadcast_if_small(cut_lineage(keys.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")))
    met = cut_lineage(keys.join(sizes, ["choice", "key"]))
    crowded = met.where(F.col("n") > group_limit).select("fingerprint").distinct()
    return linked(met.where(F.col("n") <= group_limit)).unionByName(linked(_block_keys(crowded, 16, distance)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, distance: int = 3,
                    group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per input row.

    Documents link if their fingerprints (long) differ in ``distance`` bits or fewer; the component id
    is the smallest id reachable. Equal fingerprints are merged before anything is joined, so groups of
    exact copies cost one row. The documents' narrow table (id and fingerprint) is written once to the
    shared checkpoint folder, as fingerprints are the costly part.

    A null or empty text has fingerprint zero and links like any other. Null ids rank above all others
    in the choice of a component's id (null only if all its ids are null). Repeated rows stay.
    """
    marked = cut_lineage(fingerprints(docs.select(F.col(id_column).alias("_llm_id"), F.col(text_column).alias("_llm_text")), "_llm_text", width)
                         .select("_llm_id", "fingerprint"))
    distinct = marked.groupBy("fingerprint").agg(F.min("_llm_id").alias("_llm_least"))
    linked = connected_components(near_links(distinct.select("fingerprint"), distance, group_limit))
    # fingerprint -> smallest id of its component; those without a link are their own
    labelled = distinct.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "_llm_least", F.coalesce("component", "fingerprint").alias("component"))
    least = labelled.groupBy("component").agg(F.min("_llm_least").alias("component_id"))
    of_print = labelled.join(least, "component").select("fingerprint", "component_id")
    return marked.join(of_print, "fingerprint").select(F.col("_llm_id").alias(id_column), "fingerprint", "component_id")


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of fewer words, of the whole sequence; none of none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= width:
        return np.array([hashed(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())], dtype=np.uint64)


def parities(h: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits as signed words. Two sets differ in as many elements at least as their bits do."""
    return np.packbits(np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1, bitorder="little").view(np.int64)


def prefix(h: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first of ``h`` (distinct, ascending), ``common`` ones (ascending) last: two sets as similar share one of theirs at least."""
    if not len(h):
        return h
    if len(common):
        late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate([h[~late], h[late]])
    return h[:len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def jaccard(a: str | None, b: str | None, width: int = WIDTH) -> float:
    """Jaccard similarity of the distinct shingles; of two texts without a word 1."""
    x, y = np.unique(shingles(a, width)), np.unique(shingles(b, width))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _whole_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key that never part a block, about ``ROWS`` at a time."""
    held: list[pd.DataFrame] = []
    limit, rows = ROWS, 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= limit:
            joined = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(joined["key"].to_numpy(), joined["key"].iloc[-1]))  # the last block may go on
            if cut:
                yield joined.iloc[:cut]
            held, rows = [joined.iloc[cut:]], len(joined) - cut
            limit = max(ROWS, 2 * rows)
    if rows:
        yield pd.concat(held, ignore_index=True)


def _spelled(texts: DataFrame, similarity: float, share: float) -> DataFrame:
    """Rows ``(node, key, spare)`` of ``texts(node, _llm_text)``, each shingle once: those in the lowest ``share`` of all hashes, but
    a prefix's number at least. ``spare``: how many of them can be in other texts while those that are left rule every mate out.
    """
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def frame(held: list[tuple[int, np.ndarray, int]]) -> pd.DataFrame:
        times = [len(h) for _, h, _ in held]
        return pd.DataFrame({"node": np.repeat(np.array([n for n, _, _ in held], np.int64), times), "key": np.concatenate([h for _, h, _ in held]).view(np.int64),
                             "spare": np.repeat(np.array([s for _, _, s in held], np.int32), times)})

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for f in frames:
            for node, text in zip(f["node"], f["_llm_text"]):
                h = np.unique(shingles(text))
                least = len(prefix(h, similarity, h[:0]))
                h = h[:max(least, int(np.searchsorted(h, limit)) if share < 1 else len(h))]
                held.append((node, h, len(h) - least))
                rows += len(h)
                if rows >= ROWS:
                    yield frame(held)
                    held, rows = [], 0
        if rows:
            yield frame(held)

    return bounded_batches(texts).select("node", "_llm_text").mapInPandas(spell, "node long, key long, spare int")


def _held(block: pd.DataFrame) -> pd.DataFrame:
    """Rows in order of (key, node), repeated ones once, with ``df``: how many texts hold the key."""
    key, node = block["key"].to_numpy(), block["node"].to_numpy()
    block = block[np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]]
    key = block["key"].to_numpy()
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
    return block.assign(df=np.repeat(sizes, sizes))


def with_mates(texts: DataFrame, similarity: float = SIMILARITY, share: float = LOW) -> DataFrame:
    """The nodes of ``texts(node, _llm_text)`` but those that surely link to no other.

    Two texts as similar miss less than a prefix's number of each other's shingles, so a text with as many in no other text
    has no mate. That is judged by the shingles in the lowest ``share`` of all hashes, which every text lists whole. A text with
    too few of them lists more, which count as not its own. Repeated rows count once.
    """
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _whole_blocks(frames):
            block = _held(block)
            block = block[(block["df"].to_numpy() > 1) | (block["key"].to_numpy().view(np.uint64) >= limit)]
            nodes, at, n = np.unique(block["node"].to_numpy(), return_index=True, return_counts=True)
            yield pd.DataFrame({"node": nodes, "spare": block["spare"].to_numpy()[at], "n": n})

    counts = _spelled(texts, similarity, share).repartition("key").sortWithinPartitions("key", "node").mapInPandas(shared, "node long, spare int, n long")
    return counts.groupBy("node").agg(F.first("spare").alias("spare"), F.sum("n").alias("n")).where("n > spare").select("node")


def prefixes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, n_met, first)`` of ``texts(node, _llm_text)``: the prefix of each text that may link to another, in order of how many texts
    hold a shingle. It begins with those that no other text holds (all but ``n_met``); they meet nobody, so only what comes after them is listed.
    """
    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _whole_blocks(frames):
            block = _held(block)
            yield block[block["df"].to_numpy() > 1]

    met = _spelled(texts, similarity, 1.0).repartition("key").sortWithinPartitions("key", "node").mapInPandas(shared, "node long, key long, spare int, df long")
    grouped = met.groupBy("node").agg(F.first("spare").alias("spare"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("met"))
    return grouped.where(F.size("met") > F.col("spare")).select(
        "node", F.size("met").alias("n_met"), F.slice("met.key", F.lit(1), F.size("met") - F.col("spare")).alias("first"))


def _pairs(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    a, b, *rest = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(len(names)))
    return pd.DataFrame(dict(zip(names, (np.minimum(a, b), np.maximum(a, b), *rest)))).drop_duplicates()


def _block_pairs(block: pd.DataFrame, similarity: float, steps: int | None = None) -> Iterator[pd.DataFrame]:
    """Pairs of rows of one ``key`` and different ``part`` that may reach ``similarity`` by their ``size`` and by what can follow
    the shared shingle's place (``pos``); with ``steps``, only those so many rows apart. Rows with ``bits`` (parities) are held against
    these too, and the pairs put out with the number in which they differ (``apart``).

    A pair that reaches it passes under its first shared shingle, so it is left out under others without loss.
    """
    key, node, part, size, pos = (block[c].to_numpy() for c in ("key", "node", "part", "size", "pos"))
    bits = np.frombuffer(b"".join(block["bits"]), np.uint64).reshape(len(block), -1) if "bits" in block else None
    names = ["a", "b"] if bits is None else ["a", "b", "apart"]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    end = np.repeat(starts + sizes, sizes)
    found, rows, at, step = [], 0, np.arange(len(key)), 1
    while len(at := at[at + step < end[at]]) and (steps is None or step <= steps):
        to = at + step
        both = size[at].astype(np.int64) + size[to]
        shared = np.minimum(size[at] - pos[at], size[to] - pos[to])
        may = np.flatnonzero((part[at] != part[to]) & (shared >= similarity / (1 + similarity) * both - 1e-9))
        x, y = at[may], to[may]
        pairs = (node[x], node[y])
        if bits is not None:
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            near = apart <= (1 - similarity) / (1 + similarity) * both[may] + 1e-9
            pairs = (node[x[near]], node[y[near]], apart[near])
        found.append(pairs)
        rows += len(pairs[0])
        step += 1
        if rows >= PAIRS:
            yield _pairs(found, names)
            found, rows = [], 0
    yield _pairs(found, names)


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id, _llm_row, kept_id, kept_row)``, one row per distinct id and text: the row that stands for its component.

    Documents link if the Jaccard similarity of their five-word shingles is ``similarity`` or more, computed
    exactly, and no such link between different components is left out. Who is compared: two texts as similar miss less than a fifth of each
    other's shingles, and one more, at 0.8. So a text with as many that no other text holds is done; it is judged by the shingles of
    low hash first, and what is left by all of theirs. Of the others, two that link share one of so many first shingles in any order; the order is
    by the number of texts that hold a shingle, rarest first, and these are the blocks.
    Sizes, the place of the shared shingle and 512 parities bound what two texts can share; pairs below never leave their block.

    First each text is verified against its closest mates among neighbours under its first shingles. What these links connect
    is not compared again, so a large group of near copies costs rows in proportion to its size; of the rest every pair that
    passes the bounds is verified.

    Texts that are equal but for case and white space are one node. ``_llm_row`` is a hash of the text, so that
    rows which repeat an id are told apart; the row kept has the smallest id, null last, then the smallest hash.

    Null and empty texts, and those of white space only, are one node, so one of them is kept. Long texts are hashed
    whole. An empty table gives an empty result; other columns are not read, so their names cannot clash. A dense group
    of many components whose similarities lie just below ``similarity``, though their texts hold little of their own, is compared by the square
    of its size; a block is one task's.
    """
    read = docs.select(F.col(id_column).alias("_llm_id"), text_of(text_column).alias("_llm_text"))
    noded = read.withColumn("node", F.xxhash64(F.array_join(words(ascii_lower(F.col("_llm_text"))), " "))).withColumn("_llm_row", F.xxhash64("_llm_text"))
    rank = F.struct(F.col("_llm_id").isNull(), "_llm_id", "_llm_row")

    @F.pandas_udf("struct<size:int,bits:binary>")
    def printed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [np.unique(shingles(t)) for t in batch]
            yield pd.DataFrame({"size": [len(h) for h in sets], "bits": [parities(h).tobytes() for h in sets]})

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype="float64")

    marked = cut_lineage(noded.select("_llm_id", "_llm_row", "node").distinct())
    # one row of each node, so that a large group of copies is one text
    several = marked.groupBy("node").agg(F.count("*").alias("n"), F.min_by(F.struct("_llm_id", "_llm_row"), rank).alias("one")).where("n > 1").select("node", "one")
    copies = broadcast_if_small(cut_lineage(marked.join(several, "node").where(
        ~(F.col("_llm_id").eqNullSafe(F.col("one._llm_id")) & (F.col("_llm_row") == F.col("one._llm_row")))).select(F.col("_llm_id").alias("_copy"), F.col("_llm_row").alias("_copy_row"))))
    single = noded.join(copies, noded["_llm_id"].eqNullSafe(copies["_copy"]) & (noded["_llm_row"] == copies["_copy_row"]), "left_anti").select("node", "_llm_text")
    mated = broadcast_if_small(cut_lineage(with_mates(single, similarity)))
    texts = cut_lineage(single.join(mated, "node", "left_semi").dropDuplicates(["node"]))
    prints = cut_lineage(prefixes(texts, similarity).join(bounded_batches(texts).select("node", printed("_llm_text").alias("print")), "node").select(
        "node", "print.*", (F.col("print.size") - F.col("n_met")).alias("own"), "first"))

    def near(parted: DataFrame, first: Column, steps: int | None = None) -> DataFrame:
        """Pairs of nodes of different ``part`` that share one of ``first`` and may be as similar, and in how many bits they differ."""
        def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block in _whole_blocks(frames):
                yield from _block_pairs(block, similarity, steps)

        rows = parted.select("node", "part", "size", "own", "bits", F.posexplode(first).alias("i", "key")).select(
            "node", "part", "size", (F.col("own") + F.col("i")).alias("pos"), "bits", "key")
        return cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInPandas(candidates, "a long, b long, apart long").distinct())

    def verified(some: DataFrame) -> DataFrame:
        wanted = broadcast_if_small(cut_lineage(some.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        needed = texts.join(wanted, "node", "left_semi")
        both = some.join(needed.select(F.col("node").alias("a"), F.col("_llm_text").alias("s")), "a").join(
            needed.select(F.col("node").alias("b"), F.col("_llm_text").alias("t")), "b")
        return cut_lineage(both.select("a", "b", likeness("s", "t").alias("likeness")).where(F.col("likeness") >= similarity).select("a", "b"))

    tried = near(prints.withColumn("part", F.col("node")), F.slice("first", 1, FIRST), NEXT)
    sides = tried.select("a", "b", "apart").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))  # a node has FIRST * NEXT * 2 mates at most
    closest = sides.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("apart", "b"))), 1, MATES).alias("m")).select("a", F.explode("m.b").alias("b"))
    links = verified(cut_lineage(closest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    known = connected_components(links)
    parted = prints.join(known, "node", "left").withColumn("part", F.coalesce("component", "node"))
    # from the stars of the first links, so that what they connect is settled
    linked = connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(near(parted, F.col("first")))))
    labelled = marked.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = labelled.groupBy("component").agg(F.min_by(F.struct("_llm_id", "_llm_row"), rank).alias("kept"))
    return labelled.join(kept, "component").select(
        F.col("_llm_id").alias(id_column), "_llm_row", F.col("kept._llm_id").alias("kept_id"), F.col("kept._llm_row").alias("kept_row"))


def hex_of(c: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
