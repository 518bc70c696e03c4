"""Removal of repeated byte strings by merged Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint_dir
from .lines import NO_ID
from .text import bounded_batches, text_of, without

LENGTH = 200
GRAM = 72  # bytes of an anchor; every window of LENGTH bytes holds LENGTH - GRAM + 1 candidates
BLOCK = 32  # windows that share one core
CHUNK = 1 << 23  # bytes anchored at a time
POSITION = np.uint64((1 << 24) - 1)
SHARD = 200_000  # symbols of a shard
BATCH = 2_000_000  # bytes of contexts merged together
CROWD = 20_000  # distinct contexts of an anchor above which its windows are counted by Spark instead


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of each run of ``size`` bytes, from hashes of halves; it depends on content only."""
    step, width = x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x1234567), 1
    power = np.array([0x9E3779B97F4A7C15], np.uint64)  # an array wraps around silently
    out, done = None, 0
    while size:
        if size & 1:
            if out is None:
                out, done = step, width
            else:
                n = len(step) - done
                out, done = out[:n] * power + step[done:], done + width
        size >>= 1
        if size:
            step, width, power = step[:-width] * power + step[width:], width * 2, power * power
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0x7FB5D329728EA185)
    return out ^ (out >> np.uint64(29))


def window_runs(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document, first start, windows, anchor start, anchor hash), starts in ``x``.

    ``ends`` are where the documents that make up ``x`` end. A window's anchor is the gram with the least
    hash in it, the leftmost of equals: it depends on the window's bytes alone, so equal windows have
    equal anchors at equal distance.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(x) < LENGTH:
        return none
    grams = gram_hashes(x, GRAM)
    least, size, width = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64), 1, LENGTH - GRAM + 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    n = len(x) - LENGTH + 1
    anchor = (np.minimum(least[:n], least[width - size:width - size + n]) & POSITION).astype(np.int64)
    start = np.arange(n)
    doc = np.searchsorted(ends, start, side="right")
    inside = start + LENGTH <= ends[doc]
    start, anchor, doc = start[inside], anchor[inside], doc[inside]
    if not len(start):
        return none
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    return doc[first], start[first], np.diff(np.r_[first, len(start)]), anchor[first], grams[anchor[first]].view(np.int64)


def anchored(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], tuple[np.ndarray, ...]]]:
    """Groups of texts as (their indices, their offsets, runs with starts relative to the text); a text over CHUNK comes in overlapping parts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple:
        lengths = np.array([len(b) for _, _, b in held], dtype=np.int64)
        ends = np.cumsum(lengths)
        doc, start, windows, anchor, gram = window_runs(np.frombuffer(b"".join(b for _, _, b in held), np.uint8), ends)
        base = (ends - lengths)[doc] if len(doc) else doc
        shift = np.array([o for _, o, _ in held], dtype=np.int64)[doc] if len(doc) else doc
        index = np.array([i for i, _, _ in held], dtype=np.int64)[doc] if len(doc) else doc
        return index, start - base + shift, windows, anchor - base + shift, gram

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[at:at + CHUNK + LENGTH - 1]
            if len(part) >= LENGTH:
                held.append((i, at, part))
                size += len(part)
            if size >= CHUNK // 8:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _local_order(symbols: np.ndarray, nxt: np.ndarray, longest: int) -> np.ndarray:
    """Rotations of a shard's strings in order, by doubling the compared length."""
    rank, jump, width = np.unique(symbols, return_inverse=True)[1].astype(np.int64), nxt, 1
    while width < 2 * longest:
        rank = np.unique(rank * len(symbols) + rank[jump], return_inverse=True)[1].astype(np.int64)
        jump, width = jump[jump], width * 2
    return np.argsort(rank, kind="stable")


def merged_classes(symbols: np.ndarray, lengths: np.ndarray, depth: int, shard: int = SHARD) -> np.ndarray:
    """Classes of suffixes (rotations of distinct strings, each ended by symbol 0) that agree in ``depth`` symbols.

    ``symbols`` are the strings one behind the other, ``lengths`` theirs. Each shard of strings gets its
    own Burrows-Wheeler transform. They are merged by refining the interleave: it says, in order, which
    shard the next suffix comes from. Reading the transforms through it and sorting stably by the symbol
    read gives the interleave for one more symbol; a boundary that appears in round k is a common prefix
    of k symbols. After ``depth`` rounds the intervals between boundaries are the classes. Suffixes are
    never compared across shards.

    Returns the class of each position, numbered in order.
    """
    ends = np.cumsum(lengths)
    nxt = np.arange(1, len(symbols) + 1)
    nxt[ends - 1] = ends - lengths
    found, dense = np.unique(symbols, return_inverse=True)
    dense = dense.astype(np.uint16 if len(found) < 65_536 else np.int64)
    prev = np.empty(len(symbols), np.int64)
    prev[nxt] = np.arange(len(symbols))
    cuts = np.flatnonzero(np.diff(np.r_[-1, (ends - 1) // shard]))  # first string of each shard
    bounds = np.r_[(ends - lengths)[cuts], len(symbols)]
    order, turns = [], []
    for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        order.append(_local_order(dense[a:b].astype(np.int64), nxt[a:b] - a, int(lengths.max())) + a)
        turns.append(np.full(b - a, s, np.int32))
    transforms = dense[prev[np.concatenate(order)]]  # the shards' transforms, one behind the other
    interleave = np.concatenate(turns)
    group = np.zeros(len(symbols), np.int64)

    def place(z: np.ndarray) -> np.ndarray:
        """Where the interleave reads: the n-th turn of a shard reads its n-th entry."""
        at = np.empty(len(z), np.int64)
        by = np.argsort(z, kind="stable")
        at[by] = np.arange(len(z))  # shards lie one behind the other, in the order of their numbers
        return at

    for _ in range(depth):
        read = transforms[place(interleave)]
        by = np.argsort(read, kind="stable")
        interleave, read, before = interleave[by], read[by], group[by]
        group = np.cumsum(np.r_[0, (read[1:] != read[:-1]) | (before[1:] != before[:-1])])
    classes = np.empty(len(symbols), np.int64)
    classes[np.concatenate(order)[place(interleave)]] = group
    return classes


def _laid(blobs: list[bytes], at: np.ndarray, symbols: np.ndarray) -> None:
    """Writes each blob's bytes, one up, from position ``at`` on."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols[np.repeat(at, lengths) + within] = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64) + 1


def repeated_windows(contexts: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """For each distinct context (bytes, anchor offset, copies): which of its windows occur twice or more among all.

    A context is cut into blocks of windows aligned on the anchor. The bytes that all windows of a block
    hold, its core, become one symbol; what is left and right of it stays bytes. So a window is BLOCK symbols.
    """
    cores: dict[bytes, int] = {}
    parts: dict[tuple[int, bytes, bytes], int] = {}
    members: list[tuple[int, int, int]] = []  # string, context, start of the core
    for c, (text, anchor, _) in enumerate(contexts):
        last = len(text) - LENGTH
        for b in range((anchor - last) // BLOCK, anchor // BLOCK + 1):
            start = anchor - b * BLOCK
            stop = start - BLOCK + 1 + LENGTH
            core = cores.setdefault(text[start:stop], len(cores))
            members.append((parts.setdefault((core, text[max(0, start - BLOCK + 1):start], text[stop:stop + BLOCK - 1]), len(parts)), c, start))
    string, context, core_at = np.array(members, dtype=np.int64).T
    keys = list(parts)
    core_of = np.fromiter((k[0] for k in keys), np.int64, len(keys))
    lefts = np.fromiter((len(k[1]) for k in keys), np.int64, len(keys))
    rights = np.fromiter((len(k[2]) for k in keys), np.int64, len(keys))
    copies = np.fromiter((n for _, _, n in contexts), np.int64, len(contexts))
    times = np.bincount(string, copies[context], len(keys))
    step = np.arange(BLOCK)  # of a window: symbols before the core
    valid = (step <= lefts[:, None]) & (BLOCK - 1 - step <= rights[:, None])
    repeated = valid & (times >= 2)[:, None]

    # a core that one string has is in no other window: only strings that share theirs are merged
    shared = np.flatnonzero(np.bincount(core_of)[core_of] > 1)
    if len(shared):
        lengths = lefts[shared] + rights[shared] + 2
        begin = np.cumsum(lengths) - lengths
        symbols = np.zeros(int(lengths.sum()), np.int64)  # zero ends each string
        _laid([keys[i][1] for i in shared.tolist()], begin, symbols)
        symbols[begin + lefts[shared]] = 257 + core_of[shared]
        _laid([keys[i][2] for i in shared.tolist()], begin + lefts[shared] + 1, symbols)
        classes = merged_classes(symbols, lengths, BLOCK)
        which, d = np.nonzero(valid[shared])
        own = classes[begin[which] + lefts[shared][which] - d]
        total = np.bincount(own, times[shared][which])
        hit = total[own] >= 2
        repeated[shared[which[hit]], d[hit]] = True

    windows = np.fromiter((len(text) - LENGTH + 1 for text, _, _ in contexts), np.int64, len(contexts))
    first = np.cumsum(windows) - windows
    flags = np.zeros(int(windows.sum()), bool)
    member, d = np.nonzero(repeated[string])
    flags[first[context[member]] + core_at[member] - d] = True
    return np.split(flags, first[1:])


def _runs(flags: np.ndarray) -> list[int]:
    """Maximal runs of true flags as start, end, start, end, ..."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False])).tolist()


def _anchor_rows(with_place: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for index, start, windows, anchor, gram in anchored(part.column(2).to_pylist()):
                    if len(index) and with_place:
                        at = pa.array(index)
                        yield pa.RecordBatch.from_arrays([pa.array(gram), part.column(0).take(at), part.column(1).take(at), pa.array(start),
                                                          pa.array(windows.astype(np.int32)), pa.array((anchor - start).astype(np.int32))],
                                                         ["gram", "doc", "row", "start", "windows", "anchor"])
                    elif len(index):
                        yield pa.RecordBatch.from_arrays([pa.array(gram)], ["gram"])
    return emit


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gram", "doc", "row", "start", "windows", "anchor", "d1", "d2", "bytes"]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part, rows = batch.slice(i, 256), []
            for r in part.to_pylist():
                for p in r["places"]:
                    text = r["bytes"][p["start"]:p["start"] + p["windows"] - 1 + LENGTH]
                    both = xxhash.xxh3_128_intdigest(text)
                    rows.append((p["gram"], r["doc"], r["row"], p["start"], p["windows"], p["anchor"], (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63), text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            for j in range(0, len(rows), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[j:j + 5_000]), kinds)], names)


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: merges all contexts of an anchor, many anchors at a time."""
    held: list[dict] = []
    size = 0

    def merge() -> pa.RecordBatch:
        found = repeated_windows([(r["bytes"], r["anchor"], r["copies"]) for r in held])
        return pa.RecordBatch.from_arrays([
            pa.array([r["gram"] for r in held], pa.int64()), pa.array([r["d1"] for r in held], pa.int64()), pa.array([r["d2"] for r in held], pa.int64()),
            pa.array([_runs(f) for f in found], pa.list_(pa.int32()))], ["gram", "d1", "d2", "runs"])

    for batch in batches:
        for r in batch.to_pylist():
            if size >= BATCH and r["gram"] != held[-1]["gram"]:
                yield merge()
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"])
    if held:
        yield merge()


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and starts of repeated windows to what is kept: (row columns..., n_bytes, n_removed, n_spans, kept)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part, sizes, removed, spans, kept = batch.slice(i, 256), [], [], [], []
            for text, copied, runs in zip(part.column("_llm_bytes").to_pylist(), part.column("_llm_copied").to_pylist(), part.column("_llm_runs").to_pylist()):
                gone = [(0, len(text))] if copied and len(text) >= LENGTH else _union([(r["a"], r["b"] - 1 + LENGTH) for r in runs or []])
                left, at = [], 0
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                kept.append(b"".join([*left, text[at:]]))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                spans.append(len(gone))
            own = [c for c in part.schema.names if not c.startswith("_llm_")]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [*own, "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", crowd: int = CROWD) -> DataFrame:
    """Removes from each text every byte of a 200-byte string that starts anywhere else too, same document included.

    Adds ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary: a cut may part
    a character); the text itself is left out. Strings are judged on the input and never cross documents.

    * Exact copies are merged first by digest: their texts go as a whole, and one of each supports the rest.
    * A window's anchor (its gram of least hash) finds its possible partners: equal windows have equal anchors.
      Anchors that occur once are dropped, which drops nothing repeated. Counts are combined before the shuffle.
    * The windows of an anchor make a context of bytes. Equal contexts are counted like exact copies; where an anchor
      has several, shards of contexts get their Burrows-Wheeler transforms, and these are merged by
      interleave refinement (:func:`merged_classes`) into common prefixes and repeated intervals.
      Tasks hold a bounded batch. An anchor with more than ``crowd`` distinct contexts isn't merged in one
      task; its windows are counted by digest in Spark, with the same result.

    A null or empty text has nothing to remove. Ids may be null or repeat: rows are told apart by id and
    a hash of the text.
    """
    read = without(bounded_batches(docs), "n_bytes", "n_removed", "n_spans", "kept").withColumns({
        "_llm_doc": F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), "_llm_row": F.xxhash64(text_of(text_column)),
        "_llm_more": F.xxhash64(F.lit(1), text_of(text_column)), "_llm_bytes": text_of(text_column).cast("binary")})
    digest = ["_llm_row", "_llm_more"]
    copies = read.groupBy(*digest).agg(F.count("*").alias("_llm_n"), F.min("_llm_doc").alias("_llm_least")).where("_llm_n > 1")
    copies = broadcast_if_small(_written(copies))
    marked = read.join(copies, digest, "left")
    # one text of each: anchors are looked for in these only
    single = marked.where(F.col("_llm_n").isNull() | (F.col("_llm_doc") == F.col("_llm_least"))).where(F.octet_length("_llm_bytes") >= LENGTH).select(
        F.col("_llm_doc").alias("doc"), F.col("_llm_row").alias("row"), F.col("_llm_bytes").alias("bytes"))
    often = single.mapInArrow(_anchor_rows(False), "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    places = single.mapInArrow(_anchor_rows(True), "gram long, doc long, row long, start long, windows int, anchor int").join(often, "gram").groupBy("doc", "row").agg(
        F.collect_set(F.struct("gram", "start", "windows", "anchor")).alias("places"))
    contexts = _written(single.join(places, ["doc", "row"]).mapInArrow(
        _context_rows, "gram long, doc long, row long, start long, windows int, anchor int, d1 long, d2 long, bytes binary"))
    distinct = contexts.groupBy("gram", "d1", "d2").agg(F.count("*").alias("copies"), F.first("anchor").alias("anchor"), F.first("bytes").alias("bytes"))
    mixed = distinct.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    open_ = _written(distinct.join(mixed, "gram"))
    merged = open_.where(F.col("n") <= crowd).drop("n").repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _merge_rows, "gram long, d1 long, d2 long, runs array<int>")
    runs = merged.unionByName(_counted(open_.where(F.col("n") > crowd)))
    equal = contexts.groupBy("gram", "d1", "d2").agg(F.count("*").alias("copies")).where("copies > 1").select("gram", "d1", "d2", F.lit(True).alias("whole"))
    place = contexts.select("gram", "d1", "d2", "doc", "row", "start", "windows")
    whole = place.join(equal, ["gram", "d1", "d2"]).select("doc", "row", F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b"))
    some = place.join(runs.where(F.size("runs") > 0), ["gram", "d1", "d2"]).select("doc", "row", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), lambda i: F.struct((F.col("start") + F.get("runs", i)).alias("a"), (F.col("start") + F.get("runs", i + 1)).alias("b")))).alias("s")).select("doc", "row", "s.*")
    gone = whole.unionByName(some).groupBy("doc", "row").agg(F.collect_list(F.struct("a", "b")).alias("_llm_runs"))
    final = marked.join(gone.select(F.col("doc").alias("_llm_doc"), F.col("row").alias("_llm_row"), "_llm_runs"), ["_llm_doc", "_llm_row"], "left")
    keep = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_removed", "n_spans", "kept", text_column.lower())]
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "n_bytes long, n_removed long, n_spans long, kept binary"])
    return final.select(*keep, "_llm_bytes", F.col("_llm_n").isNotNull().alias("_llm_copied"), "_llm_runs").mapInArrow(_cut_rows, schema)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: columnar, and computed once."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/substrings-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted(crowded: DataFrame) -> DataFrame:
    """Repeated windows of crowded anchors by counting window digests, spread over all tasks."""
    windows = crowded.select("gram", "d1", "d2", "copies", "bytes", F.explode(F.sequence(F.lit(1), F.octet_length("bytes") - LENGTH + 1)).alias("p")).select(
        "gram", "d1", "d2", "copies", (F.col("p") - 1).alias("p"), F.substring("bytes", F.col("p"), F.lit(LENGTH)).alias("w"))
    keyed = windows.select("gram", "d1", "d2", "copies", "p", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(1), "w").alias("w2"))
    often = keyed.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2")
    found = keyed.join(often, ["w1", "w2"]).groupBy("gram", "d1", "d2").agg(F.collect_set("p").alias("ps"))
    return found.select("gram", "d1", "d2", F.flatten(F.transform("ps", lambda p: F.array(p, p + 1))).alias("runs"))


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
