"""Language identification by cross-parsing: how few phrases of a language's text does a text fall into?"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .text import bounded_batches, text_of, without

SAMPLE_CHARS = 100_000  # symbols of labelled text that a language's automaton is built from, at most
SAMPLE_ROWS = 256  # labelled texts that they are taken from, at most
BLOCK = 1_024  # symbols that are parsed in a row; a phrase ends at a block's end too
LANES = 8_192  # blocks parsed side by side
UNDECIDED = "und"
LETTER = r"\p{L}"
BREAK = 1  # a symbol that no text has: it parts sampled texts and fills blocks up


def symbols(text: Column) -> Column:
    """Lower-case letters and marks; all that stands between them is one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts every substring of ``data``; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        state, p = len(nexts), last
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return nexts


class Parser:
    """Counts the phrases of many blocks at once: each phrase is the longest match from where the last one ended.

    The automaton's transitions stand in one table, filled up with where a new phrase begins: a cell holds
    the next state (as the place of its row) times two, plus one if a phrase begins there. Beside the automaton's
    states there is one without transitions, where every block starts and where unseen symbols lead.
    """

    def __init__(self, edges: bytes, size: int):
        start, symbol, end = np.frombuffer(edges, "<i4").reshape(3, -1)
        states = int(max(start.max(initial=0), end.max(initial=0))) + 2
        used = np.unique(symbol)
        self.code = np.zeros(256, np.uint8)  # 0: unseen
        self.code[used] = np.arange(2, len(used) + 2)
        self.code[BREAK] = 1
        width, nowhere = len(used) + 2, states - 1
        table = np.full((states, width), (nowhere * width) << 1 | 1, np.int64)
        table[:, self.code[symbol[start == 0]]] = (end[start == 0].astype(np.int64) * width) << 1 | 1
        table[start, self.code[symbol]] = (end.astype(np.int64) * width) << 1
        table[:, 1] = (nowhere * width) << 1
        self.table = table.ravel().astype(np.int32 if table.max() < 2**31 else np.int64)
        self.home, self.bits = nowhere * width, math.log2(size + 1)

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrases in each column of ``blocks`` (symbols down, blocks across; filled up with ``BREAK``)."""
        codes = self.code[blocks]
        state = np.full(blocks.shape[1], self.home, self.table.dtype)
        count, cell = np.zeros(blocks.shape[1], np.int64), np.empty_like(state)
        for row in codes:
            np.add(state, row, out=cell)
            np.take(self.table, cell, out=state, mode="clip")
            count += state & 1
            state >>= 1
        return count


def cut_blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as blocks (symbols down, blocks across) and the text that each block is of."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(owner):
        return np.zeros((0, 0), np.uint8), owner
    flat = np.full((int(counts.sum()), min(BLOCK, int(sizes.max()))), BREAK, np.uint8)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        for k in range(n):
            part = text[k * BLOCK:(k + 1) * BLOCK]
            flat[at, :len(part)] = np.frombuffer(part, np.uint8)
            at += 1
    return flat, owner


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes, int]]:
    """One automaton per label: (label, edges, symbols it was built from), ordered by label.

    Of each label's distinct texts those of least hash are taken, ``rows`` at most, and joined until they hold
    ``chars`` symbols. How small a hash must be follows from the number of distinct texts, so a hot label or a
    large group of copies sends no more rows than others. Null labels and texts without a letter teach
    nothing. What comes to the driver is bounded by ``chars`` and the number of labels.
    """
    spread = 2.0**63
    keyed = labelled.select(F.col(label_column).alias("label"), F.col(text_column).alias("text")).where(F.col("label").isNotNull() & F.col("text").rlike(LETTER)).select(
        "label", "text", F.xxhash64("text").alias("h"))
    least = {r["label"]: (4.0 * rows / max(r["n"], 1) - 1) * spread for r in keyed.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not least:
        return []
    bound = F.create_map(*[F.lit(x) for label, top in least.items() for x in (label, max(top, -spread + 1))])
    near = keyed.where(F.col("h") <= F.element_at(bound, F.col("label"))).groupBy("label", "h").agg(F.min("text").alias("text"))
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("place") <= rows)

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        texts = [t.encode() for t in table.sort_by("place").column("text").to_pylist()]
        data = bytes([BREAK]).join(texts)[:chars]
        nexts = suffix_automaton(data)
        edges = np.array([(s, c, e) for s, out in enumerate(nexts) for c, e in out.items() if c != BREAK], "<i4").T
        return pa.table({"label": [key[0].as_py()], "edges": pa.array([edges.tobytes()], pa.binary()), "size": pa.array([len(data)], pa.int64())})

    sample = first.select("label", "place", symbols(F.col("text")).alias("text"))
    found = cut_lineage(sample.groupBy("label").applyInArrow(build, "label string, edges binary, size long")).collect()
    return sorted((r["label"], bytes(r["edges"]), r["size"]) for r in found)


def identify(docs: DataFrame, models: list[tuple[str, bytes, int]], text_column: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` by the automata of :func:`train`.

    A text's lower-case letters (UTF-8 bytes, all else one blank) are parsed into phrases, each the longest match in
    a language's automaton; an unseen byte is a phrase by itself. Parsing starts anew every ``BLOCK`` symbols,
    so that blocks of long and short texts are parsed side by side in numpy. Phrases are normalised to bits
    per symbol, log2 of the sample's size each, so languages with a smaller sample have no advantage. The
    least wins, the first label in a tie. ``score`` is the lead over the runner-up, as a share of the
    runner-up's bits (1 where a single language was learned).

    A null text, an empty one and one without a letter are ``und`` with score 0, as all are without models. Rows that
    repeat are each judged; other columns stay, those named like the new ones are replaced. One narrow pass: memory is
    a batch of texts and a table per language of (states x byte values).
    """
    kept = without(docs, "lang_pred", "score")
    letters = F.when(text_of(text_column).rlike(LETTER), symbols(F.col(text_column)))
    if not models:
        return kept.withColumns({"lang_pred": F.lit(UNDECIDED), "score": F.lit(0.0)})
    labels, held = [m[0] for m in models], docs.sparkSession.sparkContext.broadcast([m[1:] for m in models])

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parsers = [Parser(edges, size) for edges, size in held.value]
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.to_pylist()]
            bits = np.zeros((len(parsers), len(texts)))
            flat, owner = cut_blocks(texts)
            for i in range(0, len(owner), LANES):
                part = np.ascontiguousarray(flat[i:i + LANES].T)
                for k, parser in enumerate(parsers):
                    bits[k] += np.bincount(owner[i:i + LANES], parser.phrases(part) * parser.bits, len(texts))
            best = bits.argmin(axis=0)
            low = np.sort(bits, axis=0)
            lead = 1 - low[0] / np.maximum(low[1], 1e-300) if len(parsers) > 1 else np.ones(len(texts))
            empty = np.array([not t for t in texts], bool)
            yield pa.StructArray.from_arrays([
                pa.array([UNDECIDED if none else labels[b] for none, b in zip(empty.tolist(), best.tolist())], pa.string()),
                pa.array(np.where(empty, 0.0, lead), pa.float64())], ["lang_pred", "score"])

    judge_text = F.arrow_udf(judge, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    judged = bounded_batches(kept).withColumn("_llm_judged", judge_text(letters))
    return judged.select(*[F.col(f"`{c}`") for c in kept.columns], "_llm_judged.lang_pred", "_llm_judged.score")


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
