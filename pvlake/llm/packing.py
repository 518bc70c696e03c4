"""Packing of tokenized documents into fixed windows by non-negative least squares."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .text import bounded_batches

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 4_000_000  # tokens held before a shard is packed
UNITS = 128  # steps in which lengths are counted for the combinations, to a window
CACHED_WORDS = 1_000_000  # distinct words whose ids a task remembers
SWEEPS = 200


def combinations(sizes: list[int], whole: int) -> list[tuple[int, ...]]:
    """Shallow combinations of present sizes that fill ``whole`` exactly: one, two or three pieces."""
    have = set(sizes)
    found = {(n,) for n in have if n == whole} | {(a, whole - a) for a in have if 2 * a <= whole and whole - a in have}
    for a in have:
        found |= {tuple(sorted((a, b, whole - a - b))) for b in have if b >= a and whole - a - b >= b and whole - a - b in have}
    return sorted(found)


def solve_counts(shapes: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often to use each combination: non-negative least squares against the histogram, rounded to what is there.

    Minimises ||A x - counts|| over x >= 0 by projected gradient steps; A holds how many pieces of each
    length a combination takes and is kept as (length, combination) pairs.
    """
    if not shapes:
        return np.zeros(0, np.int64)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    rows = np.array([place[n] for s in shapes for n in s])
    cols = np.array([j for j, s in enumerate(shapes) for _ in s])
    target = counts.astype(float)
    x = np.zeros(len(shapes))
    # a bound of the largest eigenvalue of A'A: largest row sum times largest column sum
    step = 1.0 / (np.bincount(rows, minlength=len(lengths)).max() * max(map(len, shapes)))
    momentum, last = x.copy(), 1.0
    for _ in range(SWEEPS):
        rest = np.bincount(rows, momentum[cols], len(lengths)) - target
        moved = np.maximum(0.0, momentum - step * np.bincount(cols, rest[rows], len(shapes)))
        nxt = (1 + (1 + 4 * last * last) ** 0.5) / 2
        momentum = moved + (last - 1) / nxt * (moved - x)
        x, last = moved, nxt
    whole, left = np.floor(x + 0.5).astype(np.int64), counts.copy()
    for j in np.argsort(-x, kind="stable"):  # rounding must not use a piece twice
        need = np.array([place[n] for n in shapes[j]])
        uses = np.bincount(need, minlength=len(left))[np.unique(need)]
        whole[j] = min(whole[j], int((left[np.unique(need)] // uses).min()))
        left[np.unique(need)] -= whole[j] * uses
    return whole


class _Waiting:
    """Documents not yet placed, by the number of units that hold them, with what is left of the one being cut."""

    def __init__(self, rest: np.ndarray, unit: int):
        self.rest, self.held = rest, {}
        for doc in np.flatnonzero(rest).tolist():
            self.held.setdefault(-(-int(rest[doc]) // unit), []).append(doc)
        self.tokens = int(rest.sum())
        self.open, self.start = -1, 0  # the document being cut, and how much of its rest is placed

    def take(self, size: int) -> int:
        doc = self.held[size].pop()
        if not self.held[size]:
            del self.held[size]
        self.tokens -= int(self.rest[doc])
        return doc

    def cut(self, n: int) -> tuple[int, int, int]:
        """(document, start, length) of at most ``n`` tokens of the smallest document; what is left of it is cut on later."""
        if self.open < 0:
            self.open, self.start = self.take(min(self.held)), 0
            self.tokens += int(self.rest[self.open])
        doc, start = self.open, self.start
        n = min(n, int(self.rest[doc]) - start)
        self.start, self.tokens = start + n, self.tokens - n
        if self.start == self.rest[doc]:
            self.open = -1
        return doc, start, n


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, units: int = UNITS, more: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Pieces of documents of these lengths: rows (document, start, length, sequence, offset), no padding at all; the
    documents left for a next call, if there are ``more`` to come; and the share of the placed tokens in windows that the
    least squares made.

    Whole windows are cut off the front of long documents. The rests' lengths are counted in ``units`` to a window, and
    :func:`solve_counts` finds how often to use each combination that fills one. What is left goes greedily into
    windows, always the longest that still fits by its units. The gap that a window then has, some units at most or less than the
    shortest document, is filled with a piece of the shortest documents, so few others are ever cut. Less than a window
    at the end is left for a next call or laid into sequences whose lengths are powers of two.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, unit = 0, max(window // units, 1)
    front = lengths - lengths % window
    for doc in np.flatnonzero(front).tolist():
        for start in range(0, int(front[doc]), window):
            pieces.append((doc, start, window, sequence, 0))
            sequence += 1
    waiting = _Waiting(lengths % window, unit)
    fit = window // unit  # pieces of so many units together always fit
    sizes = np.array(sorted(waiting.held), dtype=np.int64)
    counts = np.array([len(waiting.held[n]) for n in sizes.tolist()], dtype=np.int64)
    planned: list[tuple[int, ...]] = []
    while True:  # rounding leaves pieces of which combinations can be made again
        shapes = combinations(sizes[counts > 0].tolist(), fit)
        again = [shape for shape, times in zip(shapes, solve_counts(shapes, sizes, counts).tolist()) for _ in range(times)]
        if not again:
            break
        planned += again
        counts = counts - np.bincount(np.searchsorted(sizes, [n for shape in again for n in shape]), minlength=len(sizes))
    made = [[waiting.take(n) for n in shape] for shape in planned]
    gap = sum(window - int(waiting.rest[docs].sum()) for docs in made)
    while made and gap > waiting.tokens:  # gaps that nothing is left to fill
        docs = made.pop()
        gap -= window - int(waiting.rest[docs].sum())
        for doc in docs:
            waiting.held.setdefault(-(-int(waiting.rest[doc]) // unit), []).append(doc)
            waiting.tokens += int(waiting.rest[doc])

    def fill(docs: list[int]) -> None:
        """One full sequence of whole rests and of what fills its gap."""
        nonlocal sequence
        offset = 0
        for doc in docs:
            n = int(waiting.rest[doc])
            pieces.append((doc, int(front[doc]), n, sequence, offset))
            offset += n
        while offset < window:
            doc, start, n = waiting.cut(window - offset)
            pieces.append((doc, int(front[doc]) + start, n, sequence, offset))
            offset += n
        sequence += 1

    for docs in made:
        fill(docs)
    while waiting.tokens >= window:
        docs, space = [], window
        while space > 0 and (fits := [n for n in waiting.held if n * unit <= space]):
            docs.append(waiting.take(max(fits)))
            space -= int(waiting.rest[docs[-1]])
        fill(docs)
    # documents of which nothing is placed yet may be left for the next call; what remains of others ends here
    left = sorted(doc for docs in waiting.held.values() for doc in docs if front[doc] == 0) if more else []
    for doc in left:
        size = -(-int(waiting.rest[doc]) // unit)
        waiting.held[size].remove(doc)
        if not waiting.held[size]:
            del waiting.held[size]
        waiting.tokens -= int(waiting.rest[doc])
    stop = waiting.tokens
    for bit in range(window.bit_length() - 1, -1, -1):
        if stop >> bit & 1:
            offset = 0
            while offset < 1 << bit:
                doc, start, n = waiting.cut((1 << bit) - offset)
                pieces.append((doc, int(front[doc]) + start, n, sequence, offset))
                offset += n
            sequence += 1
    plan = np.array(pieces, dtype=np.int64).reshape(-1, 5)
    placed = int(plan[:, 2].sum())
    return plan, np.array(left, dtype=np.int64), (len(made) * window / placed if placed else 0.0)


#: Words of these characters keep their letters and marks apart when normalized, so their parts can be counted beforehand.
SIMPLE = re.compile("[!-~\u00c0-\u00ff]+")
PARTS = re.compile("'(?:[stmd]|re|ve|ll)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Texts of these characters (no apostrophe, which binds letters) may be lower-cased and parted around marks beforehand: the tokenizer does the same.
PLAIN = re.compile("[\t-\r -&(-~\u00c0-\u00ff]*")
MARKS = re.compile("[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\\s]+")


class Ids:
    """Token ids of texts. White space parts words for this tokenizer, so each distinct word is encoded once.

    New words are encoded many to a text. The vocabulary marks the last token of each part of a word, so
    counting a word's parts tells where its ids end; words of unusual characters are encoded alone.
    """

    def __init__(self, tokenizer: str, end_id: int):
        self.tokenizer, self.end = Tokenizer.from_file(tokenizer), np.array([end_id], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        simple = [w for w in words if SIMPLE.fullmatch(w) and not ("<" in w and any(s in w for s in self.special))]
        for w in set(words).difference(simple):
            self.known[w] = self.encode(w).tobytes()
        for i in range(0, len(simple), 500):
            part = simple[i:i + 500]
            ids = self.encode(" ".join(part))
            parts = np.cumsum([1 if w.isalpha() else len(PARTS.findall(w.lower())) for w in part])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != parts[-1]:
                raise ValueError("the vocabulary does not mark the ends of words as expected")
            stops, data = [0, *ends[parts - 1].tolist()], ids.tobytes()
            self.known.update(zip(part, [data[4 * a:4 * b] for a, b in zip(stops, stops[1:])], strict=True))

    def spread(self, text: str) -> str:
        """The same text to the tokenizer, with fewer distinct words where that is sure."""
        if PLAIN.fullmatch(text) and not ("<" in text and any(s in text for s in self.special)):
            return MARKS.sub(r" \g<0> ", text.lower())
        return text

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        # the ASCII characters that the normalizer takes for white space; others stay inside a word and are met there
        split = [self.spread(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") for t in texts]
        new = {w for words in split for w in words}.difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = {w for words in split for w in words}
        self.learn(list(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + self.end, "<u4") for words in split]


def pack_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                   window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``
    (binary, little-endian unsigned 32-bit) of all documents packed into sequences of at most ``window`` tokens.

    Every partition packs its own documents, in shards of ``shard_tokens`` tokens: the shard's length
    histogram is matched by non-negative least squares over combinations that fill a window, and the
    rest is packed greedily, see :func:`pack_lengths`. Less than a window at a shard's end goes on to the next. Sequences
    are full, except the last few of a partition (and those that end a cut document at a shard's end), whose lengths
    are powers of two. So there is no shuffle, no state beyond one shard (or one document, if longer),
    and a lost task is simply run again. ``sequence_id`` is unique: partition in the high bits.

    A null or empty text is the end id alone. Repeated rows and null ids are packed as rows of their own.
    """
    schema = T.StructType([
        docs.schema[id_column], *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType())])
    names = [f.name for f in schema.fields]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, first = Ids(tokenizer, end_id), TaskContext.get().partitionId() << 38
        held_ids: list[np.ndarray] = []
        held_keys: list[pa.Array] = []

        def shard(more: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, tokens
            lengths = np.array([len(x) for x in held_ids], dtype=np.int64)
            keys = pa.concat_arrays(held_keys)
            plan, left, _ = pack_lengths(lengths, window, more=more)
            for i in range(0, len(plan), 2_000):
                part = plan[i:i + 2_000]
                doc, start, length, sequence, offset = part.T
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(lengths[doc]), pa.array(sequence + first), pa.array(offset),
                    pa.array([held_ids[d][s:s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())], pa.binary()),
                ], names)
            first += int(plan[:, 3].max(initial=-1)) + 1
            held_ids[:] = [held_ids[d] for d in left.tolist()]
            held_keys[:] = [keys.take(pa.array(left))]
            tokens = int(lengths[left].sum())

        tokens = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                held_ids.extend(ids_of.of(part.column(1).to_pylist()))
                held_keys.append(part.column(0))
                tokens += sum(len(x) for x in held_ids[-part.num_rows:])
                if tokens >= shard_tokens:
                    yield from shard(True)
        if held_ids:
            yield from shard(False)

    return bounded_batches(docs).select(F.col(id_column), F.col(text_column)).mapInArrow(pack, schema)


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
