"""Alignment of two tokenizers over the same bytes: groups by pointer jumping, and how often ids are linked corpus-wide."""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import checkpoint_dir, cut_lineage
from .text import bounded_batches

CACHED_CHUNKS = 400_000  # distinct chunks whose alignment a task remembers
BATCH_CHARS = 1_000_000  # characters of text that are put out at a time
BROADCAST_PAIRS = 2_000_000  # id pairs that are broadcast at most; beyond that they are joined by key and salt
SALTS = 16
#: A blank after a character that is no white space: a word starts there for both tokenizers.
CUT = re.compile(r"(?<=\S)(?= )")
SPACED = re.compile(r"\s ")
RESULTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the other bytes from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Tokenizers:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, byte_level: str, pieces: str):
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_alphabet()
        with open(byte_level, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError("a piece crosses the start of a word")
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that starts with a blank; the second tokenizer adds that blank itself."""
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)

    def same_bytes(self, text: str, ids: Sequence[list[int]]) -> bool:
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in ids[0]]) == raw == b"".join([self.b_bytes[i] for i in ids[1]])


def group_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the terminal of its group, as the place of the first tokenizer's token that ends it.

    Every token points to the overlapping token that reaches farthest right, itself if none reaches farther; of
    two with the same end the first tokenizer's is meant. Pointers are doubled until none moves: after k
    rounds each token points 2**k steps on, so long chains take few rounds.
    """
    n = len(a_end)
    over = np.searchsorted(b_end, a_end)  # the other tokenizer's token that holds a token's last byte
    back = np.searchsorted(a_end, b_end)
    to = np.concatenate([np.where(b_end[over] > a_end, n + over, np.arange(n)), back])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n], to[n:]
        to = further


def link_places(a_end: np.ndarray, a_size: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens whose bytes overlap."""
    first, last = np.searchsorted(b_end, a_end - a_size, "right"), np.searchsorted(b_end, a_end)
    counts = last - first + 1
    a = np.repeat(np.arange(len(a_end)), counts)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


class Aligner:
    """Alignment of texts, each distinct chunk (from one word's leading blank to the next) once.

    Both tokenizers end a token at every chunk's end: the first parts words there beforehand, and the second has no
    piece with a blank after something else. So groups and links never leave a chunk, and a text's are its chunks' in a row.
    """

    def __init__(self, byte_level: str, pieces: str):
        self.both = Tokenizers(byte_level, pieces)
        self.names = [[f"{i}{mark}" for i in range(max(len(self.both.a_bytes), len(self.both.b_bytes)))] for mark in ",|;"]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.pairs: list[bytes] = []
        self.numbers = np.zeros((1024, 5), np.int64)  # tokens, tokens, groups, links, 1 if the bytes differ

    def add(self, chunks: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Remembers chunks that, joined, have the tokens ``a`` and ``b``."""
        a_size, b_size = self.both.a_size[a], self.both.b_size[b]
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        stops = np.cumsum([len(c.encode()) for c in chunks])
        a_group, b_group = group_ends(a_end, b_end)
        a_link, b_link = link_places(a_end, a_size, b_end)
        pairs = a[a_link] << 32 | b[b_link]
        # tokens in the order in which groups name them, each with the mark that follows
        key = np.concatenate([a_group * 2, b_group * 2 + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([a, b])[order].tolist()
        mark = np.append(np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2)), 2).tolist()
        names = self.names
        text = [names[m][i] for m, i in zip(mark, ids)]
        a_stop, b_stop = np.searchsorted(a_end, stops) + 1, np.searchsorted(b_end, stops) + 1
        if not (np.array_equal(a_end[a_stop - 1], stops) and np.array_equal(b_end[b_stop - 1], stops)):
            raise ValueError("a token crosses the start of a word")
        ends = np.concatenate([[0], np.cumsum(np.arange(len(a)) == a_group)])  # groups that end at or before a place
        l_stop = np.searchsorted(a_link, a_stop)
        made = np.stack([a_stop, b_stop, ends[a_stop], l_stop, np.zeros_like(a_stop)], axis=1)
        made[1:, :4] -= made[:-1, :4].copy()
        self._keep(chunks, made)
        begin = 0
        for stop in (a_stop + b_stop).tolist():
            self.groups.append("".join(text[begin:stop]))
            begin = stop
        raw, begin = pairs.tobytes(), 0
        for stop in (l_stop * 8).tolist():
            self.pairs.append(raw[begin:stop])
            begin = stop

    def _keep(self, chunks: list[str], made: np.ndarray) -> None:
        n = len(self.place)
        while n + len(chunks) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[n:n + len(chunks)] = made
        self.place.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks many to a text; those that end with white space (a text's last) or don't keep their bytes, alone."""
        joined = [c for c in chunks if not c[-1].isspace()]
        alone = [c for c in chunks if c[-1].isspace()]
        for i in range(0, len(joined), 2_000):
            part = joined[i:i + 2_000]
            text = "".join(part)
            ids = self.both.encode(text)
            if self.both.same_bytes(text, ids):
                self.add(part, *(np.array(x, np.int64) for x in ids))
            else:
                alone += part
        lead = self.both.encode(" x")  # in front, since a blank by itself is no text to the second tokenizer
        for chunk in alone:
            ids = [x[len(y):] for x, y in zip(self.both.encode(" x" + chunk), lead)]
            if self.both.same_bytes(chunk, ids):
                self.add([chunk], *(np.array(x, np.int64) for x in ids))
            else:
                self._keep([chunk], np.array([[0, 0, 0, 0, 1]]))
                self.groups.append("")
                self.pairs.append(b"")

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """Per text its numbers, its groups and the ids of its links."""
        cut = []
        for text in texts:
            whole = " " + (text or "")
            cut.append([] if not text else CUT.split(whole) if SPACED.search(whole) else [" " + c for c in whole[1:].split(" ")])
        new = {c for chunks in cut for c in chunks if c not in self.place}
        if len(self.place) + len(new) > CACHED_CHUNKS:
            self.clear()
            new = {c for chunks in cut for c in chunks}
        self.learn(list(new))
        get = self.place.__getitem__
        for chunks in cut:
            places = [get(c) for c in chunks]
            numbers = self.numbers[places].sum(axis=0) if places else np.zeros(5, np.int64)
            if numbers[4] or not places:
                yield np.zeros(5, np.int64), "", np.zeros(0, np.int64)
            else:
                groups, pairs = self.groups, self.pairs
                yield numbers, "".join([groups[p] for p in places])[:-1], np.frombuffer(b"".join([pairs[p] for p in places]), np.int64)


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, text_column: str = "text") -> DataFrame:
    """Aligns the tokens of a byte-level tokenizer (A, of a blank and the text) and of a piece tokenizer (B, which adds
    that blank), given by the paths of their vocabularies on every machine.

    Adds ``n_a``, ``n_b`` (tokens), ``n_groups`` (runs of bytes between places where both end a token), ``n_links`` (pairs
    of tokens whose bytes overlap), ``groups`` (``a1,a2|b1;a3|b2``: ids in order) and ``links``, the text's distinct linked
    id pairs with how often each is linked: an array of (pair, times), a pair being A's id in the upper and B's in the
    lower 32 bits. The text itself is left out, other columns stay.

    A null or empty text, and one whose bytes a tokenizer does not give back, has no tokens: zeros, empty groups.
    Rows that repeat are each aligned. One narrow pass over whole texts; a task holds a batch, and the alignment of
    up to ``CACHED_CHUNKS`` distinct chunks.
    """
    keep = [c for c in docs.columns if c.lower() not in (*RESULTS, "groups", "links", text_column.lower())]
    link = T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.IntegerType())])
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in RESULTS],
                           T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(link))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level, pieces)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= BATCH_CHARS):
                    chars, stop = chars + len(texts[stop] or ""), stop + 1
                numbers, groups, pairs, times = [], [], [], []
                for n, g, links in aligner.align(texts[at:stop]):
                    numbers.append(n)
                    groups.append(g)
                    each, count = np.unique(links, return_counts=True)
                    pairs.append(each)
                    times.append(count)
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times).astype(np.int32))], ["pair", "times"])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
                sums = np.stack(numbers)
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], *[pa.array(sums[:, i]) for i in range(4)], pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(offsets, flat)], [f.name for f in schema.fields])
                at = stop

    return bounded_batches(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(text_column)).mapInArrow(align, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, docs, best)`` of the rows of :func:`align_tokens`: in how many rows each id pair is linked, and whether no
    pair of the same A id is linked in more.

    Rows are counted per pair before the shuffle, so a pair that all texts have is no hot key.
    """
    counts = cut_lineage(aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
    a = F.shiftright("pair", 32)
    # one row per A id: no more than its vocabulary has
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the rows of :func:`align_tokens`, less ``links``.

    A link's count is the number of rows that have its id pair linked; ``count_sum`` is the sum over a row's links,
    ``n_best`` the number of links whose count is the highest of their A id, ties included.

    The aligned rows are written once, so no text is encoded twice. The pairs met are broadcast after counting them, up
    to ``broadcast_pairs``; beyond that links and pairs are dealt by pair and salt, with the same result. Either
    way a row's links are summed before they are shuffled to meet again.
    """
    rows = written(aligned.drop("n_best", "count_sum").withColumn("_llm_id", F.monotonically_increasing_id()))
    known = cut_lineage(pair_counts(rows))
    links = rows.select("_llm_id", F.explode("links").alias("l")).select("_llm_id", "l.pair", "l.times")
    if known.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        met = links.join(F.broadcast(known), "pair")
    else:
        salted = known.withColumn("_llm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("_llm_salt", F.pmod(F.xxhash64("_llm_id"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "_llm_salt"])
    sums = met.groupBy("_llm_id").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("docs")).cast("long").alias("count_sum"))
    return rows.drop("links").join(sums, "_llm_id", "left").drop("_llm_id").fillna(0, ["n_best", "count_sum"])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
