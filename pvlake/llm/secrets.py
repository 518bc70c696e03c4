"""Secret scan: fixed patterns, and strings a tokenizer's vocabulary can only spell out."""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bounded_batches

# fixed values: the contract's patterns and least lengths
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
TOKEN = "token"  # kind of the spans that the token test adds
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGESTS = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}", re.I)
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]|[0-9]+")
ALONE = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]{1,2}|[0-9]{1,4})(?![A-Za-z0-9])")
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the public split pattern of the vocabulary
MAX_RATIO = 2.0  # characters per token at which a string counts as random


def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def is_identifier(s: str, encoding: tiktoken.Encoding) -> bool:
    """Known shapes that are not secrets: digests, UUIDs, and names of which every part is a word of the vocabulary.

    A part is a run of letters (parted where case changes as in names) or of digits. A word has one or two tokens
    of 2.5 letters or more on average; besides, parts of one or two letters and numbers of up to four digits may
    stand between separators, and numbers of up to two digits after a word.
    """
    if DIGESTS.fullmatch(s) or UUID.fullmatch(s):
        return True
    rest = ALONE.sub("", s)
    parts = PARTS.findall(rest)
    numbers = [p for p in parts if p.isdigit()]
    names = [p for p in parts if not p.isdigit()]
    if any(len(n) > 2 for n in numbers) or len(numbers) > len(names):
        return False
    # the vocabulary knows most words in lower case, with or without a blank before
    tokens = [min(len(encoding.encode_ordinary(form)) for form in (p, p.lower(), f" {p.lower()}")) for p in names]
    return all(len(p) >= 2.5 * n and n <= 2 for p, n in zip(names, tokens))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def token_spans(text: str, encoding: tiktoken.Encoding, max_ratio: float) -> list[tuple[str, int, int]]:
    """Candidates of at most ``max_ratio`` characters per token, less known digests and identifiers."""
    found = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if len(s) <= max_ratio * len(encoding.encode_ordinary(s)) and not is_identifier(s, encoding):
            found.append((TOKEN, *m.span()))
    return found


def scan_secrets(docs: DataFrame, vocabulary: str, text_column: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """Adds ``spans``: array of (kind, start, end), code points, end exclusive.

    Kinds ``assign``, ``access`` and ``hex`` are leftmost non-overlapping pattern matches that pass their
    length test. Kind ``token`` are strings of 20 characters or more that the byte-pair vocabulary at path
    ``vocabulary`` (on every machine) needs many tokens for: random strings, after known digests, UUIDs and
    identifiers made of words are set aside. Spans of different kinds may overlap. Ordered by start, then
    in the order the kinds are named here.

    One narrow pass: no shuffle, state is one Arrow batch. A null or empty text has no spans; rows that
    repeat are scanned each; other columns are kept.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    order = {kind: i for i, kind in enumerate([*[b[0] for b in BASE], TOKEN])}

    @F.pandas_udf(T.ArrayType(span))
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for batch in texts:
            out = []
            for text in batch:
                found = [] if not text else base_spans(text) + token_spans(text, encoding, max_ratio)
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda s: (s[1], order[s[0]]))])
            yield pd.Series(out)

    return bounded_batches(docs).withColumn("spans", scan(F.col(text_column)))


# workers get this code with the task, whether or not the package is on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
