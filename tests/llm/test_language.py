from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlake.llm import language
from pvlake.llm.queries import op13


def parse(text: bytes, data: bytes) -> int:
    """Phrases of ``text``, each the longest match in ``data`` from where the last ended; blocks are parsed by themselves."""
    count = 0
    for at in range(0, len(text), language.BLOCK):
        block, i = text[at:at + language.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n <= len(block) and block[i:i + n] in data:
                n += 1
            i += max(n - 1, 1)
            count += 1
    return count


def walk(text: bytes, edges: bytes) -> int:
    """Phrases of ``text`` by stepping through an automaton's transitions one at a time."""
    step = {(s, c): e for s, c, e in np.frombuffer(edges, "<i4").reshape(3, -1).T.tolist()}
    count = 0
    for at in range(0, len(text), language.BLOCK):
        state = None
        for c in text[at:at + language.BLOCK]:
            if state is None or (state, c) not in step:
                count, state = count + 1, 0
            state = step.get((state, c))
    return count


def plain(text: str | None) -> bytes:
    return re.sub(r"[^\w]|[\d_]", " ", (text or "").lower()).encode()


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def vocabulary(seed: int, letters: str) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)]


WORDS = {"aa": vocabulary(1, "abcdefghij"), "bb": vocabulary(2, "abcdefghij"), "cc": vocabulary(3, "éàöabcd"), "zz": vocabulary(4, "日本語テキスト")}


def test_automaton_has_every_substring_and_no_other():
    rng = random.Random(2)
    for data in (b"", b"a", b"aaaa", b"abcbc", bytes(rng.choice(b"ab") for _ in range(60))):
        nexts = language.suffix_automaton(data)
        words, stack = set(), [(0, b"")]
        while stack:
            state, w = stack.pop()
            words.add(w)
            stack += [(t, w + bytes([c])) for c, t in nexts[state].items()]
        assert words == {data[i:j] for i in range(len(data) + 1) for j in range(i, len(data) + 1)}
        assert len(nexts) <= max(2 * len(data), 1)


def test_phrases_equal_brute_force():
    rng = random.Random(5)
    data = prose(rng, WORDS["aa"], 400).encode() + bytes([language.BREAK]) + "ééé tail".encode()
    edges = np.array([(s, c, e) for s, out in enumerate(language.suffix_automaton(data)) for c, e in out.items() if c != language.BREAK], "<i4").T
    parser = language.Parser(edges.tobytes(), len(data))
    texts = [b"", b"x", "日本 é".encode(), data[:700], data[500:1600], prose(rng, WORDS["aa"], 900).encode(), prose(rng, WORDS["bb"], 50).encode(), b"tail" * 2000, b"a"]
    blocks, owner = language.cut_blocks(texts)
    got = np.bincount(owner, parser.phrases(np.ascontiguousarray(blocks.T)), len(texts))
    assert got.tolist() == [parse(t, data) for t in texts]


def test_identify_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, WORDS[lang], rng.randint(1, 400)).title() + ". 12", lang) for i, lang in enumerate(["aa", "bb", "cc", "zz"] * 12)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, " 12 -- €", "cc"), (103, "unlabelled text", None), (104, "word " * 30_000, None), (0, rows[0][1], "aa"), (None, rows[1][1], "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "h": F.lit(1), "label": F.lit("clash")})
    models = language.train(df, chars=3_000)
    assert [m[0] for m in models] == ["aa", "bb", "cc", "zz"] and all(m[2] <= 3_000 for m in models)
    out = language.identify(df, models)
    assert set(out.columns) == {*df.columns, "lang_pred"}
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in out.collect()}
    assert got[100, None] == got[101, ""] == got[102, " 12 -- €"] == ("und", 0.0)
    for i, text, lang in rows:
        letters = " ".join(plain(text).decode().split()).encode()
        if letters:
            bits = sorted((walk(letters, m[1]) * math.log2(m[2] + 1), m[0]) for m in models)
            assert got[i, text][0] == bits[0][1] and abs(got[i, text][1] - (1 - bits[0][0] / bits[1][0])) < 1e-9
            assert lang in (None, got[i, text][0])
    assert language.identify(df.limit(0), models).count() == 0
    assert {r["lang_pred"] for r in language.identify(df, []).collect()} == {"und"}


def test_sample_is_bounded_whatever_the_copies(spark):
    rng = random.Random(11)
    rows = [("same text of many copies", "aa")] * 3_000 + [(prose(rng, WORDS["aa"], 20), "aa") for _ in range(500)] + [(None, "aa"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    (label, edges, size), = language.train(df, chars=5_000, rows=20)
    assert label == "aa" and 500 < size <= 5_000
    assert language.train(df.limit(0)) == [] and language.train(df.where("lang is null")) == []
    alone = language.identify(spark.createDataFrame([("any text",)], "text string"), [(label, edges, size)]).first()
    assert alone["lang_pred"] == "aa" and alone["score"] == 1.0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    judged = op13(spark, folder).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    n, right = judged.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 300 and right / n >= 0.98
    assert math.isfinite(right)
