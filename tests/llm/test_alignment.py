from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlake.llm import alignment
from pvlake.llm.queries import op11

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  \n ", "\n", "one", "two words", "  a  b\n c \t d  ", "don't we'll they'RE", "<|endoftext|> <s> </s> <unk>", "x ▁ y", "▁", "日本語 テスト  ab", "𝄞 é é ﬁ",
         "a\x00b \x1c c\x85 d\xa0 e　 f", "Thnttionwh erenan; 12345 67", "a" * 5000, "ab cd " * 4000, "- -- --- ====", "  x", " ﻿bom", "tab\tand\r\nline  "]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(A, B)


def brute_one(both, text):
    """Ids, groups as lists of (A ids, B ids) and links of a text, token by token."""
    if not text:
        return [], [], [], []
    raw = (" " + text).encode()
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text, num_threads=1)
    pieces = [[t[i] for i in ids] for t, ids in ((both.a_bytes, a), (both.b_bytes, b))]
    if any(b"".join(p) != raw for p in pieces):
        return [], [], [], []
    spans = []
    for p in pieces:
        at, out = 0, []
        for t in p:
            out.append((at, at + len(t)))
            at += len(t)
        spans.append(out)
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = [([i for i, (s, _) in zip(a, spans[0]) if lo <= s < hi], [i for i, (s, _) in zip(b, spans[1]) if lo <= s < hi]) for lo, hi in zip([0, *ends], ends)] if len(a) < 2000 else None
    links, j = [], 0
    for x, (s, e) in zip(a, spans[0]):
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(b) and spans[1][k][0] < e:
            links.append((x, b[k]))
            k += 1
    return a, b, groups if groups is not None else len(ends), links


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    words = ["alpha", "Beta,", "gämma", "ththtion", "\n", "", "x" * 9, "𝄞", "don't", "3.14", "\t", "erenan."]
    return [*TEXTS, *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)], TEXTS[7], TEXTS[7]]


def test_alignment_equals_brute_force(spark, both):
    texts = corpus()
    df = spark.createDataFrame([(None if i == 9 else i // 2, t, "keep", "clash") for i, t in enumerate(texts)], "doc_id long, text string, other string, groups string").withColumns(
        {"n_a": F.lit("clash"), "links": F.lit("clash"), "n_best": F.lit(1), "place": F.monotonically_increasing_id()})
    order = [r["text"] for r in df.orderBy("place").select("text").collect()]
    assert order == texts
    want = [brute_one(both, t) for t in texts]
    docs = Counter(pair for w in want for pair in set(w[3]))
    most: dict[int, int] = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    held = alignment.align_tokens(df, A, B)
    assert "other" in held.columns and "text" not in held.columns
    for limit in (2_000_000, 3):
        got = [r.asDict() for r in alignment.score_links(held, limit).orderBy("place").collect()]
        assert len(got) == len(texts)
        for g, t, (a, b, groups, links) in zip(got, texts, want):
            assert (g["n_a"], g["n_b"], g["n_links"]) == (len(a), len(b), len(links)), t
            if isinstance(groups, int):
                assert g["n_groups"] == groups
            else:
                text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
                assert (g["n_groups"], g["groups"]) == (len(groups), text), t
            assert g["count_sum"] == sum(docs[p] for p in links) and g["n_best"] == sum(docs[p] == most[p[0]] for p in links)
    assert sum(not w[0] for w in want) >= 4 and sum(len(w[0]) for w in want) > 1000


def test_chunks_are_remembered_within_bounds(both, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_CHUNKS", 30)
    aligner = alignment.Aligner(A, B)
    for text in corpus(30, 9):
        (numbers, groups, links), = aligner.align([text])
        a, b, _, pairs = brute_one(both, text)
        assert numbers[:2].tolist() == [len(a), len(b)]
        assert Counter(links.tolist()) == Counter(x << 32 | y for x, y in pairs)


def test_pointers_converge_on_long_chains():
    # tokens of two bytes, shifted by one against each other, never end together before the last
    n = 3000
    a_end, b_end = np.append(np.arange(2, 2 * n, 2), 2 * n + 1), np.append(np.arange(1, 2 * n, 2), 2 * n + 1)
    a, b = alignment.group_ends(a_end, b_end)
    assert set(a.tolist()) == set(b.tolist()) == {len(a_end) - 1}
    a, b = alignment.group_ends(np.array([1, 2, 5]), np.array([2, 4, 5]))
    assert a.tolist() == [1, 1, 2] and b.tolist() == [1, 2, 2]


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert alignment.score_links(alignment.align_tokens(df.limit(0), A, B)).count() == 0
    assert alignment.score_links(alignment.align_tokens(df, A, B)).first()["count_sum"] == 0


def test_op11_digests(spark, both, tmp_path):
    spark.createDataFrame([(0, "plain words"), (1, "▁"), (2, "plain words here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op11(spark, str(tmp_path)).collect()}
    groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute_one(both, "plain words")[2])
    assert got[0]["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest() and got[1]["groups_sha256"] == "" and got[0]["count_sum"] == 2 * got[0]["n_links"]
