from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pvlake.llm import packing, simhash, urls
from pvlake.llm.queries import QUERIES, SQL

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n ", "don't I'LL they've 'S", "x,y...z -5%*(a)b A1b2", "ΣΑΣ É x́ ńy × ÷ é÷è Ùx", "\x1c\x85\xa0 a　b", "<|endoftext|>a<|startoftext|>", "a <|endoftext|>, B",
       "ǅ İ ß ŉ ﬁ", "日本語 テスト", "𝄞" * 50, "word " * 3000, "1234567890" * 40, "_" * 300, "¿qué? ¡sí!"]


def test_word_wise_ids_equal_the_tokenizer():
    plain = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(3)
    alphabet = list("abcXYZ éÜß÷×'.,;<|>#$ 09\n\t-_") + ["<|", "'s", "'RE", "日"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids = packing.Ids(VOCABULARY, 2)
    for _ in range(2):  # unknown and known words
        got = [x.tolist() for x in ids.of(texts)]
        assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_pieces_tile_documents_and_windows(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 9000, 400), np.full(300, 1365), np.array([1]), np.array([2048, 2048, 4096, 8192, 3])][seed]
    plan, left, _ = packing.pack_lengths(lengths, 4096)
    assert not len(left)
    for doc, n in enumerate(lengths.tolist()):
        own = sorted((s, k) for d, s, k, _, _ in plan.tolist() if d == doc)
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and own[0][0] == 0
    fill = {}
    for _, _, n, sequence, offset in sorted(plan.tolist(), key=lambda p: (p[3], p[4])):
        assert offset == fill.get(sequence, 0)
        fill[sequence] = offset + n
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def test_least_squares_finds_the_repeat_counts():
    sizes, counts = np.array([1000, 1048, 2048, 3096]), np.array([50, 10, 10, 40])
    shapes = packing.combinations(sizes.tolist(), 4096)
    times = dict(zip(shapes, packing.solve_counts(shapes, sizes, counts).tolist()))
    assert times[1000, 3096] == 40 and times[1000, 1048, 2048] == 10


def test_least_squares_places_most_and_few_are_cut():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(5, 3000, 3000), rng.gamma(1.5, 800, 3000).astype(int) + 1, np.r_[rng.integers(1000, 4000, 2000), rng.integers(5, 60, 2000)]):
        plan, _, share = packing.pack_lengths(lengths, 4096)
        short = np.flatnonzero(lengths < 4096)
        pieces = np.bincount(plan[:, 0], minlength=len(lengths))
        assert share >= 0.5 and (pieces[short] > 1).mean() <= 0.2, (share, (pieces[short] > 1).mean())
        assert plan[:, 2].sum() == lengths.sum()


def test_documents_left_for_the_next_call_are_whole():
    lengths = np.random.default_rng(1).integers(1, 3000, 60)
    plan, left, _ = packing.pack_lengths(lengths, 4096, more=True)
    assert len(left) and not set(left.tolist()) & set(plan[:, 0].tolist()) and lengths[left].sum() < 4096
    assert plan[:, 2].sum() + lengths[left].sum() == lengths.sum()


def test_packed_documents(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash"))
    plain = Tokenizer.from_file(VOCABULARY)
    for shard in (4_000_000, 100):
        rows = packing.pack_documents(df.repartition(3), VOCABULARY, shard_tokens=shard).collect()
        want = sorted(((i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs), key=repr)
        documents, fill = {}, {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == fill.get(r["sequence_id"], 0)
            fill[r["sequence_id"]] = r["offset"] + r["length"]
            documents.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
        assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())
        for key, parts in documents.items():  # rows that repeat an id and a length are told apart by nothing, but hold the same pieces here
            found = sorted(parts)
            own = [ids for i, ids in want if i == key[0] and len(ids) == key[1]]
            assert own and sorted(x for _, ids in found for x in ids) == sorted(x for ids in own for x in ids)
            if len(own) == 1:
                assert [x for _, ids in found for x in ids] == own[0] and [s for s, _ in found] == np.cumsum([0, *[len(ids) for _, ids in found[:-1]]]).tolist()
        assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
        assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack_documents(df.limit(0), VOCABULARY).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 30)
    license_line = "This line stands in many documents, word for word, and says nothing new."
    docs = [(i, prose(rng, rng.randint(60, 200))) for i in range(120)]
    docs = [(i, t + "\n" + license_line if i % 10 == 0 else t) for i, t in docs]
    copy = docs[7][1]
    docs += [(200, copy), (201, copy), (201, copy), (202, None), (203, "too short"), (204, " ".join(w + "%%%" for w in prose(rng, 80).split())),
             (205, prose(rng, 60) + " " + item.upper() + " " + prose(rng, 60)), (206, license_line + "\n" + docs[8][1])]
    frame = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, read = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, read, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        read = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = read
        assert name == "packing" or read.columns == frame.columns
    ids = {n: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for n, df in seen.items() if n != "packing"}
    every = [*range(120), 200, 201, 201, 205, 206]
    assert ids["quality_rules"] == every and ids["line_dedup"] == every
    lines = brute.lines([(i, dict(docs)[i]) for i in every])
    assert {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()} == {i: w[2] for i, w in zip(every, lines)}
    assert ids["near_dedup"] == [*range(120), 205] or ids["near_dedup"] == [*range(120), 205, 206]
    assert ids["decontamination"] == [i for i in ids["near_dedup"] if i != 205]
    assert sorted({r["doc_id"] for r in seen["packing"].collect()}) == ids["decontamination"]
    total = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length"), F.count_distinct("doc_id")).first()
    assert tuple(total) == tuple(seen["packing"].agg(F.sum("length"), F.count_distinct("doc_id")).first())


def test_stages_keep_columns_that_share_a_name_with_their_own(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, prose(rng, 80), "en", None, 5, f"k{i}", f"w{i}", f"l{i}", f"c{i}", f"d{i}", i) for i in range(40)] + [(50, None, None, None, None, "", "", "", "", "", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, n_lines string, _copy string, distance string, _llm_row long"
    frame = spark.createDataFrame(docs, names)
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {d[0]: tuple(d[5:]) for d in docs[:40]}
    for part, expected in ((frame, want), (frame.limit(0), {})):
        held = part
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/{len(expected)}-{i}")
            held = spark.read.parquet(f"{tmp_path}/{len(expected)}-{i}")
            assert held.columns == frame.columns
            assert {r["doc_id"]: tuple(r)[5:] for r in held.collect()} == expected, name
        assert corpus_pipeline.pack(spark, held, str(tmp_path)).select("doc_id").distinct().count() == len(expected)


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_small_side_and_bounded_sample(spark):
    from pvlake.llm.trees import bounded_sample

    df = spark.range(1000).withColumn("label", (F.col("id") % 2).cast("double"))
    first = {r["id"] for r in bounded_sample(df, F.col("id"), 30).collect()}
    again = {r["id"] for r in bounded_sample(df.repartition(7), F.col("id"), 30).collect()}
    assert len(first) == 60 and first == again
    assert urls.FEATURES


def edited(rng, text, changes):
    """``text`` with some words changed."""
    parts = text.split()
    for i in rng.sample(range(len(parts)), changes):
        parts[i] = prose(rng, 1)
    return " ".join(parts)


def test_near_dedup_removes_edited_copies(spark):
    rng = random.Random(5)
    originals = [prose(rng, 200) for _ in range(100)]
    copies = [edited(rng, t, 1 + i % 4) for i, t in enumerate(originals)]
    crowd = [edited(rng, originals[0], 2) for _ in range(150)]  # above PAIR_LIMIT in many blocks
    far = [edited(rng, t, 15) for t in originals[:40]]
    docs = list(enumerate(originals)) + [(1000 + i, t) for i, t in enumerate(copies)] + [(2000 + i, t) for i, t in enumerate(far)] + [(3000 + i, t) for i, t in enumerate(crowd)]
    assert max(simhash.jaccard(a, b) for a, b in zip(originals, far)) < 0.8
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    near = {1000 + i for i, (a, b) in enumerate(zip(originals, copies)) if simhash.jaccard(a, b) >= 0.8}
    assert len(near) > 90 and len(near & left) <= 3
    assert {*range(100), *range(2000, 2040)} <= left and not any(i >= 3000 for i in left)


def test_near_dedup_leaves_out_no_link(spark):
    """400 pairs at 0.8 exactly or just above, of texts that all hold one passage, so that its blocks are large; and a crowd at about 0.8 against brute force."""
    rng = random.Random(11)
    passage, originals = prose(rng, 12), []
    for i in range(400):
        originals.append(f"{passage} {prose(rng, 46 + 9 * (i % 5) + i % 3)}".split())
    copies = [t[:len(t) - (len(t) - 4) // 9] + [f"new{i}x{j}" for j in range((len(t) - 4) // 9)] for i, t in enumerate(originals)]
    pairs = [(" ".join(t), " ".join(c)) for t, c in zip(originals, copies)]
    likeness = [simhash.jaccard(a, b) for a, b in pairs]
    assert min(likeness) == 0.8 and max(likeness) < 0.84
    base = prose(rng, 150)
    crowd = [edited(rng, base, 2 + i % 4) for i in range(150)]
    docs = [(i, a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (_, b) in enumerate(pairs)] + [(2000 + i, t) for i, t in enumerate(crowd)]
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    of = list(range(150))
    for i in range(150):
        for j in range(i):
            if of[i] != of[j] and simhash.jaccard(crowd[i], crowd[j]) >= 0.8:
                a, b = sorted((of[i], of[j]))
                of = [a if x == b else x for x in of]
    assert 1 < len(set(of)) < 150
    assert left == {*range(400), *(2000 + i for i in set(of))}


def test_bounds_of_near_copies_drop_no_pair_that_reaches_the_similarity():
    rng = np.random.default_rng(3)
    for _ in range(300):
        both, x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (rng.integers(1, 80), rng.integers(0, 12), rng.integers(0, 12)))
        a, b = (np.unique(np.concatenate([both, z])) for z in (x, y))
        common = np.sort(rng.choice(both, len(both) // 2, replace=False))
        shared, apart = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        assert np.bitwise_count(simhash.parities(a).view(np.uint64) ^ simhash.parities(b).view(np.uint64)).sum() <= apart
        if shared >= 0.8 * (shared + apart):
            rows = [pd.DataFrame({"key": p.view(np.int64), "node": n, "part": n, "size": len(h), "pos": range(len(p))})
                    for n, h in ((1, a), (2, b)) for p in [simhash.prefix(h, 0.8, common)]]
            found = pd.concat(simhash._block_pairs(pd.concat(rows).sort_values("key", ignore_index=True), 0.8))
            assert set(map(tuple, found.to_numpy().tolist())) == {(1, 2)}


def test_texts_with_enough_of_their_own_are_no_mates(spark):
    """Long texts around one passage and a crowd just below 0.8 make no block; pairs at 0.8 exactly stay, at any share of low hashes, repeated rows or not."""
    rng = random.Random(12)
    passage, base = prose(rng, 40), [f"w{i}" for i in range(400)]
    long = [f"{prose(rng, 100)} {passage} {' '.join(f'own{i}x{j}' for j in range(300))}" for i in range(30)]
    crowd = [" ".join(f"new{i}x{j}" if j % 22 == i % 22 else w for j, w in enumerate(base)) for i in range(60)]  # a fifth of the shingles and more are each text's own
    first = [prose(rng, 40 + i) for i in range(50)]
    pairs = [t for i, one in enumerate(first) for w in [one.split()] for t in (one, " ".join(w[:len(w) - (len(w) - 4) // 9] + [f"p{i}x{j}" for j in range((len(w) - 4) // 9)]))]
    likeness = [simhash.jaccard(a, b) for a, b in zip(pairs[::2], pairs[1::2])]
    assert 0.8 <= min(likeness) < max(likeness) < 0.85
    assert 0.6 < simhash.jaccard(crowd[0], crowd[22]) < 0.8 and simhash.jaccard(long[0], long[1]) < 0.3
    rows = list(enumerate(long + crowd + pairs))
    texts = spark.createDataFrame(rows + rows[::3], "node long, _llm_text string")
    wanted = {i for i, _ in rows[90:]}
    for share in (0.02, simhash.LOW, 1.0):
        assert wanted <= {r["node"] for r in simhash.with_mates(texts, 0.8, share).collect()}
    assert {r["node"] for r in simhash.with_mates(texts, 0.8, 1.0).collect()} == wanted
    found = {r["node"]: r for r in simhash.prefixes(texts, 0.8).collect()}
    assert set(found) == wanted and all(set(found[i]["first"]) & set(found[i + 1]["first"]) for i in range(90, 190, 2))


def test_pairs_beyond_the_parities_stay_in_their_block():
    """A block of 200 texts that share a fifth of their shingles at most puts out its one near pair, and how far it is apart."""
    rng = np.random.default_rng(4)
    both = rng.integers(0, 2**63, 20, dtype=np.uint64)
    sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, 80, dtype=np.uint64)])) for _ in range(199)]
    sets.append(np.unique(np.concatenate([sets[0][:-2], rng.integers(0, 2**63, 2, dtype=np.uint64)])))
    block = pd.DataFrame({"key": 1, "node": range(200), "part": range(200), "size": [len(h) for h in sets], "pos": 0, "bits": [simhash.parities(h).tobytes() for h in sets]})
    assert pd.concat(simhash._block_pairs(block, 0.8)).to_numpy().tolist() == [[0, 199, 4]]


def test_near_dedup_tells_rows_apart_that_share_an_id(spark):
    rng = random.Random(6)
    one, two, three, four = (prose(rng, 120) for _ in range(4))
    docs = [(1, one), (None, edited(rng, one, 1)), (None, two), (5, three), (5, edited(rng, one, 1)), (None, four), (None, edited(rng, four, 1)), (5, three)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    got = [(r["doc_id"], r["text"]) for r in left]
    assert len(got) == 4 and {(1, one), (None, two), (5, three)} <= set(got)
    assert [t for i, t in got if i is None and t in (docs[5][1], docs[6][1])]
