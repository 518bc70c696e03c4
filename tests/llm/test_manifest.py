from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlake.llm import manifest
from pvlake.llm.queries import MANIFEST_FIELDS, op12

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lift(row: list[str]) -> list[list[str]]:
    """All levels over a row of digests."""
    levels = [row]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[list[str]]:
    """Per level what stands before and after the node in its run."""
    out = []
    for row in levels[:-1]:
        run = row[i & ~1:(i & ~1) + 2]
        out.append([run[:i & 1], run[(i & 1) + 1:]])
        i >>= 1
    return out


def brute(rows: list[tuple], claim) -> list[tuple]:
    """(id, leaf, subroot, root, proof, folded root, verified) of every row."""
    order = lambda v, *more: (v is not None, *(x for x in (v,) if x is not None), *more)
    langs = sorted({r[2] for r in rows}, key=lambda v: order(v.encode() if v is not None else None))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: order(r[0], leaf(r))) for g in langs}
    lifted = {g: lift([leaf(r) for r in held]) for g, held in trees.items()}
    top = lift([lifted[g][-1][0] for g in langs])
    out = []
    for t, g in enumerate(langs):
        for i, r in enumerate(trees[g]):
            steps, folded = siblings(lifted[g], i) + siblings(top, t), leaf(claim(r))
            for before, after in steps:
                folded = sha("".join([*before, folded, *after]))
            out.append((r[0], leaf(r), lifted[g][-1][0], top[-1][0], "".join(x for s in steps for side in s for x in side), folded, folded == top[-1][0]))
    return out


def rows_of(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s", None, ""]), rng.choice(["en", "en", "en", "zz", "é", None]), rng.choice([None, i]), rng.choice(["", None, "ü" * i, "x" * 5000])) for i in range(90)]
    rows += [rows[5]] * 9 + [(None, "s", "en", 1, "a"), (None, "s", "en", 1, "a"), (None, "s", "en", 2, "b"), (7, "s", "alone", 2**63 - 1, "b"), (-4, None, "é", -1, "neg")]
    return rows


@pytest.mark.parametrize("levels", [2, 12])
def test_proofs_equal_brute_force(spark, levels):
    rows = rows_of()
    claim = lambda r: (*r[:3], r[3] + 1, r[4]) if r[3] is not None and r[0] is not None and r[0] % 7 == 0 else r
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("leaf", "tree", "idx", "n", "group", "id")})
    tampered = manifest.leaf_digest(*[(F.col("n_chars").cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in MANIFEST_FIELDS])
    claimed = F.when(F.col("doc_id") % 7 == 0, tampered).otherwise(manifest.leaf_digest(*[F.col(c) for c in MANIFEST_FIELDS]))
    leaves, nodes = manifest.build_manifest(docs, MANIFEST_FIELDS, claimed=claimed, levels=levels)
    columns = ["id", "leaf", "subroot", "root", F.array_join("proof", ""), "folded_root", "verified"]
    want = sorted(brute(rows, claim), key=repr)
    assert sorted((tuple(r) for r in manifest.prove(leaves, nodes, levels).select(*columns).collect()), key=repr) == want
    assert {w[-1] for w in want} == {True, False}
    part = leaves.where("idx % 5 = 2 or tree = 1")  # proofs of some leaves only need the same digests
    got = sorted((tuple(r) for r in manifest.prove(part, nodes, levels).select(*columns).collect()), key=repr)
    assert 0 < len(got) < len(rows) and set(got) <= set(want)


def test_multiproof_is_least():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 8, 21, 64):
        sizes = [-(-n >> k) for k in range(manifest.height(n) + 1)]
        for _ in range(20):
            known = np.array(rng.sample(range(n), rng.randint(1, n)))
            have = [set(known.tolist())] + [set() for _ in sizes[1:]]
            asked = manifest.missing(known, n)
            for level, i in asked:
                have[level].add(i)
            for level in range(len(sizes) - 1):  # a parent follows when its whole run is there
                have[level + 1] |= {j for j in range(sizes[level + 1]) if all(i in have[level] for i in (2 * j, 2 * j + 1) if i < sizes[level])}
            assert have[-1] == {0}
            covers = [{i >> level for i in known.tolist()} for level in range(len(sizes))]
            assert all(i not in covers[level] and (i ^ 1) in covers[level] for level, i in asked)  # none follows from the leaves


def test_manifest_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame([(1, "s", None, None, None)], SCHEMA)
    for part, count in ((docs.limit(0), 0), (docs, 1)):
        leaves, nodes = manifest.build_manifest(part, MANIFEST_FIELDS)
        found = manifest.prove(leaves, nodes).collect()
        assert len(found) == count
        assert all(r["leaf"] == r["root"] == r["subroot"] == r["folded_root"] and r["proof"] == [] and r["verified"] for r in found)


def test_op12_on_a_fixture(spark, tmp_path):
    spark.createDataFrame([(i, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(40)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12(spark, str(tmp_path)).collect()
    import zlib

    assert all(r["verified"] == bool(zlib.crc32(str(r["doc_id"]).encode()) % 7) for r in got) and len(got) == 40
