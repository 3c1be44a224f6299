import random
import re

import numpy as np
import pyarrow as pa

from annoloom.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            a, b = sets[x], sets[y]
            if i is not None and j is not None and a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, label int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((i, n, c, i == c) for i, n, c in brute(rows)), key=str)


def test_edges(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e f"), (7, "a b c d e f"), (8, long), (9, long + " end"), (10, "É b"), (11, "é b"), (12, "b a")]
    check(spark, rows)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    lost = spark.createDataFrame([(None, "a b c"), (None, "x y"), (3, "a b c")], "doc_id long, text string")
    assert sorted((r["component_id"], r["kept"]) for r in minhash.near_duplicates(lost).collect() if r["doc_id"] is None and r["component_id"]) == [(3, False)]


def test_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "UNIT", 32)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(220, 320):
        rows.append((i, " ".join(base[:60] + [f"u{i}_{k}" for k in range(30)])))
    rng.shuffle(rows)
    check(spark, rows)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    pool = [f"t{i}" for i in range(10_000)]
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            words = rng.choice(pool, 400, replace=False)
            cut = int(400 * 2 * share / (1 + share))
            texts = [" ".join(words), " ".join([*words[:cut], *rng.choice(pool, 400 - cut)])]
            sets, bounds = minhash.shingle_sets(pa.array(texts))
            a, b = set(sets[: bounds[1]].tolist()), set(sets[bounds[1] :].tolist())
            _, packed, _ = minhash.sketches(sets, bounds)
            errors.append(float(minhash.estimate(packed[0], packed[1])) - len(a & b) / len(a | b))
        assert abs(np.mean(errors)) < 0.05 and max(map(abs, errors)) < 0.25
