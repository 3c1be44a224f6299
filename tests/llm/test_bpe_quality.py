import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from annoloom.llm import bpe, quality
from annoloom.llm.catalog import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def coder():
    return bpe.coder_for(vocabulary_path())


def same(coder, text):
    ids, decoded = coder.encode(text)
    want = coder.whole.encode(text, add_special_tokens=False).ids
    return np.frombuffer(ids, "<u4").tolist() == want and decoded.decode("utf-8", "replace") == coder.whole.decode(want, skip_special_tokens=False)


def test_chunked_encoding_is_exact(coder):
    rng = random.Random(1)
    bits = ["word", "the", " ", "  ", "\n", "\t", "é", "日本", "'s", "'re", "12", "###", "😀", "<|endoftext|>", "\xa0", "　", " ", "ﬁ", "١", "\x85"]
    for i in range(1500):
        assert same(coder, "".join(rng.choice(bits) for _ in range(rng.randint(0, 900 if i % 10 == 0 else 60))))
    for text in ("", "a" * 5000, "日本語テキスト" * 700, " " * 3000, "x y" * 2000, "'s" * 1500, "".join(rng.choice("abcdef") for _ in range(6000))):
        assert same(coder, text)


def test_shared_passages_are_encoded_once(coder):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    passage = " ".join(words[:2000])
    coder.encode(" ".join(words[2000:2100]) + " " + passage)
    before = coder.encoded_chunks
    coder.encode(" ".join(words[2100:2200]) + " " + passage)
    assert coder.encoded_chunks - before < 10


def test_every_code_point_that_is_taken_by_the_fast_path(coder):
    odd = bpe._odd_characters()
    for cp in range(0x3000):
        c = chr(cp)
        if not odd.search(c):
            assert same(coder, f"a{c}b {c}c 1{c}2 .{c}. x {c} {c}{c}y\n{c}"), hex(cp)


def test_joins_within_runs_are_repaired(coder, monkeypatch):
    """Many cuts and small windows: all kinds of joins, against whole encoding."""
    rng = random.Random(3)
    kinds = ["東京都の、はa", "abcdefghij", "ab '\n.12", ["the", "re", "in", " ", "e", "s", "'", "st", "ing", "x" * 9, " " * 9], "0123456789", "+/AZaz09"]
    texts = ["".join(rng.choice(kinds[i % 6]) for _ in range(rng.randint(16, 1500))) for i in range(600)]
    monkeypatch.setattr(bpe, "MEAN_CHUNK", 8)
    monkeypatch.setattr(bpe, "CUT_BITS", 3)
    for least, near, tokens in ((1, 4, 1), (2, 3, 2), (8, 64, 4)):
        monkeypatch.setattr(bpe, "LEAST_CHUNK", least)
        monkeypatch.setattr(bpe, "NEAR", near)
        monkeypatch.setattr(bpe, "TOKENS", tokens)
        assert all(same(coder, t) for t in texts)


def test_passages_without_spaces_are_reused(coder):
    rng = random.Random(2)
    passage = "".join(chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(20_000))
    assert same(coder, "前言" + passage)
    encoded, reused = coder.encoded_chunks, coder.reused_chunks
    assert same(coder, "另一篇文章的开头" + passage + "end")
    assert coder.encoded_chunks - encoded < 10 and coder.reused_chunks - reused > 100


def test_very_long_texts(coder):
    rng = random.Random(4)
    for text in (" " * 1_000_000 + "x", (" " * 5000 + "word") * 100, "".join(rng.choices("abcdefghij", k=300_000)), "".join(rng.choices("AZaz09+/", k=300_000)), "'s" * 100_000):
        assert same(coder, text)


def test_other_vocabulary_files_are_encoded_whole():
    import public_tokenizers

    other = bpe.ChunkCoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some Text, with words and 12 numbers. " * 60
    ids, decoded = other.encode(text)
    want = other.whole.encode(text, add_special_tokens=False).ids
    assert not other.chunked and np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == other.whole.decode(want, skip_special_tokens=False)


def test_bpe_report(spark, sf, coder):
    odd = [(1, None, "x"), (2, "", "y"), (2, "é<|endoftext|>", None), (None, "null id", "z"), (3, "again " * 9, "z"), (3, "again " * 9, "z")]
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(odd, "doc_id long, text string, ids string")):
        want = Counter()
        for r in docs.collect():
            ids = coder.whole.encode(r["text"] or "", add_special_tokens=False).ids
            decoded = coder.whole.decode(ids, skip_special_tokens=False)
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.report(docs, vocabulary_path()).collect())
        assert got == want
        assert bpe.report(docs.limit(0), vocabulary_path()).count() == 0


def brute(text, min_repeat):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, repeated = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            repeated.update(range(i, i + 5))
    out = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(s) for s in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
    }
    if len(w) <= 300:
        n, best = len(w), [0] * len(w)
        common = [[0] * (n + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(n - 1, i, -1):
                if w[i] == w[j]:
                    common[i][j] = common[i + 1][j + 1] + 1
                    best[i], best[j] = max(best[i], common[i][j]), max(best[j], common[i][j])
        covered = {k for i, x in enumerate(best) if x >= min_repeat for k in range(i, i + x)}
        out |= {"covered_words": len(covered), "longest_repeat": max(best, default=0)}
    return out


def test_quality_against_brute_force(spark, sf):
    rng = random.Random(3)
    texts = [None, "", "\n", "a", "a\na", "  \n a", "a b c d e a b c d e\n", "é ü\r\né ü\n\n", "x " * 50, "\x0b\x0cw\x85w"]
    texts += ["".join(rng.choice(["ab", "é", "c", " ", " ", "\n", "#"]) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = quality.measure(pa.array(texts, pa.string()), 8)
    for i, text in enumerate(texts):
        for k, v in brute(text, 8).items():
            assert int(got[k][i]) == v, (k, text)


def test_quality_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(400))
    twice = " ".join(f"w{i}" for i in range(300)) + " " + " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, "a b c"), (3, clean), (4, clean + " " + clean), (5, twice), (6, clean)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.report(docs).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False), 5: (True, False), 6: (False, True)}
    assert quality.report(docs.limit(0)).count() == 0


def test_long_repeats_reject_texts_that_the_base_rule_passes(spark):
    def text(n, *copies):
        w = [f"w{i}" for i in range(n)]
        for start, to, size in copies:
            w[to : to + size] = w[start : start + size]
        return " ".join(w)

    rows = [(1, text(110, (0, 60, 10))), (2, text(2000, (0, 900, 175))), (3, text(5000, (0, 900, 51))), (4, text(5000, (0, 900, 50))), (5, text(300, (0, 100, 15))), (6, text(110, (0, 60, 7)))]
    got = {r["doc_id"]: r for r in quality.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["covered_words"], got[i]["longest_repeat"]) for i in range(1, 7)] == [(20, 10), (350, 175), (102, 51), (100, 50), (30, 15), (0, 7)]
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {1, 2, 3}


def test_memory_of_very_long_texts():
    import tracemalloc

    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    column = pa.array([text + " " + text[: 300_000]])
    tracemalloc.start()
    got = quality.measure(column, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["longest_repeat"][0] > 35_000 and peak < 22 * len(text)
