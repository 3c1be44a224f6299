"""Quality rules: word and symbol counts, repeated lines and windows, and suffix-array repetition.

The suffix array of a text's words is built by prefix doubling, for many texts at once: the text is part
of the first key, so suffixes of different texts never tie. The longest common prefixes of neighbours
come from one table of prefix sums of a polynomial over the words' hashes, so that no earlier ranks are
kept: the memory for a text grows with its words alone. Each prefix of ``min_repeat`` or more words marks a maximal
repeat; the union of their spans gives the covered share of the words, the largest prefix the longest
repeat. A text fails the method if either exceeds its limit.

Defined cases: a null or empty text has no words and fails the base rule; texts are read whole; only
``doc_id`` and ``text`` are read; repeated rows give repeated results; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.llm.common import map_arrow, mix64, polynomial, span_hashes, text_bytes, text_slices, window_hashes, words_of

#: Fixed limits of the base rule: words a text needs, words of a window, and percent of repeated words.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Limits of the method: share of the words in long repeats (as for repeated ten-word windows in common
#: corpus rules), and words of one repeat (the usual length from which verbatim text counts as duplicated).
MAX_COVERED, MAX_LONGEST = 0.1, 50
SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DDL = "doc_id long, " + ", ".join(f"{f} long" for f in FIELDS) + ", covered_words long, longest_repeat long"
OUT = pa.schema([("doc_id", pa.int64()), *[(f, pa.int64()) for f in (*FIELDS, "covered_words", "longest_repeat")]])
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.int64)


def _dup_lines(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    rows = len(bounds) - 1
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([bounds[:-1][bounds[1:] > bounds[:-1]], breaks + 1]))
    begins = begins[begins < len(data)]
    if not len(begins):
        return np.zeros(rows, np.int64)
    row = np.searchsorted(bounds, begins, side="right") - 1
    ends = np.append(begins[1:], len(data))
    ends = np.where(data[ends - 1] == 10, ends - 1, ends)
    ends = np.maximum(ends, begins)
    worded = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends, row = begins[worded], ends[worded], row[worded]
    key = mix64(span_hashes(data, begins, ends) ^ mix64(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(row[again], minlength=rows)


def _repeat_words(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(rows, np.int64)
    own = row[:n] == row[WINDOW - 1 :]
    at = np.flatnonzero(own)
    key = mix64(window_hashes(words, WINDOW)[at] ^ mix64(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + WINDOW, -1)
    return np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=rows)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions in the order of their keys, each position's rank, and the number of different keys."""
    array = np.argsort(key).astype(np.int32)
    ordered = key[array]
    fresh = np.zeros(len(key), np.int32)
    fresh[1:] = ordered[1:] != ordered[:-1]
    np.cumsum(fresh, out=fresh)
    rank = np.empty(len(key), np.int32)
    rank[array] = fresh
    return array, rank, int(fresh[-1]) + 1


def suffix_repeats(words: np.ndarray, row: np.ndarray, first: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the words that repeats of ``min_repeat`` or more words cover, and the longest repeat."""
    rows, n = len(first) - 1, len(words)
    if n < 2:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    last = first[1:][row].astype(np.int32)
    key = mix64(words ^ mix64(row.astype(np.uint64) + np.uint64(1)))
    step = 1
    while True:
        array, rank, kinds = _ranked(key)
        if kinds == n or step >= n:
            break
        key = rank.astype(np.int64)
        key *= n + 1
        # a suffix that ends inside the window is unlike any other
        inside = np.flatnonzero(np.arange(step, n + step, dtype=np.int32) < last)
        key[inside] += rank[inside + step] + 1
        step *= 2
    del key, rank
    a, b = array[:-1], array[1:]
    kept = row[a] == row[b]
    a, b = a[kept], b[kept]
    sums, inverse = polynomial(words)
    common = np.zeros(len(a), np.int32)
    size = step >> 1  # at the last ranks all windows of ``step`` words differ, or none is as long
    while size:
        at = np.flatnonzero((a + common + size <= last[a]) & (b + common + size <= last[b]))
        i, j = a[at] + common[at], b[at] + common[at]
        same = (sums[i + size] - sums[i]) * inverse[i] == (sums[j + size] - sums[j]) * inverse[j]
        common[at[same]] += size
        size >>= 1
    length = np.zeros(n, np.int64)
    np.maximum.at(length, a, common)
    np.maximum.at(length, b, common)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, length)
    marked = np.flatnonzero(length >= min_repeat)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, marked, 1)
    np.add.at(change, marked + length[marked], -1)
    return np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=rows), longest


def measure(column: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    """All figures for the texts of a column."""
    data, bounds = text_bytes(column)
    rows = len(bounds) - 1
    starts, ends, first = words_of(data, bounds)
    row = np.repeat(np.arange(rows), np.diff(first))
    words = span_hashes(data, starts, ends)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    covered, longest = suffix_repeats(words, row, first, min_repeat)
    return {
        "n_words": np.diff(first),
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _sums(_IS_SYMBOL[data], bounds),
        "n_dup_lines": _dup_lines(data, bounds, starts),
        "n_repeat_words": _repeat_words(words, row, rows),
        "covered_words": covered,
        "longest_repeat": longest,
    }


def measure_quality(docs: DataFrame, min_repeat: int = 8) -> DataFrame:
    """(doc_id, counts, covered_words, longest_repeat) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                got = measure(part.column("text"), min_repeat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(got[f].astype(np.int64)) for f in OUT.names[1:]]], schema=OUT)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, DDL)


def judge_quality(docs: DataFrame, min_repeat: int = 8, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``."""
    m = measure_quality(docs, min_repeat)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    repetitive = (F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive)


def report(docs: DataFrame) -> DataFrame:
    return judge_quality(docs).select("doc_id", *FIELDS, "base_failed", "kept", "covered_words", "longest_repeat")
