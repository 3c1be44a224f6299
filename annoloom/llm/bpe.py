"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the last eight characters alone cuts a text into chunks, so that passages that documents
share give the same chunks wherever they stand, with or without spaces. A Python worker encodes each
distinct chunk once and keeps its ids in a bounded cache. The joins of the chunks are then repaired: tokens
on both sides of a join are encoded again, in a window that grows until its ids agree with those beside it.

Agreement is exact. A window ends either at a place that no token can cross (from a non-space to a space, or
from one class of characters to another, but not after an apostrophe), or at a token of the chunk within one
run of a class. There it agrees if its outermost token is the chunk's own: a sequence of tokens is the
encoding of its run exactly if each two neighbours are the encoding of theirs, so what lies beyond stays.
Cuts within white space, or within four characters of an apostrophe, are not taken.

The chunk encoder is the rank form of the vocabulary in the file. A text with characters that the two
libraries' Unicode tables class differently is encoded whole by the ``tokenizers`` library, as are all texts
if the file asks for another splitting than the byte-level one.

Defined cases: a null or empty text has no ids and decodes to ''; texts are encoded whole; the special
string in a text becomes its id, as the ``tokenizers`` library has it; only ``doc_id`` and ``text`` are
read; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.llm.common import map_arrow, text_list, text_slices

DDL = "doc_id long, ids binary, decoded string"
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
#: What a byte-level vocabulary file means by its own splitting: fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the hash that are zero at a cut, least characters of a chunk, characters of the rolling hash, characters and tokens on each side of a
#: join that its first window may take.
CUT_BITS, LEAST_CHUNK, WINDOW, NEAR, TOKENS = 8, 64, 8, 64, 4
MEAN_CHUNK = 1 << CUT_BITS
#: Bytes of each of the cache's two generations.
CACHE_BYTES = 12 << 20
#: Runs of white space from this length on go to the ``tokenizers`` library: the other's pattern overflows on them.
LONG_SPACE = 4096
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


class ChunkCoder:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        self.chunked = _is_byte_level(spec)
        if not self.chunked:
            return
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.coder = tiktoken.Encoding("chunks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.odd = _odd_characters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.encoded_chunks = self.reused_chunks = 0

    def chunk(self, text: str) -> bytes:
        """Ids (32 bits each) of a chunk, encoded once while the cache holds it."""
        got = self.young.get(text)
        if got is not None:
            self.reused_chunks += 1
            return got
        got = self.old.get(text)
        if got is None:
            hard = len(text) >= LONG_SPACE and _LONG_SPACE.search(text)
            ids = self.whole.encode(text, add_special_tokens=False).ids if hard else self.coder.encode_ordinary(text)
            got = array("I", ids).tobytes()
            self.encoded_chunks += 1
        else:
            self.reused_chunks += 1
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[text] = got
        self.held += 200 + 2 * len(text) + len(got)
        return got

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids (little-endian, 32 bits) and decoded bytes of a whole text."""
        if not self.chunked:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes(), self.whole.decode(ids, skip_special_tokens=False).encode()
        ids = array("I")
        if self.special and any(s in text for s in self.special):
            for part in self.split.split(text):
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    ids.extend(self._ordinary(part))
        else:
            ids = self._ordinary(text)
        return np.asarray(ids, "<u4").tobytes(), b"".join(map(self.bytes_of.__getitem__, ids))

    def _ordinary(self, text: str) -> array:
        if not text.isascii() and self.odd.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids)
        out, at = array("I"), 0
        for end in [*cuts(text), len(text)]:
            own = self.chunk(text[at:end])
            skip = self._repair(text, at, end, out, own) if at and not _is_safe(text, at) else 0
            out.frombytes(own[4 * skip :] if skip else own)
            at = end
        return out

    def _repair(self, text: str, cut: int, end: int, out: array, own: bytes) -> int:
        """Make ``out``, the ids of text[:cut], begin the ids of text[:end], given the ids ``own`` of
        text[cut:end]: replaces ids at the end of ``out``; returns how many ids of ``own`` they stand for."""
        left, right = _safe_before(text, cut, cut - NEAR), _safe_after(text, cut, min(end, cut + NEAR), end)
        if (left is None or right is None) and text[cut - 1].isspace():
            # a long run of white space ends here: no token of it but the last can cross
            left, right = _safe_before(text, cut, 0), _safe_after(text, cut, end, end)
        following = memoryview(own).cast("I")
        before = after = TOKENS
        while True:
            start, dropped = self._back(text, cut, out, left, before)
            stop, skipped = self._forth(text, cut, end, following, right, after)
            ids = array("I")
            ids.frombytes(self.chunk(text[start:stop]))
            left_agrees = start in (0, left) or ids[0] == out[len(out) - dropped]
            right_agrees = stop in (end, right) or ids[-1] == following[skipped - 1]
            if left_agrees and right_agrees:
                break
            before, after = before * (1 if left_agrees else 2), after * (1 if right_agrees else 2)
        del out[len(out) - dropped :]
        out.extend(ids)
        return skipped

    def _back(self, text: str, cut: int, out: array, left: int | None, count: int) -> tuple[int, int]:
        """A place to begin a window before ``cut``: ``left``, else the start of a token at least ``count``
        tokens back at which the run may be cut; and the number of tokens from there."""
        at, n, size = cut, 0, len(out)
        goal = None if left is None else len(text[left:cut].encode())
        taken = 0
        while n < size:
            token = self.bytes_of[out[size - 1 - n]]
            n += 1
            taken += len(token)
            at -= _characters(token)
            if goal is not None:
                if taken == goal:
                    return left, n
            elif at and n >= count and not 0x80 <= token[0] < 0xC0 and "'" not in text[max(0, at - 3) : at + 1] and not text[at].isspace():
                if _is_safe(text, at) or _kind(text[at]) == _kind(text[at - 1]):
                    return at, n
        return 0, n

    def _forth(self, text: str, cut: int, end: int, following: memoryview, right: int | None, count: int) -> tuple[int, int]:
        """A place to end a window after ``cut``: ``right``, else the end of a token at least ``count``
        tokens on; and the number of tokens up to there."""
        at, n = cut, 0
        goal = None if right is None else len(text[cut:right].encode())
        taken = 0
        for n, i in enumerate(following, 1):  # noqa: B007
            token = self.bytes_of[i]
            taken += len(token)
            at += _characters(token)
            if goal is not None:
                if taken == goal:
                    return right, n
            elif n >= count and n < len(following) and not 0x80 <= self.bytes_of[following[n]][0] < 0xC0 and _kind(text[at]) == _kind(text[at - 1]) and not text[at].isspace():
                return at, n
        return end, len(following)


def _characters(token: bytes) -> int:
    """Characters that begin in a token."""
    return len(token) - sum(0x80 <= b < 0xC0 for b in token) if not token.isascii() else len(token)


def _kind(c: str) -> int:
    """Class of a character in the splitting: white space, letter, number, other."""
    return 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3


def _is_safe(text: str, at: int) -> bool:
    """Whether no token can cross this place, whatever stands around its two characters."""
    a = _kind(text[at - 1])
    return a != 0 and a != _kind(text[at]) and text[at - 1] != "'"


def _safe_before(text: str, at: int, least: int) -> int | None:
    """The last safe place before ``at`` and not before ``least``; the text's start counts."""
    while at > max(0, least):
        at -= 1
        if at == 0 or _is_safe(text, at):
            return at
    return None


def _safe_after(text: str, at: int, most: int, end: int) -> int | None:
    """The first safe place after ``at`` and before ``most``; ``end`` counts if it is no further."""
    while at + 1 < most:
        at += 1
        if _is_safe(text, at):
            return at
    return end if most >= end else None


def cuts(text: str) -> list[int]:
    """Places to cut by content, rising."""
    if len(text) < 2 * MEAN_CHUNK:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes) - WINDOW + 1
    rolling = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolling += codes[k : k + n] * _MULTIPLIERS[k]
    rolling ^= rolling >> np.uint64(29)
    rolling *= np.uint64(0xBF58476D1CE4E5B9)
    found, done = [], 0
    for at in (np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + WINDOW).tolist():
        if at - done < LEAST_CHUNK or at >= len(text) or "'" in text[at - 4 : at + 4] or (text[at - 1].isspace() and text[at].isspace()):
            continue
        found.append(at)
        done = at
    return found


def _is_byte_level(spec: dict) -> bool:
    """Whether a vocabulary file is plain byte-level BPE, split by its own pattern."""
    model, split, after = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    tokens = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    own = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    return bool(model["type"] == "BPE" and plain and tokens and own and after.get("type") == "ByteLevel" and not spec["normalizer"] and _in_merge_order(model))


def _in_merge_order(model: dict) -> bool:
    """Whether ids rise with the merges, so that ids can stand for ranks."""
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    return all(a < b for a, b in zip(ids, ids[1:], strict=False))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand
    for themselves, the other bytes, in order, for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _odd_characters() -> re.Pattern:
    """Characters that two Unicode tables may class differently: unassigned here or outside the first planes
    that have been stable, and the separators that are spaces in one library alone."""
    separators = r"\x1c-\x1f\x85\u180e\u200b\u2028\u2029"
    stable = (
        r"\u0000-\u024f\u0370-\u0373\u0391-\u03ff\u0400-\u0481\u048a-\u0513\u2010-\u2027\u2030-\u205e"
        r"\u20a0-\u20b5\u2190-\u23e7\u2500-\u26b2\u3041-\u3096\u309b-\u30ff\u4e00-\u9fa5\uac00-\ud7a3"
    )
    return re.compile(f"[{separators}]|[^{stable}]")


_coders: dict[str, ChunkCoder] = {}


def coder_for(path: str) -> ChunkCoder:
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit integers, decoded text) for every row.
    ``vocabulary`` is a path that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(vocabulary)
        for batch in batches:
            for part in text_slices(batch, "text"):
                pairs = [coder.encode(t) for t in text_list(part, "text")]
                decoded = pa.array([d.decode("utf-8", "replace") for _, d in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([i for i, _ in pairs], pa.binary()), decoded], schema=OUT)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, DDL)


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    return encode_decode(docs, vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
