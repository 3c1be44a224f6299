"""Secret scan: three base patterns, and character Markov models for what they miss.

Two character-bigram models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a candidate token's score is its log-likelihood ratio a character. Every token of 12 or
more characters of the usual encodings is a candidate, letters alone too. Tokens above the threshold of
their length that no base span touches become spans of kind ``markov``.

Defined cases: a null or empty text has no spans; texts are scanned whole; only ``doc_id`` and ``text``
are read, so further columns (clashing names too) are ignored; repeated rows give repeated results; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.llm import spans as S
from annoloom.llm.common import map_arrow, materialise, text_bytes, text_slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A candidate for the models: as many characters of the usual encodings as the base rule asks for.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Lengths from which thresholds are set apart, for scores of short tokens scatter more, and the samples of
#: each label that one needs of its own.
LENGTHS, LEAST_SAMPLES = (12, 14, 16, 20, 28, 40), 50
#: How often the label-0 samples are cleared of what the models find in them.
ROUNDS = 2
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _class_of(length: int) -> int:
    return bisect_right(LENGTHS, length)


class MarkovPair:
    """Bigram log-likelihood ratio: label 1 (random string) against label 0 (ordinary identifier)."""

    def __init__(self, ratio: np.ndarray, threshold: float, by_length: dict[int, float] | None = None):
        self.ratio, self.threshold, self.by_length = ratio, threshold, by_length or {}

    def limit(self, length: int) -> float:
        """The threshold for tokens of ``length`` characters."""
        return self.by_length.get(_class_of(length), self.threshold)

    def score(self, token: str) -> float:
        codes = _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8) & 127]
        if len(codes) < 2:
            return -math.inf
        return float(self.ratio[codes[:-1], codes[1:]].mean())


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.5, corpus: np.ndarray | None = None) -> MarkovPair:
    """Fit both models on (string, label) samples, twice: of the ordinary samples, those that the first models place
    above the middle of the random ones are taken for secrets in the sampled texts and left out of the second.
    The threshold lies midway between the lowest
    score of nearly all random samples (2nd percentile) and the highest of nearly all ordinary ones (99.9th), but
    never under the latter; so does that of each class of lengths with enough samples. ``corpus`` (``letter_pairs``) joins
    the ordinary model with the weight that the pairs of the ordinary samples have together, a fifth of it
    in capitals."""
    samples = list(samples)
    first = _fit(samples, smoothing, corpus)
    strange = [first.score(t) for t, y in samples if y == 1]
    if strange:
        middle = float(np.median(strange))
        samples = [(t, y) for t, y in samples if y == 1 or len(t) < LENGTHS[0] or first.score(t) <= middle]
    return _fit(samples, smoothing, corpus)


def _fit(samples: list[tuple[str, int]], smoothing: float, corpus: np.ndarray | None) -> MarkovPair:
    size = len(ALPHABET) + 1
    counts = np.full((2, size, size), smoothing)
    for token, label in samples:
        codes = _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8) & 127]
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    if corpus is not None and corpus.sum():
        capitals = np.zeros_like(corpus)
        both = corpus[:52, :52].reshape(2, 26, 2, 26).sum(axis=(0, 2))
        capitals[26:52, 26:52] = both
        weight = (counts[0] - smoothing).sum() / corpus.sum()
        counts[0] += weight * (0.8 * corpus + 0.2 * capitals)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    pair = MarkovPair(logs[1] - logs[0], 0.0)
    scored = [(_class_of(len(t)), y, pair.score(t)) for t, y in samples if y == 1 or len(t) >= LENGTHS[0]]

    def between(ordinary: list[float], strange: list[float]) -> float:
        top = float(np.percentile(ordinary, 99.9))
        return max(top, (top + float(np.percentile(strange, 2))) / 2)

    pair.threshold = between([v for _, y, v in scored if y == 0] or [0.0], [v for _, y, v in scored if y == 1] or [1.0])
    for k in range(1, len(LENGTHS) + 1):
        own = [[v for c, y, v in scored if c == k and y == label] for label in (0, 1)]
        if min(map(len, own)) >= LEAST_SAMPLES:
            pair.by_length[k] = between(*own)
    return pair


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """How often each letter follows each other one in the texts of all documents, whole. Each task sends
    one count for each pair that it met."""
    size = len(ALPHABET) + 1
    code = np.full(256, 52, np.int64)
    code[:128] = np.minimum(_CODE, 52)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(53 * 53, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, bounds = text_bytes(part.column("text"))
                codes = code[data]
                pairs = codes[:-1] * 53 + codes[1:]
                inner = bounds[(bounds > 0) & (bounds < len(data))]
                pairs[inner - 1] = 53 * 53 - 1  # of two texts
                counts += np.bincount(pairs, minlength=53 * 53)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["pair", "n"])

    met = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "pair long, n long")
    out = np.zeros((size, size))
    for r in met.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        a, b = divmod(r["pair"], 53)
        if a < 52 and b < 52:
            out[a, b] = r["n"]
    return out


def labelled_samples(docs: DataFrame, max_docs: int = 400, max_chars: int = 20_000, random_strings: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Label 1: strings drawn uniformly from the alphabets of common encodings, those of letters alone among
    them. Label 0: words outside found secrets of up to ``max_docs`` documents of at most ``max_chars`` characters
    (chosen by a hash of doc_id), alone and joined as identifiers are, also in capitals, numbers, and lines of one symbol. These two bounds limit the fit alone, never the scan."""
    some = docs.filter(F.length("text").between(1, max_chars)).select("doc_id", "text")
    # ids first: tasks send no texts but those of the ids chosen
    ids = some.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(max_docs)
    ids = materialise(ids, "sample")
    rows = some.join(F.broadcast(ids), "doc_id").orderBy("h", "doc_id", "text").limit(max_docs).select("text").collect()
    texts = [without(r["text"], base_spans(r["text"])) for r in rows]
    samples = _samples_of(texts, random_strings, seed)
    for _ in range(ROUNDS):
        # what the models find in the sampled texts is not ordinary
        model = train(samples)
        texts = [without(t, scan(t, model)) for t in texts]
        samples = _samples_of(texts, random_strings, seed)
    return samples


def _samples_of(texts: list[str], random_strings: int, seed: int) -> list[tuple[str, int]]:
    words = sorted({w for t in texts for w in re.findall(r"[A-Za-z]{3,}", t)})
    rng = random.Random(seed)
    samples = [(w, 0) for w in sorted({*words, *(w.upper() for w in words)})]
    if words:
        for _ in range(2 * random_strings):
            some = [rng.choice(words).lower() for _ in range(rng.randint(2, 5))]
            style = rng.randrange(5)
            joined = ("_".join(some), "-".join(some), some[0] + "".join(w.capitalize() for w in some[1:]), "/".join(some), "".join(some))[style]
            joined = joined.upper() if rng.random() < 0.2 else joined
            samples.append((joined + str(rng.randrange(100)) * (rng.random() < 0.2), 0))
    samples += [(str(rng.randrange(10 ** rng.randint(4, 15))), 0) for _ in range(random_strings // 4)]
    samples += [(rng.choice("-=_+/") * rng.randint(12, 64), 0) for _ in range(random_strings // 8)]
    hexes, small, capital, digits = "0123456789abcdef", ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = (hexes, hexes.upper(), small + digits, capital + digits, ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", small, capital, ALPHABET[:52])
    for i in range(2 * random_strings):
        alphabet = alphabets[i % len(alphabets)]
        samples.append(("".join(rng.choice(alphabet) for _ in range(rng.randint(12, 24) if i % 20 < 10 else rng.randint(20, 64))), 1))
    return samples


def base_spans(text: str) -> list[tuple]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), 1.0, True) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), 1.0, True) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), 1.0, True) for m in HEX.finditer(text)]
    return found


def without(text: str, spans: list[tuple]) -> str:
    """The text with spaces in place of spans."""
    for _, start, end, *_ in spans:
        text = text[:start] + " " * (end - start) + text[end:]
    return text


def scan(text: str, model: MarkovPair) -> list[tuple]:
    """All spans of one text, by start, then kind."""
    found = base_spans(text)
    base = S.Cover(found)
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if base.touches(m.start(), m.end()):
            continue
        score = model.score(token)
        if score > model.limit(len(token)):
            found.append(("markov", m.start(), m.end(), score, False))
    return S.in_order(found, KINDS)


def find_secrets(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """(doc_id, spans) for every row. Without a model, one is trained on ``labelled_samples(docs)``
    and the letter pairs of all documents."""
    model = model or train(labelled_samples(docs), corpus=letter_pairs(docs))
    return S.map_spans(docs, lambda text: scan(text, model))


def report(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """Counts and digests of the spans, one row a document."""
    found = find_secrets(docs, model)
    return found.select(
        "doc_id",
        *[S.count_of("spans", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(S.joined("spans", base_only=True), 256).alias("base_sha256"),
        S.joined("spans").alias("spans"),
    )
