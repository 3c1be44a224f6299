"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel: gap-weighted subsequences of three symbols. A unit's feature of three symbols is the sum, over
the places where they occur in order within ``SPAN`` symbols, of ``DECAY`` to the power of the span they
take; vectors are normalised. So ``i-d-i-o-t`` or ``idixot`` stay near ``idiot``. Units are the tokens of a
text; a run of single letters is one; a long token is cut into overlapping pieces, in which every window of
``SPAN`` symbols lies whole. Letters count without their accents; other scripts' letters share 24 symbols, digits
have their own, and punctuation takes room but matches nothing. (Pairs of neighbouring short words as further
units were tried: on held-out rows they cost more right answers than they gave.)

Training: labels hold for documents, insults are units. Units that may be the cause are first ranked by how
unevenly their subsequences fall on the two classes; then a machine is trained on the best unit of each toxic
document against units of the clean ones, the choice is made anew with it, and so on (multiple-instance
learning). The machine is linear in the Nystroem map of the kernel's values against the landmark units, and is
fitted by Newton steps on the squared hinge loss. A second such machine weighs the highest unit scores of a
document against its length, so that a unit that is now and then innocent needs company; it is fitted on
every fifth document of each class, which the first machine has not seen (on all if a class has under five). As the
kernel's features are sums over subsequences, the trained machine is one weight for each subsequence, so scoring costs
the same whatever the number of landmarks.

Only the fit reads a sample: up to ``max_docs`` documents of each class, of up to ``max_chars``
characters, in the order of a hash of doc_id. Every text is scored whole.

Defined cases: a null or empty text has score 0; without labels of both classes all scores are 0; several
labels of a document count as toxic if one is; of units that score alike the first in their order is taken, and
texts of equal score get equal answers; only ``doc_id``, ``text`` and the labels' ``doc_id`` and
``toxic`` are read; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.llm.common import SLICE_BYTES, map_arrow, materialise, text_slices

SPAN, DECAY, PIECE = 5, 0.6, 24
_BITS, _FIRST, _LAST, _GAP = 6, 61, 62, 63
TABLE = 1 << (3 * _BITS)
#: Tokens whose scores a Python worker keeps.
CACHE_TOKENS = 100_000
_MARKS = re.compile(r"[\u0300-\u036f]+")
_LETTER_RUN = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def tokens(text: str) -> Counter[str]:
    """Counts of a text's units before they are cut into pieces: lower-cased tokens without accents and outer
    punctuation, runs of single letters joined."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
    found: Counter[str] = Counter()
    for word, n in Counter(low.split()).items():
        found[word.strip(_EDGES)] += n
    found.update(re.sub(r"\s", "", m[0]) for m in _LETTER_RUN.finditer(low))
    found.pop("", None)
    return found


def document_features(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of the highest 1, 2, 4 and 8 token scores, each token as often as it occurs; how many tokens
    score high; the text's length; a constant."""
    out = np.zeros(8)
    out[:4], out[7] = -1.5, 1.0
    if len(scores):
        best = np.argpartition(-scores, min(8, len(scores) - 1))[:8]
        best = best[np.argsort(-scores[best], kind="stable")]
        top = np.repeat(np.clip(scores[best], -1.5, 1.5), np.minimum(counts[best], 8))[:8]
        top = np.pad(top, (0, 8 - len(top)), constant_values=-1.5)
        out[:4] = top[0], top[:2].mean(), top[:4].mean(), top.mean()
        out[4], out[5], out[6] = np.log1p([counts[scores > 0.5].sum(), counts[scores > 0].sum(), counts.sum()])
    return out


def _codes(pieces: list[str], length: int) -> np.ndarray:
    """Symbols of equally long pieces, between the end marks."""
    chars = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").reshape(len(pieces), length).astype(np.int64)
    plain = (chars >= 97) & (chars <= 122)
    other = 36 + chars * 40503 % 24
    symbols = np.where(plain, chars - 97, np.where(chars < 128, np.where((chars >= 48) & (chars <= 57), 26 + chars - 48, _GAP), other))
    return np.pad(symbols, ((0, 0), (1, 1)), constant_values=((0, 0), (_FIRST, _LAST)))


_triples: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if n not in _triples:
        found = [(i, j, k, DECAY ** (k - i + 1)) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
        i, j, k, w = zip(*found, strict=True) if found else ((), (), (), ())
        _triples[n] = np.array(i, np.int64), np.array(j, np.int64), np.array(k, np.int64), np.array(w, np.float64)
    return _triples[n]


def features(pieces: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes (pieces x places) and their weights, normalised; a place with a gap weighs 0."""
    symbols = _codes(pieces, length)
    i, j, k, w = _places(length + 2)
    a, b, c = symbols[:, i], symbols[:, j], symbols[:, k]
    codes = (a << (2 * _BITS)) | (b << _BITS) | c
    weights = np.where((a == _GAP) | (b == _GAP) | (c == _GAP), 0.0, w)
    square = (weights**2).sum(axis=1)
    ordered = np.sort(symbols, axis=1)
    twice = np.flatnonzero(((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] != _GAP)).any(axis=1))
    if len(twice) and codes.shape[1]:
        # subsequences that occur several times: their weights add up before they are squared
        order = np.argsort(codes[twice], axis=1)
        own = np.take_along_axis(codes[twice], order, 1)
        heavy = np.take_along_axis(weights[twice], order, 1)
        begins = np.ones(own.shape, bool)
        begins[:, 1:] = own[:, 1:] != own[:, :-1]
        sums = np.add.reduceat(heavy.ravel(), np.flatnonzero(begins.ravel()))
        firsts = np.concatenate([[0], np.cumsum(begins.sum(axis=1))[:-1]])
        square[twice] = np.add.reduceat(sums**2, firsts)
    return codes, weights / np.sqrt(np.maximum(square, 1e-12))[:, None]


def pieces_of(token: str) -> list[str]:
    """Overlapping pieces of a long token; every window of ``SPAN`` symbols lies in one of them."""
    if len(token) <= PIECE:
        return [token]
    return [token[i : i + PIECE] for i in range(0, len(token) - PIECE // 2, PIECE // 2)]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word indices, codes, weights) for equally long pieces of the words, a thousand at a time."""
    groups: dict[int, list[tuple[int, str]]] = {}
    for n, word in enumerate(words):
        for piece in pieces_of(word):
            groups.setdefault(len(piece), []).append((n, piece))
    for length, group in groups.items():
        for at in range(0, len(group), 1024):
            part = group[at : at + 1024]
            codes, weights = features([p for _, p in part], length)
            yield np.array([n for n, _ in part]), codes, weights


@dataclass
class ToxicityModel:
    weight: np.ndarray  # of each subsequence
    bias: float
    document: np.ndarray  # weights of a document's features
    steepness: float = 1.0

    def token_scores(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf)
        for index, codes, weights in _by_length(words):
            np.maximum.at(out, index, (self.weight[codes] * weights).sum(axis=1) + self.bias)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-self.steepness * (features @ self.document), -50, 50)))


def _landmark_matrix(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Column of each subsequence code (the last column is empty), and landmarks x columns."""
    found = list(_by_length(landmarks))
    used = np.unique(np.concatenate([c.ravel() for _, c, _ in found]))
    column = np.full(TABLE, len(used), np.int32)
    column[used] = np.arange(len(used))
    matrix = np.zeros((len(landmarks), len(used) + 1), np.float32)
    for index, codes, weights in found:
        np.add.at(matrix, (np.repeat(index, codes.shape[1]), column[codes].ravel()), weights.ravel().astype(np.float32))
    return column, matrix


def _kernel(words: list[str], column: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Kernel values of pieces against landmarks."""
    out = np.zeros((len(words), len(matrix)))
    turned = np.ascontiguousarray(matrix.T)
    for index, codes, weights in _by_length(words):
        for at in range(0, len(index), 256):
            part = slice(at, at + 256)
            out[index[part]] = np.einsum("bt,btm->bm", weights[part].astype(np.float32), turned[column[codes[part]]])
    return out


def _newton_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Primal squared-hinge machine; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        xs = x[active] * cost[active, None]
        w = np.linalg.solve(xs.T @ x[active] + np.diag(penalty * cost.sum()), xs.T @ y[active])
        now = y * (x @ w) < 1
        if np.array_equal(now, active) or not now.any():
            break
        active = now
    return w


def _unevenness(docs: list[Counter[str]], y: np.ndarray) -> np.ndarray:
    """Standard score of each subsequence's share in toxic against clean documents."""
    counts = np.zeros((2, TABLE))
    for words, label in zip(docs, y, strict=True):
        if words:
            seen = np.unique(np.concatenate([np.where(w > 0, c, TABLE - 1).ravel() for _, c, w in _by_length(sorted(words))]))
            counts[label, seen] += 1
    z = _standard_score(counts, y)
    z[TABLE - 1] = 0
    return np.clip(z, -12, 12)


def _standard_score(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    share = counts.sum(axis=0) / (n0 + n1)
    return (counts[1] / n1 - counts[0] / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n0 + 1 / n1))


def fit(texts: list[str], labels: list[int], landmarks: int = 192, rounds: int = 4, seed: int = 5) -> ToxicityModel | None:
    """Train on labelled texts; None without both classes. A fifth of them sets the document weights and threshold."""
    y = np.array(labels, np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return None
    docs = [tokens(t) for t in texts]
    fifth = np.zeros(len(y), bool)
    for label in (0, 1):
        fifth[np.flatnonzero(y == label)[4::5]] = True
    judged = fifth if len({*y[fifth]}) == 2 else np.ones(len(y), bool)
    model = _fit_units([docs[i] for i in np.flatnonzero(~fifth)], y[~fifth], landmarks, rounds, seed)
    x = np.array([_features_of(docs[i], model) for i in np.flatnonzero(judged)])
    y = y[judged]
    target = np.where(y == 1, 1.0, -1.0)
    model.document = _newton_svm(x, target, np.full(len(target), 1 / len(target)), ridge=1e-4)
    margin = x @ model.document
    model.document[-1] -= _threshold(margin, y)
    model.steepness = 2.0 / max(float(np.median(np.abs(x @ model.document))), 1e-3)
    return model


def _fit_units(docs: list[Counter[str]], y: np.ndarray, landmarks: int, rounds: int, seed: int) -> ToxicityModel:
    """The machine for units, from documents with units (cut into pieces here) and labels."""
    rng = np.random.default_rng(seed)
    docs = [Counter({p: 1 for w in d for p in pieces_of(w)}) for d in docs]
    vocabulary = sorted(set().union(*docs))
    number = {w: n for n, w in enumerate(vocabulary)}
    inside = [np.array(sorted(number[w] for w in d), np.int64) for d in docs]
    df = np.zeros((2, len(vocabulary)))
    for ids, label in zip(inside, y, strict=True):
        df[label, ids] += 1
    z = _standard_score(df, y)
    # units that the labels alone show to be uneven: causes from the start, and never clean
    shown = np.flatnonzero((z >= 5) & (df[1] >= 4))
    in_clean = df[0] > 0
    in_clean[shown] = False
    model = ToxicityModel(_unevenness(docs, y), 0.0, np.zeros(8))
    for _ in range(rounds):
        score = model.token_scores(vocabulary)
        tops = [score[ids].max() for ids, label in zip(inside, y, strict=True) if len(ids) and not label]
        sure = np.percentile(tops, 98) if tops else -np.inf
        votes: dict[int, int] = {int(n): int(df[1, n]) for n in shown}
        fallback: dict[int, int] = {}
        clean: set[int] = set()
        for ids, label in zip(inside, y, strict=True):
            if not len(ids):
                continue
            best = ids[np.argsort(-score[ids], kind="stable")[:5]]
            if label:
                # a document without a sure cause is left out of this round
                best = [int(n) for n in best if not in_clean[n]]
                for n in best:
                    if score[n] > sure and z[n] < 5:
                        votes[n] = votes.get(n, 0) + 1
                for n in best[:1]:
                    fallback[n] = fallback.get(n, 0) + 1
            else:
                clean.update(best[:3].tolist())
                clean.update(rng.choice(ids, min(4, len(ids)), replace=False).tolist())
        votes = votes or fallback
        if not votes or not clean:
            break
        witness = sorted(votes, key=lambda n: (-votes[n], n))
        clean = sorted(clean.difference(votes))
        half = landmarks // 2
        marks = [*witness[:half], *rng.permutation(clean)[: landmarks - half].tolist()]
        column, matrix = _landmark_matrix([vocabulary[n] for n in marks])
        values, vectors = np.linalg.eigh((matrix @ matrix.T).astype(np.float64))
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        words = [vocabulary[n] for n in [*witness, *clean]]
        target = np.concatenate([np.ones(len(witness)), -np.ones(len(clean))])
        x = np.column_stack([_kernel(words, column, matrix) @ root, np.ones(len(words))])
        heard = np.array([votes[n] for n in witness], np.float64) ** 0.5
        cost = np.concatenate([0.5 * heard / heard.sum(), np.full(len(clean), 0.5 / len(clean))])
        w = _newton_svm(x, target, cost)
        weight = np.zeros(TABLE, np.float32)
        there = column < matrix.shape[1] - 1
        weight[there] = ((root @ w[:-1]) @ matrix)[column[there]]
        model = ToxicityModel(weight, float(w[-1]), np.zeros(8))
    return model


def _features_of(words: Counter[str], model: ToxicityModel) -> np.ndarray:
    return document_features(model.token_scores(list(words)), np.fromiter(words.values(), np.int64, len(words)))


def _threshold(top: np.ndarray, y: np.ndarray) -> float:
    """The cut with fewest errors; of several, the middle of the widest gap."""
    order = np.argsort(top, kind="stable")
    top, y = top[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    bounds = np.concatenate([[top[0] - 1], top, [top[-1] + 1]])
    gaps = np.diff(bounds)
    best = max(np.flatnonzero(errors == errors.min()), key=lambda k: (gaps[k], -k))
    return float((bounds[best] + bounds[best + 1]) / 2)


def may_learn(doc_id: F.Column) -> F.Column:
    """Whether a row's label may be learnt from: crc32 of its id as text is no multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_chars: int = 20_000) -> ToxicityModel | None:
    """Train on the documents that have a label and may be learnt from."""
    marked = labels.filter(F.col("toxic").isNotNull() & may_learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    marked = materialise(marked.withColumn("h", F.xxhash64("doc_id")), "marked")
    rows = []
    for y in (0, 1):
        # twice as many ids, for some have no text or a longer one; at most so many are broadcast
        ids = marked.filter(F.col("y") == y).orderBy("h", "doc_id").limit(2 * max_docs)
        some = docs.filter(F.length("text").between(1, max_chars)).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        rows += some.orderBy("h", "doc_id", "text").limit(max_docs).collect()
    return fit([r["text"] for r in rows], [r["y"] for r in rows])


def score_texts(texts: Iterable[str | None], model: ToxicityModel | None, known: dict[str, float] | None = None) -> np.ndarray:
    """Scores of texts; ``known`` keeps token scores from call to call, within a bound."""
    known = {} if known is None else known
    texts = [t if isinstance(t, str) else "" for t in texts]
    out = np.zeros(len(texts))
    if model is None:
        return out
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_BYTES):
            size += len(texts[to])
            to += 1
        counted = [tokens(t) for t in texts[at:to]]
        if len(known) > CACHE_TOKENS:
            known.clear()
        fresh = list(set().union(*counted).difference(known))
        known.update(zip(fresh, model.token_scores(fresh).tolist(), strict=True))
        rows = [document_features(np.fromiter(map(known.__getitem__, w), np.float64, len(w)), np.fromiter(w.values(), np.int64, len(w))) for w in counted]
        out[at:to] = np.where([bool(w) for w in counted], model.probability(np.array(rows)), 0.0)
        at = to
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores = score_texts(part.column("text").to_pylist(), held.value, known)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], schema=OUT)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", (~may_learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
