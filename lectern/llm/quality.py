"""Document quality by nearest-neighbour voting among latent-semantic vectors.

Terms are a document's words and their shapes (which kinds of characters a word has, in order), hashed,
and one for words said again at once; terms weigh log(1 + count) times a rarity learned from the sample. A truncated singular value
decomposition of the labelled sample's term matrix gives RANK axes. The labelled vectors are broadcast:
at most SAMPLE rows of RANK numbers, learned from at most SAMPLE_CHARACTERS of text; both bounds are parameters and do
not grow with the data. Each
document is compared with all of them by cosine, in exact blocks, and its NEAREST neighbours vote with
the weight of their similarity.

Defined results: null and empty texts have no term; they, and texts at no positive similarity to any
neighbour, get the share of label 1 in the sample (0 without labels). Equal similarities are taken in
the sample's order (its label, then its terms). Rows that repeat a doc_id are scored row by row, and the least of their
texts is learned from; a null doc_id teaches nothing. Repeated labels count once.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm import shared

SAMPLE = 6000
SAMPLE_CHARACTERS = 60_000_000
WORD_TERMS = 1 << 14
SHAPE_TERMS = 1 << 11
RANK = 48
NEAREST = 15
SHARPNESS = 8
CACHED_WORDS = 400_000
PROJECTED = 100_000

_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_TERMS = pa.schema([("quality", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary())])
_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_SHAPES = [(re.compile(r"[a-zß-öø-ÿ]"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"[0-9]"), "0")]


def word_terms(raw: str) -> tuple[int, int]:
    """Term numbers of a raw word: the word itself and its shape, runs of one kind as one."""
    shape = raw
    for kind, sign in _SHAPES:
        shape = kind.sub(sign, shape)
    shape = _RUNS.sub(r"\1", shape)
    code = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))
    return code(raw) % WORD_TERMS, WORD_TERMS + code(shape) % SHAPE_TERMS


class Remembered(dict):
    def __missing__(self, raw: str) -> tuple[int, int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[raw] = word_terms(raw)
        return found


def term_counts(text: str, remembered: Remembered) -> tuple[np.ndarray, np.ndarray]:
    split = text.split()
    words = Counter(split)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    numbers = np.array([remembered[w] for w in words], np.int64)
    times = np.fromiter(words.values(), np.int64, len(words))
    total = np.bincount(numbers.ravel(), weights=np.repeat(times, 2), minlength=WORD_TERMS + SHAPE_TERMS + 1)
    total[-1] = sum(map(eq, split, islice(split, 1, None)))  # words said again at once
    terms = np.flatnonzero(total)
    return terms.astype(np.int32), total[terms].astype(np.int64)


@dataclass
class Model:
    rarity: np.ndarray  # of each term
    axes: np.ndarray  # terms x RANK
    vectors: np.ndarray  # of the sample, unit length
    labels: np.ndarray
    share: float


def _weighted(terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Weights of all documents' terms; words and shapes each have unit length in a document, so neither drowns the other."""
    w = np.log1p(counts) * rarity[terms]
    of = np.repeat(np.arange(len(sizes)), sizes) * 2 + (terms >= WORD_TERMS)
    norm = np.sqrt(np.bincount(of, weights=w * w, minlength=2 * len(sizes)))
    return w / np.maximum(norm, 1e-12)[of]


def _project(terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows of documents times axes, some PROJECTED terms at a time."""
    out = np.zeros((len(sizes), axes.shape[1]))
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        start = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, start + PROJECTED, side="right")))
        full = first + np.flatnonzero(sizes[first:last] > 0)
        if len(full):
            some = slice(start, ends[last - 1])
            out[full] = np.add.reduceat(weights[some, None] * axes[terms[some]], ends[full] - sizes[full] - start, axis=0)
        first = last
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(labels: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, rank: int = RANK) -> Model:
    """Randomised truncated SVD of the sample's weighted term matrix, two power iterations, fixed seed."""
    width, n = WORD_TERMS + SHAPE_TERMS + 1, len(labels)
    if not n:
        return Model(np.zeros(width), np.zeros((width, rank)), np.zeros((0, rank)), np.zeros(0), 0.0)
    rarity = np.log((1 + n) / (1 + np.bincount(terms, minlength=width))) + 0.1
    weights = _weighted(terms, counts, sizes, rarity)
    row = np.repeat(np.arange(n), sizes)

    def back(q: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(terms, weights=weights * q[row, k], minlength=width) for k in range(q.shape[1])], axis=1)

    guess = np.random.default_rng(7).standard_normal((width, rank + 8))
    for _ in range(3):
        q, _ = np.linalg.qr(_project(terms, weights, sizes, guess))
        guess = back(q)
    axes = np.linalg.svd(guess, full_matrices=False)[0][:, :rank]
    return Model(rarity, axes.astype(np.float32), _unit(_project(terms, weights, sizes, axes)), labels.astype(np.float64), float(labels.mean()) if n else 0.0)


def train(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS) -> Model:
    """labels: doc_id, quality (0 or 1; other values are left out); usable: the condition on doc_id under which a label may be learned."""
    told = shared.labelled_sample(docs, labels, "quality", usable, sample, characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = Remembered()
        for batch in batches:
            found = [term_counts(t, remembered) for t in batch.column("text").to_pylist()]
            yield shared.batch_of(_TERMS, batch.column("label"), [t.tobytes() for t, _ in found], [c.tobytes() for _, c in found])

    rows = sorted(told.mapInArrow(run, "quality int, terms binary, counts binary").collect())
    sizes = np.array([len(r.terms) // 4 for r in rows], np.int64)
    return fit(
        np.array([r.quality for r in rows], np.int64),
        np.frombuffer(b"".join(bytes(r.terms) for r in rows), np.int32).astype(np.int64),
        np.frombuffer(b"".join(bytes(r.counts) for r in rows), np.int64),
        sizes,
    )


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest values of each row; of equal values the first ones."""
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, best, axis=1).min(axis=1)
    for row in np.flatnonzero((near == least[:, None]).sum(axis=1) > 1):
        above, tied = np.flatnonzero(near[row] > least[row]), np.flatnonzero(near[row] == least[row])
        best[row] = np.concatenate([above, tied[: k - len(above)]])
    return best


def scores(model: Model, texts: list[str], remembered: Remembered) -> np.ndarray:
    found = [term_counts(t, remembered) for t in texts]
    sizes = np.array([len(t) for t, _ in found], np.int64)
    out = np.full(len(texts), model.share)
    if not len(model.labels) or not sizes.any():
        return out
    terms = np.concatenate([t for t, _ in found]).astype(np.int64)
    weights = _weighted(terms, np.concatenate([c for _, c in found]), sizes, model.rarity)
    vectors = _unit(_project(terms, weights, sizes, model.axes))
    near = vectors @ model.vectors.T
    k = min(NEAREST, near.shape[1])
    best = nearest(near, k)
    pull = np.clip(np.take_along_axis(near, best, axis=1), 0.0, None) ** SHARPNESS
    total = pull.sum(axis=1)
    voted = total > 0
    out[voted] = (pull * model.labels[best]).sum(axis=1)[voted] / total[voted]
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE, RANK and the numbers of terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, remembered = held.value, Remembered()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield shared.batch_of(_SCORES, part.column("doc_id"), scores(known, part.column("text").to_pylist(), remembered))

    return shared.id_text(docs).mapInArrow(run, "doc_id long, score double")
