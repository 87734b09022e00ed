"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words; the
document's is the noisy-or of its sentences, 1 - prod(1 - p). Only document labels are known, and the
weights follow the noisy-or likelihood, so the model finds the offending sentences by itself
(offending_sentences returns them).

Every sentence of a clean text has some probability too, and their sum would call any text toxic that is long
enough. So a document's score is the greater of two: its likeliest sentence, and the noisy-or of all beyond
what a clean text of as many sentences comes to (its mean and LEAK_SPREAD standard deviations, learned from
the clean documents).

Training uses at most SAMPLE labelled documents, with SAMPLE_CHARACTERS of text together, taken in the order of a hash
of their id; both bounds are parameters. Everything else, the scoring of each document over its whole text, covers all rows.

Defined results: null and empty texts have no sentence that counts and get the score of one sentence
without words. Rows that repeat a doc_id are scored row by row, and the least of their texts is learned from; a null
doc_id is trained on by none. Repeated labels count once; a document with both labels counts as one of each.
Without labels of both kinds every score is the share of label 1 (0 if there is none). Other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm import shared

SAMPLE = 6000
SAMPLE_CHARACTERS = 60_000_000
DIMENSIONS = 1 << 18
LEAST_DOCS = 12
SURE = 3.2
DECAY = 2e-5
LEAK_SPREAD = 3.0
STEPS = 150
CACHED_WORDS = 500_000
FIT_DOCS = 256

_SENTENCE = re.compile(r"[.!?\n]+")
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_BAGS = pa.schema([("toxic", pa.int32()), ("features", pa.binary()), ("sizes", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def word_features(raw: str) -> tuple[int, int, int]:
    """Feature numbers of a raw word: its letters and digits, lower-cased, and its first four and five characters (offensive stems take endings)."""
    word = raw.lower().strip("\"'“”‘’.,;:!?()[]{}<>*#$%&|-_").encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    return tuple(zlib.crc32(f"{kind} {part}".encode()) % DIMENSIONS for kind, part in (("word", word), ("four", word[:4]), ("five", word[:5])))


class Remembered(dict):
    """What a function gives for a raw word, remembered for a bounded number of words."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, raw: str):
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[raw] = self.function(raw)
        return found


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    constant: float | None = None  # the score of every document, where nothing could be learned
    leak: float = 0.0  # -log(1 - p) of a clean document's sentence: mean, standard deviation
    spread: float = 0.0


def bags(texts: list[str], of_word: Remembered) -> tuple[list, np.ndarray, np.ndarray]:
    """What of_word gives for the words of all sentences in turn, words per sentence, sentences per text (at least one, maybe without words)."""
    found: list = []
    sizes: list[int] = []
    counts = []
    look = of_word.__getitem__
    for text in texts:
        before = len(sizes)
        for sentence in _SENTENCE.split(text):
            if words := sentence.split():
                found.extend(map(look, words))
                sizes.append(len(words))
        if len(sizes) == before:
            sizes.append(0)
        counts.append(len(sizes) - before)
    return found, np.array(sizes, np.int64), np.array(counts, np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def sentence_logits(model: Model, weights: list[float], sizes: np.ndarray) -> np.ndarray:
    return model.bias + _sums(np.array(weights, np.float64), sizes)


def weigher(model: Model) -> Remembered:
    return Remembered(lambda raw: float(model.weights[list(word_features(raw))].sum()))


def scores(model: Model, texts: list[str], weights: Remembered) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    found, sizes, counts = bags(texts, weights)
    logits = sentence_logits(model, found, sizes)
    likeliest = np.exp(-np.logaddexp(0.0, -np.maximum.reduceat(logits, np.cumsum(counts) - counts)))
    return np.clip(np.maximum(likeliest, noisy_or(logits, counts, model.leak, model.spread)), 0.0, 1.0)


def noisy_or(logits: np.ndarray, counts: np.ndarray, leak: float, spread: float) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) of each document's sentences, summed as logarithms, beyond what clean ones come to."""
    expected = leak * counts + LEAK_SPREAD * spread * np.sqrt(counts)
    return -np.expm1(-np.maximum(_sums(np.logaddexp(0.0, logits), counts) - expected, 0.0))


def likelihood(z: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray) -> float:
    """Mean log-likelihood of document labels under the noisy-or of their sentences' logits z."""
    log_clean = -np.bincount(doc_of, weights=np.logaddexp(0.0, z), minlength=len(toxic))
    return float(np.where(toxic == 1, np.log(np.maximum(-np.expm1(log_clean), 1e-300)), log_clean).mean())


def pulls(z: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """What the likelihood, summed over documents, gains with each sentence's logit."""
    none = np.exp(-np.bincount(doc_of, weights=np.logaddexp(0.0, z), minlength=len(toxic)))
    return np.where(toxic == 1, none / np.maximum(1 - none, 1e-9), -1.0)[doc_of] * np.exp(-np.logaddexp(0.0, -z))


def fit(toxic: np.ndarray, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> Model:
    """features: a row of feature numbers for each word."""
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, float(toxic.mean()) if len(toxic) else 0.0)
    in_docs, in_toxic = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    ends = np.cumsum(sizes)[np.cumsum(counts) - 1]  # of each document's words
    for first in range(0, len(counts), FIT_DOCS):
        last = min(first + FIT_DOCS, len(counts))
        start = ends[first - 1] if first else 0
        here = np.repeat(np.arange(last - first), np.diff(np.concatenate([[start], ends[first:last]])))
        pairs = np.unique((here[:, None] * DIMENSIONS + features[start : ends[last - 1]]).ravel())
        in_docs += np.bincount(pairs % DIMENSIONS, minlength=DIMENSIONS)
        in_toxic += np.bincount(pairs % DIMENSIONS, weights=toxic[first:last][pairs // DIMENSIONS], minlength=DIMENSIONS)
    clean = in_docs - in_toxic
    lift = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((clean + 0.5) / ((1 - toxic).sum() + 1))
    error = np.sqrt(1 / (in_toxic + 0.5) + 1 / (clean + 0.5))
    used = np.flatnonzero((in_docs >= LEAST_DOCS) & (lift > SURE * error))  # words that toxic documents have more often, beyond chance
    place = np.full(DIMENSIONS, -1, np.int32)
    place[used] = np.arange(len(used))
    of_sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rows, columns = [], []
    for kind in range(features.shape[1]):
        column = place[features[:, kind]]
        rows.append(of_sentence[column >= 0])
        columns.append(column[column >= 0])
    row, column = np.concatenate(rows), np.concatenate(columns)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    w = np.clip(lift[used], 0, 4)
    bias = -5.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    n_sentences, n_docs = len(sizes), len(counts)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights=w[column], minlength=n_sentences)
        pull = pulls(z, doc_of, toxic)
        slope = np.append(np.bincount(column, weights=pull[row], minlength=len(w)) / n_docs - DECAY * w, pull.sum() / n_docs)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(w + move[:-1], 0.0)
        bias = min(bias + move[-1], -2.0)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = w
    z = bias + np.bincount(row, weights=w[column], minlength=n_sentences)
    leaks = np.logaddexp(0.0, z)[toxic[doc_of] == 0]
    return Model(weights, float(bias), None, float(leaks.mean()), float(leaks.std()))


def train(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS) -> Model:
    """labels: doc_id, toxic (0 or 1; other values are left out); usable: the condition on doc_id under which a label may be learned."""
    told = shared.labelled_sample(docs, labels, "toxic", usable, sample, characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Remembered(word_features)
        for batch in batches:
            for toxic, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                features, sizes, _ = bags([text], numbers)
                yield shared.batch_of(_BAGS, [toxic], [np.array(features, np.int32).tobytes()], [sizes.astype(np.int32).tobytes()])

    rows = told.mapInArrow(run, "toxic int, features binary, sizes binary").collect()  # bounded by sample and characters
    rows.sort()
    sizes = [np.frombuffer(r.sizes, np.int32) for r in rows]
    features = np.frombuffer(b"".join(r.features for r in rows), np.int32).reshape(-1, 3)
    toxic = np.array([r.toxic for r in rows], np.int64)
    del rows
    return fit(toxic, features, np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64), np.array([len(s) for s in sizes], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        weights = weigher(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield shared.batch_of(_SCORES, part.column("doc_id"), scores(known, part.column("text").to_pylist(), weights))

    return shared.id_text(docs).mapInArrow(run, "doc_id long, score double")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number among the non-blank ones), start, end (code points, end exclusive), score, of sentences at least so likely."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        weights = weigher(known)
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                edges = [0, *(x for m in _SENTENCE.finditer(text) for x in m.span()), len(text)]
                spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if text[a:b].strip()]
                if spans and known.constant is None:
                    weighed, sizes, _ = bags([text], weights)
                    p = np.exp(-np.logaddexp(0.0, -sentence_logits(known, weighed, sizes)))
                    found += [(doc_id, k, a, b, float(p[k])) for k, (a, b) in enumerate(spans) if p[k] >= least]
            yield shared.batch_of(_SPANS, *(map(list, zip(*found, strict=True)) if found else [[]] * 5))

    return shared.id_text(docs).mapInArrow(run, "doc_id long, sentence int, start int, end int, score double")


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of docs whose own score is below least, all columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        weights = weigher(known)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield part.filter(pa.array(scores(known, [t or "" for t in part.column(at).to_pylist()], weights) < least))

    return docs.mapInArrow(run, docs.schema)
