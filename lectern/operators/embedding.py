"""Texts to vectors: unigram pieces, pooling, prefixes, and the vectors that are still missing.

The model is injected: a function from lists of piece ids to vectors of each piece (a PieceModel), loaded once a
worker by its factory, or an Embedder that takes texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import relational

# Prefixes, marks and sizes of the embedding model.
PASSAGE, QUERY = "passage: ", "query: "
BEGIN, PAD, END, UNKNOWN = 0, 1, 2, 3
MOST_PIECES, GROUP = 512, 64
WORDS_REMEMBERED = 100_000

#: Texts to vectors, as many as texts; a factory makes one on a worker.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Piece ids of a text to a vector for each.
PieceModel = Callable[[Sequence[int]], Sequence[Sequence[float]]]


class UnigramTokenizer:
    """Pieces of the greatest total score, by dynamic programming over a text's positions.

    vocabulary: (piece, score) in the order of their ids. A blank is written as ▁ and each word starts with one; runs of letters that no
    piece covers are one unknown. normalise: a function of the text (a precompiled character map), none by default. special: strings that
    are pieces of their own wherever they stand. The ids of up to WORDS_REMEMBERED words are remembered.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]], normalise: Callable[[str], str] | None = None, special: dict[str, int] | None = None):
        self.ids = {piece: (k, score) for k, (piece, score) in enumerate(vocabulary) if k > UNKNOWN}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.worst = min((score for _, score in self.ids.values()), default=0.0) - 10.0
        self.normalise = normalise or (lambda text: text)
        self.special = special or {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Text between special strings, and these; the longest that starts first."""
        while text:
            hits = [(text.find(s), -len(s), s) for s in self.special if s in text]
            if not hits:
                yield text, None
                return
            at, _, found = min(hits)
            if at:
                yield text[:at], None
            yield found, self.special[found]
            text = text[at + len(found) :]

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        ids, worst, longest = self.ids, self.worst, self.longest
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for end in range(1, len(word) + 1):
            score, begin, piece = best[end - 1][0] + worst, end - 1, UNKNOWN
            for start in range(max(0, end - longest), end):
                known = ids.get(word[start:end])
                if known:
                    some = best[start][0] + known[1]
                    if some > score or (some == score and start < begin):  # of equal ways the one whose last piece is longest
                        score, begin, piece = some, start, known[0]
            best.append((score, begin, piece))
        out, at = [], len(word)
        while at:
            _, start, piece = best[at]
            if not (piece == UNKNOWN and out and out[-1] == UNKNOWN):
                out.append(piece)
            at = start
        return out[::-1]

    def encode(self, text: str, most: int = MOST_PIECES) -> list[int]:
        ids: list[int] = []
        for segment, special in self._segments(text):
            if special is not None:
                ids.append(special)
                continue
            for word in self.normalise(segment).split():
                found = self.known.get(word)
                if found is None:
                    if len(self.known) >= WORDS_REMEMBERED:
                        self.known.clear()
                    found = self.known[word] = tuple(self.word(f"▁{word}"))
                ids += found
                if len(ids) > most:
                    break
        return [BEGIN, *ids[: most - 2], END]


def character_map(rules: dict[str, str]) -> Callable[[str], str]:
    """A normaliser that replaces, from each place on, the longest text that has a rule; other characters stay."""
    longest = max(map(len, rules), default=0)

    def normalise(text: str) -> str:
        out, at = [], 0
        while at < len(text):
            n = next((n for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in rules), 0)
            out.append(rules[text[at : at + n]] if n else text[at])
            at += n or 1
        return "".join(out)

    return normalise


def normalised(vector: Column) -> Column:
    """A vector of length one; zeros stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(vector, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def pooled(vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, v: the mean, of length one, of the vectors (keys, v) of each key; sums by place, so a key with many vectors is no hot task."""
    each = vectors.select(*keys, F.posexplode("v").alias("place", "x"))
    means = each.groupBy(*keys, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    joined = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("v"))
    return joined.withColumn("v", normalised(F.col("v")))


def piece_embedder(tokenizer: UnigramTokenizer, model: PieceModel) -> Embedder:
    """An Embedder that pools a model's vectors of a text's pieces."""
    import numpy as np

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            mean = np.asarray(model(tokenizer.encode(text)), float).mean(axis=0)
            out.append((mean / (np.linalg.norm(mean) or 1.0)).tolist())
        return out

    return embed


@lru_cache(maxsize=4)
def _made(factory: Callable[[], Embedder]) -> Embedder:
    return factory()


def embedded(texts: DataFrame, factory: Callable[[], Embedder], prefix: str = PASSAGE, key: str = "id", group: int = GROUP) -> DataFrame:
    """key, v of texts (key, text): in groups of group texts; factory makes the embedder once a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = _made(factory)
        for batch in batches:
            for at in range(0, len(batch), group):
                some = batch.iloc[at : at + group]
                vectors = embed([prefix + (t or "") for t in some["text"]])
                yield pd.DataFrame({key: some[key].to_numpy(), "v": [list(map(float, v)) for v in vectors]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, v array<double>")


def missing(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks (id, text) without a vector of the model (vectors: chunk_id, model_id)."""
    done = vectors.where(F.col("model_id") == model).select(F.col("chunk_id").alias("id")).distinct()
    return chunks.join(done, "id", "left_anti")


def built(chunks: DataFrame, vectors: DataFrame, model: str, factory: Callable[[], Embedder]) -> DataFrame:
    """The vectors (chunk_id, model_id, v) of one model for all chunks: those of other models go, missing ones are made."""
    kept = relational.delete(vectors, F.col("model_id") != model).join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    new = embedded(missing(chunks, vectors, model), factory)
    return kept.select("chunk_id", "model_id", "v").unionByName(new.select(F.col("id").alias("chunk_id"), F.lit(model).alias("model_id"), "v"))
