"""Pieces of texts by a unigram vocabulary, behind a compiled character map.

A map lies in bytes as a double array over UTF-8: a number of bytes, that many bytes of units, then the texts put in, each ended by a zero. From a
place, the text that the shortest matching beginning of a character stands for takes the place of the whole character (a grapheme of up to five bytes,
else each code point of it); other characters stay. Then runs of blanks are one, a text is marked at its start and at blanks, and cut before each mark.

Texts are cut and encoded where they lie, without a shuffle: a task finds the best way through the lattice of a word (of equal ways to a place the one whose last
piece is longest) when it first meets the word and remembers up to WORDS_REMEMBERED of them. Vocabularies are tables (id, piece, score); workers get
the pieces as one broadcast array, which holds at most LARGEST pieces; models of this kind have up to a few hundred thousand.

Defined results: a null text is an empty text, which has no pieces. Characters no piece has are the unknown id, once for each run of them. Rows that
repeat a key keep their rows; ids are in the order of the text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.text import TEXTS_AT_ONCE, sliced
from lectern.sources.scratch import settled

MARK = "▁"
PENALTY = 10.0  # how far an unknown character is below the worst piece
LARGEST = 4_000_000
REMEMBERED = 200_000
WORDS_REMEMBERED = 400_000
WHOLE_BYTES = 6  # a grapheme of fewer bytes is looked up as one

_GRAPHEME = regex.compile(r"\X")
_WORD = regex.compile(f"{MARK}[^{MARK}]*")
_LEAF = 1 << 31


class CharacterMap:
    """A compiled map, read from its bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]
        self.known: dict[str, str] = {}

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def value(self, key: bytes) -> str | None:
        """What the shortest beginning of key that has an entry stands for."""
        at = self._step(self.units[0])
        for byte in key:
            at ^= byte
            if not byte or at >= len(self.units) or self.units[at] & (_LEAF | 0xFF) != byte:
                return None
            unit = self.units[at]
            at ^= self._step(unit)
            if unit >> 8 & 1:
                begin = self.units[at] & _LEAF - 1
                return self.texts[begin : self.texts.index(0, begin)].decode()
        return None

    def _looked_up(self, grapheme: str) -> str:
        key = grapheme.encode("utf-8", "surrogatepass")
        whole = self.value(key) if len(key) < WHOLE_BYTES else None
        if whole is not None:
            return whole
        parts = ((c, self.value(c.encode("utf-8", "surrogatepass"))) for c in grapheme)
        return "".join(c if found is None else found for c, found in parts)

    def normalise(self, text: str) -> str:
        out = []
        for grapheme in _GRAPHEME.findall(text):
            found = self.known.get(grapheme)
            if found is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = self.known[grapheme] = self._looked_up(grapheme)
            out.append(found)
        return "".join(out)


def compiled(rules: Mapping[str, str]) -> bytes:
    """The bytes of a map from texts to texts."""
    tree: dict = {}
    for key in rules:
        node = tree
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[None] = key
    texts, begins = b"", {}
    for key, value in rules.items():
        begins[key] = len(texts)
        texts += value.encode() + b"\0"
    units: dict[int, int] = {0: 0}
    todo, taken = [(0, tree)], set()
    free = 1
    while todo:
        at, node = todo.pop()
        labels = [0 if b is None else b for b in node]
        base = free
        while base in taken or any(base ^ b in units for b in labels):  # a label only tells a child from others where no two nodes share a base
            base += 1
        taken.add(base)
        if (at ^ base) >= 1 << 21:
            raise ValueError("more entries than a map of this form holds")
        units[at] |= (at ^ base) << 10 | (None in node) << 8
        for byte, below in node.items():
            units[base ^ (byte or 0)] = _LEAF | begins[below] if byte is None else byte
        todo += [(base ^ byte, below) for byte, below in node.items() if byte is not None]
        while free in units:
            free += 1
    flat = np.zeros(max(units) + 1, "<u4")
    flat[list(units)] = list(units.values())
    return (4 * len(flat)).to_bytes(4, "little") + flat.tobytes() + texts


def normalised(texts: DataFrame, blob: bytes, *kept: str) -> DataFrame:
    """kept columns and text, normalised by the map; nulls stay."""
    held = texts.sparkSession.sparkContext.broadcast(blob)  # the model's own map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = CharacterMap(held.value)
        for batch in sliced(batches, TEXTS_AT_ONCE):
            done = pa.array([None if t is None else rules.normalise(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), done], names=[*kept, "text"])

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.select(*kept, "text").mapInArrow(run, f"{schema}, text string" if kept else "text string")


def words_of(text: str) -> list[str]:
    """The marked words of a normalised text."""
    one = regex.sub(" {2,}", " ", text)
    marked = one.replace(" ", MARK)
    return _WORD.findall(marked if marked.startswith(MARK) else MARK + marked) if marked else []


class Lattice:
    """The best way through the pieces that a word is made of."""

    def __init__(self, pieces: Mapping[str, tuple[int, float]], unknown: int):
        self.pieces, self.unknown = pieces, unknown
        self.longest = max(map(len, pieces), default=0)
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - PENALTY
        self.beginnings: dict[str, tuple[int, float] | None] = {p[:n]: None for p in pieces for n in range(1, len(p) + 1)}
        self.beginnings.update(pieces)

    def ids(self, word: str) -> list[int]:
        n, longest, known = len(word), self.longest, self.beginnings.get
        best: list[float | None] = [0.0] + [None] * n
        last = [(0, self.unknown)] * (n + 1)
        for start in range(n):
            single, here = False, best[start]
            for end in range(start + 1, min(n, start + longest) + 1):
                found = known(word[start:end], False)
                if found:
                    score = here + found[1]
                    if best[end] is None or score > best[end]:
                        best[end], last[end] = score, (start, found[0])
                    single = single or end == start + 1
                elif found is False:
                    break
            if not single and (best[start + 1] is None or here + self.unknown_score > best[start + 1]):
                best[start + 1], last[start + 1] = here + self.unknown_score, (start, self.unknown)
        found, end = [], n
        while end:
            start, piece = last[end]
            if not (piece == self.unknown and found and found[-1] == self.unknown):
                found.append(piece)
            end = start
        return found[::-1]


class WordIds(dict):
    """The ids of a word. Bounded: words not asked for while half of WORDS_REMEMBERED others came are forgotten."""

    def __init__(self, ways: Lattice):
        self.ways, self.older = ways, {}

    def __missing__(self, word: str) -> array:
        if len(self) >= WORDS_REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = array("i", self.ways.ids(word))
        self[word] = found
        return found


def encoded(texts: DataFrame, vocabulary: DataFrame, path: str, blob: bytes | None = None, unknown: int = 0, special: Mapping[str, int] | None = None, key: str = "id") -> DataFrame:
    """key, ids (array of int) of every row of texts (key, text). vocabulary: id, piece, score; special: texts that are ids of their own; path: a new folder."""
    spark = texts.sparkSession
    special = dict(special or {})
    held = spark.sparkContext.broadcast(blob)
    either = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    lattice = settled(vocabulary.select(F.col("id").cast("int").alias("id"), "piece", F.col("score").cast("double").alias("score")), f"{path}/pieces")
    if (count := lattice.count()) > LARGEST:
        raise ValueError(f"{count} pieces: a vocabulary for workers' memory has {LARGEST} at most")
    listed = spark.sparkContext.broadcast(lattice.orderBy("id").toArrow())  # at most LARGEST pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = CharacterMap(held.value) if held.value else None
        table = listed.value
        known = WordIds(Lattice({p: (i, s) for i, p, s in zip(*(table[c].to_pylist() for c in ("id", "piece", "score")), strict=True)}, unknown))
        for batch in sliced(batches, TEXTS_AT_ONCE):
            ids, ends = array("i"), [0]
            for text in batch.column("text").to_pylist():
                at = 0
                for m in either.finditer(text) if either else ():
                    for word in words_of(rules.normalise(text[at : m.start()]) if rules else text[at : m.start()]):
                        ids.extend(known[word])
                    ids.append(special[m[0]])
                    at = m.end()
                rest = text[at:] if at else text
                for word in words_of(rules.normalise(rest) if rules else rest):
                    ids.extend(known[word])
                ends.append(len(ids))
            flat = pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[key, "ids"])

    whole = texts.select(key, F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, ids array<int>")


def trained(texts: DataFrame, longest: int = 6, least: int = 20) -> DataFrame:
    """id, piece, score: parts of up to longest characters that stand least times or more in distinct marked words (id 0 is the unknown), by count; 1000 times the logarithm of the share."""
    words = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("w")).where("w <> ''").distinct().select(F.concat(F.lit(MARK), "w").alias("w"))
    starts = words.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("a"))
    parts = starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("w") - F.col("a") + 1)), lambda n: F.substr("w", F.col("a"), n))).alias("piece"))
    counted = parts.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order, whole = Window.orderBy(F.desc("n"), "piece"), Window.partitionBy(F.lit(0))  # a vocabulary
    return counted.select(F.row_number().over(order).alias("id"), "piece", F.round(F.log(F.col("n") / F.sum("n").over(whole)) * 1000).alias("score"))
