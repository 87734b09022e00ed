"""Texts cut into pieces at blanks, by Arrow, and ids of distinct pieces.

A blank before a non-blank always starts a pre-token of the byte-level pattern, so a text may be cut there:
what follows is a piece, and each distinct piece of a slice of texts is looked at once. A piece of Latin
letters, with ASCII punctuation after them or not, is one pre-token or two (stem and tail); all others are left
to the pattern of the library in use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARACTERS = 16_000_000

_LOOSE_BLANK = r" (?:[\x09-\x0d\x1c-\x20\x{85}\p{Z}]|\z)"
_PIECE_START = re.compile(r" (?=\S)")
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
_SIMPLE = rf"^(?P<stem>[{_LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]*)$"


def strings(values) -> pa.Array:
    return pa.array(values, pa.large_string())


def objects(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def flags(values: pa.Array) -> np.ndarray:
    return objects(values).astype(bool)


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start + size in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_CHARACTERS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) arrays of whole documents, about most bytes of text together (one document may have more)."""
    ids, texts, size = [], [], 0
    for batch in batches:
        doc_id, text = batch.column("doc_id"), batch.column("text").cast(pa.large_string())
        ends = np.cumsum(objects(pc.binary_length(text)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = min(int(np.searchsorted(ends, before + most - size)) + 1, batch.num_rows)
            ids.append(doc_id.slice(at, upto - at))
            texts.append(text.slice(at, upto - at))
            size += int(ends[upto - 1]) - before
            at = upto
            if size >= most:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in turn, without the blank before each, and how many each text has (one at least, maybe empty)."""
    loose = flags(pc.match_substring_regex(texts, _LOOSE_BLANK))
    if not loose.any():
        found = pc.split_pattern(texts, " ")
        return found.values, np.diff(objects(found.offsets))
    plain = pc.split_pattern(texts.filter(pa.array(~loose)), " ")
    odd = [_PIECE_START.split(t) for t in objects(texts.filter(pa.array(loose)))]
    sizes, starts = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    sizes[~loose], sizes[loose] = np.diff(objects(plain.offsets)), [len(o) for o in odd]
    starts[~loose] = objects(plain.offsets)[:-1]
    starts[loose] = len(plain.values) + np.cumsum(sizes[loose]) - sizes[loose]
    values = pa.concat_arrays([plain.values, strings([p for o in odd for p in o])])
    return values.take(pa.array(gathered(starts, sizes))), sizes


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Each text's pieces as numbers, how many each text has, the distinct later pieces, the distinct first pieces.

    Numbers from len(later) on are first pieces, which no blank precedes.
    """
    values, sizes = cut(texts)
    heads = np.cumsum(sizes) - sizes
    found = values.dictionary_encode()
    numbers = objects(found.indices).astype(np.int64)
    first = values.take(pa.array(heads)).dictionary_encode()
    numbers[heads] = len(found.dictionary) + objects(first.indices)
    return numbers, sizes, found.dictionary, first.dictionary


def simple(pieces: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Which pieces are a stem and maybe a tail; their distinct stems and each one's number, the same of tails."""
    found = pc.extract_regex(pieces, _SIMPLE)
    which = flags(found.is_valid())
    found = found.filter(pa.array(which))
    stems, tails = (pc.struct_field(found, k).dictionary_encode() for k in (0, 1))
    return which, stems.dictionary, objects(stems.indices), tails.dictionary, objects(tails.indices)


class Lists:
    """Lists of numbers: how many each has, and all of them in turn."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.sizes, self.flat = sizes.astype(np.int64), flat
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, numbers: np.ndarray) -> Lists:
        sizes = self.sizes[numbers]
        return Lists(sizes, self.flat[gathered(self.starts[numbers], sizes)])

    @staticmethod
    def of(lists: list, dtype=np.uint32) -> Lists:
        return Lists(np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], dtype))

    @staticmethod
    def joined(parts: list[Lists]) -> Lists:
        return Lists(np.concatenate([p.sizes for p in parts]), np.concatenate([p.flat for p in parts]))

    @staticmethod
    def beside(left: Lists, right: Lists) -> Lists:
        """Each list of left with the same list of right after it."""
        sizes = left.sizes + right.sizes
        out = np.empty(int(sizes.sum()), left.flat.dtype)
        starts = np.cumsum(sizes) - sizes
        out[gathered(starts, left.sizes)] = left.flat
        out[gathered(starts + left.sizes, right.sizes)] = right.flat
        return Lists(sizes, out)


class Remembered:
    """Lists of ids of distinct words, each asked for once while it is remembered; at most most words are kept."""

    def __init__(self, ask, most: int):
        self.ask, self.most = ask, most
        self.words, self.lists = strings([]), Lists(np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def ids(self, words: pa.Array) -> Lists:
        """words: distinct."""
        place = pc.index_in(words, self.words)
        missing = words.filter(place.is_null())
        if not len(missing):
            return self.lists.take(objects(place))
        fresh = self.ask(missing)
        place = objects(place.fill_null(-1)).copy()
        place[place < 0] = len(self.words) + np.arange(len(missing))
        together = Lists.joined([self.lists, fresh])
        found = together.take(place)
        if len(together) <= self.most:
            self.words, self.lists = pa.concat_arrays([self.words, missing]), together
        elif len(fresh) <= self.most:
            self.words, self.lists = missing, fresh
        else:
            self.words, self.lists = self.words.slice(0, 0), Lists(np.zeros(0, np.int64), np.zeros(0, np.uint32))
        return found


def split_at(ids: np.ndarray, opens: np.ndarray) -> Lists:
    """Ids of words that all start with their only blank, as lists; opens: whether the token of an id starts with a blank."""
    starts = np.flatnonzero(opens[ids])
    return Lists(np.diff(np.append(starts, len(ids))), ids)
