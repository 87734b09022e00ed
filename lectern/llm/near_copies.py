"""Near copies by SimHash, with an exact check of the Jaccard similarity of word shingles and an exact way for the links SimHash does not reach.

Two documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Each set has a SimHash fingerprint of its shingles. Sets whose fingerprints differ in 3 or fewer bits (simhash.linked) are
compared whole, and those linked are one class. At a similarity of 0.8 fingerprints differ in about 10 bits, so links between classes remain.

No link is missed (prefix filter for the rest): in any one order of all shingles, two sets that are so similar share a
shingle among the first n - ceil(0.8 n) + 1 of each. So each set is put under those shingles, and sets that
meet are compared whole. The order takes shingles that a sample finds common last, so few sets meet for
a common line; it is the same for all sets, and whatever the sample, the links are the same. Sets of one class are not compared again, and where
all that meet are of one class none is read.

Equal sets are folded first. Where sets meet no list of pairs is made: links are walked
(components.linked_sets) and held together by a shallow tree. The sets themselves lie in files in the
shared folder, from which workers read them one by one; a row only says where.

Defined results: a null text is an empty text; texts without words have the empty set and are copies of each
other; fewer than five words give one shingle of all of them. Rows that repeat a doc_id keep their rows; a null
doc_id has a null component. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import components, shared, simhash

SHINGLE = 5
SIMILARITY = 0.8
SAMPLED = 32  # one set in so many is counted for the order
COMMON = 500_000
CACHED_WORDS = 150_000
OPEN_FILES = 64
READ_AT_ONCE = 4096
HELD_HASHES = 2_000_000

_START_BITS, _PART_BITS = 22, 12
_FILE_VALUES = 1 << (_START_BITS - 1)
_ROUNDING = 1e-9
_FACTOR, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SETS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("place", pa.int64()), ("bits", pa.int64())])
_SHINGLES = pa.schema([("shingle", pa.int64())])
_PREFIXES = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("place", pa.int64()), ("class", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class WordHashes(dict):
    """The hash of a word. Bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str, hashes: WordHashes, length: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = shared.lowered_words(text)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    length = min(length, len(codes))
    reach = len(codes) - length + 1 if len(codes) else 0
    mixed = np.full(reach, length, np.uint64)
    for k in range(length):
        mixed = mixed * _FACTOR + codes[k : k + reach]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _STIR
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


class Sets:
    """The sets by their place. Each is read by itself, in whatever store; a bounded number of files stays open."""

    def __init__(self, path: str):
        self.store, self.path = shared.file_system(path)
        self.files: dict[int, pa.NativeFile] = {}

    def at(self, place: int) -> np.ndarray:
        file, start = place >> _START_BITS, 8 * (place & ((1 << _START_BITS) - 1))
        opened = self.files.get(file)
        if opened is None:
            if len(self.files) >= OPEN_FILES:
                self.files.pop(next(iter(self.files))).close()
            opened = self.files[file] = self.store.open_input_file(f"{self.path}/{file}")
        some = opened.read_at(READ_AT_ONCE, start)
        size = int.from_bytes(some[:8], "little")
        if 8 * (size + 1) > len(some):
            some = opened.read_at(8 * (size + 1), start)
        return np.frombuffer(some, np.uint64, size, 8)


def _written_sets(docs: DataFrame, path: str, length: int) -> DataFrame:
    """doc_id, digest, place, bits (the fingerprint) of each row's set; a file has the size of a set before its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, held, size = WordHashes(), 0, [], 0
        attempt = TaskContext.get().taskAttemptId() << _PART_BITS  # a repeated task writes files of its own
        for batch in batches:
            digests, places, prints = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, hashes, length)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                places.append((attempt | part) << _START_BITS | size)
                prints.append(simhash.majority(found))
                held += [np.array([len(found)], np.uint64), found]
                size += len(found) + 1
                if size >= _FILE_VALUES:
                    shared.put_array(f"{path}/{attempt | part}", np.concatenate(held))
                    part, held, size = part + 1, [], 0
            yield shared.batch_of(_SETS, batch.column("doc_id"), digests, places, np.array(prints, np.uint64).view(np.int64))
        if held:
            shared.put_array(f"{path}/{attempt | part}", np.concatenate(held))

    return shared.id_text(docs).mapInArrow(run, "doc_id long, digest binary, place long, bits long")


def _common(nodes: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that a sample of the sets has often, and their rank from the least common on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(path)
        for batch in batches:
            for place in batch.column("place").to_pylist():
                yield shared.batch_of(_SHINGLES, sets.at(place).view(np.int64))

    sample = nodes.where(F.pmod(F.xxhash64("node", "place"), F.lit(SAMPLED)) == 0).select("place")
    counted = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    values = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(values) - np.arange(len(values)))[order]


def prefix(found: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the one order: those not common by hash, then the common by rank."""
    count = len(found) - math.ceil(similarity * len(found) - _ROUNDING) + 1
    if not len(found) or not len(common):
        return found[:count]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    often = common[at] == found
    rare = found[~often][:count]
    if len(rare) == count:
        return rare
    return np.concatenate([rare, found[often][np.argsort(ranks[at[often]])]])[:count]


def _alike(mine: np.ndarray, others: Sequence[np.ndarray], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets, of these sizes, are as similar to mine."""
    close = np.zeros(len(sizes), bool)
    fits = np.flatnonzero((sizes >= similarity * len(mine) - _ROUNDING) & (len(mine) >= similarity * sizes - _ROUNDING))
    for at in range(0, len(fits) if len(mine) else 0, 256):
        some = fits[at : at + 256]
        size = sizes[some]
        found = np.concatenate([others[k] for k in some.tolist()])
        same = mine[np.minimum(np.searchsorted(mine, found), len(mine) - 1)] == found
        both = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64)
        close[some] = both >= similarity * (len(mine) + size - both) - _ROUNDING
    return close


def _linked(values: list[np.ndarray], classes: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Sets of item numbers that links hold together; items of one class are held together already."""
    sizes = np.array([len(v) for v in values])

    def near(item: int, unseen: np.ndarray) -> np.ndarray:
        close = classes[unseen] == classes[item]
        rest = unseen[~close]
        close[~close] = _alike(values[item], _Chosen(values, rest), sizes[rest], similarity)
        return close

    return components.linked_sets(len(values), near)


class _Chosen(Sequence):
    """Some of the values, by their numbers."""

    def __init__(self, values: list[np.ndarray], numbers: np.ndarray):
        self.values, self.numbers = values, numbers

    def __getitem__(self, k: int) -> np.ndarray:
        return self.values[self.numbers[k]]

    def __len__(self) -> int:
        return len(self.numbers)


def _checked(path: str, similarity: float) -> simhash.Alike:
    """The exact check of sets by their places. Sets read are held for the next comparison, in all HELD_HASHES hashes."""
    sets, held, size = Sets(path), {}, 0

    def at(place: int) -> np.ndarray:
        nonlocal size
        found = held.get(place)
        if found is None:
            found = sets.at(place)
            if size + len(found) > HELD_HASHES:
                held.clear()
                size = 0
            held[place] = found
            size += len(found)
        return found

    def alike(place: int, places: np.ndarray) -> np.ndarray:
        mine, close = at(place), np.zeros(len(places), bool)
        for first in range(0, len(places), 256):
            others = [at(p) for p in places[first : first + 256].tolist()]
            close[first : first + 256] = _alike(mine, others, np.array([len(o) for o in others]), similarity)
        return close

    return alike


def near_duplicates(docs: DataFrame, path: str, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, component_id for every row of docs; path: a new folder in the shared folder."""
    spark = docs.sparkSession
    files, n = f"{path}/sets", shared.shuffle_partitions(spark)
    rows = shared.settled(_written_sets(docs, files, shingle), f"{path}/rows")
    nodes = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("place").alias("place"), F.first("bits").alias("bits"))
    nodes = shared.settled(nodes, f"{path}/nodes")
    found = simhash.linked(nodes.select("bits", F.col("place").alias("node")), f"{path}/simhash", check=lambda: _checked(files, similarity))
    known = nodes.join(found.select(F.col("node").alias("place"), "component"), "place", "left").select("node", "place", F.coalesce("component", "place").alias("class"))
    held = spark.sparkContext.broadcast(_common(nodes, files))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(files)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [prefix(sets.at(p), *held.value, similarity) for p in part.column("place").to_pylist()]
                sizes = [len(f) for f in found]
                yield shared.batch_of(_PREFIXES, np.concatenate(found).view(np.int64), *(np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "place", "class")))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, done = Sets(files), set()
        for table in shared.sorted_runs(batches, "shingle"):
            key, node, place, known_as = (table[c].to_numpy() for c in ("shingle", "node", "place", "class"))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            edges = []
            for start, size in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
                order = start + np.argsort(place[start : start + size])
                met = xxhash.xxh3_128_digest(place[order].tobytes())
                if met in done:
                    continue
                if len(done) >= CACHED_WORDS:
                    done.clear()
                done.add(met)
                classes = known_as[order]
                if (classes == classes[0]).all():
                    edges.append(components.forest(node[order]))
                    continue
                edges += [components.forest(node[order][group]) for group in _linked([sets.at(p) for p in place[order].tolist()], classes, similarity)]
            if edges:
                yield shared.batch_of(_EDGES, *map(np.concatenate, zip(*edges, strict=True)))

    spread = known.repartition(n, "node").sortWithinPartitions("place")
    placed = spread.mapInArrow(prefixes, "shingle long, node long, place long, class long").repartition(n, "shingle").sortWithinPartitions("shingle")
    found = components.connected_components(placed.mapInArrow(links, "a long, b long"), f"{path}/components")
    classes = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    classes = shared.settled(classes, f"{path}/classes")
    return rows.join(classes, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def kept_one_each(docs: DataFrame, path: str, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group, as simhash.kept_one_each."""
    return simhash.leaders_of(docs, near_duplicates(docs, path, similarity, shingle))
