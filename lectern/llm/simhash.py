"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where more than half of the document's shingle hashes have it. Two
fingerprints at 3 or fewer differing bits differ by at most one bit in one of their two 32-bit halves
(2 + 2 is already 4). So every distinct fingerprint goes into two tables by its exact halves, and asks
each table for the small Hamming ball around its half: the half itself and all halves at one bit. Of
two halves at one bit, one has a 0 there, so asking only with 0 turned into 1 meets each pair. Table
matches are verified over all 64 bits.

Copies share one fingerprint and are folded before any of this, so groups of copies cost one row. Within
a table entry no list of pairs is made: links are walked (components.linked_sets) and held together by
a shallow tree.

Two fingerprints of one entry have at most 3 differing bits in the other half, which has 4 bytes, so in one of these
bytes they are equal. So an entry may be taken apart by (byte, its value) without losing a link. This is done in the
plan for the entries of a half that HOT_HALF fingerprints or more share and of the halves at one bit from it (each
part is a key of its own, so the entry is dealt over up to 1,024 of them), and within a task for entries of more
than LARGE_ENTRY rows, so that these are not compared all against all. The links are the same either way.

Defined results: a null text is an empty text; a text without words has fingerprint zero and is linked
like any other; fewer than three words give one shingle of all of them. Rows that repeat a doc_id keep
their rows; a null doc_id has a null component. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import components, shared

SEED = 42
SHINGLE = 3
RADIUS = 3
LARGE_ENTRY = 512
HOT_HALF = 20_000

Alike = Callable[[int, np.ndarray], np.ndarray]  # of a node and others near it, which of these are linked to it

_HALF = np.uint64(0xFFFFFFFF)
_PRINTS = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])
_ENTRIES = pa.schema([("entry", pa.int64()), ("bits", pa.int64()), ("node", pa.int64()), ("asks", pa.bool_())])
_KEYS = pa.schema([("entry", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = shared.lowered_words(text)
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = list(accumulate((len(w) + 1 for w in words)))
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *ends[: len(words) - shingle]], [e - 1 for e in ends[shingle - 1 :]], strict=True)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned hashes: a bit is set where more than half of them have it."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, bits: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield shared.batch_of(_PRINTS, batch.column("doc_id"), bits)

    return shared.id_text(docs).mapInArrow(run, "doc_id long, bits long")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint: its place in both tables, and the places at one more set bit that it asks for."""
    one = np.uint64(1) << np.arange(32, dtype=np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            bits = part.column("bits").to_numpy().view(np.uint64)
            nodes = part.column("node").to_numpy()
            for table, half in ((0, bits & _HALF), (1, bits >> np.uint64(32))):
                row, bit = np.nonzero((half[:, None] & one) == 0)
                keys = np.concatenate([half, half[row] | one[bit]]) | np.uint64(table << 32)
                who = np.concatenate([np.arange(len(bits)), row])
                asks = np.arange(len(who)) >= len(bits)
                yield shared.batch_of(_ENTRIES, keys.view(np.int64), bits[who].view(np.int64), nodes[who], asks)


def _halves(distinct: DataFrame) -> DataFrame:
    """entry: the exact entries of all fingerprints."""
    low, high = F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("bits", 32)
    return distinct.select(F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("entry"))


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries and those at one bit."""
    one = np.concatenate([[0], np.int64(1) << np.arange(32, dtype=np.int64)])
    for batch in batches:
        yield shared.batch_of(_KEYS, (batch.column("entry").to_numpy()[:, None] ^ one).ravel())


def _spread(entries: DataFrame, distinct: DataFrame, hot_half: int, path: str) -> DataFrame:
    """entries with key: the entry and, for hot ones, a byte of the other half and its value (one row for each of the four bytes)."""
    hot = _halves(distinct).groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= hot_half).select("entry")
    hot = shared.settled(hot.mapInArrow(_around, "entry long").distinct(), f"{path}/hot").withColumn("hot", F.lit(True))  # its size decides how it is joined
    other = F.when(F.col("entry") < F.lit(1 << 32), F.shiftrightunsigned("bits", 32)).otherwise(F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)))
    parts = F.array(*[F.shiftrightunsigned(other, 8 * byte).bitwiseAND(F.lit(255)) + (1 + 256 * byte) for byte in range(4)])
    part = F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(0).cast("long"))))
    return entries.join(hot, "entry", "left").select("bits", "node", "asks", "entry", part.alias("part")).select((F.shiftleft("entry", 11) + F.col("part")).alias("entry"), "bits", "node", "asks")


def _entry_links(bits: np.ndarray, asks: np.ndarray, nodes: np.ndarray | None = None, alike: Alike | None = None) -> list[np.ndarray]:
    """Sets of rows of one table entry that links hold together. Two that only ask are not compared: their own entries do that."""

    def near(item: int, unseen: np.ndarray) -> np.ndarray:
        close = np.bitwise_count(bits[unseen] ^ bits[item]) <= RADIUS
        if asks[item]:
            close &= ~asks[unseen]
        if alike is not None and close.any():
            close[close] = alike(int(nodes[item]), nodes[unseen[close]])
        return close

    return components.linked_sets(len(bits), near)


def _links(batches: Iterator[pa.RecordBatch], check: Callable[[], Alike] | None = None) -> Iterator[pa.RecordBatch]:
    alike = check() if check else None
    for table in shared.sorted_runs(batches, "entry"):
        entry = table["entry"].to_numpy()
        bits = table["bits"].to_numpy().view(np.uint64)
        nodes, asks = table["node"].to_numpy(), table["asks"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        sizes = np.diff(np.append(starts, len(entry)))
        held = np.add.reduceat(~asks, starts)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for start, size in zip(starts[(sizes > 1) & (held > 0)], sizes[(sizes > 1) & (held > 0)], strict=True):
            b, n, k = bits[start : start + size], nodes[start : start + size], asks[start : start + size]
            for some in _split(b, size, int(entry[start]) >> 43):
                edges += [components.forest(n[some][group]) for group in _entry_links(b[some], k[some], n[some], alike)]
        if edges:
            yield shared.batch_of(_EDGES, *map(np.concatenate, zip(*edges, strict=True)))


def _split(bits: np.ndarray, size: int, table: int) -> Iterator[np.ndarray]:
    """Row numbers to compare with each other: all of a small entry; of a large one those equal in a byte of the other half."""
    if size <= LARGE_ENTRY:
        yield np.arange(size)
        return
    other = bits >> np.uint64(32) if table == 0 else bits & _HALF
    for byte in range(4):
        value = (other >> np.uint64(8 * byte)) & np.uint64(255)
        order = np.argsort(value, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(some) > 1:
                yield some


def linked(distinct: DataFrame, path: str, hot_half: int = HOT_HALF, check: Callable[[], Alike] | None = None) -> DataFrame:
    """node, component of every fingerprint (bits, node; one row a node) that is linked. check: called in a task, gives the exact check that follows; else near ones are linked."""
    n = shared.shuffle_partitions(distinct.sparkSession)
    entries = distinct.select("bits", "node").repartition(n, "node").mapInArrow(_entries, "entry long, bits long, node long, asks boolean")
    placed = _spread(entries, distinct, hot_half, path).repartition(n, "entry").sortWithinPartitions("entry")
    return components.connected_components(placed.mapInArrow(lambda batches: _links(batches, check), "a long, b long"), f"{path}/components")


def near_duplicates(docs: DataFrame, path: str, shingle: int = SHINGLE, hot_half: int = HOT_HALF) -> DataFrame:
    """doc_id, bits, component_id for every row of docs; path: a new folder in the shared folder."""
    prints = shared.settled(fingerprints(docs, shingle), f"{path}/prints")
    distinct = prints.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("node"))
    distinct = shared.settled(distinct, f"{path}/distinct")
    found = linked(distinct, path, hot_half)
    classes = distinct.join(found, distinct.node == found.node, "left").select("bits", F.coalesce("component", distinct.node).alias("component_id"))
    classes = shared.settled(classes, f"{path}/classes")
    return prints.join(classes, "bits", "left").select("doc_id", "bits", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def kept_one_each(docs: DataFrame, path: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group: that of its least doc_id. Of rows that share it the least by the other columns stays; rows without doc_id stay."""
    return leaders_of(docs, near_duplicates(docs, path, shingle))


def leaders_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of docs what kept_one_each keeps; found: doc_id, component_id."""
    leaders = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(leaders, "doc_id", "left_semi")
    others = [c for c in docs.columns if c.lower() != "doc_id"]
    least = named.groupBy("doc_id").agg(F.min(F.struct(F.lit(0), *others)).alias("row"))  # partly done before the shuffle, so a repeated id is no hot task
    alone = least.select(*[F.col("doc_id") if c not in others else F.col("row").getField(c) for c in docs.columns])
    return alone.toDF(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
