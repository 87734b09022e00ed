"""A full-text index that is kept in a folder and changed by what changed.

A segment is a table of posting blocks: for a word and a span of SPAN ids one row with the ids that hold it (as offsets in the span), how often and
how long the hits are, and the largest of both, from which follows the best score that an id of the block can have. Blocks are written in
ranges of word and span, so a word's blocks lie together. Beside them stands what the segment says of ids: book and pages, or that an id is gone.

A change is a new segment of the changed ids alone; older segments are not touched. What an older segment says of an id counts only while no newer one names
it. A version lists the segments in order; it is written last, so a write that fails leaves the index as it was. Segments of like size are merged, so
there are few, each row is rewritten a logarithmic number of times, and a change of one part in a hundred writes about that part.
One writer at a time; readers see the version that was the newest when they began.

The best k are found with an early end: the spans with the best sums of block bounds are scored first, their k-th best score is a threshold, and of all
other spans only those whose bound reaches it are unpacked. Scores are those of retrieval.text_search.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import retrieval
from lectern.sources import library
from lectern.sources.scratch import names_below, removed, settled

SPAN = 512
AT_ONCE = 200  # texts that a task cuts into words together
SEEDS = 16
MERGE = 4  # a segment joins the newer ones once they come to a MERGE-th of it
STEM = retrieval.PREFIX_FROM
WRITTEN = 5  # a hit is written as 0, the term's number, offset and size, with three blanks and one before the next hit

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PLAIN_WORD = re.compile(r"[0-9A-Za-z]+")  # the same in ASCII
_POSTINGS = pa.schema([("term", pa.string()), ("id", pa.int64()), ("count", pa.int32()), ("digits", pa.int32())])
_BLOCKS = "term string, span long, n int, most_count int, most_digits int, offsets array<int>, counts array<int>, digits array<int>"
_CHUNKS = "id long, book_id string, start_page int, end_page int, gone boolean"
_VERSION = "place int, segment string, ids long, ticket string"


def _lengths(text: str) -> np.ndarray:
    """Where each character begins in UTF-8, and the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])


def _digits(numbers: np.ndarray) -> np.ndarray:
    return np.searchsorted(10 ** np.arange(1, 19), numbers, "right") + 1


def postings(chunks: DataFrame) -> DataFrame:
    """term, id, count, digits: how often each word of a chunk (id, text) stands there, case and accents aside, and how many digits its places and sizes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            words, owner, digits = [], [], []
            for k, (text, folded) in enumerate(zip(batch.column("text").to_pylist(), batch.column("folded").to_pylist(), strict=True)):
                found = [m.span() for m in (_PLAIN_WORD if folded.isascii() else _WORD).finditer(folded)]
                if not found:
                    continue
                words.extend(folded[a:b] for a, b in found)
                owner.append(np.full(len(found), k))
                places = np.minimum(np.array(found), len(text))
                begins = _lengths(text)[places]
                digits.append(_digits(begins[:, 0]) + _digits(begins[:, 1] - begins[:, 0]))
            if not words:
                continue
            coded = pa.array(words, pa.string()).dictionary_encode()
            keys = coded.indices.to_numpy().astype(np.int64) * AT_ONCE + np.concatenate(owner)  # a word's rows together, which packs well
            used, at = np.unique(keys, return_inverse=True)
            ids = batch.column("id").to_numpy()[used % AT_ONCE]
            terms = coded.dictionary.take(pa.array(used // AT_ONCE))
            yield pa.RecordBatch.from_arrays([terms, pa.array(ids), pa.array(np.bincount(at), pa.int32()), pa.array(np.bincount(at, np.concatenate(digits)).astype(np.int32))], schema=_POSTINGS)

    whole = chunks.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("folded", library.fold(F.col("text")))
    return whole.mapInArrow(run, "term string, id long, count int, digits int")


def packed(found: DataFrame) -> DataFrame:
    """Posting blocks of postings (term, id, count, digits)."""
    rows = found.select("term", F.floor(F.col("id") / SPAN).alias("span"), F.pmod("id", F.lit(SPAN)).cast("int").alias("offset"), "count", "digits")
    return rows.repartitionByRange("term", "span").sortWithinPartitions("term", "span", "offset").mapInArrow(_in_blocks, _BLOCKS)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted postings, in their order. What is held over is one block, at most SPAN rows."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not rows.num_rows:
            continue
        term, span = rows["term"].combine_chunks(), rows["span"].to_numpy()
        new = (span[1:] != span[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(starts) > 1:
            yield _blocks_of(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1])
    if held is not None:
        yield _blocks_of(held, np.zeros(1, np.int64))


def _blocks_of(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    bounds = pa.array(np.append(starts, rows.num_rows), pa.int32())
    counts, digits = rows["count"].to_numpy(), rows["digits"].to_numpy()
    lists = [pa.ListArray.from_arrays(bounds, pa.array(rows[c].to_numpy(), pa.int32())) for c in ("offset", "count", "digits")]
    most = [pa.array(np.maximum.reduceat(some, starts), pa.int32()) for some in (counts, digits)]
    at = pa.array(starts)
    columns = [rows["term"].combine_chunks().take(at), pa.array(rows["span"].to_numpy()[starts]), pa.array(np.diff(np.append(starts, rows.num_rows)), pa.int32()), *most, *lists]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCKS.split(", ")])


def unpacked(blocks: DataFrame, *kept: str) -> DataFrame:
    """id, count, digits and the kept columns, a row a posting."""
    rows = blocks.select(*kept, "span", F.inline(F.arrays_zip("offsets", "counts", F.col("digits").alias("sizes"))))
    return rows.select(*kept, (F.col("span") * SPAN + F.col("offsets")).alias("id"), F.col("counts").alias("count"), F.col("sizes").alias("digits"))


@dataclass(frozen=True)
class Segment:
    name: str
    ids: int
    ticket: str | None


class Store:
    """The index in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Versions and segments ------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        """Numbers of the complete versions, the newest last."""
        return sorted(int(n) for n in names_below(self.spark, f"{self.path}/versions") if "_SUCCESS" in names_below(self.spark, f"{self.path}/versions/{n}"))

    def segments(self) -> list[Segment]:
        """The segments of the newest version, the oldest first."""
        versions = self._versions()
        if not versions:
            return []
        rows = self.spark.read.schema(_VERSION).parquet(f"{self.path}/versions/{versions[-1]:09d}").orderBy("place").collect()  # a row a segment
        return [Segment(r.segment, r.ids, r.ticket) for r in rows]

    def _commit(self, segments: list[Segment]) -> None:
        tried = [int(n) for n in names_below(self.spark, f"{self.path}/versions")]
        rows = [(k, s.name, s.ids, s.ticket) for k, s in enumerate(segments)]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.parquet(f"{self.path}/versions/{max(tried, default=0) + 1:09d}")

    def _blocks(self, segments: list[Segment]) -> DataFrame:
        """segment (its place) and the columns of its blocks."""
        some = [self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/segments/{s.name}/blocks").select(F.lit(k).alias("segment"), "*") for k, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, some)

    def _chunks(self, segments: list[Segment], first: int = 0) -> DataFrame:
        some = [self.spark.read.schema(_CHUNKS).parquet(f"{self.path}/segments/{s.name}/chunks").select(F.lit(k).alias("segment"), "*") for k, s in enumerate(segments) if k >= first]
        return reduce(DataFrame.unionByName, some)

    def _live(self, found: DataFrame, segments: list[Segment]) -> DataFrame:
        """found (segment, id, ...) without what a newer segment says otherwise. Only ids of the newer, smaller segments are looked at."""
        if len(segments) == 1:
            return found
        newest = self._chunks(segments, 1).groupBy("id").agg(F.max("segment").alias("_newest"))
        return found.join(newest, "id", "left").where(F.coalesce("_newest", F.lit(0)) == F.col("segment")).drop("_newest")

    def _write(self, chunks: DataFrame, gone: DataFrame | None, ticket: str | None, texts: DataFrame | None = None) -> Segment:
        name = uuid.uuid4().hex[:12]
        folder = f"{self.path}/segments/{name}"
        said = chunks.select(F.col("id").cast("long").alias("id"), F.col("book_id").cast("string").alias("book_id"), *[F.col(c).cast("int").alias(c) for c in ("start_page", "end_page")], F.lit(False).alias("gone"))
        if gone is not None:
            none = [F.lit(None).cast(kind).alias(c) for c, kind in (("book_id", "string"), ("start_page", "int"), ("end_page", "int"))]
            dropped = gone.select(F.col("id").cast("long").alias("id")).distinct().join(said.select("id"), "id", "left_anti")
            said = said.unionByName(dropped.select("id", *none, F.lit(True).alias("gone")))
        ids = settled(said, f"{folder}/chunks").count()
        raw = settled(postings(chunks if texts is None else texts), f"{folder}/raw")  # cut into words once, although ranges are sampled
        packed(raw).write.parquet(f"{folder}/blocks")
        removed(self.spark, f"{folder}/raw")
        return Segment(name, ids, ticket)

    # Changes --------------------------------------------------------------------------------------

    def build(self, chunks: DataFrame, texts: DataFrame | None = None) -> Store:
        """A new index of chunks (id, book_id, start_page, end_page, text; one row an id), in place of what was there.

        texts (id, text, of the same ids): where the texts are, if pages are counted beside them and texts need not travel for that.
        """
        self._commit([self._write(chunks, None, None, texts)])
        return self

    def change(self, chunks: DataFrame, gone: DataFrame | None = None, ticket: str | None = None, texts: DataFrame | None = None) -> Store:
        """Chunks put in or changed, and ids (id) that go; texts as in build. A change whose ticket the index has already is left out, so it can be repeated."""
        before = self.segments()
        if ticket is not None and any(s.ticket == ticket for s in before):
            return self
        self._commit([*before, self._write(chunks, gone, ticket, texts)])
        self.merge()
        return self

    def merge(self, whole: bool = False) -> None:
        """Merges the newest segments with those that they come to a MERGE-th of (or all of them). The replaced ones stay for readers until swept."""
        before = self.segments()
        first, total = len(before) - 1, before[-1].ids if before else 0
        while first > 0 and (whole or total * MERGE >= before[first - 1].ids):
            first -= 1
            total += before[first].ids
        run = before[first:]
        if len(run) < 2:
            return
        name = uuid.uuid4().hex[:12]
        folder = f"{self.path}/segments/{name}"
        said = self._live(self._chunks(run), run)
        ids = settled((said.where("NOT gone") if first == 0 else said).select(*[c.split()[0] for c in _CHUNKS.split(", ")]), f"{folder}/chunks").count()
        packed(self._live(unpacked(self._blocks(run), "segment", "term"), run)).write.parquet(f"{folder}/blocks")
        self._commit([*before[:first], Segment(name, ids, before[-1].ticket)])

    def sweep(self) -> int:
        """Removes segments that the newest version does not list and older versions; returns how many segments went."""
        kept = {s.name for s in self.segments()}
        newest = self._versions()[-1:]
        for n in names_below(self.spark, f"{self.path}/versions"):
            if int(n) not in newest:
                removed(self.spark, f"{self.path}/versions/{n}")
        gone = [n for n in names_below(self.spark, f"{self.path}/segments") if n not in kept]
        for n in gone:
            removed(self.spark, f"{self.path}/segments/{n}")
        return len(gone)

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function for changes (id, book_id, start_page, end_page, text, seq, deleted): of an id the row of the greatest seq counts.

        A batch that runs again after a restart changes nothing: its number is the segment's ticket.
        """

        def write(batch: DataFrame, number: int) -> None:
            last = batch.groupBy("id").agg(F.max_by(F.struct("book_id", "start_page", "end_page", "text", "deleted"), "seq").alias("c")).select("id", "c.*")
            held = settled(last, f"{self.path}/incoming/{stream}-{number}")
            if held.isEmpty():
                return
            self.change(held.where("NOT deleted"), held.where("deleted").select("id"), ticket=f"{stream}-{number}")
            removed(self.spark, f"{self.path}/incoming/{stream}-{number}")

        return write

    # Search ---------------------------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        """id, book_id, start_page, end_page of what the index holds."""
        segments = self.segments()
        return self._live(self._chunks(segments), segments).where("NOT gone").select("id", "book_id", "start_page", "end_page")

    def _matched(self, terms: list[str], segments: list[Segment]) -> DataFrame:
        """Blocks of the words that a term matches, a row a block and number of a term."""
        blocks = self._blocks(segments)
        match = [_matches(t) for t in terms]
        numbers = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in enumerate(match)]))
        return blocks.where(reduce(or_, match)).withColumn("number", F.explode(numbers))

    def search(self, terms: list[str]) -> DataFrame:
        """id, book_id, start_page, end_page, score of every chunk that a term matches."""
        segments = self.segments()
        if not terms or not segments:
            return self.spark.createDataFrame([], "id long, book_id string, start_page int, end_page int, score double")
        return self._placed(self._scored(self._matched(terms, segments), segments), segments)

    def _scored(self, matched: DataFrame, segments: list[Segment], *keys: str) -> DataFrame:
        live = self._live(unpacked(matched, *keys, "segment", "number"), segments)
        length = F.sum(F.col("digits") + F.col("count") * (F.length(F.col("number").cast("string")) + WRITTEN)) - 1
        return live.groupBy(*keys, "segment", "id").agg((-length).cast("double").alias("score"))

    def _placed(self, scored: DataFrame, segments: list[Segment], *keys: str) -> DataFrame:
        return scored.join(self._chunks(segments).where("NOT gone"), ["segment", "id"]).select(*keys, "id", "book_id", "start_page", "end_page", "score")

    def top(self, terms: list[str], k: int = retrieval.TOP, where: Column | None = None) -> DataFrame:
        """id, score, pos (from 0) of the k best, ties by id; where: which chunks may be found, by book_id, start_page and end_page."""
        segments = self.segments()
        if not terms or not segments:
            return retrieval.top(self.search([]), k, ascending=True)
        matched = self._matched(terms, segments)
        reached = self.reached(matched, segments, k, where)
        return retrieval.top(self._within(reached, segments, where), k, ascending=True)

    def _within(self, blocks: DataFrame, segments: list[Segment], where: Column | None, *keys: str) -> DataFrame:
        found = self._placed(self._scored(blocks, segments, *keys), segments, *keys)
        return found if where is None else found.where(where)

    def reached(self, matched: DataFrame, segments: list[Segment], k: int, where: Column | None = None) -> DataFrame:
        """The matched blocks of the spans that can hold one of the k best."""
        bounds = matched.groupBy("span").agg(F.sum(_bound()).alias("bound"))
        seeds = [r.span for r in bounds.orderBy(F.desc("bound"), "span").limit(SEEDS).collect()]  # SEEDS numbers
        first = self._within(matched.where(F.col("span").isin(seeds)), segments, where).orderBy("score", "id").limit(k).agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
        if first["n"] < k:
            return matched
        near = bounds.where(F.col("bound") - 1 >= -first["worst"])
        low, high = near.agg(F.min("span"), F.max("span")).first()
        return matched.where(F.col("span").between(low, high)).join(near.select("span"), "span", "left_semi")

    def top_many(self, asked: DataFrame, path: str, k: int = retrieval.TOP) -> DataFrame:
        """question, id, score, pos of the k best of every question. asked: question, number, term (* at the end: its beginnings); path: a new folder.

        The same early end, question by question, in joins: no value of a question or the index goes through the driver.
        """
        segments = self.segments()
        if not segments:
            return asked.limit(0).select("question", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("pos"))
        blocks = self._blocks(segments)
        told = asked.select("question", "number", library.fold(F.regexp_replace("term", r"\*+$", "")).alias("said"), F.endswith("term", F.lit("*")).alias("open"))
        vocabulary = blocks.select("term").distinct()
        by_stem = told.withColumn("stem", F.left("said", F.lit(STEM))).join(vocabulary.withColumn("stem", F.left("term", F.lit(STEM))), "stem")
        wanted = settled(by_stem.where((F.col("term") == F.col("said")) | (F.col("open") & F.startswith("term", "said"))).select("question", "number", "term"), f"{path}/wanted")
        asked_for = settled(blocks.join(wanted.select("term").distinct(), "term", "left_semi"), f"{path}/blocks")  # read again for the bounds and both scores
        matched = asked_for.join(wanted, "term")
        bounds = settled(matched.groupBy("question", "span").agg(F.sum(_bound()).alias("bound")), f"{path}/bounds")
        best = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("bound"), "span"))
        seeds = bounds.withColumn("turn", best).where(F.col("turn") <= SEEDS).select("question", "span")
        some = self._scored(matched.join(seeds, ["question", "span"], "left_semi"), segments, "question")
        turn = F.row_number().over(Window.partitionBy("question").orderBy("score", "id"))
        least = some.withColumn("turn", turn).where(F.col("turn") == k).select("question", F.col("score").alias("least"))
        near = bounds.join(least, "question", "left").where(F.col("least").isNull() | (F.col("bound") - 1 >= -F.col("least"))).select("question", "span")
        scored = self._scored(matched.join(settled(near, f"{path}/near"), ["question", "span"], "left_semi"), segments, "question")
        return scored.withColumn("pos", turn - 1).where(F.col("pos") < k).select("question", "id", "score", "pos")


def _matches(term: str) -> Column:
    folded = retrieval._folded_term(term)
    return F.startswith("term", F.lit(folded)) if term.endswith("*") else F.col("term") == folded


def _bound() -> Column:
    """The longest list of hits that an id of a block can have for a term."""
    return F.col("most_digits") + F.col("most_count") * (F.length(F.col("number").cast("string")) + WRITTEN)


def kept(chunks: DataFrame, path: str, texts: DataFrame | None = None) -> Store:
    """The index of chunks at path, built only if it is not there; texts as in Store.build."""
    store = Store(chunks.sparkSession, path)
    return store if store.segments() else store.build(chunks, texts)
