"""Token-ID / binary output: documents as Parquet files of token ids, for selective reads.

Layout: files in ascending doc_id order, one list<int32> per document. The ids are dictionary coded
(a vocabulary fits one dictionary page), doc_id and n_tokens are delta coded; row groups close at
row_group_tokens tokens, at ROW_GROUP_DOCS documents or where a slice of texts that is encoded at once ends
(pieces.SLICE_CHARACTERS), and every file carries a page index. A reader of doc_id and n_tokens never
touches the ids' pages.

Defined results: a null text is an empty text, and an empty text has the end id alone. Rows with the
same doc_id (or none; they come first) are ordered by text. An empty table gives no file and no rows.
Very long texts are one row each; a row group holds at least one document. Other columns are ignored.

Ids are those of the tokenizers library for the whole text. Strings of added tokens in a text (<|endoftext|>)
are text like any other by default, so that no text can write an end of document; with added_as_text=False they
are the added tokens, as in the library's plain call. A blank that precedes a non-blank always starts a pre-token of the
byte-level pattern, so a text is cut there (pieces), each distinct piece of a slice is encoded by the library
once, and stems are remembered by the worker, in a table of bounded size.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import pieces, shared

ROW_GROUP_DOCS = 8192
CACHED_PIECES = 1_000_000
BATCH_PIECES = 4096
RANGE_CHARACTERS = 64

FILE_SCHEMA = pa.schema([pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int32()), pa.field("ids", pa.list_(pa.int32()))])
MANIFEST = "part int, file string, n_docs long, n_tokens long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself if visible in Latin-1, else from U+0100 on."""
    hidden = iter(range(256, 512))
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}


class PieceEncoder:
    """Texts to ids, with the library asked once for each distinct piece.

    A text that holds the string of an added token goes to the library whole, unless such strings are to be
    text like any other (added_as_text).
    """

    def __init__(self, tokenizer_path: str, added_as_text: bool = True, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait for each other only burn it
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.whole.encode_special_tokens = added_as_text
        self.added = [] if added_as_text else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.single = Tokenizer.from_file(tokenizer_path)  # for words that are one pre-token, spelled in byte letters
        self.single.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = byte_letters()
        blank = self.letters[0x20]
        self.opens = np.zeros(self.whole.get_vocab_size(), bool)
        for token, number in self.whole.get_vocab().items():
            self.opens[number] = token.startswith(blank)
        self.blank = blank
        self.stems = pieces.Remembered(self._stems, cached)

    def _ids(self, texts: list[str]) -> pieces.Lists:
        return pieces.Lists.of([e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)])

    def _stems(self, words: pa.Array) -> pieces.Lists:
        letters, blank = self.letters, self.blank
        spelled = [blank + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)) for w in pieces.objects(words)]
        some = [spelled[at : at + BATCH_PIECES] for at in range(0, len(spelled), BATCH_PIECES)]
        ids = [np.array(e.ids, np.uint32) for e in self.single.encode_batch_fast(some, is_pretokenized=True, add_special_tokens=False)]
        return pieces.split_at(np.concatenate(ids), self.opens) if ids else pieces.Lists.of([])

    def _later(self, found: pa.Array) -> pieces.Lists:
        """Ids of distinct pieces that a blank precedes."""
        which, stems, stem_of, tails, tail_of = pieces.simple(found)
        tail_ids = self._ids(pieces.objects(tails).tolist())
        simple = pieces.Lists.beside(self.stems.ids(stems).take(stem_of), tail_ids.take(tail_of))
        left = found.filter(pa.array(~which))
        blank = pieces.flags(pc.or_(pc.match_substring(left, " "), pc.equal(left, "")))
        whole = self._ids([f" {p}" if p else "" for p in pieces.objects(left.filter(pa.array(blank)))])
        other = self._joined(pieces.objects(left.filter(pa.array(~blank))).tolist())
        place = np.empty(len(found), np.int64)
        place[which] = np.arange(len(simple))
        place[~which] = len(simple) + np.where(blank, np.cumsum(blank) - 1, len(whole) + np.cumsum(~blank) - 1)
        return pieces.Lists.joined([simple, whole, other]).take(place)

    def _joined(self, found: list[str]) -> pieces.Lists:
        """Ids of pieces without blanks, encoded some at a time with a blank before each."""
        some = [" " + " ".join(found[at : at + BATCH_PIECES]) for at in range(0, len(found), BATCH_PIECES)]
        ids = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
        return pieces.split_at(np.concatenate(ids), self.opens) if ids else pieces.Lists.of([])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = self.lists(pieces.strings(texts))
        for start, size in zip(found.starts.tolist(), found.sizes.tolist(), strict=True):
            yield found.flat[start : start + size].astype("<u4").tobytes()

    def lists(self, texts: pa.Array) -> pieces.Lists:
        """The ids of each text of a slice."""
        if self.added:
            held = pieces.flags(pc.match_substring_regex(texts, "|".join(re.escape(t) for t in self.added)))
            if held.any():
                plain = self._encode(texts.filter(pa.array(~held))) if not held.all() else pieces.Lists.of([])
                whole = self._ids(pieces.objects(texts.filter(pa.array(held))).tolist())
                return pieces.Lists.joined([plain, whole]).take(np.where(held, len(plain) + np.cumsum(held) - 1, np.cumsum(~held) - 1))
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> pieces.Lists:
        numbers, sizes, later, first = pieces.coded(texts)
        ids = pieces.Lists.joined([self._later(later), self._ids(pieces.objects(first).tolist())]).take(numbers)
        ends = np.concatenate([[0], np.cumsum(ids.sizes)])
        last = np.cumsum(sizes)
        return pieces.Lists(ends[last] - ends[last - sizes], ids.flat)


@functools.lru_cache(maxsize=2)
def piece_encoder(tokenizer_path: str, added_as_text: bool) -> PieceEncoder:
    return PieceEncoder(tokenizer_path, added_as_text)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, row_group_tokens: int = 2_000_000, partitions: int | None = None, added_as_text: bool = True
) -> DataFrame:
    """Encodes docs (doc_id, text) into files below folder, a URI that all machines share; returns the manifest.

    The only shuffle deals the texts out by ranges of doc_id. The manifest (a row per file, as many as
    partitions) is what the driver sees.
    """
    spark = docs.sparkSession
    n = partitions or shared.shuffle_partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_path, added_as_text)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.parquet"
        total = [0, 0]

        def groups() -> Iterator[pa.Table]:
            for doc_ids, texts in pieces.slices(batches):
                ids = encoder.lists(texts)
                counts = ids.sizes + 1
                ends = np.cumsum(counts)
                flat = np.full(int(ends[-1]), end_id, np.int32)
                flat[pieces.gathered(ends - counts, ids.sizes)] = ids.flat
                first = 0
                while first < len(counts):
                    before = int(ends[first - 1]) if first else 0
                    last = min(int(np.searchsorted(ends, before + row_group_tokens)) + 1, first + ROW_GROUP_DOCS, len(counts))
                    yield group(doc_ids.slice(first, last - first), counts[first:last], flat[before : ends[last - 1]])
                    first = last

        def group(doc_ids: pa.Array, counts: np.ndarray, flat: np.ndarray) -> pa.Table:
            total[0] += len(counts)
            total[1] += len(flat)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return pa.Table.from_arrays([doc_ids, pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=FILE_SCHEMA)

        tables = groups()
        first = next(tables, None)
        if first is None:
            return

        def into(stream) -> None:
            with pq.ParquetWriter(
                stream, FILE_SCHEMA, compression="zstd", use_dictionary=["ids.list.element"], column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"},
                write_page_index=True, data_page_size=1 << 18, store_schema=False, version="2.6",
            ) as out:
                out.write_table(first, row_group_size=ROW_GROUP_DOCS)
                for table in tables:
                    out.write_table(table, row_group_size=ROW_GROUP_DOCS)

        shared.put_file(f"{folder}/{name}", into)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [total[0]], "n_tokens": [total[1]]})

    opening = F.left("text", F.lit(RANGE_CHARACTERS))  # deals the rows of a repeated doc_id over ranges too, in the order of their texts
    ordered = shared.id_text(docs).repartitionByRange(n, "doc_id", opening).sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(write, MANIFEST).collect()  # a row per file
    return spark.createDataFrame(sorted(rows), MANIFEST)


def read_token_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Row groups are read one at a time."""
    spark = manifest.sparkSession
    files, start = [], 0
    for row in manifest.orderBy("part").collect():  # a row per file
        files.append((row.file, start))
        start += row.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, path = shared.file_system(uri)
                with store.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    for k in range(file.num_row_groups):
                        group = file.read_row_group(k).combine_chunks()
                        counts = group["n_tokens"].to_numpy().astype(np.int64)
                        ids = group["ids"].chunk(0).flatten().to_numpy().astype("<u4", copy=False)
                        ends = np.cumsum(counts)
                        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends - counts, ends, strict=True)]
                        yield shared.batch_of(READ, group["doc_id"].chunk(0), before + ends - counts, counts, crcs)
                        before += int(counts.sum())

    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(files, "file string, start long").repartition(len(files))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token_files(spark: SparkSession, folder: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files as a table: chosen columns, and documents of an id range by row-group statistics and page index."""
    found = spark.read.parquet(folder)
    if first is not None:
        found = found.where(F.col("doc_id") >= first)
    if last is not None:
        found = found.where(F.col("doc_id") <= last)
    return found.select(*(columns or ["doc_id", "n_tokens", "ids"]))
