"""Byte-level BPE by a global shuffle of distinct words.

Texts are gathered into chunks of whole documents. A chunk explodes its texts into pre-tokens with
positions, once: the positions, as each position's number in the chunk's word list, go to a file of the shared
folder, and what travels is the chunk's distinct pre-tokens, one block per hash bucket. A bucket's task sees
every block of its words in the whole corpus, so each distinct word is encoded once (Remembered bounds
what it holds; a word that it let go is encoded again); the ids go back to the chunks that asked, where they
are put together by position. A word that occurs in every document is one entry per chunk, so no task depends on
how often it occurs. Decoding joins the token-byte table, which has one row per vocabulary entry and
is broadcast.

The words are a table in the shared folder, whose rows name the files of their own task's attempt. So a repeated task
changes nothing, and the input is read once.

Defined results: a null or empty text has no ids. Rows that repeat a doc_id are encoded row by row.
A chunk holds at least one document, however long. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import pieces, shared

CHUNK_CHARACTERS = 12_000_000
ASKED_WORDS = 500_000
REMEMBERED_WORDS = 3_000_000
JOINED_WORDS = 50_000

_BLOCK = "chunk string, bucket int, body binary"
_BLOCKS = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("body", pa.binary())])
_ONE_WORD = r"^ [^\x09-\x0d\x1c-\x20\x{85}\p{Z}]+$"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


_CODERS: dict[tuple[str, str], object] = {}


def coder(ranks_path: str, pattern: str, ranks: dict[bytes, int]):
    """One encoder per worker and vocabulary."""
    import tiktoken

    key = ranks_path, pattern
    if key not in _CODERS:
        _CODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[key]


def pack(values: np.ndarray) -> bytes:
    """Numbers with bytes of one significance together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()) if len(values) else b""


def unpack(body: bytes, dtype) -> np.ndarray:
    if not body:
        return np.empty(0, dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def layout(values: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and bytes of a large string or binary array that starts at its buffers' start."""
    _, offsets, data = values.buffers()
    return (np.frombuffer(offsets, np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)), data if data is not None else pa.py_buffer(b"")


def from_layout(kind: pa.DataType, offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])


def read_words(body: bytes) -> tuple[np.ndarray, bytes]:
    """Sizes and bytes of a block of words."""
    n = int.from_bytes(body[:4], "little")
    flat = zstandard.ZstdDecompressor().decompress(body[4:])
    return np.frombuffer(flat, np.uint32, n).astype(np.int64), flat[4 * n :]


def words_of(later: pa.Array, first: pa.Array, pattern) -> tuple[pa.Array, pieces.Lists]:
    """The distinct pre-tokens of pieces, and each piece's pre-tokens as their numbers: later ones (which a blank precedes), then first ones."""
    which, stems, stem_of, tails, tail_of = pieces.simple(later)
    tailed = pieces.flags(pc.not_equal(tails, ""))
    other = [pattern.findall(f" {p}") if p else [] for p in pieces.objects(later.filter(pa.array(~which)))]
    heads = [pattern.findall(p) for p in pieces.objects(first)]
    spelled = pc.binary_join_element_wise(pieces.strings([""])[0], stems, pieces.strings([" "])[0])
    odd = pieces.strings([w for ws in (*other, *heads) for w in ws])
    words = pa.concat_arrays([spelled, tails.filter(pa.array(tailed)), odd]).dictionary_encode()
    numbers = pieces.objects(words.indices).astype(np.int64)
    of_stems, of_tails, of_odd = np.split(numbers, [len(stems), len(stems) + int(tailed.sum())])
    simple = pieces.Lists.beside(pieces.Lists(np.ones(len(stem_of), np.int64), of_stems[stem_of]), pieces.Lists(tailed, of_tails).take(tail_of))
    rest = pieces.Lists(np.array([len(ws) for ws in (*other, *heads)], np.int64), of_odd)
    place = np.empty(len(later), np.int64)
    place[which] = np.arange(len(simple))
    place[~which] = len(simple) + np.arange(len(other))
    return words.dictionary, pieces.Lists.joined([simple, rest]).take(np.concatenate([place, len(simple) + len(other) + np.arange(len(heads))]))


@dataclass
class Chunk:
    """Documents put together: ids of each word of the chunk, the words in use one after the other, and how many of them each document has."""

    doc_ids: pa.Array
    words: pieces.Lists
    used: np.ndarray
    sizes: np.ndarray

    def edges(self) -> np.ndarray:
        """Where each document's words begin, and where the last one's end."""
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def spelled(self, tokens: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
        """All documents with each id replaced by its entry of tokens: where each begins, and the bytes."""
        offsets, data = layout(tokens.take(pa.array(self.words.flat)))
        words = from_layout(pa.large_binary(), offsets[np.concatenate([[0], np.cumsum(self.words.sizes)])], data)
        offsets, data = layout(words.take(pa.array(self.used)))
        return offsets[self.edges()], data

    def counts(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.words.sizes[self.used])])[self.edges()])


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, rows, schema: str, chunk_characters: int = CHUNK_CHARACTERS, path: str | None = None) -> DataFrame:
    """The table of rows(chunk, token bytes): the columns of schema, a row per document. path: a new folder in the shared folder.

    encoded() is the plain form.
    """
    spark = docs.sparkSession
    path = path or shared.workspace(spark, "byte-bpe")
    n = shared.shuffle_partitions(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # one entry per vocabulary entry
    names = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for doc_ids, texts in pieces.slices(batches, chunk_characters):
            numbers, piece_counts, later, first = pieces.coded(texts)
            words, lists = words_of(later, first, compiled)
            used = lists.take(numbers)
            ends = np.concatenate([[0], np.cumsum(used.sizes)])
            last = np.cumsum(piece_counts)
            buckets = np.array([zlib.crc32(w) % n for w in pieces.objects(words.cast(pa.large_binary()))], np.int32)
            order = pc.sort_indices(pa.table({"bucket": buckets, "word": words}), sort_keys=[("bucket", "ascending"), ("word", "ascending")])
            place = np.empty(len(words), np.uint32)  # the number of each word once the blocks stand in the order of their buckets
            place[pieces.objects(order)] = np.arange(len(words), dtype=np.uint32)
            name = uuid.uuid4().hex
            absent = pieces.flags(doc_ids.is_null()).astype(np.uint8)
            parts = [pack(pieces.objects(doc_ids.fill_null(-1))), pack(absent), pack((ends[last] - ends[last - piece_counts]).astype(np.uint32)), pack(place[used.flat])]
            shared.put_file(f"{path}/positions/{name}", lambda stream, p=parts: stream.write(np.array([len(x) for x in p], np.uint64).tobytes() + b"".join(p)))
            offsets, data = layout(words.take(order))
            data = memoryview(data)
            edges = np.searchsorted(buckets[pieces.objects(order)], np.arange(n + 1))
            asked = np.flatnonzero(np.diff(edges)) if len(words) else np.zeros(1, np.int64)  # a chunk without words asks for none
            pack_words = zstandard.ZstdCompressor(level=3).compress
            bodies = [
                (b - a).to_bytes(4, "little") + pack_words(np.diff(offsets[a : b + 1]).astype(np.uint32).tobytes() + data[offsets[a] : offsets[b]].tobytes())
                for a, b in zip(edges[asked].tolist(), edges[asked + 1].tolist(), strict=True)
            ]
            yield shared.batch_of(_BLOCKS, [name] * len(asked), asked.astype(np.int32), bodies)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(ranks_path, pattern, ranks.value)
        opens = np.zeros(max(ranks.value.values(), default=0) + 1, bool)
        opens[[rank for token, rank in ranks.value.items() if token.startswith(b" ")]] = True

        def encode(words: pa.Array) -> pieces.Lists:
            single = pieces.flags(pc.match_substring_regex(words, _ONE_WORD))
            plain = pieces.objects(words.filter(pa.array(single)))
            joined = [library.encode_to_numpy("".join(plain[at : at + JOINED_WORDS])).astype(np.uint32) for at in range(0, len(plain), JOINED_WORDS)]
            lists = [pieces.split_at(ids, opens) for ids in joined]
            lists.append(pieces.Lists.of([library.encode_ordinary(w) for w in pieces.objects(words.filter(pa.array(~single)))]))
            together = pieces.Lists.joined(lists)
            return together.take(np.where(single, np.cumsum(single) - 1, len(plain) + np.cumsum(~single) - 1))

        known = pieces.Remembered(encode, REMEMBERED_WORDS)

        def answer(asked: list[tuple]) -> pa.RecordBatch:
            sizes = np.concatenate([s for _, _, s, _ in asked])
            words = from_layout(pa.large_string(), np.concatenate([[0], np.cumsum(sizes)]), pa.py_buffer(b"".join(d for _, _, _, d in asked))).dictionary_encode()
            numbers = pieces.objects(words.indices)
            ids = known.ids(words.dictionary)
            bodies, at = [], 0
            for _, _, s, _ in asked:
                own = ids.take(numbers[at : at + len(s)])
                bodies.append(len(s).to_bytes(4, "little") + pack(np.concatenate([own.sizes.astype(np.uint32), own.flat])))
                at += len(s)
            return shared.batch_of(_BLOCKS, [c for c, _, _, _ in asked], [b for _, b, _, _ in asked], bodies)

        asked, size = [], 0
        for batch in batches:
            for chunk, bucket, body in zip(batch.column("chunk").to_pylist(), batch.column("bucket").to_pylist(), batch.column("body").to_pylist(), strict=True):
                asked.append((chunk, bucket, *read_words(body)))
                size += len(asked[-1][2])
                if size >= ASKED_WORDS:
                    yield answer(asked)
                    asked, size = [], 0
        if asked:
            yield answer(asked)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = [b""] * (max(ranks.value.values(), default=0) + 1)
        for token, rank in ranks.value.items():
            by_rank[rank] = token
        tokens = pa.array(by_rank, pa.large_binary())
        name, blocks = None, []
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if chunk != name and blocks:
                    yield shared.batch_of(arrow, *rows(_chunk(f"{path}/positions/{name}", blocks), tokens))
                    blocks = []
                name = chunk
                blocks.append(body)
        if blocks:
            yield shared.batch_of(arrow, *rows(_chunk(f"{path}/positions/{name}", blocks), tokens))

    asked = shared.settled(shared.id_text(docs).mapInArrow(cut, _BLOCK), f"{path}/words")
    answers = asked.repartitionById(n, F.col("bucket")).mapInArrow(answered, _BLOCK)
    return answers.repartition(n, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(together, schema)


def _chunk(positions: str, blocks: list[bytes]) -> Chunk:
    body = shared.file_bytes(positions)
    sizes = np.frombuffer(body, np.uint64, 4).astype(np.int64)
    ends = np.cumsum(sizes) + 32
    ids, absent, counts, used = (unpack(body[e - s : e], kind) for e, s, kind in zip(ends.tolist(), sizes.tolist(), (np.int64, np.uint8, np.uint32, np.uint32), strict=True))
    lists = []
    for block in blocks:
        n = int.from_bytes(block[:4], "little")
        numbers = unpack(block[4:], np.uint32)
        lists.append(pieces.Lists(numbers[:n], numbers[n:]))
    return Chunk(pa.array(ids, mask=absent.astype(bool)), pieces.Lists.joined(lists), used, counts.astype(np.int64))


def _digests(chunk: Chunk, tokens: pa.Array) -> tuple:
    decimal = pa.array([f"{i} ".encode() for i in range(len(tokens))], pa.large_binary())
    hashed = []
    for table, blank in ((decimal, 1), (tokens, 0)):
        edges, data = chunk.spelled(table)
        view = memoryview(data)
        hashed.append([hashlib.sha256(view[a : max(a, b - blank)]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
    return chunk.doc_ids, chunk.counts(), *hashed


def digests(docs: DataFrame, ranks_path: str, pattern: str, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one blank), decoded_sha256."""
    return encode_decode(docs, ranks_path, pattern, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **options)


def _plain(chunk: Chunk, tokens: pa.Array) -> tuple:
    edges, data = chunk.spelled(tokens)
    ids = chunk.words.take(chunk.used).flat.astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(chunk.counts())])
    return chunk.doc_ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), from_layout(pa.large_binary(), edges, data).cast(pa.binary())


def encoded(docs: DataFrame, ranks_path: str, pattern: str, **options) -> DataFrame:
    """doc_id, ids, decoded (the bytes that the ids stand for)."""
    return encode_decode(docs, ranks_path, pattern, _plain, "doc_id long, ids array<int>, decoded binary", **options)
