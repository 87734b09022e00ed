"""Token files, byte-level BPE and the n-gram model against the plain libraries and a direct count."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq

from lectern.llm import byte_bpe, ngram_lm, pieces, shared, token_files

ODD = [
    "  two  blanks \n x", "\n\n a\tb  ", "a b c's 're x \x1c y \x85 z", " lead", "trail ", "<|endoftext|> x <|endoftext|>", "日本 語。 é, è.", " ", "", None,
    "x 12a. y3, ᠎ q", "don't we'll 12's", "z" * 30_000, "mm " * 20_000,
]


def texts(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    return rows + [(5000 + i, t) for i, t in enumerate(ODD)] + [rows[3], (None, "no id")]


def test_token_files_round_trip(spark, data):
    from tokenizers import Tokenizer

    rows = texts(spark, data)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, ids int")
    path = P.path("byte_bpe_50k.json")
    folder = shared.workspace(spark, "t")
    manifest = token_files.write_token_files(docs, folder, path, row_group_tokens=5_000)
    got = [tuple(r) for r in token_files.read_token_digests(manifest).collect()]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    some = token_files.read_token_files(spark, folder, ["doc_id", "n_tokens"], first=5000, last=5003)
    assert sorted(r.doc_id for r in some.collect()) == [5000, 5001, 5002, 5003]
    file = pq.ParquetFile(manifest.first().file.removeprefix("file://"))
    column = file.metadata.row_group(0).column(2)
    assert "RLE_DICTIONARY" in column.encodings and column.has_offset_index and file.num_row_groups > 1
    assert "DELTA_BINARY_PACKED" in file.metadata.row_group(0).column(0).encodings


def test_token_files_by_the_plain_call(spark, data):
    """The query's ids are those of the library's plain call: strings of added tokens are the added tokens."""
    from tokenizers import Tokenizer

    rows = texts(spark, data) + [(i, t) for i, t in enumerate(["hello <|endoftext|> world", " <|endoftext|>  a", "x<|endoftext|><|endoftext|>y  \n", "<|endoftext"], 7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, shared.workspace(spark, "t"), P.path("byte_bpe_50k.json"), added_as_text=False)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert library.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in token_files.read_token_digests(manifest).collect())
    ids = [(i or -1, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]
    assert got == sorted((i, len(x), zlib.crc32(x)) for i, x in ids)


def test_pieces_cut_and_slice_as_documents_do():
    for size in (1, 40, 10_000):
        docs = [(i, t or "") for i, t in enumerate(ODD)]
        batches = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in some], "text": [t for _, t in some]}) for some in (docs[:5], docs[5:])]
        found = list(pieces.slices(iter(batches), size))
        assert [(i, t) for ids, ts in found for i, t in zip(ids.to_pylist(), ts.to_pylist(), strict=True)] == docs
        for _, some in found:
            values, sizes = pieces.cut(some)
            ends = np.cumsum(sizes)
            assert [" ".join(values.to_pylist()[b - n : b]) for n, b in zip(sizes, ends, strict=True)] == some.to_pylist()


def test_token_files_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    manifest = token_files.write_token_files(none, shared.workspace(spark, "t"), P.path("byte_bpe_50k.json"))
    assert token_files.read_token_digests(manifest).collect() == []


def test_small_caches_change_nothing():
    path = P.path("byte_bpe_50k.json")
    some = [t or "" for t in ODD] * 2
    assert list(token_files.PieceEncoder(path, cached=8).encode(some)) == list(token_files.PieceEncoder(path).encode(some))


def test_byte_bpe_equals_the_library(spark, data):
    import tiktoken

    rows = texts(spark, data)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    for size in (12_000_000, 15_000):
        got = byte_bpe.digests(docs, path, P.PATTERN, chunk_characters=size).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((want(*r) for r in rows), key=repr)
    plain = byte_bpe.encoded(docs, path, P.PATTERN).where("doc_id = 5006").first()
    assert plain.ids == library.encode_ordinary(ODD[6]) and bytes(plain.decoded).decode() == ODD[6]
    assert byte_bpe.digests(docs.limit(0), path, P.PATTERN).collect() == []


def direct_model(rows):
    train = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 10]
    words = lambda t: [*(t or "").encode().lower().split(), "end"]
    single, pairs = Counter(), Counter()
    for t in train:
        w = words(t)
        single.update(w)
        pairs.update(zip(["begin", *w], w))  # noqa: B905
    total, kinds = sum(single.values()), len(single)
    high = ngram_lm._discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)])
    ahead = Counter(w for _, w in pairs)
    low = ngram_lm._discounts([sum(n == k for n in ahead.values()) for k in (1, 2, 3, 4)])
    off = lambda n, d: d[min(n, 3) - 1] if n else 0
    spare = sum(off(n, low) for n in ahead.values()) / len(pairs)
    rest, seen = defaultdict(float), Counter()
    for (v, _), n in pairs.items():
        rest[v] += off(n, high)
        seen[v] += n

    def probability(v, w):
        one = max(ahead[w] - off(ahead[w], low), 0) / len(pairs) + spare / (kinds + 1)
        return (max(pairs[v, w] - off(pairs[v, w], high), 0) + rest[v] * one) / seen[v] if seen[v] else one

    out = {}
    for i, t in rows:
        w = words(t)
        score = sum(math.log10(probability(v, x)) for v, x in zip(["begin", *w], w))  # noqa: B905
        base = sum(math.log10((single[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        out[i] = len(w), sum(single[x] > 0 for x in w), base, score
    everything = sum(probability("begin", x) for x in single) + probability("begin", "never seen")
    return out, total, everything


def test_ngram_model_equals_a_direct_count(spark, data, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SLICE_WORDS", 20_000)
    monkeypatch.setattr(ngram_lm, "HELD_ENTRIES", 3_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(900, None), (901, "Xx yy zz"), (902, ""), (903, "same " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, total, everything = direct_model(rows)
    assert abs(everything - 1) < 1e-9
    model = ngram_lm.train(docs, shared.crc_remainder("doc_id", 10) != 0, shared.workspace(spark, "t"))
    assert model.tokens == total
    scored = ngram_lm.score(docs, model).collect()
    assert len(scored) == len(rows)
    for r in scored:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert abs(r.base_score - base) < 1e-6 * max(1, n) and abs(r.score - score) < 1e-5 * max(1, n)
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_ngram_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = ngram_lm.train(docs.limit(0), shared.crc_remainder("doc_id", 10) >= 0, shared.workspace(spark, "t"))
    assert [tuple(r) for r in ngram_lm.score(docs, model).collect()] == [(1, 3, 0, 0.0, 0.0)]
    assert ngram_lm.score(docs.limit(0), model).collect() == []
