"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays.

Words are counted by 64-bit hash. The counts go, sorted by hash and cut by hash range, into files of the
shared folder; a word's number is its place in them. Bigrams are counted as pairs of numbers in one 64-bit
key, cut by a mix of the key (so no word's followers meet in one task), and stored the same way. From the
bigrams come, by word number, how many different words stand before a word and how many followers were
seen once, twice or more often; from these the discounts. Workers map the files and look up the sorted
distinct keys of a slice of documents at a time, so they hold little in memory however large the model is.

What tasks exchange is pre-aggregated: sorted keys as compressed differences, a block per task and cut.
The driver gets one row per cut.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)      g(v) = sum of discounts of v's followers / c(v)
    p(w) = max(n(w) - D'(n(w)), 0) / N + g' / (V + 1)           n(w): different words before w, N: their sum

D is the discount for counts of 1, 2 and 3 or more, from how many bigrams were seen 1 to 4 times; D' the
same of n. An unknown context leaves p(w); an unknown word has only the uniform share. The context of a
document's first token is its beginning. The model is of order 2: with higher orders the stored hash
arrays of all counts exceed the disk that is granted per input byte (README).

Defined results: a null or empty text is one end token. Rows that repeat a doc_id count and are scored row
by row; a null doc_id is treated as the empty text by held_out. With nothing to learn from, N and V are 0
and every token has probability 1 / (V + 1). Very long texts are scored whole, in slices. Other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

END = b" "  # no word holds a blank
BEGIN_NUMBER = 0
HELD_ENTRIES = 1_500_000
SLICE_WORDS = 1_000_000
ADDED = 0.1
MOST = (1 << 32) - 1  # what a stored bigram count holds; larger ones lie in a table beside it

_BLOCK = "cut int, body binary"
_BLOCKS = pa.schema([("cut", pa.int32()), ("body", pa.binary())])
_ROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


# Blocks of sorted keys with counts ----------------------------------------------------------------


def pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, with their columns of counts; bytes of one significance together, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    flat = [len(keys).to_bytes(8, "little"), steps.view(np.uint8).reshape(-1, 8).T.tobytes()]
    flat += [c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for c in counts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(flat))


def unpack(body: bytes, columns: int = 1) -> tuple[np.ndarray, ...]:
    flat = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(flat[:8], "little")
    steps = np.ascontiguousarray(np.frombuffer(flat, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).ravel()
    rest = [np.ascontiguousarray(np.frombuffer(flat, np.uint8, 4 * n, 8 + 8 * n + 4 * n * k).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64) for k in range(columns)]
    return np.cumsum(steps, dtype=np.uint64), *rest


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *(np.add.reduceat(c[order], starts) for c in counts)


def _blocks(keys: np.ndarray, cuts: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block per cut; keys are sorted, and stay so within a cut."""
    order = np.argsort(cuts, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(cuts[order])) + 1) if len(order) else []:
        yield shared.batch_of(_BLOCKS, [int(cuts[some[0]])], [pack(keys[some], *(c[some] for c in counts))])


def _merged(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """(cut, keys, counts...) of each cut from blocks sorted by cut; blocks are summed as they come."""
    cut, held, size = None, [], 0
    for batch in batches:
        for here, body in zip(batch.column("cut").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if here != cut:
                if held:
                    yield cut, *_sum(held)
                cut, held, size = here, [], 0
            held.append(unpack(body, columns))
            size += len(held[-1][0])
            if len(held) > 1 and size > 2 * len(held[0][0]) + HELD_ENTRIES:
                held = [_sum(held)]
                size = len(held[0][0])
    if held:
        yield cut, *_sum(held)


def _sum(held: list[tuple]) -> tuple[np.ndarray, ...]:
    return summed(*(np.concatenate(column) for column in zip(*held, strict=True)))


def _range_cut(hashes: np.ndarray, cuts: int) -> np.ndarray:
    """Cuts of equal hash ranges, in ascending order."""
    return ((hashes >> np.uint64(32)) * np.uint64(cuts) >> np.uint64(32)).astype(np.int32)


def _pair_cut(keys: np.ndarray, cuts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return _range_cut(mixed ^ (mixed >> np.uint64(32)), cuts)


# The stored model ---------------------------------------------------------------------------------


@dataclass
class Model:
    folder: str
    cuts: int
    bases: list[int]  # words in all cuts before each
    tokens: int  # N of the base score
    begins: int  # training documents
    begin_followers: tuple[int, int, int]  # of the beginning, seen once, twice, more often
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    different: int  # bigrams
    low_spare: float = 1.0  # what p(w) leaves to all words alike

    @property
    def words(self) -> int:
        return self.bases[-1]


class Files:
    """The arrays of a model, mapped when first asked for."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def array(self, name: str, cut: int, dtype) -> np.ndarray:
        if (name, cut) not in self.open:
            self.open[name, cut] = shared.mapped_array(f"{self.model.folder}/{name}-{cut:06d}", dtype)
        return self.open[name, cut]

    def find(self, name: str, keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The place of each key in its cut's sorted array, -1 if it is not there."""
        found = np.full(len(keys), -1, np.int64)
        order = np.argsort(cuts, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(cuts[order])) + 1) if len(order) else []:
            stored = self.array(name, int(cuts[some[0]]), np.uint64)
            if len(stored):
                place = np.minimum(np.searchsorted(stored, keys[some]), len(stored) - 1)
                found[some] = np.where(stored[place] == keys[some], place, -1)
        return found

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1 on, 0 for words not in training."""
        cuts = _range_cut(hashes, self.model.cuts)
        place = self.find("word", hashes, cuts)
        return np.where(place < 0, 0, np.array(self.model.bases, np.int64)[cuts] + place + 1)

    def gather(self, name: str, numbers: np.ndarray, dtype) -> np.ndarray:
        """A stored column at word numbers (from 1 on)."""
        bases = np.array(self.model.bases, np.int64)
        cuts = np.searchsorted(bases, numbers - 1, side="right") - 1
        out = np.zeros(len(numbers), dtype)
        order = np.argsort(cuts, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(cuts[order])) + 1) if len(order) else []:
            cut = int(cuts[some[0]])
            out[some] = self.array(name, cut, dtype)[numbers[some] - 1 - bases[cut]]
        return out


class WordNumbers:
    """Numbers of the words of a slice of documents: each distinct word is looked up once in the files."""

    def __init__(self, files: Files):
        self.files = files

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all tokens in turn (each document's words, then the end) and the tokens per document."""
        distinct = list(set().union(*texts, (END,)))
        hashes = np.array([word_hash(w) for w in distinct], np.uint64)
        order = np.argsort(hashes)
        numbers = np.empty(len(distinct), np.int64)
        numbers[order] = self.files.numbers(hashes[order])
        known = dict(zip(distinct, numbers.tolist(), strict=True))
        look = known.__getitem__
        end = known[END]
        flat: list[int] = []
        for words in texts:
            flat.extend(map(look, words))
            flat.append(end)
        return np.array(flat, np.int64), np.array([len(w) + 1 for w in texts], np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(shared.lowered_words(text))
            size += len(texts[-1]) + 1
            if size >= SLICE_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _before(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each; -1 marks the beginning of a document."""
    previous = np.concatenate([[0], numbers[:-1]])
    previous[np.cumsum(sizes) - sizes] = -1
    return previous


def _discounts(seen: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many things were seen 1, 2, 3 and 4 times; halves where the data give none."""
    n1, n2, n3, n4 = seen
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * after / at, 0.05), k - 0.05) for k, at, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


# Training -----------------------------------------------------------------------------------------


def train(docs: DataFrame, usable: Column, folder: str, cuts: int | None = None, most: int = MOST) -> Model:
    """Counts the rows of docs where usable holds; folder: a new one in the shared folder; most: the largest count in the array of counts."""
    spark = docs.sparkSession
    cuts = cuts or shared.shuffle_partitions(spark)
    texts = shared.id_text(docs.where(usable))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def send() -> Iterator[pa.RecordBatch]:
            keys, n = summed(np.array([word_hash(w) for w in counts], np.uint64), np.array(list(counts.values()), np.int64))
            yield from _blocks(keys, _range_cut(keys, cuts), n)

        for ids, some in _slices(batches):
            for words in some:
                counts.update(words)
            counts[END] += len(ids)
            if len(counts) >= HELD_ENTRIES:
                yield from send()
                counts.clear()
        if counts:
            yield from send()

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, keys, n in _merged(batches, 1):
            shared.put_array(f"{folder}/word-{cut:06d}", keys)
            shared.put_array(f"{folder}/count-{cut:06d}", n)
            yield pa.RecordBatch.from_pydict({"cut": pa.array([cut], pa.int32()), "words": [len(keys)], "tokens": [int(n.sum())]})

    dealt = texts.mapInArrow(count_words, _BLOCK).repartitionById(cuts, F.col("cut")).sortWithinPartitions("cut")
    stored = {r.cut: r for r in dealt.mapInArrow(store_words, "cut int, words long, tokens long").collect()}  # a row per cut
    sizes = [stored[c].words if c in stored else 0 for c in range(cuts)]
    for cut in range(cuts):
        if cut not in stored:
            shared.put_array(f"{folder}/word-{cut:06d}", np.zeros(0, np.uint64))
    bases = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    if bases[-1] >= 1 << 32:
        raise ValueError("more distinct words than a 32-bit word number holds")
    model = Model(folder, cuts, bases, sum(r.tokens for r in stored.values()), 0, (0, 0, 0), (0.5, 0.75, 1.0), (0.5, 0.75, 1.0), 0)
    if not model.words:
        return model
    end_hash = np.array([word_hash(END)], np.uint64)
    files = Files(model)
    model.begins = int(files.gather("count", files.numbers(end_hash), np.int64)[0])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers(Files(model))
        held: list[tuple] = []
        size = 0
        for _, some in _slices(batches):
            found, lengths = numbers.of(some)
            before = np.maximum(_before(found, lengths), BEGIN_NUMBER)
            keys = np.sort((before.astype(np.uint64) << np.uint64(32)) | found.astype(np.uint64))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held.append((keys[starts], np.diff(np.append(starts, len(keys)))))
            size += len(starts)
            if size >= 4 * HELD_ENTRIES:
                keys, n = _sum(held)
                yield from _blocks(keys, _pair_cut(keys, cuts), n)
                held, size = [], 0
        if held:
            keys, n = _sum(held)
            yield from _blocks(keys, _pair_cut(keys, cuts), n)

    def store_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stores a cut of bigrams and sends on, by word number, what its bigrams say about their words."""
        ends = np.array(bases[1:], np.int64)
        for cut, keys, n in _merged(batches, 1):
            shared.put_array(f"{folder}/pair-{cut:06d}", keys)
            shared.put_array(f"{folder}/times-{cut:06d}", np.minimum(n, most).astype(np.uint32))
            over = np.flatnonzero(n > most)
            shared.put_array(f"{folder}/over-{cut:06d}", np.stack([over, n[over]]).astype(np.int64))
            before, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            one, two, more = (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)
            nothing = np.zeros(len(n), np.int64)
            told = summed(np.concatenate([word, before]), np.concatenate([nothing + 1, nothing]), *(np.concatenate([nothing, x]) for x in (one, two, more)))
            at_begin = told[0] == BEGIN_NUMBER
            begin = [int(c[at_begin].sum()) for c in told[2:]]
            told = tuple(c[~at_begin] for c in told)
            yield from _blocks(told[0], np.searchsorted(ends, told[0].astype(np.int64) - 1, side="right").astype(np.int32), *told[1:])
            tally = [int((n == k).sum()) for k in (1, 2, 3, 4)] + begin + [len(n)]
            yield shared.batch_of(_BLOCKS, [-1 - cut], [np.array(tally, np.int64).tobytes()])

    pairs = texts.mapInArrow(count_pairs, _BLOCK).repartitionById(cuts, F.col("cut")).sortWithinPartitions("cut")
    told = shared.settled(pairs.mapInArrow(store_pairs, _BLOCK), f"{folder}/told")
    tallied = {-1 - r.cut: np.frombuffer(r.body, np.int64) for r in told.where("cut < 0").collect()}  # a row per cut
    for cut in set(range(cuts)) - set(tallied):
        for name, dtype in (("pair", np.uint64), ("times", np.uint32), ("over", np.int64)):
            shared.put_array(f"{folder}/{name}-{cut:06d}", np.zeros(0, dtype))
    tallies = np.sum(list(tallied.values()), axis=0)
    model.discounts = _discounts(tallies[:4].tolist())
    model.begin_followers = tuple(int(x) for x in tallies[4:7])
    model.different = int(tallies[7])
    discounts = np.array(model.discounts)

    def store_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, numbers, ahead, one, two, more in _merged(batches, 4):
            at = numbers.astype(np.int64) - 1 - bases[cut]
            n = np.zeros(sizes[cut], np.uint32)
            spare = np.zeros(sizes[cut], np.float32)
            n[at] = ahead
            count = np.asarray(Files(model).array("count", cut, np.int64))
            spare[at] = (discounts[0] * one + discounts[1] * two + discounts[2] * more) / count[at]
            shared.put_array(f"{folder}/ahead-{cut:06d}", n)
            shared.put_array(f"{folder}/spare-{cut:06d}", spare)
            yield shared.batch_of(_BLOCKS, [cut], [np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [(n > 2).sum()], np.int64).tobytes()])

    by_word = told.where("cut >= 0").repartitionById(cuts, F.col("cut")).sortWithinPartitions("cut")
    seen = np.sum([np.frombuffer(r.body, np.int64) for r in by_word.mapInArrow(store_contexts, _BLOCK).collect()], axis=0)  # a row per cut
    model.low_discounts = _discounts(seen[:4].tolist())
    low = model.low_discounts
    model.low_spare = (low[0] * seen[0] + low[1] * seen[1] + low[2] * seen[4]) / model.different
    return model


# Scoring ------------------------------------------------------------------------------------------


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    off = np.array([0.0, *discounts])
    return np.maximum(counts - off[np.minimum(counts, 3)], 0.0)


def _scores(model: Model, files: Files, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Known tokens, base score and model score of each document."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    tell = lambda values: np.bincount(of, weights=values, minlength=len(sizes))
    distinct, place = np.unique(numbers, return_inverse=True)
    known = distinct > 0
    counts = np.zeros(len(distinct), np.int64)
    single = np.full(len(distinct), 1 / (model.words + 1))
    spare = np.zeros(len(distinct))
    if model.words:
        counts[known] = files.gather("count", distinct[known], np.int64)
        single *= model.low_spare
        single[known] += _discounted(files.gather("ahead", distinct[known], np.uint32).astype(np.int64), model.low_discounts) / model.different
        spare[known] = files.gather("spare", distinct[known], np.float32)
    base = tell(np.log10((counts + ADDED) / (model.tokens + ADDED * (model.words + 1)))[place])
    if not model.words:
        return tell(np.zeros(len(numbers))), base, tell(np.log10(single)[place])
    before = _before(numbers, sizes)
    begin = before < 0
    here = np.concatenate([[0], place[:-1]])  # the place of the token before
    total = np.where(begin, model.begins, counts[here])
    rest = np.where(begin, float(np.dot(model.discounts, model.begin_followers)) / max(model.begins, 1), spare[here])
    keys = (np.maximum(before, BEGIN_NUMBER).astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64)
    asked, back = np.unique(keys, return_inverse=True)
    cuts = _pair_cut(asked, model.cuts)
    found = files.find("pair", asked, cuts)
    times = np.zeros(len(asked), np.int64)
    hit = np.flatnonzero(found >= 0)
    order = hit[np.argsort(cuts[hit], kind="stable")]
    for some in np.split(order, np.flatnonzero(np.diff(cuts[order])) + 1) if len(order) else []:
        cut = int(cuts[some[0]])
        times[some] = files.array("times", cut, np.uint32)[found[some]]
        over, real = files.array("over", cut, np.int64).reshape(2, -1)
        if len(over):
            at = np.minimum(np.searchsorted(over, found[some]), len(over) - 1)
            times[some] = np.where(over[at] == found[some], real[at], times[some])
    together = _discounted(times, model.discounts)[back]
    usable = total > 0
    p = single[place]
    p = np.where(usable, together / np.maximum(total, 1) + rest * p, p)
    return tell(known[place].astype(float)), base, tell(np.log10(p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(model)
        words = WordNumbers(files)
        for ids, texts in _slices(batches):
            numbers, sizes = words.of(texts)
            known, base, found = _scores(model, files, numbers, sizes)
            yield shared.batch_of(_ROW, ids, sizes, known.astype(np.int64), base, found)

    return shared.id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> Column:
    """Of each scored document: 10 to the mean negative log10 probability of a token."""
    return F.pow(F.lit(10.0), -scored["score"] / scored["n_tokens"])
