"""Benchmark decontamination by template windows.

Words become template tokens: numbers, units after a number, and names (capitalised, not first in a
sentence) are replaced by typed placeholders, other words lose their case and outer punctuation. Windows
of WINDOW template tokens of documents and benchmark items are hashed and joined. The windows that a
document and an item share fall into alignments (difference of positions); an alignment counts if its
slots are consistent, that is if each slot value of the item always stands for the same value in the
document. So a question told again with other numbers or names is found, and one that only shares its
phrasing in places is not. A document is contaminated by an item when consistent alignments cover
SIMILARITY of the item's windows.

A window has up to four forms, and an item's window is covered when any of them is shared: narrow (as above),
wide (capitalised openings of sentences are names as well, at least WIDE_CONTENT other words), caseless
(numbers and units are slots, names are words: copies in capitals or small letters), and plain. Wide windows make a
second reading of an alignment, with a consistency of its own, so a changed opening word loses nothing.

Template windows need CONTENT words that are no placeholder. Windows of fewer words beside numbers and units
(sequences, tables) only have the plain form, which matches the same words and values. An item is judged by its
windows with enough content where those are half of all or more, and by all its windows. Items of fewer than WINDOW
tokens are one window of their whole length, with as many content words as CONTENT allows for that length.

The documents' windows that cannot match are dropped early by a Bloom filter of the benchmark's hashes, which is
broadcast: FILTER_BITS bits, however large the benchmark is. What passes goes to an exact join on the hash, so the filter
only decides how much that is. There the items' side is laid under SALTS keys and the documents' windows are dealt over
them, so a window that very many documents hold is no hot key. What an alignment collects is bounded by its item: it has
a row for each form of each of the item's windows at most.

Defined results: null or empty texts and items have no window and never match. Rows that repeat a doc_id
count as one document's, repeated items as one item. Rows without doc_id are judged by their text: leaks has a
row without doc_id for each such text, and without_leaks drops the rows that have it. Items without
item_id are left out. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

WINDOW = 5
CONTENT = 3
WIDE_CONTENT = 2
SIMILARITY = 0.8
FILTER_BITS = 1 << 27
SALTS = 16
CACHED_WORDS = 400_000

# Units.
UNITS = frozenset(
    """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
    mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons ounce ounces ml l liter liters litre litres gallon gallons
    s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
    km/h mph m/s hz khz mhz ghz w kw kwh v a j kj cal kcal pa kpa bar degree degrees celsius fahrenheit kelvin percent
    usd eur gbp dollar dollars euro euros cent cents byte bytes kb mb gb tb""".split()
)

_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:%|°|[a-zA-Z]{1,3})?$")
_EDGES = "\"'“”‘’«»¿¡.,;:!?()[]{}…"
_NUM, _UNIT, _CAPITAL, _ENDS = 1, 2, 4, 8
_HIT = "hash long, doc string, position int, slots array<string>, wide boolean, content boolean"
_HITS = pa.schema([("hash", pa.int64()), ("doc", pa.string()), ("position", pa.int32()), ("slots", pa.list_(pa.string())), ("wide", pa.bool_()), ("content", pa.bool_())])

# Forms of a window.
NARROW, WIDE, CASELESS, PLAIN = range(4)


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 8 << 8


_PLACEHOLDERS = np.array([_code("<number>"), _code("<unit>"), _code("<name>")], np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordCodes(dict):
    """For a raw word: a hash of its plain form with four flags in the low bits. Bounded."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        plain = raw.strip(_EDGES)
        flags = _ENDS if raw.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", ":", "…") else 0
        if _NUMBER.match(plain):
            flags |= _NUM
        elif plain.lower() in UNITS:
            flags |= _UNIT
        elif plain[:1].isupper() and plain[1:].islower():
            flags |= _CAPITAL
        found = self[raw] = _code(plain.lower()) | flags
        return found


def template(texts: list[str], codes: WordCodes) -> tuple[list[list[str]], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Raw words of each text; for each form (NARROW, WIDE, CASELESS, PLAIN) the hashes of all tokens in turn and which are slots; how many tokens each text has."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    look = codes.__getitem__
    coded = np.array([c for w in words for c in map(look, w)], np.uint64)
    none = np.zeros(len(coded), bool)
    if not len(coded):
        return words, [(coded, none)] * 4, sizes
    flags = coded.astype(np.uint8)
    first = np.zeros(len(coded), bool)
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    before = np.concatenate([[0], flags[:-1]]).astype(np.uint8)
    number = (flags & _NUM) > 0
    unit = ((flags & _UNIT) > 0) & ((before & _NUM) > 0) & ~first
    capital = (flags & _CAPITAL) > 0
    name = capital & ~first & ((before & _ENDS) == 0)
    plain = coded >> np.uint64(4) << np.uint64(4)
    forms = []
    for named in (name, capital, none):
        forms.append((np.select([number, unit, named], list(_PLACEHOLDERS), default=plain), number | unit | named))
    return words, [*forms, (plain, none)], sizes


def windows(tokens: np.ndarray, slots: np.ndarray, sizes: np.ndarray, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the window that starts at each token: its hash, how many tokens are no slot, and whether it lies inside its text."""
    n = len(tokens)
    if n < length:
        return np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, bool)
    hashes, filled = np.full(n, length + seed, np.uint64), np.zeros(n, np.int64)
    reach = n - length + 1
    with np.errstate(over="ignore"):
        for k in range(length):
            hashes[:reach] = hashes[:reach] * _FACTOR + (tokens[k : k + reach] >> np.uint64(7))
            filled[:reach] += ~slots[k : k + reach]
        hashes ^= hashes >> np.uint64(29)
    ends = np.repeat(np.cumsum(sizes), sizes)
    return hashes, filled, np.arange(n) + length <= ends


def forms_of_windows(forms: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Form, hashes, which windows have that form, and which have enough content (the same for all forms)."""
    least = min(CONTENT, length)
    narrow, filled, inside = windows(*forms[NARROW], sizes, length)
    content = inside & (filled >= least)
    yield NARROW, narrow, content, content
    wide, wide_filled, _ = windows(*forms[WIDE], sizes, length)
    yield WIDE, wide, content & (wide_filled < filled) & (wide_filled >= min(WIDE_CONTENT, length)), content
    caseless, caseless_filled, _ = windows(*forms[CASELESS], sizes, length, 1 << 8)
    yield CASELESS, caseless, inside & (caseless_filled >= least), content
    plain, _, _ = windows(*forms[PLAIN], sizes, length, 1 << 9)
    yield PLAIN, plain, inside & (caseless_filled < least), content


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the id as text, or a digest of the text of a row without id), doc_id, text."""
    named = shared.id_text(docs)
    return named.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("="), F.sha2("text", 256))).alias("doc"), "doc_id", "text")


def _places(hashes, bits: int):
    """The two bits of each hash, as Spark columns or numpy arrays of int64."""
    return hashes & (bits - 1), (hashes >> 32) & (bits - 1)


def _filter(told: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the items' hashes: a bit array. Its words are put together before they come to the driver, so that at most bits / 64 rows do."""
    low, high = F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftright("hash", 32).bitwiseAND(F.lit(bits - 1))
    places = told.select(F.explode(F.array(low, high)).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _windows_of(docs: DataFrame, lengths: list[int], wanted, whole_only: bool = False) -> DataFrame:
    """hash, doc, position, slots (the values in the window's slots, empty text elsewhere; null without any) of docs (doc, text).

    wanted: a broadcast Bloom filter, or None for all windows. whole_only: windows under WINDOW
    are made of texts of just that length (benchmark items); otherwise anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        sieve = None if wanted is None else wanted.value

        def passing(hit: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            for which in range(2):
                place = _places(hashes[hit].view(np.int64), 64 * len(sieve))[which]
                hit = hit[(sieve[place >> 6] >> (place & 63) & 1).astype(bool)]
            return hit

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column("doc").to_pylist()
                words, forms, sizes = template(part.column("text").to_pylist(), codes)
                starts = np.cumsum(sizes) - sizes
                for length, (form, hashes, real, content) in ((n, found) for n in lengths for found in forms_of_windows(forms, sizes, n)):
                    if whole_only:
                        real = real & np.repeat(sizes == length if length < WINDOW else sizes >= WINDOW, sizes)
                    hit = np.flatnonzero(real)
                    if sieve is not None:
                        hit = passing(hit, hashes)
                    if not len(hit):
                        continue
                    of = np.searchsorted(starts + sizes, hit, side="right")
                    position = hit - starts[of]
                    # An item's caseless and plain windows tell its names too; the document has the same words there.
                    slots = forms[NARROW if whole_only and form != WIDE else form][1]
                    held = [
                        [words[d][p + k].strip(_EDGES).lower() if slots[i + k] else "" for k in range(length)] if slots[i : i + length].any() else None
                        for i, d, p in zip(hit.tolist(), of.tolist(), position.tolist(), strict=True)
                    ]
                    yield shared.batch_of(_HITS, hashes[hit].view(np.int64), [ids[d] for d in of.tolist()], position.astype(np.int32), held, np.full(len(hit), form == WIDE), content[hit])

    return docs.select("doc", "text").mapInArrow(run, _HIT)


def leaks(docs: DataFrame, benchmark: DataFrame, path: str, similarity: float = SIMILARITY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, item_id, similarity, kind (exact: all slots have the item's values; else restated) of each leak.

    benchmark: item_id, text; path: a new folder in the shared folder; filter_bits: a power of two, 64 or more.
    """
    found = _leaks(_keyed(docs), benchmark, path, similarity, filter_bits)
    return found.select(F.when(~F.startswith("doc", F.lit("=")), F.col("doc")).cast("long").alias("doc_id"), "item_id", "similarity", "kind")


def _leaks(docs: DataFrame, benchmark: DataFrame, path: str, similarity: float, filter_bits: int) -> DataFrame:
    """leaks with doc, as _keyed makes it, in place of doc_id."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    all_lengths = list(range(1, WINDOW + 1))
    told = _windows_of(items.select(F.col("item_id").cast("string").alias("doc"), "text"), all_lengths, None, whole_only=True).select(
        "hash", F.col("doc").cast("long").alias("item_id"), F.col("position").alias("item_position"), F.col("slots").alias("item_slots"), F.col("wide").alias("item_wide"), F.col("content").alias("item_content")
    )
    told = shared.settled(told.distinct(), f"{path}/items")
    held = spark.sparkContext.broadcast(_filter(told, filter_bits))  # filter_bits bits
    short = [r.n for r in _token_counts(items).where(f"n < {WINDOW}").distinct().collect()]  # under WINDOW values
    asked = _windows_of(docs, sorted({WINDOW, *(n for n in short if n > 0)}), held)
    # Openings of sentences as slots are a reading of their own: where it is not consistent, the narrow one may be.
    readings = F.when(F.col("wide") | F.col("item_wide"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    filled = F.zip_with("item_slots", F.coalesce("slots", "item_slots"), lambda told, here: F.struct(told.alias("told"), F.when(here == "", told).otherwise(here).alias("here")))
    dealt = asked.drop("content").withColumn("salt", F.pmod(F.xxhash64("doc", "position"), F.lit(SALTS)).cast("int"))
    salted = told.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    pairs = dealt.join(salted, ["hash", "salt"]).withColumn("reading", F.explode(readings))
    aligned = pairs.groupBy("doc", "item_id", "reading", (F.col("position") - F.col("item_position")).alias("shift")).agg(
        F.collect_set(F.struct("item_position", "item_content")).alias("covered"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("item_slots").isNotNull(), F.filter(filled, lambda s: s["told"] != ""))))).alias("filled"),
    )
    told_values = F.array_distinct(F.transform("filled", lambda s: s["told"]))
    sound = aligned.where(F.size("filled") == F.size(told_values)).select(
        "doc", "item_id", "covered", F.forall("filled", lambda s: s["told"] == s["here"]).alias("same")
    )
    totals = told.groupBy("item_id").agg(F.countDistinct("item_position").alias("total"), F.countDistinct(F.when(F.col("item_content"), F.col("item_position"))).alias("total_content"))
    found = sound.groupBy("doc", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.bool_and("same").alias("same"))
    of_all = F.size("covered") / F.col("total")
    of_content = F.size(F.filter("covered", lambda c: c["item_content"])) / F.col("total_content")
    rated = found.join(totals, "item_id").withColumn("similarity", F.when(2 * F.col("total_content") >= F.col("total"), F.greatest(of_all, of_content)).otherwise(of_all))
    return rated.where(F.col("similarity") >= similarity).select("doc", "item_id", "similarity", F.when(F.col("same"), "exact").otherwise("restated").alias("kind"))


def _token_counts(items: DataFrame) -> DataFrame:
    """n, the tokens of each item, cut as template() cuts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(t.split()) for t in batch.column("text").to_pylist()], pa.int32())})

    return items.select("text").mapInArrow(run, "n int")


def without_leaks(docs: DataFrame, benchmark: DataFrame, path: str) -> DataFrame:
    """Rows of docs that no item leaked into, all columns as they were."""
    found = _leaks(_keyed(docs), benchmark, path, SIMILARITY, FILTER_BITS).select(F.col("doc").alias("leak")).distinct()
    found = shared.settled(found, f"{path}/leaks")
    text = F.coalesce(docs["text"], F.lit(""))
    doc = F.coalesce(docs["doc_id"].cast("long").cast("string"), F.concat(F.lit("="), F.sha2(text, 256)))
    return docs.join(found, doc == found["leak"], "left_anti")
