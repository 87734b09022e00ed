"""Names of people as a table, found in the pages of their own book: whole words, capitalised, accents and case aside, leftmost and longest first.

Of a page only the words with a capital travel, each with as many characters as the longest name has, and meet the names of the book that begin with
that word. Nothing is collected but the length of the longest name. Where found names overlap, the earlier one stays (of those that start together the longest);
this is decided within a run of overlapping finds, not a page.

Defined results: a null or empty text has no names. Of names of a book that are equal but for accents and case the first in order counts. Pages without a book find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import _fold_letter
from lectern.operators.text import TEXTS_AT_ONCE, sliced

_WORD = regex.compile(r"\w+")
_CAPITALS = "book_id string, doc_id long, start int, word string, ahead string"


def _folded(text: str) -> str:
    return "".join(map(_fold_letter, text))


def _keyed(names: DataFrame) -> DataFrame:
    """names with book_id as text, and word, key: what each name begins with and its form for comparison. Names that begin with no word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_folded((n or "").strip()) for n in batch.column("name").to_pylist()]
            words = [m[0] if (m := _WORD.match(k)) else None for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.string()), pa.array(keys, pa.string())], names=["name", "word", "key"])

    forms = names.select("name").distinct().mapInArrow(run, "name string, word string, key string").where("word IS NOT NULL")
    return names.withColumn("book_id", F.col("book_id").cast("string")).join(forms, "name")


def listed(names: DataFrame, order: str = "name") -> DataFrame:
    """book_id, word, key, name of the names (book_id, name and the column order), one a key."""
    return _keyed(names.select("book_id", "name", F.col(order).alias("turn"))).groupBy("book_id", "word", "key").agg(F.min_by("name", F.struct("turn", "name")).alias("name"))


def _capitals(pages: DataFrame, longest: int) -> DataFrame:
    """Every word with a capital: where it starts, itself and what follows, folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TEXTS_AT_ONCE):
            rows: list[tuple] = []
            for book, doc, text in zip(*(part.column(c).to_pylist() for c in ("book_id", "doc_id", "text")), strict=True):
                folded = _folded(text)
                for m in _WORD.finditer(folded):
                    at = m.start()
                    if text[at].isupper() and not (at and text[at - 1].isalnum()):
                        rows.append((book, doc, at, m[0], folded[at : at + longest + 1]))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["book_id", "doc_id", "start", "word", "ahead"])

    named = pages.select(F.col("book_id").cast("string").alias("book_id"), F.col("doc_id").cast("long").alias("doc_id"), "text").where("book_id IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(run, _CAPITALS)


def found(pages: DataFrame, names: DataFrame, order: str = "name") -> DataFrame:
    """book_id, doc_id, start, end, name, key of every name of a book in its pages. pages: book_id, doc_id (unique), text."""
    known = listed(names, order)
    longest = known.agg(F.max(F.length("key"))).first()[0] or 0
    met = _capitals(pages, longest).join(known, ["book_id", "word"])
    n = F.length("key")
    after = F.substr("ahead", n + 1, F.lit(1))
    whole = met.where(F.startswith("ahead", "key") & ~after.rlike(r"^[\p{L}\p{N}]"))
    each = whole.groupBy("book_id", "doc_id", "start").agg(F.max_by(F.struct((F.col("start") + n).alias("end"), "name", "key"), n).alias("m")).select("book_id", "doc_id", "start", "m.end", "m.name", "m.key")
    before = Window.partitionBy("book_id", "doc_id").orderBy("start")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = each.withColumn("fresh", (F.coalesce(reached, F.lit(0)) <= F.col("start")).cast("int")).withColumn("run", F.sum("fresh").over(before))
    some = runs.groupBy("book_id", "doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("start", "end", "name", "key"))).alias("finds"))
    none = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start:int,end:int,name:string,key:string>>").alias("kept"))
    step = lambda s, f: F.when(f["start"] >= s["free"], F.struct(f["end"].alias("free"), F.concat(s["kept"], F.array(f)).alias("kept"))).otherwise(s)
    kept = F.aggregate("finds", none, step, lambda s: s["kept"])
    return some.select("book_id", "doc_id", F.inline(kept))


def people_in(pages: DataFrame, names: DataFrame, order: str = "name") -> DataFrame:
    """book_id, doc_id, character_id, place (from 0): the people of a book that a page names, by first appearance. names: book_id, name, character_id.

    A name that several people have tells nobody.
    """
    owners = _keyed(names.select("book_id", "name", "character_id")).groupBy("book_id", "key").agg(F.countDistinct("character_id").alias("n"), F.min("character_id").alias("character_id"))
    alone = owners.where("n = 1").select("book_id", "key", "character_id")
    first = found(pages, names, order).join(alone, ["book_id", "key"]).groupBy("book_id", "doc_id", "character_id").agg(F.min("start").alias("start"))
    place = F.row_number().over(Window.partitionBy("book_id", "doc_id").orderBy("start", "character_id")) - 1
    return first.select("book_id", "doc_id", "character_id", place.alias("place"))
