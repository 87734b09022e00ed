"""An inverted index of the words of chunks, and full-text search through it.

A row is a word of a chunk, with where it stands (offset and size in UTF-8 bytes). The index is written in ranges of the
word, so a search for a word or its beginning reads the row groups that can hold it, not the texts; it is kept in step with
its chunks by taking out and adding the rows of those that changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import retrieval
from lectern.sources import library

_WORD = regex.compile(r"[\p{L}\p{N}]+")
ROW = "term string, id long, book_id string, start_page int, end_page int, offset int, size int"


def rows(chunks: DataFrame) -> DataFrame:
    """The index rows of chunks (id, book_id, start_page, end_page, text): words without case and accents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c in batch.itertuples(index=False):
                at, offset = 0, 0
                for m in _WORD.finditer(c.folded or ""):
                    offset += len(c.text[at : m.start()].encode())
                    size = len(c.text[m.start() : m.end()].encode())
                    out.append((m[0], c.id, c.book_id, c.start_page, c.end_page, offset, size))
                    at, offset = m.end(), offset + size
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ROW.split(", ")])

    whole = chunks.select("id", "book_id", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), "text", library.fold(F.col("text")).alias("folded"))
    return whole.mapInPandas(run, ROW)


def write(chunks: DataFrame, path: str) -> DataFrame:
    """The index as a table below path, in ranges of the word; a frequent word's rows are dealt over ranges by chunk."""
    rows(chunks).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)
    return read(chunks.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def synced(index: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after chunks were inserted or changed (changed: as rows() reads them) and deleted (id)."""
    gone = changed.select("id").union(deleted.select("id")).distinct()
    return index.join(gone, "id", "left_anti").select(*index.columns).unionByName(rows(changed))


def _matches(term: str) -> Column:
    folded = retrieval._folded_term(term)
    return F.startswith("term", F.lit(folded)) if term.endswith("*") else F.col("term") == folded


def search(index: DataFrame, terms: list[str]) -> DataFrame:
    """id, book_id, start_page, end_page, score as retrieval.text_search: minus the length of the list of hits. Counts are partial sums."""
    hits = None
    for number, term in enumerate(terms):
        written = F.length(F.concat_ws(" ", F.lit("0"), F.lit(str(number)), F.col("offset").cast("string"), F.col("size").cast("string")))
        some = index.where(_matches(term)).select("id", "book_id", "start_page", "end_page", written.alias("n"))
        hits = some if hits is None else hits.unionByName(some)
    if hits is None:
        return index.where(F.lit(False)).select("id", "book_id", "start_page", "end_page", F.lit(0.0).alias("score"))
    total = (F.sum("n") + F.count("*") - 1) * -1
    return hits.groupBy("id", "book_id", "start_page", "end_page").agg(total.cast("double").alias("score"))
