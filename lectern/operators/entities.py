"""What the entity tables are asked and told: lookups, orders, inserts with ids, and changes of single columns.

Tables are DataFrames with the columns of lectern.sources.schema; a change gives the table as it is afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import relational
from lectern.sources import library

# The orders in which rows of a book, character or thread are listed.
ORDERS = {
    "chapters": ("start_page", "id"), "page_layouts": ("page",), "page_texts": ("page",), "chunks": ("ordinal",), "bookmarks": ("page", "id"), "highlights": ("page", "paragraph", "start_offset"),
    "characters": ("first_page", "id"), "character_names": ("first_page", "id"), "character_facts": ("page", "id"), "relations": ("page", "id"), "chat_messages": ("id",),
}


def of(rows: DataFrame, kind: str, owner: str = "book_id", **key) -> DataFrame:
    """Rows of one owner, or of all, in the order of their kind."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(owner, *ORDERS[kind])


def one(rows: DataFrame, **key) -> DataFrame:
    """The row with a key; of several the first by all columns."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(*rows.columns).limit(1)


def in_range(rows: DataFrame, first: int, last: int, page: str = "page") -> DataFrame:
    return rows.where(F.col(page).between(first, last))


def insert(current: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """current and new, the new rows with ids after the greatest so far, in the order of the integer column order (which new has besides).

    The new rows are numbered in blocks, so a large insert is not numbered by one task.
    """
    last = current.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    placed = library.numbered(new.withColumn("_all", F.lit(0)), "_all", order, "_place").crossJoin(F.broadcast(last))  # one row
    return current.unionByName(placed.withColumn(key, (F.col("_last") + F.col("_place")).cast("long")).select(*current.columns))


def changed(rows: DataFrame, key: Column, **values) -> DataFrame:
    """The table with columns set in the rows that key tells."""
    return relational.update(rows, F.coalesce(key, F.lit(False)), **values)


# Books ---------------------------------------------------------------------------------------------


def with_status(books: DataFrame, status: str) -> DataFrame:
    return books.where(F.col("index_status") == status).select("id")


def not_prepared(books: DataFrame) -> DataFrame:
    return books.where(~F.col("ai_prepared") & (F.col("index_status") != "FAILED")).select("id", "index_status", "index_progress")


def set_prepared(books: DataFrame, book: Column) -> DataFrame:
    return changed(books, book, ai_prepared=True)


def set_index_state(books: DataFrame, book: Column, status: str, progress: float) -> DataFrame:
    return changed(books, book, index_status=status, index_progress=F.lit(progress).cast("float"))


def set_metadata(books: DataFrame, book: Column, title: Column, author: Column) -> DataFrame:
    return changed(books, book, title=title, author=author)


def opened(books: DataFrame, book: Column, at: Column) -> DataFrame:
    return changed(books, book, last_opened_at=at)


def set_document_type(books: DataFrame, book: Column, kind: str, source: str) -> DataFrame:
    return changed(books, book, document_type=kind, document_type_source=source)


# Pages and chunks -----------------------------------------------------------------------------------


def readable_paragraphs(page_texts: DataFrame) -> DataFrame:
    """Paragraphs and levels of the pages that a cleaner has been over; neither raw nor clean text is read."""
    return page_texts.where("cleaner_version > 0").select("book_id", "page", "paragraphs", "levels", "cleaner_version")


def without_book(rows: DataFrame, book: str) -> DataFrame:
    return relational.delete(rows, F.col("book_id") == book)


def upserted(rows: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new take the place of those with their key; there the last by all columns counts."""
    marked = rows.withColumn("_turn", F.lit(0)), new.select(*rows.columns).withColumn("_turn", F.lit(1))
    return relational.upsert(*marked, keys, "_turn").drop("_turn")


# People ---------------------------------------------------------------------------------------------


def lower_first_page(characters: DataFrame, pages: DataFrame) -> DataFrame:
    """characters with first_page no later than the pages (character_id, page) told."""
    least = pages.groupBy(F.col("character_id").alias("id")).agg(F.min("page").alias("_page"))
    return characters.join(least, "id", "left").withColumn("first_page", F.least("first_page", "_page")).select(*characters.columns)


def set_primary(names: DataFrame, chosen: DataFrame) -> DataFrame:
    """names with primary_from set to page for the ids told (id, page)."""
    told = chosen.groupBy("id").agg(F.max("page").alias("_page"))
    return names.join(told, "id", "left").withColumn("primary_from", F.coalesce("_page", "primary_from")).select(*names.columns)


def end_relation(relations: DataFrame, relation: Column, page: Column) -> DataFrame:
    return changed(relations, relation, ended_at=page)
