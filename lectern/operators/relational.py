"""Row-level work on entity tables: upserts, deletes with their consequences, re-keying, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """current with changes applied: of the rows with one key the last by version stays (by all columns on a tie).

    An aggregate, so it is partially done before the shuffle and a key with many changes is no hot task.
    """
    rows = current.unionByName(changes)
    others = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(F.col(version), *[F.col(c) for c in others if c != version])).alias("row")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"row.{c}").alias(c) for c in others]).select(*rows.columns)


def update(df: DataFrame, condition: Column, **values) -> DataFrame:
    """df with columns set where the condition holds."""
    return df.withColumns({name: F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)) for name, value in values.items()})


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def cascade(children: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    """Children whose parent (column key) is not among the deleted ids (one column)."""
    gone = deleted.toDF("_gone").distinct()
    return children.join(gone, children[key] == gone["_gone"], "left_anti")


def set_null(children: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    """Children with the key nulled where their parent is deleted."""
    gone = deleted.toDF("_gone").distinct()
    joined = children.join(gone, children[key] == gone["_gone"], "left")
    return joined.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def rekey(df: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """df with ids replaced by the mapping (old_id, new_id); ids without an entry stay."""
    for column in columns:
        one = mapping.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
        df = df.join(one, df[column] == one["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
    return df


def in_order(rows: DataFrame, wanted: Sequence[int], key: str = "id") -> DataFrame:
    """Rows of the wanted ids with their place in the list; unknown ids are left out. The list is the caller's, so it is small."""
    places = rows.sparkSession.createDataFrame(list(enumerate(wanted)) or [], "place int, _id long").groupBy("_id").agg(F.min("place").alias("place"))
    return rows.join(F.broadcast(places), rows[key] == places["_id"]).drop("_id")


def remap_to_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """chunks with chapter: the number of the level-0 chapter that starts last within the chunk's pages, or null.

    An equi-join on the book with the range as a further condition; the match is an aggregate.
    """
    starts = chapters.where("level = 0").select(F.col("book_id").alias("_book"), F.col("start_page").alias("_start"), F.col("number").alias("_number"))
    within = (chunks["book_id"] == starts["_book"]) & starts["_start"].between(chunks["start_page"], chunks["end_page"])
    best = chunks.join(starts, within).groupBy("id").agg(F.max_by("_number", "_start").alias("chapter"))
    return chunks.join(best, "id", "left")


def chapter_at(rows: DataFrame, chapters: DataFrame, page: str = "page", group: str = "book_id", block_pages: int = 256) -> DataFrame:
    """rows with chapter: the number of the last chapter in order that starts at or before the page; null if none (as-of join).

    Chapters are kept by blocks of pages, each with the last chapter of the blocks before, so a lookup is an
    equi-join on book and block, and what meets in one place is a block, not a book.
    """
    block = lambda c: F.floor(F.col(c) / block_pages).alias("_block")
    starts = chapters.select(F.col(group).alias("_group"), block("start_page"), "number", "start_page")
    blocks = starts.groupBy("_group", "_block").agg(F.sort_array(F.collect_list(F.struct("number", "start_page"))).alias("_chapters"), F.max("number").alias("_last"))
    asked = rows.select(F.col(group).alias("_group"), block(page)).distinct()
    both = blocks.unionByName(asked, allowMissingColumns=True).groupBy("_group", "_block").agg(F.first("_chapters", ignorenulls=True).alias("_chapters"), F.max("_last").alias("_last"))
    before = F.max("_last").over(Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    known = both.withColumn("_before", before).drop("_last")
    keyed = rows.withColumn("_at", F.floor(F.col(page) / block_pages))
    joined = keyed.join(known, (keyed[group] == known["_group"]) & (keyed["_at"] == known["_block"]), "left")
    here = F.try_element_at(F.filter("_chapters", lambda c: c["start_page"] <= F.col(page)), F.lit(-1))["number"]
    return joined.withColumn("chapter", F.coalesce(here, "_before")).drop("_chapters", "_before", "_at", "_group", "_block")


def overlapping(rows: DataFrame, ranges: DataFrame, start: str = "start_page", end: str = "end_page") -> DataFrame:
    """rows that overlap any of the ranges (book_id, first, last), once each."""
    meets = (rows["book_id"] == ranges["book_id"]) & (rows[start] <= ranges["last"]) & (rows[end] >= ranges["first"])
    return rows.join(ranges, meets, "left_semi")


def contained(rows: DataFrame, ranges: DataFrame, start: str = "start_page", end: str = "end_page") -> DataFrame:
    inside = (rows["book_id"] == ranges["book_id"]) & (rows[start] >= ranges["first"]) & (rows[end] <= ranges["last"])
    return rows.join(ranges, inside, "left_semi")


def first_by(rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each key (distinctBy)."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
