"""A book's index when its text was read anew: old chapters, newly found entries and what hangs on the chapters, merged in one plan.

Books are taken as they are: with the same chapters only sections come in (SECTIONS); where nothing depends on the old chapters the new
ones take their place (REBUILD) and chunks are keyed anew; else what is new comes in as sections below the old chapters (INSERT). A book that has sections already, or for
which nothing was found, stays as it is.

Chunks find their chapter by stretches of pages: a chapter is put under each stretch it reaches into, a chunk under that of its first page, so the
join is on (book, stretch) and a book with a third of all pages is many keys. Numbers and ends of entries need a book's entries in order, and only these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import location

STRETCH = 256
SECTIONS, REBUILD, INSERT = "SECTIONS", "REBUILD", "INSERT"
_CHAPTER = ("book_id", "number", "title", "start_page", "end_page", "level", "source")


def ways(old: DataFrame, entries: DataFrame, dependents: DataFrame) -> DataFrame:
    """book_id, way of the books that change. dependents: book_id of what refers to chapters other than chunks."""
    starts = lambda df, name: df.groupBy("book_id").agg(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.col("start_page")))).alias(name))
    plain = old.groupBy("book_id").agg(F.max("level").alias("deepest"))
    both = starts(old, "before").join(plain.where("deepest = 0"), "book_id").join(starts(entries, "found"), "book_id")
    used = dependents.select("book_id").distinct().withColumn("used", F.lit(True))
    way = F.when(F.col("before") == F.col("found"), SECTIONS).when(F.col("used").isNull(), REBUILD).otherwise(INSERT)
    return both.join(used, "book_id", "left").select("book_id", way.alias("way"))


def _numbered(entries: DataFrame, page_counts: DataFrame) -> DataFrame:
    """entries (book_id, start_page, level, idx, ...) with number (from 1) and end_page, in order of page, level and idx."""
    placed = entries.join(page_counts, "book_id").withColumn("idx", F.struct("level", "idx"))
    return location.numbered_entries(placed, F.col("page_count")).withColumn("number", F.greatest("number", F.lit(1)))


def merged(old: DataFrame, found: DataFrame, dependents: DataFrame, page_counts: DataFrame) -> DataFrame:
    """The chapters after the upgrade (book_id, number, title, start_page, end_page, level, source, way: null where the book stays as it is).

    old: chapters; found: book_id, idx, title, start_page, level, source; page_counts: book_id, page_count.
    """
    entries = location.normalised_entries(found)
    way = ways(old, entries, dependents)
    marked = old.join(way, "book_id", "left")
    kept = marked.where("way IS NULL OR way <> 'REBUILD'").select(*_CHAPTER, "way")
    new = entries.join(way, "book_id")
    rebuilt = _numbered(new.where("way = 'REBUILD'"), page_counts).select(*_CHAPTER, "way")
    there = old.select("book_id", "start_page", "title")
    fresh = new.where("way = 'INSERT'").join(there, ["book_id", "start_page", "title"], "left_anti").withColumn("level", F.greatest("level", F.lit(1)))
    sections = new.where("way = 'SECTIONS' AND level > 0").unionByName(fresh).select("book_id", "idx", "title", "start_page", "level", "source", "way")
    below = marked.where("way <> 'REBUILD'").select("book_id", F.lit(-1).cast(found.schema["idx"].dataType).alias("idx"), "title", "start_page", "level", "source", "way")
    inserted = _numbered(below.unionByName(sections), page_counts).where("level > 0").select(*_CHAPTER, "way")
    return kept.unionByName(rebuilt).unionByName(inserted)


def keyed_anew(chunks: DataFrame, chapters: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """chunks (id, book_id, start_page, chapter) of rebuilt books with the number of the last chapter of level 0 whose pages hold their first page, or null; others as they were.

    chapters: as merged gives them.
    """
    spans = chapters.where("way = 'REBUILD' AND level = 0").select(
        F.col("book_id").alias("_book"), F.col("start_page").alias("_start"), F.col("end_page").alias("_end"), F.col("number").alias("_number"),
        F.explode(F.sequence(F.floor(F.col("start_page") / stretch), F.floor(F.col("end_page") / stretch))).alias("_stretch"),
    )
    here = F.floor(chunks["start_page"] / stretch)
    within = (chunks["book_id"] == spans["_book"]) & (here == spans["_stretch"]) & chunks["start_page"].between(spans["_start"], spans["_end"])
    best = chunks.join(spans, within).groupBy("id").agg(F.max_by("_number", "_start").alias("_number"))
    rebuilt = chapters.where("way = 'REBUILD'").select("book_id").distinct().withColumn("_rebuilt", F.lit(True))
    joined = chunks.join(best, "id", "left").join(rebuilt, "book_id", "left")
    return joined.withColumn("chapter", F.when(F.col("_rebuilt"), F.col("_number")).otherwise(F.col("chapter"))).select(*chunks.columns)
