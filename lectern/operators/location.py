"""Page ranges: quarters of a range, merging, limits, chapters with parts; and chapter outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stretch(first: Column, last: Column, part: Column) -> Column:
    """(first, last) of the START, MIDDLE or END quarter of a page range, at least one page; the whole range otherwise."""
    size = last - first + 1
    width = F.greatest(F.lit(1), F.least(F.ceil(size * 0.25), size)).cast("int")
    middle = first + F.floor((size - width) / 2).cast("int")
    begin = F.when(part == "END", last - width + 1).when(part == "MIDDLE", middle).otherwise(first)
    end = F.when(part == "START", first + width - 1).when(part == "MIDDLE", middle + width - 1).otherwise(last)
    return F.struct(begin.alias("first"), end.alias("last"))


def merge_ranges(ranges: DataFrame, group: str = "book_id") -> DataFrame:
    """Ranges (first, last) of each group merged where one starts at most a page after the others end."""
    order = Window.partitionBy(group).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def limited(ranges: DataFrame, limit: Column) -> DataFrame:
    """Ranges cut at the last page read; what lies beyond goes. A null limit changes nothing."""
    return ranges.withColumn("last", F.when(limit.isNull(), F.col("last")).otherwise(F.least("last", limit))).where("first <= last")


def nearest_part(chapters: DataFrame, is_part: Column, group: str = "book_id", order: str = "number") -> Column:
    """The title up to its first dot of the last part heading at or before each chapter."""
    title = F.when(is_part, F.trim(F.substring_index("title", ".", 1)))
    return F.last(title, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def normalised_entries(entries: DataFrame, group: str = "book_id") -> DataFrame:
    """Entries (start_page, level, title, idx) in page order: the first chapter of a page, each section once per page and title."""
    key = F.when(F.col("level") > 0, F.col("title"))
    turn = F.row_number().over(Window.partitionBy(group, F.col("level") == 0, "start_page", key).orderBy("idx"))
    return entries.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def numbered_entries(entries: DataFrame, page_count: Column, group: str = "book_id") -> DataFrame:
    """Entries with number (chapters so far) and end_page: a page before the next entry of the same or a higher level, else the last page; never before the start."""
    order = Window.partitionBy(group).orderBy("start_page", "idx")
    after = Window.partitionBy(group).orderBy(F.desc("start_page"), F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)  # from the end: a frame open to the end is read anew for each row
    number = F.sum((F.col("level") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.lit(None).cast("int")
    for level in (2, 1, 0):
        upto = F.last(F.when(F.col("level") <= level, F.col("start_page")), ignorenulls=True).over(after)
        following = F.when(F.col("level") == level, upto).otherwise(following)
    end = F.greatest(F.coalesce(following - 1, page_count), F.col("start_page"))
    return entries.withColumn("number", number.cast("int")).withColumn("end_page", end)
