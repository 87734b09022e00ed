"""Key points of chapters: what is missing, what it costs, what may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(chapters: DataFrame, saved: DataFrame) -> DataFrame:
    return chapters.join(saved.select(F.col("chapter_id").alias("id")), "id", "left_anti")


def points_range(pages: Column) -> tuple[Column, Column]:
    """Least and most points of a chapter of so many pages."""
    return F.when(pages <= 2, 1).otherwise(2), F.least(F.greatest(F.floor((pages + 1) / 2), F.lit(3)), F.lit(15)).cast("int")


def parsed(answer: Column, first: Column, last: Column) -> Column:
    """Points (text, page) of a JSON answer: blank ones go, pages are held within first and last."""
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    points = F.from_json(body, "struct<points:array<struct<text:string,page:int>>>")["points"]
    full = F.filter(points, lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")
    held = F.transform(full, lambda p: F.struct(F.trim(p["text"]).alias("text"), F.least(F.greatest(F.coalesce(p["page"], first), first), last).alias("page")))
    return F.coalesce(held, F.array().cast("array<struct<text:string,page:int>>"))


def until(points: Column, page: Column) -> Column:
    """Points up to a page; all without one."""
    return F.filter(points, lambda p: page.isNull() | (p["page"] <= page))


def plan(chapters: DataFrame, saved: DataFrame, limit: Column) -> DataFrame:
    """chapters with way: POINTS and their text for a chapter that has some to show, NOTHING for an empty one, TEXT for refused or missing ones."""
    joined = chapters.join(saved.select(F.col("chapter_id").alias("id"), "status", "points"), "id", "left")
    shown = until(F.col("points"), limit)
    way = F.when(F.col("status") == "EMPTY", "NOTHING").when((F.col("status") == "READY") & (F.size(shown) > 0), "POINTS").when(F.col("status") == "READY", "NOTHING").otherwise("TEXT")
    text = F.array_join(F.transform(shown, lambda p: F.concat(F.lit("- "), p["text"], F.lit(" (p. "), p["page"].cast("string"), F.lit(")"))), "\n")
    return joined.withColumn("way", way).withColumn("text", F.when(way == "POINTS", text)).drop("status", "points")


def recap(planned: DataFrame) -> DataFrame:
    """book_id, recap: titles and points of the chapters that have some, in order. A book's chapters are its outline, not its text."""
    with_points = planned.where("way = 'POINTS'")
    return with_points.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.concat_ws("\n", "title", "text").alias("t")))), lambda x: x["t"]), "\n\n").alias("recap"))
