"""Derived relations over the input tables, each with the DuckDB text of the same relation.

A book is a source of documents, a page one of its documents in the order of doc_id. Page numbers are
counted in blocks of doc_id and shifted by the counts of the blocks before, so that a book with a third
of all pages is not numbered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.tables import table

PAGES_PER_CHAPTER = 20
NUMBER_BLOCK = 4096

# Letters and what they are without their accents (all scripts keep their other letters).
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: Accents that the location rules fold; ñ stays.
LOCATION_ACCENTED = "áéíóúüàèìòù"
LOCATION_PLAIN = "aeiouuaeiou"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with its place (from 1) within group by the distinct integer column order, without one task per group."""
    block = F.floor(F.col(order) / NUMBER_BLOCK)
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col(group).alias("_group"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order))
    placed = blocked.withColumn("_within", within)
    joined = placed.join(shifts, (placed[group] == shifts["_group"]) & (placed["_block"] == shifts["_at"]))
    return joined.withColumn(name, (F.col("_within") + F.col("_shift")).cast("int")).drop("_block", "_group", "_at", "_shift", "_within")


def pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """book_id, page, doc_id and the named further columns of documents."""
    docs = table(spark, folder, "documents").select(F.col("source").alias("book_id"), "doc_id", *columns)
    return numbered(docs, "book_id", "doc_id", "page")


def books(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(F.col("source").alias("book_id")).agg(F.count("*").cast("int").alias("page_count"))


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    starts = books(spark, folder).withColumn("start_page", F.explode(F.sequence(F.lit(1), "page_count", F.lit(PAGES_PER_CHAPTER))))
    end = F.least(F.col("start_page") + PAGES_PER_CHAPTER - 1, F.col("page_count"))
    number = ((F.col("start_page") - 1) / PAGES_PER_CHAPTER).cast("int") + 1
    title = F.concat(F.lit("Páginas "), F.col("start_page").cast("string"), F.lit("–"), end.cast("string"))
    return starts.select("book_id", number.alias("number"), "start_page", end.alias("end_page"), title.alias("title"), F.lit(0).alias("level"))


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One chunk a page: id, book_id, ordinal, start_page, end_page."""
    return pages(spark, folder, *columns).select(
        F.col("doc_id").alias("id"), "book_id", (F.col("page") - 1).alias("ordinal"), F.col("page").alias("start_page"), F.col("page").alias("end_page"), *columns
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), F.col("label").alias("model"))


def reading_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("reader"), F.floor("value").cast("int").alias("page"), "ts", "event_type")


def graph(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between suppliers and parts as one set of people; self relations are left out."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    rows = table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), day.alias("page"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("status"),
    )
    return rows.where("from_id <> to_id")


PAGES_SQL = "lib_pages AS (SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page, doc_id, text, lang FROM documents)"
BOOKS_SQL = f"{PAGES_SQL}, lib_books AS (SELECT book_id, CAST(count(*) AS INTEGER) AS page_count FROM lib_pages GROUP BY book_id)"
CHAPTERS_SQL = f"""{BOOKS_SQL}, chapter_starts AS (SELECT book_id, page_count, CAST(unnest(range(1, page_count + 1, 20)) AS INTEGER) AS start_page FROM lib_books),
lib_chapters AS (SELECT book_id, CAST((start_page - 1) // 20 + 1 AS INTEGER) AS number, start_page, least(start_page + 19, page_count) AS end_page,
  'Páginas ' || start_page || '–' || least(start_page + 19, page_count) AS title, 0 AS level FROM chapter_starts)"""
CHUNKS_SQL = f"{CHAPTERS_SQL}, lib_chunks AS (SELECT doc_id AS id, book_id, page - 1 AS ordinal, page AS start_page, page AS end_page, text FROM lib_pages)"
LOG_SQL = "reading_log AS (SELECT event_id, user_id AS reader, CAST(floor(value) AS INTEGER) AS page, ts, event_type FROM events)"
GRAPH_SQL = """graph AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_suppkey AS from_id, l_partkey AS to_id,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS page, l_returnflag AS type, l_linestatus AS status
  FROM lineitem WHERE l_suppkey <> l_partkey)"""
