"""The library's relational queries: lookups, joins, changes, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import relational
from lectern.plans.registry import query
from lectern.sources import kept_tables, library, scratch
from lectern.sources.tables import table

PAGES_OF = "WITH " + library.PAGES_SQL


@query(
    "library_overview",
    f"""WITH {library.BOOKS_SQL}, {library.LOG_SQL}, pos AS (SELECT reader, arg_max(page, (ts, event_id)) AS page, max(ts) AS opened FROM reading_log WHERE event_type = 'view' GROUP BY reader),
mark AS (SELECT reader, arg_max(page, (ts, event_id)) AS bookmark FROM reading_log WHERE event_type = 'click' GROUP BY reader)
SELECT book_id, page_count, coalesce(p.page, 0) AS page, bookmark, CASE WHEN page_count > 0 THEN round(coalesce(p.page, 0)::DOUBLE / page_count, 9) ELSE 0 END AS progress
FROM lib_books LEFT JOIN pos p ON 'src' || p.reader = book_id LEFT JOIN mark m ON 'src' || m.reader = book_id""",
)
def library_overview(spark: SparkSession, folder: str) -> DataFrame:
    log = library.reading_log(spark, folder)
    latest = lambda kind: log.where(F.col("event_type") == kind).groupBy("reader").agg(F.max_by("page", F.struct("ts", "event_id")).alias(kind))
    reader = F.concat(F.lit("src"), F.col("reader").cast("string"))
    opened, marked = (latest(kind).select(reader.alias("book_id"), kind) for kind in ("view", "click"))
    page = F.coalesce("view", F.lit(0))
    shelf = library.books(spark, folder).join(opened, "book_id", "left").join(marked, "book_id", "left")
    return shelf.select("book_id", "page_count", page.alias("page"), F.col("click").alias("bookmark"), F.coalesce(F.round(F.try_divide(page, F.col("page_count")), 9), F.lit(0.0)).alias("progress"))


@query("book_by_id", f"WITH {library.BOOKS_SQL} SELECT * FROM lib_books WHERE book_id = 'src3'")
def book_by_id(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "documents").where("source = 'src3'")
    return one.groupBy(F.col("source").alias("book_id")).agg(F.count("*").cast("int").alias("page_count"))


@query(
    "books_without_chunks",
    f"WITH {library.BOOKS_SQL} SELECT book_id FROM lib_books b WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id AND e.label < 1 WHERE d.source = b.book_id AND d.doc_id % 50 < 17)",
)
def books_without_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("book_id"))
    first = table(spark, folder, "embeddings").where("label < 1").select(F.col("vec_id").alias("doc_id"))
    indexed = docs.where("doc_id % 50 < 17").join(first, "doc_id", "left_semi")
    return library.books(spark, folder).join(indexed, "book_id", "left_anti").select("book_id")


@query("pages_of_book_from", f"{PAGES_OF} SELECT doc_id, page, lang FROM (SELECT * FROM lib_pages WHERE book_id = 'src3' AND page >= 4 ORDER BY page LIMIT 5) WHERE lang = 'en'")
def pages_of_book_from(spark: SparkSession, folder: str) -> DataFrame:
    """The language filter comes after the limit, as a reader that fetches five pages sees it."""
    window = library.pages(spark, folder, "lang").where("book_id = 'src3' AND page >= 4").orderBy("page").limit(5)
    return window.where("lang = 'en'").select("doc_id", "page", "lang")


@query("pages_in_range", f"{PAGES_OF} SELECT doc_id, book_id, page FROM lib_pages WHERE page BETWEEN 3 AND 6")
def pages_in_range(spark: SparkSession, folder: str) -> DataFrame:
    return library.pages(spark, folder).where("page BETWEEN 3 AND 6").select("doc_id", "book_id", "page")


@query("pages_up_to_date", "SELECT count(*) AS n FROM documents WHERE lang = 'en' AND n_chars > 500")
def pages_up_to_date(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("lang = 'en' AND n_chars > 500").agg(F.count("*").alias("n"))


@query("books_with_outdated_text", "SELECT DISTINCT source AS book_id FROM documents WHERE n_chars > 0 AND n_chars < 300")
def books_with_outdated_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("n_chars > 0 AND n_chars < 300").select(F.col("source").alias("book_id")).distinct()


@query("books_have_chunks", "SELECT source AS book_id, count(*) > 0 AS has_chunks, count(*) FILTER (WHERE n_chars > 2000) > 0 AS has_long FROM documents GROUP BY source")
def books_have_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(F.col("source").alias("book_id")).agg((F.count("*") > 0).alias("has_chunks"), F.bool_or(F.col("n_chars") > 2000).alias("has_long"))


@query("chunk_counts", "SELECT source AS book_id, count(*) AS n FROM documents GROUP BY source")
def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(F.col("source").alias("book_id")).agg(F.count("*").alias("n"))


@query("chunks_by_ids", "SELECT d.doc_id AS id, w.place, d.lang FROM documents d JOIN (VALUES (17, 0), (3, 1), (99, 3), (42, 4)) w(id, place) ON d.doc_id = w.id")
def chunks_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    return relational.in_order(rows, [17, 3, -5, 99, 42, 3]).select("id", "place", "lang")


@query("chunk_ids_in_pages", f"WITH {library.CHUNKS_SQL} SELECT id, book_id, ordinal FROM lib_chunks WHERE start_page >= 5 AND end_page <= 9")
def chunk_ids_in_pages(spark: SparkSession, folder: str) -> DataFrame:
    return library.chunks(spark, folder).where("start_page >= 5 AND end_page <= 9").select("id", "book_id", "ordinal")


@query("book_vectors", "SELECT d.source AS book_id, e.vec_id AS chunk_id, e.label AS model FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.label = 3")
def book_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book_id"))
    return library.vectors(spark, folder).where("model = 3").join(docs, "chunk_id").select("book_id", "chunk_id", "model")


@query("vector_counts", "SELECT d.source AS book_id, e.label AS model, count(*) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY ALL")
def vector_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book_id"))
    return library.vectors(spark, folder).join(docs, "chunk_id").groupBy("book_id", "model").agg(F.count("*").alias("n"))


@query("pending_chunks", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_chunks(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id")).join(done, "id", "left_anti")


@query("orphaned_vectors", "SELECT vec_id AS chunk_id, label AS model FROM embeddings WHERE NOT (label <> 3 AND vec_id IN (SELECT doc_id FROM documents WHERE source = 'src3'))")
def orphaned_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """What stays after the vectors of other models go from one book."""
    book = table(spark, folder, "documents").where("source = 'src3'").select(F.col("doc_id").alias("chunk_id"))
    rows = library.vectors(spark, folder).select("chunk_id", "model")
    return rows.where("model = 3").unionByName(rows.where("model <> 3").join(book, "chunk_id", "left_anti"))


@query(
    "remap_chunks_to_chapters",
    f"""WITH {library.CHUNKS_SQL}, wide AS (SELECT id, book_id, start_page, end_page + 3 AS end_page FROM lib_chunks)
SELECT w.id, max(c.number) AS chapter FROM wide w LEFT JOIN lib_chapters c ON c.book_id = w.book_id AND c.level = 0 AND c.start_page BETWEEN w.start_page AND w.end_page GROUP BY w.id""",
)
def remap_chunks_to_chapters(spark: SparkSession, folder: str) -> DataFrame:
    wide = library.chunks(spark, folder).withColumn("end_page", F.col("end_page") + 3)
    return relational.remap_to_chapters(wide, library.chapters(spark, folder)).select("id", "chapter")


@query(
    "current_chapter_asof",
    f"""WITH {library.CHAPTERS_SQL}, {library.LOG_SQL}, seen AS (SELECT event_id, 'src' || reader AS book_id, page FROM reading_log)
SELECT a.event_id, max(c.number) AS chapter FROM seen a LEFT JOIN lib_chapters c ON c.book_id = a.book_id AND c.start_page <= a.page GROUP BY a.event_id""",
)
def current_chapter_asof(spark: SparkSession, folder: str) -> DataFrame:
    log = library.reading_log(spark, folder).select("event_id", F.concat(F.lit("src"), F.col("reader").cast("string")).alias("book_id"), "page")
    return relational.chapter_at(log, library.chapters(spark, folder)).select("event_id", "chapter")


@query("books_deleted_cascade", "SELECT doc_id, source AS book_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def books_deleted_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("book_id"))
    return relational.cascade(docs, "book_id", docs.where("book_id IN ('src1', 'src2')").select("book_id"))


@query("chapters_deleted_set_null", f"WITH {library.CHUNKS_SQL} SELECT id, CASE WHEN ordinal // 20 + 1 <> 2 THEN ordinal // 20 + 1 END AS chapter FROM lib_chunks")
def chapters_deleted_set_null(spark: SparkSession, folder: str) -> DataFrame:
    rows = library.chunks(spark, folder).select("id", (F.floor(F.col("ordinal") / 20) + 1).alias("chapter"))
    gone = library.chapters(spark, folder).where("number = 2").select("number")
    return relational.set_null(rows, "chapter", gone).select("id", "chapter")


@query("books_updated", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'TEXT_READY' ELSE 'PENDING' END AS status, CASE WHEN n_chars < 500 THEN 1.0::DOUBLE ELSE 0 END AS progress FROM documents")
def books_updated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "n_chars", F.lit("PENDING").alias("status"), F.lit(0.0).alias("progress"))
    return relational.update(rows, F.col("n_chars") < 500, status="TEXT_READY", progress=1.0).select("doc_id", "status", "progress")


@query("upsert_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.struct("ts", "event_id").alias("version"), "event_type", "event_id")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return relational.upsert(old, new, ["user_id"], "version").select("user_id", "event_type", "event_id")


@query("dependent_count", "SELECT (SELECT count(*) FROM labels WHERE quality = 0) + (SELECT count(*) FROM labels WHERE toxic = 1) AS n")
def dependent_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").agg((F.count_if(F.col("quality") == 0) + F.count_if(F.col("toxic") == 1)).alias("n"))


@query(
    "title_lookup",
    """SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(trim(left(b.text, 40)))) GROUP BY b.item_id""",
)
def title_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first document that contains a title, ignoring case. Joined on the title's longest whole word first, then compared in full."""
    asked = table(spark, folder, "benchmark").select("item_id", F.lower(F.trim(F.left("text", F.lit(40)))).alias("title"))
    inner = F.slice(F.split("title", r"\s+"), 2, F.greatest(F.size(F.split("title", r"\s+")) - 2, F.lit(0)))
    word = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(-F.length(w), w.alias("w")))), 1)["w"]
    keyed = asked.select("item_id", "title", word.alias("word"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).join(keyed.select("word").distinct(), "word", "left_semi")
    near = keyed.join(held, "word").join(docs, "doc_id").where(F.contains(F.lower("text"), F.col("title")))
    first = near.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    return asked.select("item_id").join(first, "item_id", "left")


@query("library_sorted", f"WITH {library.BOOKS_SQL} SELECT book_id, page_count, CAST(row_number() OVER (ORDER BY page_count DESC, lower(book_id)) AS INTEGER) AS place FROM lib_books")
def library_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each book; books are few, one row each, and numbered after aggregation."""
    from pyspark.sql import Window

    rows = library.books(spark, folder)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("page_count").desc(), F.lower("book_id"))))


@query("first_per_source_and_lang", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def first_per_source_and_lang(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))


@query("set_operations", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT vec_id FROM embeddings WHERE label = 0")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    either = labels.where("quality = 0").select("doc_id").union(labels.where("toxic = 1").select("doc_id")).distinct()
    return either.join(table(spark, folder, "embeddings").where("label = 0").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def _kept(spark: SparkSession, folder: str) -> kept_tables.Tables:
    """Customers, their orders, the lines of these and who supplies them, as tables kept in the shared folder."""
    tables = [
        kept_tables.Kept("customer", "c_custkey long, c_name string, c_acctbal double", ("c_custkey",)),
        kept_tables.Kept("supplier", "s_suppkey long, s_name string", ("s_suppkey",), 4),
        kept_tables.Kept("orders", "o_orderkey long, o_custkey long, o_totalprice double", ("o_orderkey",)),
        kept_tables.Kept("lineitem", "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double", ("l_orderkey", "l_linenumber")),
    ]
    references = [
        kept_tables.Reference("orders", "o_custkey", "customer", kept_tables.CASCADE),
        kept_tables.Reference("lineitem", "l_orderkey", "orders", kept_tables.CASCADE),
        kept_tables.Reference("lineitem", "l_suppkey", "supplier", kept_tables.SET_NULL),
    ]
    kept = kept_tables.Tables(spark, scratch.workspace(spark, "tables"), tables, references)
    filled = kept.transaction()
    for each in tables:
        (filled.put if each.name == "lineitem" else filled.add)(each.name, table(spark, folder, each.name).select(*each.columns))  # lines have repeated keys
    filled.commit()
    return kept


@query(
    "tables_changed",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 4 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 40 <> 3), o AS (SELECT * FROM orders WHERE o_custkey % 40 <> 3 AND o_orderkey % 100 <> 7),
l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 10 <> 1 THEN l_suppkey END AS l_suppkey FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders))
SELECT 'customer' AS name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, count(*) FILTER (WHERE c_acctbal = 0) AS marked FROM c
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), 0 FROM o UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey * 8 + l_linenumber) AS BIGINT), count(*) FILTER (WHERE l_suppkey IS NULL) FROM l
UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT), 0 FROM supplier WHERE s_suppkey % 10 <> 1""",
)
def tables_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Some customers, orders and suppliers go with what refers to them, some customers change; what the tables hold then."""
    kept = _kept(spark, folder)
    change = kept.transaction()
    customers = kept.read("customer")
    change.put("customer", customers.where("c_custkey % 50 = 4").withColumn("c_acctbal", F.lit(0.0)))
    change.delete("customer", customers.where("c_custkey % 40 = 3").select("c_custkey"))
    change.delete("orders", kept.read("orders").where("o_orderkey % 100 = 7").select("o_orderkey"))
    change.delete("supplier", kept.read("supplier").where("s_suppkey % 10 = 1").select("s_suppkey"))
    change.commit()
    told = None
    for name, keys, marked in (
        ("customer", F.col("c_custkey"), F.col("c_acctbal") == 0), ("orders", F.col("o_orderkey"), F.lit(False)),
        ("lineitem", F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_suppkey").isNull()), ("supplier", F.col("s_suppkey"), F.lit(False)),
    ):
        some = kept.read(name).agg(F.count("*").alias("n"), F.sum(keys).cast("long").alias("keys"), F.count_if(marked).alias("marked")).select(F.lit(name).alias("name"), "n", "keys", "marked")
        told = some if told is None else told.unionByName(some)
    return told
