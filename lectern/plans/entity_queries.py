"""Queries on entity tables, which are made from the input tables in Spark and in DuckDB alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import entities, relational
from lectern.plans.registry import query
from lectern.sources.tables import table

#: Each entity as (input table, {column: SQL that Spark and DuckDB read alike}).
ENTITIES = {
    "books": ("supplier", {
        "id": "concat('b', CAST(s_suppkey AS VARCHAR(20)))", "title": "s_name", "author": "CASE WHEN s_suppkey % 3 = 0 THEN 'A' END", "last_opened_at": "CAST(s_nationkey AS BIGINT) * 1000",
        "index_status": "CASE s_suppkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'READY' WHEN 2 THEN 'TEXT_READY' ELSE 'FAILED' END", "index_progress": "CAST((s_suppkey % 10) / 10.0 AS FLOAT)",
        "ai_prepared": "s_suppkey % 5 < 2", "document_type": "CASE WHEN s_suppkey % 2 = 0 THEN 'GENERIC' ELSE 'LITERATURE' END", "document_type_source": "'AUTO'",
    }),
    "page_layouts": ("part", {"book_id": "p_brand", "page": "p_partkey", "lines": "p_name"}),
    "page_texts": ("part", {"book_id": "p_brand", "page": "p_partkey", "raw_text": "p_type", "clean_text": "p_name", "paragraphs": "p_type", "levels": "p_size", "cleaner_version": "CAST(p_size % 3 AS INTEGER)"}),
    "chunks": ("orders", {"id": "o_orderkey", "book_id": "o_orderpriority", "ordinal": "o_orderkey % 1000", "text": "o_orderstatus"}),
    "chunk_embeddings": ("embeddings", {"chunk_id": "vec_id", "model_id": "concat('m', CAST(label AS VARCHAR(20)))"}),
    "chapters": ("customer", {"id": "c_custkey", "book_id": "c_mktsegment", "start_page": "CAST(c_nationkey * 7 + c_custkey % 7 AS BIGINT)", "title": "c_name"}),
    "chapter_key_points": ("customer", {"chapter_id": "c_custkey", "book_id": "c_mktsegment", "status": "CASE WHEN c_nationkey % 5 = 0 THEN 'REFUSED' ELSE 'READY' END", "points": "c_name"}),
    "bookmarks": ("events", {"id": "event_id", "book_id": "event_type", "page": "CAST(floor(value) AS INTEGER)", "note": "props"}),
    "highlights": ("events", {"id": "event_id", "book_id": "event_type", "page": "CAST(floor(value) AS INTEGER)", "paragraph": "CAST(event_id % 9 AS INTEGER)", "start_offset": "CAST(event_id % 50 AS INTEGER)", "note": "CASE WHEN event_id % 4 = 0 THEN props END"}),
    "characters": ("part", {"id": "p_partkey", "book_id": "p_brand", "first_page": "CAST(p_size * 10 AS INTEGER)"}),
    "character_names": ("part", {"id": "p_partkey", "character_id": "p_partkey % 100", "name": "p_name", "first_page": "CAST(p_size AS INTEGER)", "primary_from": "CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS INTEGER) END"}),
    "character_facts": ("orders", {"id": "o_orderkey", "character_id": "o_custkey", "page": "CAST(floor(o_totalprice) AS BIGINT) % 500", "text": "o_orderpriority"}),
    "relations": ("orders", {"id": "o_orderkey", "book_id": "o_orderpriority", "from_id": "o_custkey", "to_id": "o_orderkey % 50", "page": "CAST(floor(o_totalprice) AS BIGINT) % 500", "ended_at": "CASE WHEN o_orderstatus = 'F' THEN CAST(9 AS BIGINT) END"}),
    "character_scans": ("customer", {"book_id": "c_mktsegment", "chapter_id": "c_custkey", "model": "concat('m', CAST(c_nationkey AS VARCHAR(20)))"}),
    "chat_threads": ("customer", {"id": "c_custkey", "book_id": "c_mktsegment"}),
    "chat_messages": ("conversations", {"id": "conv_id * 1000 + turn", "thread_id": "conv_id", "role": "role", "text": "text"}),
    "downloaded_models": ("nation", {"id": "n_name", "kind": "CASE WHEN n_regionkey % 2 = 0 THEN 'TTS' ELSE 'EMBEDDER' END", "size_bytes": "CAST(n_nationkey AS BIGINT) * 100"}),
}


def entity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = ENTITIES[name]
    return table(spark, folder, source).select(*[F.expr(sql).alias(c) for c, sql in columns.items()])


def _sql(name: str) -> str:
    source, columns = ENTITIES[name]
    return f"e_{name} AS (SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {source})"


def asked(name: str, oracle: str, *names: str):
    """Registers a query of (rows of each entity named) with its SQL over e_<entity>."""

    def register(function: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(*[entity(spark, folder, n) for n in names])

        query(name, f"WITH {', '.join(map(_sql, names))} {oracle}")(run)
        return function

    return register


def _placed(rows: DataFrame, kind: str, owner: str = "book_id") -> DataFrame:
    """Rows of each owner with their place in the order of their kind."""
    order = Window.partitionBy(owner).orderBy(*entities.ORDERS[kind])
    return rows.withColumn("place", F.row_number().over(order))


asked("books_ids_with_status", "SELECT id FROM e_books WHERE index_status = 'READY'", "books")(lambda b: entities.with_status(b, "READY"))
asked("books_not_prepared", "SELECT id, index_status, index_progress FROM e_books WHERE NOT ai_prepared AND index_status <> 'FAILED'", "books")(entities.not_prepared)
asked("books_set_prepared", "SELECT id, ai_prepared OR id = 'b3' AS ai_prepared FROM e_books", "books")(lambda b: entities.set_prepared(b, F.col("id") == "b3").select("id", "ai_prepared"))
asked(
    "books_set_index_state",
    "SELECT id, CASE WHEN id = 'b4' THEN 'READY' ELSE index_status END AS index_status, CASE WHEN id = 'b4' THEN 1.0 ELSE index_progress END::FLOAT AS index_progress FROM e_books",
    "books",
)(lambda b: entities.set_index_state(b, F.col("id") == "b4", "READY", 1.0).select("id", "index_status", "index_progress"))
asked(
    "books_set_metadata", "SELECT id, CASE WHEN id = 'b5' THEN upper(title) ELSE title END AS title, CASE WHEN id = 'b5' THEN 'X' ELSE author END AS author FROM e_books", "books"
)(lambda b: entities.set_metadata(b, F.col("id") == "b5", F.upper("title"), F.lit("X")).select("id", "title", "author"))
asked("books_opened", "SELECT id, CASE WHEN id = 'b6' THEN last_opened_at + 77 ELSE last_opened_at END AS last_opened_at FROM e_books", "books")(
    lambda b: entities.opened(b, F.col("id") == "b6", F.col("last_opened_at") + 77).select("id", "last_opened_at")
)
asked(
    "books_set_document_type",
    "SELECT id, CASE WHEN id = 'b7' THEN 'SCIENTIFIC' ELSE document_type END AS document_type, CASE WHEN id = 'b7' THEN 'USER' ELSE document_type_source END AS document_type_source FROM e_books",
    "books",
)(lambda b: entities.set_document_type(b, F.col("id") == "b7", "SCIENTIFIC", "USER").select("id", "document_type", "document_type_source"))
asked(
    "chapters_insert_all",
    "SELECT id, book_id, title FROM e_chapters UNION ALL SELECT (SELECT max(id) FROM e_chapters) + row_number() OVER (ORDER BY id), book_id, 'new ' || title FROM e_chapters WHERE start_page < 40",
    "chapters",
)(
    lambda c: entities.insert(
        c.select("id", "book_id", "title"), c.where("start_page < 40").select("book_id", F.concat(F.lit("new "), "title").alias("title"), F.col("id").alias("turn")), "turn"
    )
)
asked("page_layouts_of_book", "SELECT book_id, page, lines, row_number() OVER (PARTITION BY book_id ORDER BY page) AS place FROM e_page_layouts", "page_layouts")(lambda p: _placed(p, "page_layouts"))
asked("page_layouts_pages", "SELECT page FROM e_page_layouts WHERE book_id = 'Brand#11'", "page_layouts")(lambda p: entities.of(p, "page_layouts", book_id="Brand#11").select("page"))
asked("page_layouts_range", "SELECT book_id, page, lines FROM e_page_layouts WHERE page BETWEEN 20 AND 90", "page_layouts")(lambda p: entities.in_range(p, 20, 90))
asked(
    "page_layouts_upsert",
    "SELECT book_id, page, CASE WHEN page % 4 = 0 THEN 'again ' || lines ELSE lines END AS lines FROM e_page_layouts UNION ALL SELECT 'new', page, lines FROM e_page_layouts WHERE page < 9",
    "page_layouts",
)(
    lambda p: entities.upserted(
        p, p.where("page % 4 = 0").withColumn("lines", F.concat(F.lit("again "), "lines")).unionByName(p.where("page < 9").withColumn("book_id", F.lit("new"))), ["book_id", "page"]
    )
)
asked("page_texts_get", "SELECT * FROM e_page_texts WHERE page = 17", "page_texts")(lambda p: entities.one(p, page=17))
asked("page_texts_of_book", "SELECT book_id, page, clean_text, row_number() OVER (PARTITION BY book_id ORDER BY page) AS place FROM e_page_texts", "page_texts")(
    lambda p: _placed(p.select("book_id", "page", "clean_text"), "page_texts")
)
asked("page_texts_paragraphs", "SELECT book_id, page, paragraphs, levels, cleaner_version FROM e_page_texts WHERE cleaner_version > 0", "page_texts")(entities.readable_paragraphs)
asked("page_texts_upsert", "SELECT book_id, page, CASE WHEN cleaner_version = 0 THEN 3 ELSE cleaner_version END AS cleaner_version FROM e_page_texts", "page_texts")(
    lambda p: entities.upserted(p, p.where("cleaner_version = 0").withColumn("cleaner_version", F.lit(3)), ["book_id", "page"]).select("book_id", "page", "cleaner_version")
)
asked(
    "chunks_insert_all",
    "SELECT id, text FROM e_chunks UNION ALL SELECT (SELECT max(id) FROM e_chunks) + row_number() OVER (ORDER BY id), 'n' FROM e_chunks WHERE ordinal < 100",
    "chunks",
)(lambda c: entities.insert(c.select("id", "text"), c.where("ordinal < 100").select(F.lit("n").alias("text"), F.col("id").alias("turn")), "turn"))
asked("chunks_of_book", "SELECT id, book_id, ordinal, row_number() OVER (PARTITION BY book_id ORDER BY ordinal, id) AS place FROM e_chunks", "chunks")(
    lambda c: _placed(c.select("id", "book_id", F.struct("ordinal", "id").alias("ordinal")), "chunks").withColumn("ordinal", F.col("ordinal.ordinal"))
)
asked("chunks_ids_of_book", "SELECT id FROM e_chunks WHERE book_id = '1-URGENT'", "chunks")(lambda c: entities.of(c, "chunks", book_id="1-URGENT").select("id"))
asked("chunks_delete_of_book", "SELECT id, book_id FROM e_chunks WHERE book_id <> '5-LOW'", "chunks")(lambda c: entities.without_book(c, "5-LOW").select("id", "book_id"))
asked("embeddings_insert_all", "SELECT chunk_id, model_id FROM e_chunk_embeddings UNION ALL SELECT chunk_id + 1000000, 'new' FROM e_chunk_embeddings WHERE chunk_id < 50", "chunk_embeddings")(
    lambda v: entities.upserted(v, v.where("chunk_id < 50").select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), F.lit("new").alias("model_id")), ["chunk_id"])
)
asked("key_points_get", "SELECT * FROM e_chapter_key_points WHERE chapter_id = 12", "chapter_key_points")(lambda k: entities.one(k, chapter_id=12))
asked(
    "key_points_upsert_delete",
    "SELECT chapter_id, CASE WHEN status = 'REFUSED' THEN 'READY' ELSE status END AS status FROM e_chapter_key_points WHERE chapter_id % 11 <> 0",
    "chapter_key_points",
)(
    lambda k: relational.delete(entities.upserted(k, k.where("status = 'REFUSED'").withColumn("status", F.lit("READY")), ["chapter_id"]), F.col("chapter_id") % 11 == 0).select("chapter_id", "status")
)
asked("bookmarks_of_book", "SELECT id, book_id, page, row_number() OVER (PARTITION BY book_id ORDER BY page, id) AS place FROM e_bookmarks", "bookmarks")(
    lambda b: _placed(b, "bookmarks").select("id", "book_id", "page", "place")
)
asked("bookmarks_get", "SELECT * FROM e_bookmarks WHERE book_id = 'click' AND page = 31 ORDER BY id LIMIT 1", "bookmarks")(lambda b: entities.one(b, book_id="click", page=31))
asked(
    "bookmarks_upsert_delete", "SELECT id, CASE WHEN page = 7 THEN 'seen' ELSE note END AS note FROM e_bookmarks WHERE book_id <> 'error'", "bookmarks"
)(lambda b: entities.without_book(entities.upserted(b, b.where("page = 7").withColumn("note", F.lit("seen")), ["id"]), "error").select("id", "note"))
asked("highlights_of_book", "SELECT id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY page, paragraph, start_offset, id) AS place FROM e_highlights", "highlights")(
    lambda h: _placed(h.withColumn("start_offset", F.struct("start_offset", "id")), "highlights").select("id", "book_id", "place")
)
asked(
    "highlights_set_note_delete", "SELECT id, CASE WHEN page = 5 THEN 'mine' ELSE note END AS note FROM e_highlights WHERE paragraph <> 8", "highlights"
)(lambda h: relational.delete(entities.changed(h, F.col("page") == 5, note="mine"), F.col("paragraph") == 8).select("id", "note"))
asked("characters_of_book", "SELECT id, book_id, first_page, row_number() OVER (PARTITION BY book_id ORDER BY first_page, id) AS place FROM e_characters", "characters")(
    lambda c: _placed(c, "characters")
)
asked("characters_insert", "SELECT id, book_id, first_page FROM e_characters UNION ALL SELECT (SELECT max(id) FROM e_characters) + row_number() OVER (ORDER BY id), book_id, 1 FROM e_characters WHERE first_page = 10", "characters")(
    lambda c: entities.insert(c, c.where("first_page = 10").select("book_id", F.lit(1).alias("first_page"), F.col("id").alias("turn")), "turn")
)
asked(
    "characters_lower_first_page",
    "SELECT c.id, least(first_page, p) AS first_page FROM e_characters c LEFT JOIN (SELECT character_id, CAST(min(page) AS INTEGER) AS p FROM e_character_facts GROUP BY 1) f ON f.character_id = c.id",
    "characters", "character_facts",
)(lambda c, f: entities.lower_first_page(c, f.select("character_id", F.col("page").cast("int").alias("page"))).select("id", "first_page"))
asked("character_names_of", "SELECT id, character_id, name, row_number() OVER (PARTITION BY character_id ORDER BY first_page, id) AS place FROM e_character_names", "character_names")(
    lambda n: _placed(n, "character_names", "character_id").select("id", "character_id", "name", "place")
)
asked("character_names_set_primary", "SELECT id, CASE WHEN id % 10 = 0 THEN first_page + 1 ELSE primary_from END AS primary_from FROM e_character_names", "character_names")(
    lambda n: entities.set_primary(n, n.where("id % 10 = 0").select("id", (F.col("first_page") + 1).alias("page"))).select("id", "primary_from")
)
asked(
    "character_facts_of",
    "SELECT f.id, c.book_id, f.character_id, row_number() OVER (PARTITION BY f.character_id ORDER BY page, f.id) AS place FROM e_character_facts f JOIN e_characters c ON c.id = f.character_id",
    "character_facts", "characters",
)(lambda f, c: _placed(f.join(c.select(F.col("id").alias("character_id"), "book_id"), "character_id"), "character_facts", "character_id").select("id", "book_id", "character_id", "place"))
asked(
    "character_facts_insert",
    "SELECT id, text FROM e_character_facts UNION ALL SELECT (SELECT max(id) FROM e_character_facts) + row_number() OVER (ORDER BY id), 'fact' FROM e_character_facts WHERE page < 20",
    "character_facts",
)(lambda f: entities.insert(f.select("id", "text"), f.where("page < 20").select(F.lit("fact").alias("text"), F.col("id").alias("turn")), "turn"))
asked("relations_of_book", "SELECT id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY page, id) AS place FROM e_relations", "relations")(
    lambda r: _placed(r, "relations").select("id", "book_id", "place")
)
asked("relations_end", "SELECT id, CASE WHEN id % 64 = 1 THEN page + 5 ELSE ended_at END AS ended_at FROM e_relations", "relations")(
    lambda r: entities.end_relation(r, F.col("id") % 64 == 1, F.col("page") + 5).select("id", "ended_at")
)
asked("character_scans_ids", "SELECT chapter_id FROM e_character_scans WHERE book_id = 'BUILDING' AND model = 'm3'", "character_scans")(
    lambda s: s.where((F.col("book_id") == "BUILDING") & (F.col("model") == "m3")).select("chapter_id")
)
asked("character_scans_upsert", "SELECT book_id, chapter_id, CASE WHEN chapter_id % 6 = 0 THEN 'other' ELSE model END AS model FROM e_character_scans", "character_scans")(
    lambda s: entities.upserted(s, s.where("chapter_id % 6 = 0").withColumn("model", F.lit("other")), ["book_id", "chapter_id"])
)
asked("chat_threads_insert", "SELECT id, book_id FROM e_chat_threads UNION ALL SELECT (SELECT max(id) FROM e_chat_threads) + 1, 'new'", "chat_threads")(
    lambda t: entities.insert(t, t.orderBy("id").limit(1).select(F.lit("new").alias("book_id"), F.lit(1).cast("long").alias("turn")), "turn")
)
asked("chat_messages_get", "SELECT * FROM e_chat_messages WHERE id = (SELECT min(id) FROM e_chat_messages)", "chat_messages")(
    lambda m: m.join(F.broadcast(m.agg(F.min("id").alias("id"))), "id").select(*m.columns)  # one row
)
asked(
    "chat_messages_insert",
    "SELECT id, role FROM e_chat_messages UNION ALL SELECT (SELECT max(id) FROM e_chat_messages) + row_number() OVER (ORDER BY id), 'copy' FROM e_chat_messages WHERE role = 'system'",
    "chat_messages",
)(lambda m: entities.insert(m.select("id", "role"), m.where("role = 'system'").select(F.lit("copy").alias("role"), F.col("id").alias("turn")), "turn"))
asked("downloaded_models_all", "SELECT id, kind, size_bytes FROM e_downloaded_models", "downloaded_models")(lambda d: d)
asked("downloaded_models_change", "SELECT id, CASE WHEN kind = 'TTS' THEN size_bytes + 1 ELSE size_bytes END AS size_bytes FROM e_downloaded_models WHERE id <> 'PERU'", "downloaded_models")(
    lambda d: relational.delete(entities.upserted(d, d.where("kind = 'TTS'").withColumn("size_bytes", F.col("size_bytes") + 1), ["id"]), F.col("id") == "PERU").select("id", "size_bytes")
)
