"""Schemas of the entity tables, stated once. Readers never infer."""

from __future__ import annotations

# The entities and their columns.
SCHEMAS = {
    "books": "id string, title string, author string, file_name string, file_path string, page_count int, cover_path string, imported_at long, last_opened_at long, index_status string, index_progress float, cleaner_version int, document_type string, document_type_source string, ai_prepared boolean",
    "chapters": "id long, book_id string, number int, title string, start_page int, end_page int, source string, level int",
    "page_texts": "book_id string, page int, raw_text string, clean_text string, paragraphs array<string>, is_scanned boolean, cleaner_version int, levels array<int>",
    "page_layouts": "book_id string, page int, lines array<struct<t:string,x:float,r:float,y:float,s:float,b:boolean,w:float>>",
    "chunks": "id long, book_id string, chapter_id long, ordinal int, text string, start_page int, end_page int, char_start long, char_end long, token_count int",
    "chunk_embeddings": "chunk_id long, model_id string, dim int, vector array<float>",
    "chapter_key_points": "chapter_id long, book_id string, status string, points array<struct<text:string,page:int>>, model string, created_at long",
    "reading_positions": "book_id string, page int, paragraph_index int, phrase_index int, updated_at long, max_page int",
    "bookmarks": "id long, book_id string, page int, note string, created_at long",
    "highlights": "id long, book_id string, page int, paragraph int, start_offset int, end_offset int, note string, created_at long",
    "characters": "id long, book_id string, first_page int",
    "character_names": "id long, character_id long, name string, kind string, first_page int, primary_from int",
    "character_facts": "id long, character_id long, chapter_id long, page int, text string",
    "relations": "id long, book_id string, from_id long, to_id long, type string, label string, page int, ended_at int",
    "character_scans": "book_id string, chapter_id long, model string, scanned_at long",
    "chat_threads": "id long, book_id string, created_at long",
    "chat_messages": "id long, thread_id long, role string, text string, citations array<int>, created_at long, sources array<struct<number:int,kind:string,start_page:int,end_page:int,text:string>>",
    "downloaded_models": "id string, kind string, version string, path string, size_bytes long, sha256 string, downloaded_at long",
}
KEYS = {
    "page_texts": ("book_id", "page"), "page_layouts": ("book_id", "page"), "chunk_embeddings": ("chunk_id",), "chapter_key_points": ("chapter_id",), "reading_positions": ("book_id",),
    "character_scans": ("book_id", "chapter_id"),
}
#: Children of each table by their key: what a delete takes along.
CASCADES = {
    "books": {t: "book_id" for t in ("chapters", "page_texts", "page_layouts", "chunks", "chapter_key_points", "reading_positions", "bookmarks", "highlights", "characters", "relations", "character_scans", "chat_threads")},
    "chapters": {"chapter_key_points": "chapter_id", "character_facts": "chapter_id", "character_scans": "chapter_id"},
    "chunks": {"chunk_embeddings": "chunk_id"},
    "characters": {"character_names": "character_id", "character_facts": "character_id"},
    "chat_threads": {"chat_messages": "thread_id"},
}
SET_NULL = {"chapters": {"chunks": "chapter_id"}}
#: Columns that later versions added, with what older rows get.
ADDED = {"reading_positions": {"max_page": "page"}, "page_texts": {"levels": "array()"}, "books": {"document_type_source": "'AUTO'", "ai_prepared": "false"}, "chapters": {"level": "0"}}
