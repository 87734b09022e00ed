"""Readers, codecs, answers, key points and chapter references."""

import json
import struct

from pyspark.sql import functions as F

from lectern.operators import chapters as ch
from lectern.operators import chat, key_points, text
from lectern.sources import readers
from lectern.sources.schema import CASCADES, SCHEMAS, SET_NULL


def test_evaluation_set(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"books": [{"title": "A", "extra": 1, "questions": [{"question": "q", "pages": [1, 2]}, {"question": "r", "pages": []}]}]}))
    assert sorted(map(tuple, readers.evaluation_set(spark, str(path)).collect())) == [("A", "q", [1, 2]), ("A", "r", [])]


def test_files_as_pages(spark, tmp_path):
    (tmp_path / "my.book.txt").write_text("uno\fdos")
    rows = readers.page_files(spark, f"{tmp_path}/*.txt", lambda raw: raw.decode().split("\f")).collect()
    assert sorted(map(tuple, rows)) == [("my.book", 1, "uno"), ("my.book", 2, "dos")]


def test_outline_in_preorder(spark):
    nodes = spark.createDataFrame([(1, None, 1, "A", 1), (2, 1, 2, "A.2", 5), (3, 1, 1, " ", None), (4, 3, 1, "A.1.1", 2), (5, None, 2, "B", 9)], "node_id int, parent_id int, ord int, title string, page int")
    flat = readers.flat_outline(spark, nodes).orderBy("place").collect()
    assert [(r.title, r.page, r.depth) for r in flat] == [("A", 1, 0), ("A.1.1", 2, 2), ("A.2", 5, 1), ("B", 9, 0)]


def test_codecs(spark):
    row = spark.createDataFrame([("[1, 2]", [1.5, -0.1, 0.0, 3.4e38, 1e-40]), ("nonsense", [])], "j string, v array<float>")
    got = row.select(readers.json_array(F.col("j"), "int").alias("j"), readers.packed_floats(F.col("v")).alias("b"), readers.unpacked_floats(readers.packed_floats(F.col("v"))).alias("v")).collect()
    assert [r.j for r in got] == [[1, 2], []]
    assert bytes(got[0].b) == struct.pack("<5f", 1.5, -0.1, 0.0, 3.4e38, 1e-40)
    assert got[0].v == list(struct.unpack("<5f", bytes(got[0].b)))


def test_entities_gain_the_columns_of_later_versions(spark, tmp_path):
    spark.createDataFrame([("b", 7, 0, 0, 5)], "book_id string, page int, paragraph_index int, phrase_index int, updated_at long").write.parquet(f"{tmp_path}/reading_positions.parquet")
    assert readers.entity(spark, str(tmp_path), "reading_positions").first().max_page == 7
    assert {t for children in [*CASCADES.values(), *SET_NULL.values()] for t in children} <= set(SCHEMAS)


def test_settings_have_limits(spark):
    values = spark.createDataFrame([(1, "gemini-x", 9.0, None, ["b"]), (2, "other", None, 0.1, None)], "user_id int, model string, speed double, scale double, spoilers_off array<string>")
    got = {r.user_id: (r.model, r.speed, r.scale, r.spoilers_off) for r in readers.settings(values).collect()}
    assert got == {1: ("gemini-x", 2.0, 1.0, ["b"]), 2: (None, 1.0, 0.8, [])}


def answer(text=None, finish=None, thought=False, **more):
    return "data: " + json.dumps({"candidates": [{"content": {"parts": [{"text": text, "thought": thought}]}, "finishReason": finish}]} | more)


def test_streamed_answers(spark):
    error = "data: " + json.dumps({"error": {"code": 503, "message": "busy"}})
    rows = [(1, 1, answer("Ho")), (1, 2, ": comment"), (1, 3, answer("think", thought=True)), (1, 4, answer("la", "STOP", usageMetadata={"promptTokenCount": 5, "candidatesTokenCount": 2})),
            (2, 1, answer("cut")), (3, 1, error), (4, 1, answer("some")), (4, 2, error), (5, 1, answer("", "SAFETY"))]
    got = {r.answer_id: (r.text, r.outcome) for r in chat.folded_stream(spark.createDataFrame(rows, "answer_id int, n int, line string")).collect()}
    assert got == {1: ("Hola", "Complete"), 2: ("cut", "Incomplete"), 3: ("", "Overloaded"), 4: ("some", "Incomplete"), 5: ("", "Refused")}


def test_key_points(spark):
    chapters = spark.createDataFrame([(1, "b", 1, "Uno"), (2, "b", 2, "Dos"), (3, "b", 3, "Tres")], "id long, book_id string, number int, title string")
    saved = spark.createDataFrame([(1, "READY", [("a", 3), ("z", 90)]), (2, "EMPTY", [])], "chapter_id long, status string, points array<struct<text:string,page:int>>")
    planned = key_points.plan(chapters, saved, F.lit(50))
    assert {r.id: (r.way, r.text) for r in planned.collect()} == {1: ("POINTS", "- a (p. 3)"), 2: ("NOTHING", None), 3: ("TEXT", None)}
    assert key_points.recap(planned).first().recap == "Uno\n- a (p. 3)"
    assert [r.id for r in key_points.missing(chapters, saved).collect()] == [3]
    told = spark.createDataFrame([('x {"points":[{"text":" a ","page":99},{"text":" "}]} y',), ("bad",)], "a string")
    assert [[tuple(p) for p in r.p] for r in told.select(key_points.parsed(F.col("a"), F.lit(1), F.lit(40)).alias("p")).collect()] == [[("a", 40)], []]


TITLES = ["Part One. Ice", "Chapter 1", "Chapter 2", "Part Two", "Interlude", "Chapter 1", "Chapter 2", "Chapter 3", "Epilogue"]
STARTS = [1, 3, 12, 40, 41, 50, 58, 70, 96]


def book(spark):
    # Spanish words are what the reader of questions knows.
    said = {"Part One. Ice": "Parte primera. Hielo", "Part Two": "Parte 2", "Interlude": "Intermedio", "Epilogue": "Epílogo"}
    rows = [("x", i, said.get(t, t.replace("Chapter", "Capítulo")), s, (STARTS[1:] + [101])[i - 1] - 1) for i, (t, s) in enumerate(zip(TITLES, STARTS, strict=True), 1)]
    return spark.createDataFrame([*rows, ("y", 1, "Only", 1, 9)], "book_id string, number int, title string, start_page int, end_page int")


def test_chapter_references(spark):
    asked = [
        ("x", 60, "current", None, None, 7), ("x", 60, "previous", None, None, 6), ("x", 40, "next", None, None, 5), ("x", 45, "previous", None, None, 3), ("x", 1, "last", None, None, 9),
        ("x", 60, "titled:epilogo", None, None, 9), ("x", 60, "number", 2, None, 7), ("x", 5, "number", 2, None, 3), ("x", 5, "number", 1, 2, 6), ("x", 5, "number", 3, None, 8),
        ("x", 5, "number", 3, 1, None), ("x", 5, "number", 9, None, 9), ("x", 5, "number", 30, None, None), ("x", 0, "current", None, None, None), ("x", 0, "next", None, None, 1),
        ("y", 3, "current", None, None, 1), ("z", 3, "current", None, None, None),
    ]
    rows = [(b, p, (k, n, part), want) for b, p, k, n, part, want in asked]
    table = spark.createDataFrame(rows, f"book_id string, page int, reference {ch.REFERENCE}, want int")
    found = ch.resolve(table, book(spark)).collect()
    assert len(found) == len(rows) and all(r.chapter == r.want for r in found), [r for r in found if r.chapter != r.want]
    labels = {(r.book_id, r.number): r.label for r in ch.part_labels(book(spark)).collect()}
    assert labels["x", 3] == "Parte primera" and labels["x", 7] == "Parte 2" and labels["y", 1] is None


def test_places_become_pages(spark):
    asked = [
        ("al principio del libro", [(1, 25)]), ("al final del libro", [(76, 100)]), ("a mitad del libro", [(38, 62)]), ("la primera parte", [(1, 39)]), ("la segunda parte", [(40, 100)]),
        ("los capítulos 1 y 2", [(50, 69)]), ("los capítulos 1, 3 y 9", [(50, 57), (70, 100)]), ("el capítulo 30", None), ("al final del capítulo 3", [(89, 95)]), ("la novena parte", None), ("¿Quién?", None),
    ]
    table = spark.createDataFrame([("x", 60, 100, q) for q, _ in asked], "book_id string, page int, page_count int, question string")
    found = {r.question: r.ranges for r in ch.pages_of(text.located(table, True), book(spark)).collect()}
    assert {q: r and [tuple(x) for x in r] for q, r in found.items()} == dict(asked)
    events = spark.createDataFrame([("x", 5), ("x", 1), ("x", 99)], "book_id string, number int")
    assert {(r.number, r.first, r.last) for r in ch.around_event(events, book(spark)).collect()} == {(5, 12, 69), (1, 1, 39), (99, None, None)}


def test_response_schema():
    built = chat.response_schema({"tipo": ["A", "B"], "paginas": [["integer"]][0], "nota?": "string"})
    assert built["required"] == ["tipo", "paginas"] and built["properties"]["nota"]["nullable"] and built["properties"]["tipo"] == {"type": "STRING", "enum": ["A", "B"]}


def test_fragments_are_numbered_and_rendered(spark):
    hits = spark.createDataFrame([("b", 20, 22, "dos"), ("b", 3, 3, "uno")], "book_id string, start_page int, end_page int, text string")
    titles = spark.createDataFrame([("b", 1, 15, 1, 'El "viaje"'), ("b", 16, 30, 2, "Vuelta")], "book_id string, start_page int, end_page int, number int, title string")
    found = chat.fragments(hits, titles)
    text = found.select("number", chat.rendered(F.col("number"), F.col("start_page"), F.col("end_page"), F.col("chapter"), F.col("text")).alias("t")).orderBy("number").collect()
    assert [r.t for r in text] == ['<fragmento n="1" paginas="3" capitulo="El \'viaje\'">\nuno\n</fragmento>', '<fragmento n="2" paginas="20-22" capitulo="Vuelta">\ndos\n</fragmento>']


def test_availability(spark):
    rows = [("FAILED", 0.0, True, True, True), ("READY", 1.0, False, True, True), ("READY", 1.0, True, True, True), ("TEXT_READY", 1.0, True, False, True), ("PENDING", 0.4, True, True, False), ("PENDING", 0.0, True, True, False)]
    table = spark.createDataFrame(rows, "s string, p double, k boolean, m boolean, c boolean")
    got = [r.a for r in table.select(chat.availability(*map(F.col, "spkmc")).alias("a")).collect()]
    assert got == ["BOOK_FAILED", "NO_KEY", "READY", "READY_TEXT_ONLY", "INDEXING", "WAITING"]
