"""Injected models, jobs, vectors, streams and sources in small cases."""

import itertools
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import asking, characters, embedding, models, search_index
from lectern.sources import importing
from lectern.streaming import control

PIECES = [("<s>", 0), ("<pad>", 0), ("</s>", 0), ("<unk>", 0), ("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -3.2), ("ba", -5.1), ("aba", -6.0), ("▁ab", -4.4)]


def best_split(word, scores):
    """The greatest total score of all ways to cut a word into pieces."""
    best = -math.inf
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]  # noqa: B905
        if all(p in scores for p in parts):
            best = max(best, sum(scores[p] for p in parts))
    return best


def test_unigram_pieces_are_the_best_of_all_cuts():
    tokenizer, scores = embedding.UnigramTokenizer(PIECES), dict(PIECES[4:])
    names = [p for p, _ in PIECES]
    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            word = "▁" + "".join(letters)
            ids = tokenizer.word(word)
            assert "".join(names[i] for i in ids) == word and sum(scores[names[i]] for i in ids) == pytest.approx(best_split(word, scores))
    assert tokenizer.encode("ab xyz a") == [0, names.index("▁ab"), names.index("▁"), 3, names.index("▁a"), 2]
    assert len(tokenizer.encode("ab " * 1000)) == embedding.MOST_PIECES and tokenizer.encode("") == [0, 2]
    special = embedding.UnigramTokenizer(PIECES, embedding.character_map({"Á": "a", "Áb": "b", "…": ""}), {"<pad>": 1})
    assert special.encode("Á<pad>Áb…") == [0, names.index("▁a"), 1, names.index("▁"), names.index("b"), 2]


def test_pooled_pieces():
    tokenizer = embedding.UnigramTokenizer(PIECES)
    embed = embedding.piece_embedder(tokenizer, lambda ids: [[float(i), 1.0, 0.0] for i in ids])
    ids = tokenizer.encode("ab a")
    want = np.array([np.mean(ids), 1.0, 0.0])
    assert np.allclose(embed(["ab a"])[0], want / np.linalg.norm(want))
    assert embedding.piece_embedder(tokenizer, lambda ids: [[0.0, 0.0] for _ in ids])(["x"]) == [[0.0, 0.0]]


def test_requests_are_tried_again_as_their_kind_says():
    for kind, most, pause in (("Overloaded", 3, 1.0), ("RateLimited", 3, 20.0), ("Unauthorized", 1, 0.0), ("Network", 1, 0.0)):
        calls, waits = [], []

        def client(request, kind=kind, calls=calls):
            calls.append(request)
            raise models.ModelError(kind)

        assert models.answered_once(client, {"prompt": "x"}, waits.append)["outcome"] == kind
        assert len(calls) == most and waits == [pause * n for n in range(1, most)]
    turns = iter([models.ModelError("Overloaded"), {"text": "fine", "input": 1, "output": 1}])

    def flaky(request):
        found = next(turns)
        if isinstance(found, Exception):
            raise found
        return found

    assert models.answered_once(flaky, {}, lambda s: None)["outcome"] == "Complete"
    assert models.answered_once(lambda r: {"text": " ", "blocked": True}, {})["outcome"] == "Refused"


def test_stages_that_are_not_bound_are_left_out(spark):
    seen = []
    stages = models.Stages(classify=lambda b: b.withColumn("kind", F.lit("GENERIC")), analyse_people=lambda b: seen.append(b.count()))
    found = stages.run(spark.range(3), "embed", "classify", "analyse_people", "speak")
    assert found.columns == ["id", "kind"] and seen == [3]


def test_places_without_judges_and_with_them(spark):
    chapters = spark.createDataFrame([("b", n, f"Chapter {n}", 10 * n - 9, 10 * n) for n in range(1, 9)], "book_id string, number int, title string, start_page int, end_page int")
    questions = ["¿Quién muere al final?", "¿Qué pasó después del incendio?", "¿Qué pasa en el capítulo 5?", "¿Quién es Ana?"]
    asked = spark.createDataFrame([("b", 30, 80, q) for q in questions], "book_id string, page int, page_count int, question string")
    ranges = lambda rows: {r.question: r.ranges and [tuple(x) for x in r.ranges] for r in rows.collect()}
    assert ranges(asking.locate(asked, chapters, F.lit(None).cast("int"))) == {questions[0]: None, questions[1]: None, questions[2]: [(41, 50)], questions[3]: None}
    judged = asking.locate(asked, chapters, F.lit(45), lambda rows: rows.withColumn("is_part", F.lit(True)), lambda rows: rows.withColumn("number", F.lit(2)))
    assert ranges(judged) == {questions[0]: [], questions[1]: [(1, 40)], questions[2]: [(41, 45)], questions[3]: None}


def test_answers_that_cannot_be_read(spark):
    rows = ["no", "{broken", '{"characters":null}', "x {} y", '{"characters":[{"ref":null,"names":null}]}']
    table = spark.createDataFrame([(i, a, 1, 9) for i, a in enumerate(rows)], "extraction_id int, answer string, first int, last int")
    found = {r.extraction_id: r.x for r in table.select("extraction_id", characters.parsed(F.col("answer")).alias("x")).collect()}
    assert found[0] is None and found[1] is None and found[2].characters == [] and found[3].same == []
    assert [tuple(r) for r in characters.told(table).select("extraction_id", "ref", "names", "facts").collect()] == [(4, "", [], [])]


def test_an_index_finds_what_the_texts_hold(spark):
    chunks = spark.createDataFrame([(1, "b", 1, 1, "Árbol, árboles y arbolito"), (2, "b", 2, 2, "nada"), (3, "b", 3, 3, None)], "id long, book_id string, start_page int, end_page int, text string")
    index = search_index.rows(chunks)
    assert {(r.id, r.score) for r in search_index.search(index, ["arbol*", "nada"]).collect()} == {(1, -float(len("0 0 0 6 0 0 8 8 0 0 19 8"))), (2, -float(len("0 1 0 4")))}
    assert search_index.search(index, []).collect() == []


def wav(code, bits, channels, raw, size=None):
    form = struct.pack("<HHIIHH", code, channels, 8000, 0, 0, bits)
    extra = b"LIST" + struct.pack("<i", 3) + b"abc\0"
    return b"RIFF\0\0\0\0WAVE" + extra + b"fmt " + struct.pack("<i", len(form)) + form + b"data" + struct.pack("<i", len(raw) if size is None else size) + raw


def test_sound_of_wav_bytes():
    assert importing.pcm(wav(1, 16, 2, struct.pack("<4h", 16384, 0, -32768, -32768)))[1].tolist() == [0.25, -1.0]
    assert importing.pcm(wav(1, 8, 1, bytes([128, 255, 0]), 0))[1].tolist() == [0.0, 127 / 128, -1.0]
    rate, samples = importing.pcm(wav(3, 32, 1, struct.pack("<2f", 0.5, -0.5), -1))
    assert rate == 8000 and samples.tolist() == [0.5, -0.5]
    for bad in (b"RIFFxxxxWAVE", b"nothing", wav(2, 4, 1, b"")):
        with pytest.raises(ValueError):
            importing.pcm(bad)


def test_streams_of_states(spark, tmp_path):
    schema = "key string, ts long, source string, value double"
    for n, rows in enumerate(([("k", 1, "a", 1.0), ("k", 2, "a", 2.0)], [("k", 3, "b", 5.0), ("j", 3, "b", 6.0)], [("k", 4, "a", 3.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = control.bounded(spark, f"{tmp_path}/in/*", schema)
    told = control.combined_stream(stream, ["a", "b"]).writeStream.format("memory").queryName("both").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    assert told.awaitTermination(120)
    assert sorted((r.key, r.a, r.b) for r in spark.table("both").collect()) == [("k", 2.0, 5.0), ("k", 3.0, 5.0)]
    assert len(told.recentProgress) >= 3
    passed = []
    seen = control.observed(lambda s: s.read.schema(schema).parquet(f"{tmp_path}/in/*").groupBy("source").count(), lambda rows: passed.append({r.source: r["count"] for r in rows.collect()}))
    watched = control.bounded(spark, f"{tmp_path}/in/*", schema).writeStream.foreachBatch(seen).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    assert watched.awaitTermination(120)
    assert passed == [{"a": 3, "b": 2}]


def test_pages_are_written_some_at_a_time(spark, tmp_path):
    pages = spark.range(1, 61).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("page"), F.lit("t").alias("text"))
    control.write_pages(pages, pages.select("book_id", "page"), str(tmp_path))
    control.write_pages(pages.where("page = 1"), pages.where("page = 1").select("book_id", "page"), str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/page_texts")
    assert found.count() == 61 and found.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= control.PAGES_AT_ONCE
    assert spark.read.parquet(f"{tmp_path}/page_layouts").count() == 61


def test_when_a_reading_stops():
    assert control.stops_at(100, 5, None) == 400 and control.stops_at(100, 5, 300) == 300 and control.stops_at(1, None, None) is None


def test_intact_files(spark, tmp_path):
    import hashlib

    (tmp_path / "m.bin").write_bytes(b"model")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    path = files.first().path
    registry = spark.createDataFrame([("good", path, hashlib.sha256(b"model").hexdigest()), ("bad", path, "0")], "id string, path string, sha256 string")
    assert {(r.id, r.ok) for r in models.intact(files, registry).collect()} == {("good", True), ("bad", False)}


def test_a_word_is_taken_apart_once_as_long_as_it_is_remembered(monkeypatch):
    tokenizer, asked = embedding.UnigramTokenizer(PIECES), []
    plain, word = embedding.UnigramTokenizer(PIECES), tokenizer.word
    monkeypatch.setattr(tokenizer, "word", lambda w: asked.append(w) or word(w))
    text = "ab ba ab zz ab"
    assert tokenizer.encode(text) == [embedding.BEGIN, *(i for w in text.split() for i in plain.word(f"▁{w}")), embedding.END] == tokenizer.encode(text)
    assert asked == ["▁ab", "▁ba", "▁zz"]
    monkeypatch.setattr(embedding, "WORDS_REMEMBERED", 2)
    assert tokenizer.encode("cc dd ab") == plain.encode("cc dd ab") and len(tokenizer.known) <= 2
