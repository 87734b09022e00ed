"""The kept index: equal to a search of all texts after any changes, blocks passed over, files that a change leaves alone, streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import posting_store, question_tables, retrieval

CHUNK = "id long, book_id string, start_page int, end_page int, text string"
WORDS = "árbol arboleda casa Casas río riberas noche nochebuena sol mar marea 42 niño 😀 x".split()
TERMS = ["arbol*", "casa*", "noche", "mar", "zzz*"]


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, f"b{i % 3}", i % 40, i % 40 + 1, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for i in ids]


@pytest.fixture
def store(spark, tmp_path):
    return posting_store.Store(spark, f"{tmp_path}/index")


def all_scores(rows):
    return sorted((r.id, r.score) for r in rows.collect())


def files(path):
    return {f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns for folder, _, names in os.walk(path) for name in names}


def test_search_equals_a_scan_after_changes(spark, store):
    rows = {r[0]: r for r in texts(1, range(-40, 200))}
    store.build(spark.createDataFrame(list(rows.values()), CHUNK))
    for turn in range(4):
        rng = random.Random(turn)
        changed = texts(100 + turn, rng.sample(range(-50, 260), 12))
        gone = rng.sample(sorted(rows), 5)
        rows = {i: r for i, r in rows.items() if i not in gone} | {r[0]: r for r in changed}
        store.change(spark.createDataFrame(changed, CHUNK), spark.createDataFrame([(g,) for g in [*gone, *gone[:1], 9_999]], "id long"))
        whole = spark.createDataFrame(list(rows.values()), CHUNK)
        assert all_scores(store.search(TERMS)) == all_scores(retrieval.text_search(whole, TERMS))
        assert sorted(store.top(TERMS, 7).select("id", "score", "pos").collect()) == sorted(retrieval.top(retrieval.text_search(whole, TERMS), 7, True).select("id", "score", "pos").collect())
        assert sorted(r.id for r in store.chunks().collect()) == sorted(rows)
    pages = (F.col("start_page") >= 5) & (F.col("end_page") <= 20) & (F.col("book_id") == "b1")
    assert all_scores(store.top(TERMS, 4, pages)) == all_scores(retrieval.top(retrieval.text_search(whole.where(pages), TERMS), 4, True))
    store.merge(whole=True)
    assert len(store.segments()) == 1 and store.sweep() > 0
    assert all_scores(store.search(TERMS)) == all_scores(retrieval.text_search(whole, TERMS))
    assert store.search([]).collect() == [] and store.top([], 3).collect() == []


def test_blocks_that_cannot_reach_the_best_are_not_unpacked(spark, store, monkeypatch):
    monkeypatch.setattr(posting_store, "SPAN", 16)
    rows = [(i, "b", 1, 1, "casa " * (60 if i // 16 == 7 else 1 + i % 3) + "mar") for i in range(16 * 60)]
    store.build(spark.createDataFrame(rows, CHUNK))
    segments = store.segments()
    matched = store._matched(["casa", "mar"], segments)
    read = store.reached(matched, segments, 10)
    assert matched.count() == 120 and read.count() == 2
    whole = spark.createDataFrame(rows, CHUNK)
    assert all_scores(store.top(["casa", "mar"], 10)) == all_scores(retrieval.top(retrieval.text_search(whole, ["casa", "mar"]), 10, True))


def test_a_small_change_writes_little_and_leaves_the_rest(spark, store):
    store.build(spark.createDataFrame(texts(1, range(1000)), CHUNK))
    before = files(store.path)
    store.change(spark.createDataFrame(texts(2, range(0, 1000, 100)), CHUNK))
    after = files(store.path)
    assert {f: after[f] for f in before} == before
    assert [s.ids for s in store.segments()] == [1000, 10]
    blocks = store._blocks(store.segments()).groupBy("segment").agg(F.sum("n").alias("n"))
    postings = {r.segment: r.n for r in blocks.collect()}
    assert postings[1] < postings[0] / 50
    for turn in range(3, 9):
        store.change(spark.createDataFrame(texts(turn, range(turn, 1000, 100)), CHUNK))
    assert len(store.segments()) <= 4 and store.segments()[0].ids == 1000


def test_a_write_that_fails_changes_nothing(spark, store, monkeypatch):
    store.build(spark.createDataFrame(texts(1, range(50)), CHUNK))
    want = all_scores(store.search(TERMS))
    broken = spark.createDataFrame(texts(2, range(10)), CHUNK).withColumn("text", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        store.change(broken)
    assert all_scores(store.search(TERMS)) == want and len(store.segments()) == 1
    os.makedirs(f"{store.path}/versions/000000002")  # a version that was begun and never finished
    assert all_scores(store.search(TERMS)) == want
    store.change(spark.createDataFrame(texts(3, range(10)), CHUNK))
    assert len(store.segments()) >= 1 and all_scores(store.search(TERMS)) != want


def test_a_stream_of_changes_with_a_restart(spark, store, tmp_path):
    rows = {r[0]: r for r in texts(1, range(60))}
    store.build(spark.createDataFrame(list(rows.values()), CHUNK))
    folder = f"{tmp_path}/changes"
    fields = CHUNK + ", seq long, deleted boolean"
    for part in range(3):
        new = [(*r, s, False) for s in (0, 1) for r in texts(10 * part + s, range(part, 60, 7))] + [(part + 40, None, None, None, None, 9, True)]
        spark.createDataFrame(new, fields).coalesce(1).write.mode("append").parquet(folder)
        rows |= {r[0]: r for r in texts(10 * part + 1, range(part, 60, 7))}
        rows.pop(part + 40, None)
        stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(folder)
        query = stream.writeStream.foreachBatch(store.sink("s")).option("checkpointLocation", f"{tmp_path}/state").start()  # goes on where it ended
        query.processAllAvailable()
        query.stop()
        whole = spark.createDataFrame(list(rows.values()), CHUNK)
        assert all_scores(store.search(TERMS)) == all_scores(retrieval.text_search(whole, TERMS))
    before = [s.name for s in store.segments()]
    store.sink("s")(spark.createDataFrame([(1, "b", 1, 1, "otra", 1, False)], fields), 2)  # the last batch again
    assert [s.name for s in store.segments()] == before


def test_questions_in_a_table(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(posting_store, "SPAN", 16)
    monkeypatch.setattr(posting_store, "SEEDS", 2)
    store.build(spark.createDataFrame(texts(1, range(300)), CHUNK))
    store.change(spark.createDataFrame(texts(2, range(0, 300, 9)), CHUNK), spark.createDataFrame([(5,), (6,)], "id long"))
    asked = {q: random.Random(q).sample(["arbol*", "casas", "noche*", "mar", "42", "niño", "nada*", "x"], q % 4) for q in range(40)}
    table = spark.createDataFrame([(q, n, t) for q, terms in asked.items() for n, t in enumerate(terms)], "question long, number int, term string")
    got = {}
    for r in store.top_many(table, f"{tmp_path}/many", 6).collect():
        got.setdefault(r.question, []).append((r.pos, r.id, r.score))
    for q in (0, 1, 2, 3, 17, 38):
        assert sorted(got.get(q, [])) == sorted((r.pos, r.id, r.score) for r in store.top(asked[q], 6).collect())


def test_vectors_for_thousands_of_questions(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 6)).round(2)
    asked = rng.normal(size=(3000, 6)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9001, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (9002, [5.0])]
    questions = [(f"q{i}", q.tolist()) for i, q in enumerate(asked)] + [("one", [2.0]), ("none", None)]
    found = question_tables.vector_top(spark.createDataFrame(rows, "chunk_id long, v array<double>"), spark.createDataFrame(questions, "question string, v array<double>"), 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.question, {})[r.pos] = (r.id, r.score)
    assert got.pop("one") == {0: (9002, 10.0)} and len(got) == 3000
    scores = np.round(asked @ vectors.T, 9)
    for i in range(0, 3000, 37):
        order = np.lexsort([np.arange(700), -scores[i]])[:5]
        assert [got[f"q{i}"][p] for p in range(5)] == [(int(j), float(scores[i, j])) for j in order]


def test_tiles_are_passed_over():
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(200, 4)) * 0.05 + c for c in ((9, 0, 0, 0), (0, 9, 0, 0), (-9, 0, 0, 0))])
    asked = np.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0]])
    ids, scores, left_out = question_tables.best_of(np.arange(600), vectors, asked, 3, tile=50)
    exact = np.round(asked @ vectors.T, 9)
    assert left_out > 600
    for q in range(2):
        assert ids[q].tolist() == np.lexsort([np.arange(600), -exact[q]])[:3].tolist()


def test_blocks_are_made_of_sorted_postings_over_batches():
    import pyarrow as pa

    rows = [("a", 0, k, k + 1, 9 - k) for k in range(6)] + [("a", 1, 3, 1, 1), ("b", 1, 0, 2, 2), ("b", 1, 7, 1, 5)]
    names = ["term", "span", "offset", "count", "digits"]
    kinds = pa.schema([("term", pa.string()), ("span", pa.int64()), ("offset", pa.int32()), ("count", pa.int32()), ("digits", pa.int32())])
    whole = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)
    want = [("a", 0, 6, 6, 9, list(range(6)), [1, 2, 3, 4, 5, 6], [9, 8, 7, 6, 5, 4]), ("a", 1, 1, 1, 1, [3], [1], [1]), ("b", 1, 2, 2, 5, [0, 7], [2, 1], [2, 5])]
    for size in (1, 2, 4, 9):
        parts = [whole.slice(0, 0), *(whole.slice(k, size) for k in range(0, len(rows), size))]
        assert [tuple(r.values()) for b in posting_store._in_blocks(iter(parts)) for r in b.to_pylist()] == want
    assert list(posting_store._in_blocks(iter([]))) == []


def test_texts_beside_the_chunks_are_not_shuffled(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "b", 1, 1), (700, "b", 2, 2)], "id long, book_id string, start_page int, end_page int")
    texts = spark.createDataFrame([(1, "La casa ÁRBOL casa"), (700, "árbol ½ ﬁn"), (-3, None)], "id long, text string")
    both = chunks.join(texts, "id")
    found = [posting_store.Store(spark, f"{tmp_path}/{n}").build(*given).search(["casa", "arbol"]) for n, given in enumerate(((both,), (chunks, texts)))]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) and found[0].count() == 2
    assert "Exchange" not in posting_store.postings(texts)._jdf.queryExecution().executedPlan().toString()
