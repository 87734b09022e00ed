"""Results that differed from DuckDB's on larger tables only: what has to hold there, made small."""

import duckdb
import pyarrow as pa
import pytest

from lectern.functions import location
from lectern.plans import catalogue


def agree(spark, folder, name, **tables):
    """The query's rows and DuckDB's over the same tables."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    result = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=repr)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == want and want


def documents(spark, texts, sources=1):
    rows = [(i, t, "es", f"s{i % sources}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_paragraphs_keep_the_digits_at_their_ends(spark, tmp_path):
    lines = "0 uno 0\n1 dos 1\n2 tres 2\n cuatro \n \n4 cinco 4"
    agree(spark, tmp_path, "words_across_pages", documents=documents(spark, [lines] * 15))


def test_chapters_beyond_the_thousandth_are_read():
    place = location.detect("Resume los capítulos 999 y 1000", True)
    assert place.chapters == [("number", 999, None), ("number", 1000, None)]
    assert location.detect("¿Qué pasa en el capítulo 123456789?", True).chapters == [("number", 123456789, None)]
    assert location.detect("¿Qué pasa en el capítulo 12345678901?", True) is None


@pytest.mark.parametrize("name", ["event_anchors", "locate_question", "question_located", "fragment_plans", "position_texts", "recaps_current", "chapter_bounds"])
def test_books_of_many_chapters(spark, tmp_path, name):
    agree(spark, tmp_path, name, documents=documents(spark, ["x"] * 903, 3))


def test_an_ending_meets_one_relation_of_a_pair(spark):
    from lectern.operators import graph

    rows = [(i, 1, 2, "FRIEND" if i % 2 else None if i == 8 else "OTHER", 5 + i % 3, None) for i in range(9)] + [(20, 2, 3, "ENEMY", 1, 4)]
    relations = spark.createDataFrame(rows, "id long, from_id long, to_id long, type string, page int, ended_at int")
    endings = spark.createDataFrame([(2, 1, "FRIEND", 30), (1, 2, "FRIEND", 29), (1, 2, "SPOUSE", 31), (1, 2, None, 32), (2, 3, "ENEMY", 9)], "a long, b long, type string, at int")
    found = graph.end_relations(relations, endings)
    assert {r.id: r.ended_at for r in found.collect() if r.ended_at} == {5: 29, 8: 32, 20: 4}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [_a") >= 2  # relations are summed up before endings meet them


def test_texts_become_objects_a_few_at_a_time(spark, tmp_path, monkeypatch):
    from lectern.operators import name_tables, text, unigram

    batches = pa.table({"n": list(range(10))}).to_batches()
    assert [b.num_rows for b in text.sliced(iter(batches), 4)] == [4, 4, 2]
    for module in (name_tables, text, unigram):
        monkeypatch.setattr(module, "TEXTS_AT_ONCE", 3)
    monkeypatch.setattr(text, "PAGES_AT_ONCE", 3)
    docs = documents(spark, ["Anna vino. Boris fue.\nAnna y Boris"] * 20, 2)
    agree(spark, tmp_path, "names_in_books", documents=docs)
    agree(spark, tmp_path, "texts_normalised", documents=docs)
    agree(spark, tmp_path, "layout_blocks", documents=docs)
