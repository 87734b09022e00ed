"""Tables changed in place: against rows held in memory, files that stay, writes that fail, deletions that spread."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.sources import kept_tables
from lectern.sources.kept_tables import CASCADE, SET_NULL, Kept, Reference

BOOKS = Kept("books", "id long, title string, version int", ("id",), 8)
PAGES = Kept("pages", "book_id long, page int, text string", ("book_id", "page"), 8)
MARKS = Kept("marks", "id long, book_id long, note string", ("id",), 4)
THREADS = Kept("threads", "id string, book_id long", ("id",), 4)
NOTES = Kept("notes", "id long, mark_id long", ("id",), 4)
LINKS = [
    Reference("pages", "book_id", "books", CASCADE), Reference("marks", "book_id", "books", CASCADE),
    Reference("threads", "book_id", "books", SET_NULL), Reference("notes", "mark_id", "marks", CASCADE),
]


@pytest.fixture
def tables(spark, tmp_path):
    return kept_tables.Tables(spark, f"{tmp_path}/tables", [BOOKS, PAGES, MARKS, THREADS, NOTES], LINKS)


def held(tables, name):
    return sorted((tuple(r) for r in tables.read(name).collect()), key=repr)


def files(path):
    return {f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns for folder, _, names in os.walk(path) for name in names}


def rows(spark, table, values):
    return spark.createDataFrame(values, table.schema)


def fill(spark, tables):
    tables.transaction().add("books", rows(spark, BOOKS, [(i, f"t{i}", 1) for i in range(60)])).add("pages", rows(spark, PAGES, [(i % 60, i, "x") for i in range(300)])).add(
        "marks", rows(spark, MARKS, [(i, i % 60, "n") for i in range(120)])
    ).add("threads", rows(spark, THREADS, [(f"t{i}", i % 60 if i % 5 else None) for i in range(90)])).add("notes", rows(spark, NOTES, [(i, i) for i in range(120)])).commit()


def test_a_few_keys_leave_the_other_files_as_they_are(spark, tables):
    fill(spark, tables)
    before = files(tables.path)
    old = tables.places()
    tables.transaction().put("books", rows(spark, BOOKS, [(3, "new", 2), (1000, "more", 1)])).commit()
    after = files(tables.path)
    assert {f: after[f] for f in before} == before
    changed = {k for k, folder in tables.places().items() if old.get(k) != folder}
    assert len(changed) <= 2 and {n for n, _ in changed} == {"books"}
    new = [f for f in after if f not in before and "/data/" in f and f.endswith(".parquet")]
    assert len(new) == len(changed)
    assert dict((i, t) for i, t, _ in held(tables, "books")) == {**{i: f"t{i}" for i in range(60)}, 3: "new", 1000: "more"}
    assert sorted(tables.read("books", 1).select("id").toPandas()["id"]) == list(range(60))  # the version before is still there
    assert tables.sweep() >= 0 and len(held(tables, "books")) == 61


def test_deletions_spread(spark, tables):
    fill(spark, tables)
    tables.transaction().delete("books", spark.createDataFrame([(7,), (8,), (9_999,)], "id int")).commit()
    gone = {7, 8}
    assert held(tables, "books") == sorted(((i, f"t{i}", 1) for i in range(60) if i not in gone), key=repr)
    assert held(tables, "pages") == sorted(((i % 60, i, "x") for i in range(300) if i % 60 not in gone), key=repr)
    marks = [i for i in range(120) if i % 60 not in gone]
    assert [r[0] for r in sorted(held(tables, "marks"))] == marks and [r[0] for r in sorted(held(tables, "notes"))] == marks
    assert held(tables, "threads") == sorted(((f"t{i}", i % 60 if i % 5 and i % 60 not in gone else None) for i in range(90)), key=repr)


def test_what_fails_changes_nothing(spark, tables):
    fill(spark, tables)
    before = {n: held(tables, n) for n in tables.tables}
    broken = rows(spark, BOOKS, [(1, "x", 9), (2, "y", 9)]).withColumn("title", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("title")))
    begun = tables.transaction().delete("books", rows(spark, BOOKS, [(5, "", 0)]))
    with pytest.raises(Exception, match="broken"):
        begun.put("books", broken).commit()
    with pytest.raises(ValueError, match="there already"):
        tables.transaction().add("books", rows(spark, BOOKS, [(1, "again", 1)]))
    with pytest.raises(ValueError, match="there already"):
        tables.transaction().add("books", rows(spark, BOOKS, [(70, "a", 1), (70, "b", 1)]))
    os.makedirs(f"{tables.path}/versions/000000009")  # begun and never finished
    assert {n: held(tables, n) for n in tables.tables} == before
    assert begun.commit() == 10 and len(held(tables, "books")) == 59  # what was done before the failure can still be taken


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes(spark, tables, seed):
    rng = random.Random(seed)
    books, marks = {}, {}
    for _ in range(6):
        change = tables.transaction()
        put = [(rng.randrange(30), f"t{rng.random():.4f}", rng.randrange(5)) for _ in range(rng.randrange(1, 9))]
        change.put("books", rows(spark, BOOKS, put), newer="version")
        for i, t, v in sorted(put, key=lambda r: (r[2], r[1])):
            if i not in books or (v, t) >= (books[i][1], books[i][0]):
                books[i] = (t, v)
        some = {rng.randrange(40): rng.choice([*books, None]) for _ in range(5)}
        change.put("marks", rows(spark, MARKS, [(i, b, "n") for i, b in some.items()]))
        marks |= some
        gone = rng.sample(range(30), 4)
        change.delete("books", spark.createDataFrame([(g,) for g in gone], "id long"))
        assert len(held(tables, "books")) != 0 or tables.version() == 0
        books = {i: r for i, r in books.items() if i not in gone}
        marks = {i: b for i, b in marks.items() if b not in gone}
        change.commit()
        assert held(tables, "books") == sorted(((i, t, v) for i, (t, v) in books.items()), key=repr)
        assert held(tables, "marks") == sorted(((i, b, "n") for i, b in marks.items()), key=repr)
