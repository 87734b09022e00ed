"""Names as a table against a finder of one book's names."""

import random

import pytest

from lectern.functions.text import NameFinder
from lectern.operators import name_tables


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_finder_for_each_book(spark, seed):
    rng = random.Random(seed)
    words = ["Ana", "María", "maria", "López", "De", "la", "O'Neil", "Ana María", "Bo", "Élan", "x", "Anabel", "D'Arco", "Nº", "ÁNA"]
    names = {b: [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3]))) for _ in range(8)] + [" ", "", "'Abd"] for b in ("p", "q", "r")}
    pages = [(rng.choice("pqrs"), i, " ".join(rng.choices([*words, ",", "(", "—"], k=rng.randrange(0, 40))).replace(" ,", ",")) for i in range(60)] + [("p", 900, None), ("p", 901, ""), (None, 902, "Ana")]
    listed = [(b, n, k) for b, some in names.items() for k, n in enumerate(some)]
    table = spark.createDataFrame(listed, "book_id string, name string, turn int")
    found = name_tables.found(spark.createDataFrame(pages, "book_id string, doc_id long, text string"), table, "turn")
    got = sorted((r.doc_id, r.start, r.end, r.name) for r in found.collect())
    want = []
    for book, doc, text in pages:
        if book in names and text:
            want += [(doc, a, b, names[book][n]) for a, b, n in NameFinder(names[book]).find(text)]
    assert got == sorted(want) and len(want) > 50


def test_people_in_order_of_appearance(spark):
    pages = spark.createDataFrame([("b", 1, "Bo y Ana López, y Ana. Bo"), ("c", 2, "Ana"), ("b", 3, "nadie")], "book_id string, doc_id long, text string")
    names = spark.createDataFrame([("b", "Ana López", 1), ("b", "ana", 1), ("b", "Bo", 2), ("b", "BÓ", 3), ("c", "Ana", 7)], "book_id string, name string, character_id long")
    assert sorted((r.doc_id, r.character_id, r.place) for r in name_tables.people_in(pages, names).collect()) == [(1, 1, 0), (2, 7, 0)]
