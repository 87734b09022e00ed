"""Words cut by page ends against mending page after page."""

import random

import pytest
import regex

from lectern.operators import page_edges

CUT = regex.compile(r"(?s)^(.+?\s)?(\w+)[-‐‑–—]\s*$")


def one_after_the_other(pages, levels=None):
    pages = [list(p or []) for p in pages]
    levels = [list(x) for x in levels] if levels else [[0] * len(p) for p in pages]
    for i in range(len(pages) - 1):
        left, right = pages[i], pages[i + 1]
        if not left or not right or levels[i][-1] or levels[i + 1][0]:
            continue
        m, first = CUT.match(left[-1]), right[0].strip()
        word = first.split()[0] if first else ""
        if not m or not word or not word[0].islower():
            continue
        left[-1] = ((m[1] or "") + m[2] + word).rstrip()
        rest = first[len(word) :].lstrip(" ")
        right[:1] = [rest] if rest else []
        if not rest:
            levels[i + 1] = levels[i + 1][1:]
    return pages


def got(spark, books, levels=None):
    rows = [(b, n + 1, p, "kept", *([levels[b][n]] if levels else [])) for b, pages in books.items() for n, p in enumerate(pages)]
    table = spark.createDataFrame(rows, "book_id string, page int, paragraphs array<string>, word string" + (", levels array<int>" if levels else ""))
    out = {}
    for r in sorted(page_edges.mended(table).collect(), key=lambda r: (r.book_id, r.page)):
        out.setdefault(r.book_id, []).append(r.paragraphs or [])
        assert r.word == "kept"
    return out


def test_chains_over_several_pages(spark):
    books = {
        "a": [["the inter-"], ["national deal", "and fed-"], ["eral"], ["Next-"], ["Upper"]],
        "b": [["un-"], ["be-"], ["liev-"], ["able x-"], ["y"], ["z"]],
        "c": [["one two-"], None, ["three"]],
        "d": [["é-"], ["ßa b-"], ["c-d e-  "], ["f"]],
        "e": [["foo.bar-"], ["baz"], ["a-"], ["(paren)"], ["b—"], ["\tc  d"]],
    }
    assert got(spark, books) == {b: one_after_the_other(p) for b, p in books.items()}


@pytest.mark.parametrize("seed", range(3))
def test_random_books(spark, seed):
    rng = random.Random(seed)
    words = ["a-", "b-", "C-", "d", "e.", "ñu-", "Öl", "x-y-", "9-"]
    books = {f"b{k}": [[" ".join(rng.choices(words, k=rng.choice([1, 1, 1, 2, 3]))) for _ in range(rng.choice([0, 1, 1, 1, 2]))] for _ in range(40)] for k in range(8)}
    assert got(spark, books) == {b: one_after_the_other(p) for b, p in books.items()}
    levels = {b: [[rng.choice([0, 0, 0, 1]) for _ in p] for p in pages] for b, pages in books.items()}
    assert got(spark, books, levels) == {b: one_after_the_other(p, levels[b]) for b, p in books.items()}
