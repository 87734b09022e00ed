"""License statements: base phrases against a plain scan, merged diagonals, odd texts."""

import random
import re

import pytest

from lectern.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    found = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def told(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_equals_a_plain_scan(spark, data):
    rng = random.Random(2)
    parts = "gnu general public license apache mit cc by BY CC-BY Mit-License, the x é ünï 9 LICENSE GNU".split()
    texts = [" ".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", " \n", "mit license " * 500, "cc by cc by cc", "MIT License", "K cc by", "gnu general public", "apache\x00license", "x" * 200_000 + " mit license"]
    rows = [(i, t, 5, "a", 1) for i, t in enumerate(texts)] + [(0, texts[0], 5, "a", 1), (None, "cc by", 5, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, template string, row int")
    got = license_scan.scan(docs).collect()
    assert sorted(((r.doc_id, *told(r)) for r in got), key=repr) == sorted(((i, *base(t)) for i, t, *_ in rows), key=repr)
    table = spark.read.parquet(f"{data}/documents.parquet")
    found = {r.doc_id: told(r) for r in license_scan.scan(table).collect()}
    assert found == {r.doc_id: base(r.text) for r in table.collect()}
    assert license_scan.scan(docs.limit(0)).collect() == []


MIT = next(t for label, t in license_scan.STATEMENTS if label == "mit-text")


@pytest.mark.parametrize(
    "change, found",
    [
        (lambda w: w, True),
        (lambda w: [*w[:20], "inserted", "words", "here", *w[20:]], True),
        (lambda w: [*w[:10], *w[13:]], True),
        (lambda w: [x if i % 25 != 5 else "other" for i, x in enumerate(w)], True),
        (lambda w: w[: len(w) // 2], False),
        (lambda w: w[::-1], False),
    ],
)
def test_changed_statements(spark, change, found):
    text = "before it all " + " ".join(change(MIT.split())) + " and after"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.labels == "mit-text") == found and r.base_labels == "" and (r.score >= 0.8) == found
    if found:
        span = license_scan.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("label = 'mit-text' AND agreement >= 0.8").first()
        assert span.start == 3 and span.end == len(words(text)) - 2


def test_statements_and_phrases_together(spark):
    rows = [(1, "Text. Licensed under CC BY-NC 4.0."), (2, "Released under the MIT License."), (3, "Licensed under the Apache License, Version 2.0 ..."), (4, "the general public has no license"), (5, "own words of a house")]
    got = {r.doc_id: (r.base_labels, r.labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("cc-by", "cc-by,cc-by-nc-4.0"), 2: ("mit", "mit,mit-release"), 3: ("apache", "apache,apache-2.0"), 4: ("", ""), 5: ("", "")}
    own = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"own words": "own"}, []).where("labels <> ''").collect()
    assert [(r.doc_id, r.labels, r.first_word) for r in own] == [(5, "own", 0)]


def test_no_python_in_the_plan(spark, data):
    plan = license_scan.scan(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search(r"Python|MapInArrow|MapInPandas|ArrowEval|ExistingRDD", plan)
