"""Results that were lost once: odd white space, each family of keys alone, long words, counts beyond a word, one token set in very many URLs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, ngram_lm, pii, quality, shared, url_rules


@pytest.mark.parametrize("item, held", [("\nzeta quux blorp fnord\n", "zeta quux blorp fnord"), ("alpha beta gamma delta", "alpha beta gamma delta"), ("\x1cone two\x85", "one two")])
def test_short_items_with_any_white_space_are_found_alone(spark, item, held):
    docs = spark.createDataFrame([(1, f"well then {held} and so on"), (2, "nothing of it here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, shared.workspace(spark, "t")).collect()] == [(1, 7)]


FAMILIES = ["AKIA" + "A1B2" * 4, "ASIA" + "A1B2" * 4, "ghp_" + "a1B2c3" * 6, "ghs_" + "a1B2c3" * 6, "AIza" + "aB3_-" * 7, "xoxb-1234567890-abc"]


@pytest.mark.parametrize("secret", FAMILIES)
def test_each_family_of_keys_alone(spark, secret):
    docs = spark.createDataFrame([(1, f"see {secret} there")], "doc_id long, text string")
    assert pii.find(docs).select(pii.written(F.col("spans"))).first()[0] == f"key:4:{4 + len(secret)}"
    assert pii.redact(docs).first().text == "see <key> there"


@pytest.mark.parametrize("form", ["password={}", "password: {}", "Password :\t{}", "api_key = '{}'", 'token:"{}"'])
def test_passwords_as_they_are_written(spark, form):
    docs = spark.createDataFrame([(1, form.format("hunter2222")), (2, "the password is secret, token by token")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: form.format("<password>"), 2: "the password is secret, token by token"}


def test_every_match_of_a_kind_passes_its_hint(spark):
    examples = {"email": "a@b.c", "ip": "1.2.3.4", "card": "4111 1111 1111 1111", "phone": "+4930123456", "iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789", "national": "(212) 555-0123"}
    rows = [(kind, text) for kind, text in examples.items()] + [("key", f) for f in FAMILIES] + [("password", "secret:\tabcdefg8")]
    table = spark.createDataFrame(rows, "kind string, text string")
    for kind in {k for k, _ in rows}:
        some = table.where(F.col("kind") == kind)
        assert some.where(F.col("text").rlike(pii.PATTERNS[kind])).count() == some.where(pii.HINTS[kind](F.col("text"))).count() == some.count()


def test_long_words_are_shaped_whole():
    plain, digits = "a" * 300, "a" * 100 + "9" + "a" * 199
    assert quality.word_terms(plain)[1] != quality.word_terms(digits)[1]
    assert quality.word_terms("Aa" * 100)[1] == quality.word_terms("Bb" * 100)[1]


def test_bigram_counts_beyond_the_array_of_counts(spark):
    rows = [(i, "a b " * 30 + "c d") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = ngram_lm.train(docs, F.lit(True), shared.workspace(spark, "t"))
    capped = ngram_lm.train(docs, F.lit(True), shared.workspace(spark, "t"), most=2)
    scores = lambda m: [r.score for r in ngram_lm.score(docs, m).orderBy("doc_id").collect()]
    assert scores(capped) == scores(plain)
    stored = np.concatenate([ngram_lm.Files(capped).array("times", c, np.uint32) for c in range(capped.cuts)])
    assert stored.max() == 2


def test_one_token_set_in_very_many_urls(spark):
    sets = spark.createDataFrame([(["a", "b"], 25), (["c", "d"], 3)], "items array<string>, blocked long")
    rows = url_rules._repeated(sets, most=10)
    assert {tuple(r["items"]): r["count"] for r in rows.groupBy("items").count().collect()} == {("a", "b"): 25, ("c", "d"): 3}


def test_models_with_cuts_that_hold_no_bigram(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b a")], "doc_id long, text string")
    model = ngram_lm.train(docs, F.lit(True), shared.workspace(spark, "t"), cuts=64)
    asked = spark.createDataFrame([(i, f"w{i} a b w{i}") for i in range(50)], "doc_id long, text string")
    few = ngram_lm.train(docs, F.lit(True), shared.workspace(spark, "t"), cuts=1)
    assert [r.score for r in ngram_lm.score(asked, model).orderBy("doc_id").collect()] == [r.score for r in ngram_lm.score(asked, few).orderBy("doc_id").collect()]
