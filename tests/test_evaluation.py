"""Ranks of expected passages against a search of all documents by all questions."""

import random

import pytest
import regex

from lectern.operators import evaluation

WORD = regex.compile(r"[\p{L}\p{N}]+")


def direct(docs, items, depth):
    words = lambda t: {w for w in WORD.findall(t.lower())}
    out = {}
    for item, text, question in items:
        if text is None:
            continue
        expected = {i for i, body in docs if text in (body or "")}
        asked = {w for w in words(question or "") if len(w) >= 3}
        scored = sorted((-len(asked & words(body or "")), i) for i, body in docs)
        best = [i for n, i in scored if n][:depth]
        if expected:
            out[item] = min((k + 1 for k, i in enumerate(best) if i in expected), default=None)
    return out


@pytest.mark.parametrize("seed, depth", [(1, 5), (2, 20), (3, 1)])
def test_equals_a_search_of_all(spark, seed, depth):
    rng = random.Random(seed)
    pool = [f"w{i}x" * (1 + i % 3) for i in range(30)] + ["the"] * 30 + ["Öl", "niño", "ab"]
    docs = [(i, "the " + " ".join(rng.choices(pool, k=rng.randrange(0, 15)))) for i in range(150)] + [(900, None), (901, "")]
    items = []
    for q in range(40):
        body = docs[rng.randrange(150)][1]
        cut = rng.randrange(0, max(1, len(body) - 3))
        items.append((q, body[cut : cut + rng.randrange(2, 40)], rng.choice([" ".join(rng.choices(pool, k=4)), "the", "", None])))
    items += [(50, None, "the"), (51, "nowhere to be found here", "the"), (52, "", "the")]
    table = spark.createDataFrame(items, "item_id long, text string, question string")
    found = evaluation.ranks(spark.createDataFrame(docs, "doc_id long, text string"), table, depth)
    assert {r.item_id: r["rank"] for r in found.collect()} == direct(docs, items, depth)
    whole = evaluation.metrics(found).first()
    assert whole.questions == len(direct(docs, items, depth))
