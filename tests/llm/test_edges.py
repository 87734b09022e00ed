"""Nulls, repeats, empty and very large values, clashing columns and adversarial chains, for operators and the pipeline."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import byte_bpe, embedding_dups, ngram_lm, quality, shared, simhash, toxicity, url_rules

CLASH = "chunk string, bucket int, body string, turn int, salt int, hash long, leak string, node long, label int, spans string, bits long"


def with_clash(docs):
    return docs.withColumns({f.split()[0]: F.lit(None).cast(f.split()[1]) for f in CLASH.split(", ")})


def test_urls_of_very_many_tokens_and_repeated_pages(spark):
    long = "http://a.net/" + "/".join(f"part{i}" for i in range(5000))
    pages = spark.createDataFrame([(1, long), (1, long), (1, "http://b.org/x"), (None, long), (None, None)], "page_id long, url string")
    found = [(r.page_id, r.rule, r.verdict) for r in url_rules.judge(with_clash(pages)).collect()]
    assert sorted(found, key=repr) == sorted([(1, None, "allow"), (1, None, "allow"), (1, "org/", "allow"), (None, None, "allow"), (None, None, "allow")], key=repr)


def test_wide_vectors_and_chains_of_vectors(spark):
    rng = np.random.default_rng(8)
    wide = rng.normal(size=(6, 3000))
    wide[3:] = wide[:3] + rng.normal(scale=0.01, size=(3, 3000))
    order = [0, *range(59, 0, -1)]
    step = np.arccos(0.951)
    chain = [(order[k], [float(np.cos(k * step / 2)), float(np.sin(k * step / 2)), 0.0] if k < 18 else None) for k in range(60)]
    turned = [(order[k] + 100, [float(np.cos(k * 0.31)), float(np.sin(k * 0.31))]) for k in range(20)]
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(wide)] + chain + turned
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dups.near_duplicates(with_clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), shared.workspace(spark, "t")).collect()}
    assert [got[1000 + i] for i in range(6)] == [(1, 1000 + i % 3) for i in range(6)]
    vectors = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None}
    for i, v in vectors.items():
        assert got[i][0] == sum(j != i and len(w) == len(v) and float(v @ w) >= 0.95 for j, w in vectors.items())
    first = [got[order[k]][1] for k in range(18)]
    assert len(set(first)) == 1 and first[0] == min(order[:18])
    assert {got[order[k] + 100][1] for k in range(20)} == {100}


@pytest.mark.parametrize("hot_half", [simhash.HOT_HALF, 2])
def test_chains_of_fingerprints(spark, monkeypatch, hot_half):
    """Each differs from the next in two bits or three, in an order of ids that a smaller one crosses node by node."""
    prints, bits = [], 0
    for k in range(30):
        prints.append(bits)
        bits ^= 0b11 << (2 * k)
    others = [0xFFFF_0000_FFFF_0000 ^ (1 << b) for b in range(0, 64, 3)]
    ids = [0, *range(29, 0, -1)]
    rows = [(i, p) for i, p in zip(ids, prints, strict=True)] + [(100 + i, p) for i, p in enumerate(others)] + [(500, prints[7]), (None, prints[3])]
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "doc_id long, bits long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: table)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, shared.workspace(spark, "t"), hot_half=hot_half).collect()}
    assert {found[i] for i in range(30)} == {0} and found[500] == 0 and found[None] is None
    assert {found[100 + i] for i in range(len(others))} == {100}


def test_models_of_repeated_rows_and_other_columns(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "c"), (None, "d d"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.train(with_clash(docs), F.lit(True), shared.workspace(spark, "t"))
    plain = ngram_lm.train(docs, F.lit(True), shared.workspace(spark, "t"))
    assert model.tokens == plain.tokens == sum(len((t or "").split()) + 1 for _, t in rows)
    scored = sorted((tuple(r) for r in ngram_lm.score(with_clash(docs), model).collect()), key=repr)
    assert scored == sorted((tuple(r) for r in ngram_lm.score(docs, plain).collect()), key=repr) and len(scored) == len(rows)


def test_byte_bpe_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None), (2, " \n")], "doc_id long, text string")
    found = byte_bpe.encoded(with_clash(docs), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in found) == [(0, ""), (1, "one two"), (1, "one two"), (2, " \n")]


def test_classifiers_of_empty_documents_and_tied_labels(spark):
    docs = spark.createDataFrame([(i, ["good plain words", "bad bad words", "", None][i % 4]) for i in range(40)] + [(3, "twice")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i // 40) for i in range(80)], "doc_id long, label int")
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        model = module.train(with_clash(docs), labels.withColumnRenamed("label", name), F.lit(True))
        scores = [r.score for r in module.score(with_clash(docs), model).collect()]
        assert len(scores) == 45 and all(0 <= s <= 1 for s in scores)
        assert module.score(docs.limit(0), model).collect() == []
        assert {r.score for r in module.score(docs, module.train(docs.limit(0), labels.withColumnRenamed("label", name), F.lit(True))).collect()} == {0.0}


def test_pipeline_of_odd_documents(spark, tmp_path, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "x"), (1, base, "x"), (2, base + " tail", "y"), (3, None, "z"), (4, "", "z"), (5, f"before {item} after", "w"), (None, f"again {item}", "w"), (None, "mail me a@b.org", "w"),
        (6, "long " * 60_000, "v"), (7, "call +49 (30) 1234 5678 now", "v"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "k", 5) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, turn int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = shared.settled(stage(spark, kept, str(tmp_path)), shared.workspace(spark, "t"))
        assert kept.dtypes == docs.dtypes
    found = sorted(((r.doc_id, r.text, r.spans, r.turn) for r in kept.collect()), key=repr)
    assert [(i, t) for i, t, _, _ in found if i not in (3, 4)] == [(1, base), (6, "long " * 60_000), (7, "call <phone> now"), (None, "mail me <email>")] and {(s, n) for *_, s, n in found} == {("k", 5)}
    assert len([i for i, *_ in found if i in (3, 4)]) == 1  # texts without words are copies of each other
    ends = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.decoded or "") for r in ends) == sorted((i or 0, t or "") for i, t, _, _ in found)
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
