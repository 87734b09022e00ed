"""The pipeline, stage by stage, against direct computations."""

import base64

import public_tokenizers as P

import corpus_pipeline


def test_stages_follow_each_other(spark, data):
    import tiktoken

    documents = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.dtypes == documents.dtypes, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > 0.8 * documents.count() and counts[2] == counts[3]
    encoded = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(encoded) == set(kept)
    for doc_id, r in encoded.items():
        text = kept[doc_id].text
        assert r.ids == library.encode_ordinary(text) and r.decoded == text and r.n_tokens == len(r.ids) and kept[doc_id].n_chars == len(text)


def test_run_is_the_stages(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "n_tokens", "ids", "decoded"]
