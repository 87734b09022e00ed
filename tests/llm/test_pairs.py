"""SimHash and embedding near-duplicates against brute force, and their edge cases."""

import re
from collections import Counter

import numpy as np
import xxhash

from lectern.llm import components, embedding_dups, near_copies, shared, simhash


def leaders(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def by_the_book(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    long = "word " * 70_000
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one\u00a0two"), (1005, long), (1006, long + "end"), (1007, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.bits & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, shared.workspace(spark, "t")).collect()}
    prints = {i: by_the_book(t) for i, t in rows if len(t or "") < 100_000}
    assert all(got[i][0] == p for i, p in prints.items())
    want = leaders(sorted(got), lambda a, b: (got[a][0] ^ got[b][0]).bit_count() <= 3)
    assert {i: c for i, (_, c) in got.items()} == want


def test_dense_groups_are_not_paired(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:2] for i, j in rng.integers(0, 64, (700, 2))]
    prints = np.unique(np.array([*map(int, base), *near], np.uint64))
    asks = np.zeros(len(prints), bool)
    groups = simhash._entry_links(prints, asks)
    want = leaders(list(range(len(prints))), lambda a, b: (int(prints[a]) ^ int(prints[b])).bit_count() <= 3)
    firsts = {int(g.min()): set(g.tolist()) for g in groups}
    assert firsts == {k: {i for i, c in want.items() if c == k} for k in set(want.values()) if list(want.values()).count(k) > 1}
    split = {frozenset((int(a), int(b))) for some in simhash._split(prints, len(prints), 0) for g in simhash._entry_links(prints[some], asks[some]) for a, b in zip(*components.forest(some[g]), strict=True)}
    same_half = lambda a, b: (int(prints[a]) ^ int(prints[b])) & 0xFFFFFFFF == 0
    want = leaders(list(range(len(prints))), lambda a, b: same_half(a, b) and (int(prints[a]) ^ int(prints[b])).bit_count() <= 3)
    reached = leaders(list(range(len(prints))), lambda a, b: frozenset((a, b)) in split)
    assert all(reached[i] <= want[i] for i in want)


def test_kept_documents(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "w"), (2, "other text here", "z"), (None, "a b c d", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    kept = simhash.kept_one_each(docs, shared.workspace(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, "a b c d", "w"), (2, "other text here", "z"), (None, "a b c d", "n")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none, shared.workspace(spark, "t")).collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dups.near_duplicates(none, shared.workspace(spark, "t")).collect() == []


def test_embeddings_equal_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(embedding_dups, "TILE", 200)
    rng = np.random.default_rng(0)
    given = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x = np.stack(given.embedding).astype(float)
    x = np.concatenate([x, x[:50] + rng.normal(0, 0.02, (50, 64)), x[50:60], np.tile(x[3], (300, 1)) + rng.normal(0, 0.01, (300, 64)), x[5:6] * 3])
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    odd = [(9001, None, "b"), (9002, [0.0] * 64, "b"), (9003, [float("nan")] * 64, "b"), (9004, [], "b"), (9005, [1.0, 2.0], "b"), (None, [1.0, 2.0], "b"), (9006, [1.0, 2.01], "b")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dups.near_duplicates(vectors, shared.workspace(spark, "t")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    first = leaders(list(range(len(x))), lambda a, b: links[a, b])
    assert {i: got[i] for i in range(len(x))} == {i: (int(links[i].sum()), first[i], first[i] == i) for i in range(len(x))}
    assert {i: got[i][:2] for i in (9001, 9002, 9003, 9004, 9005, None, 9006)} == {
        9001: (0, 9001), 9002: (0, 9002), 9003: (0, 9003), 9004: (0, 9004), 9005: (2, 9005), None: (2, None), 9006: (2, 9005),
    }


def test_embeddings_without_or_with_negative_ids(spark):
    rows = [(None, [1.0, 2.001]), (9005, [1.0, 2.0]), (9006, [1.0, 2.01]), (-7, [-5.0, 1.0]), (-3, [-5.0, 1.01]), (4, [-5.0, 1.02]), (None, [3.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dups.near_duplicates(vectors, shared.workspace(spark, "t")).collect()), key=repr)
    assert got == sorted(
        [(None, 2, None, True), (9005, 2, 9005, True), (9006, 2, 9005, False), (-7, 2, -7, True), (-3, 2, -7, False), (4, 2, -7, False), (None, 0, None, True)], key=repr
    )


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(map(tuple, components.connected_components(edges, shared.workspace(spark, "t")).collect()))
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_near_copies_equal_brute_force(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "SAMPLED", 2)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocabulary, 30))  # in half of all texts
    texts = []
    for _ in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(4, 400))))
        texts.append(" ".join(words) + (f" {line}" if rng.random() < 0.5 else ""))
        for edits in (1, 2, 3, 4):
            changed = words.copy()
            for place in rng.integers(0, len(words), max(1, edits * len(words) // 120)):
                changed[place] = "other"
            texts.append(" ".join(changed))
    texts += [None, "", " \n", "One two", "one TWO", texts[0].upper()]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()) else set() for t in texts]
    want = leaders(list(range(len(texts))), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs, shared.workspace(spark, "t")).collect()}
    assert got == want | {None: None} and 60 < len(set(want.values())) < 280
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(want.values()) | {None}
    assert near_copies.near_duplicates(docs.limit(0), shared.workspace(spark, "t")).collect() == []


def test_near_copies_are_found_by_simhash_and_checked_exactly(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(25):
        words = [f"w{n}" for n in rng.integers(0, 3000, 300)]
        texts += [" ".join(words), " ".join([*words[:-1], "last"]), " ".join([*words[:150], *["x"] * 3, *words[150:]])]
    prints = [simhash.majority(near_copies.shingles(t, near_copies.WordHashes())) for t in texts]
    sets = [set(near_copies.shingles(t, near_copies.WordHashes()).tolist()) for t in texts]
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    close = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    ids, seen = list(range(len(texts))), []
    linked = simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda *a, **k: seen.append(linked(*a, **k)) or seen[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs, shared.workspace(spark, "t")).collect()}
    assert got == leaders(ids, alike)
    by_print = leaders(ids, lambda a, b: close(a, b) and alike(a, b))
    held = sorted(n for _, n in Counter(r.component for r in seen[0].collect()).items())
    assert held == sorted(n for n in Counter(by_print.values()).values() if n > 1) and held


def test_equal_fingerprints_of_unlike_sets_are_not_linked(spark, tmp_path):
    places = {10: {1, 2, 3, 4, 5}, 20: {1, 2, 3, 4, 5, 6}, 30: {7, 8, 9}}
    check = lambda: lambda mine, others: np.array([5 * len(places[mine] & places[o]) >= 4 * len(places[mine] | places[o]) for o in others.tolist()])
    prints = spark.createDataFrame([(5, 10), (7, 20), (5, 30)], "bits long, node long")
    assert {tuple(r) for r in simhash.linked(prints, f"{tmp_path}/a", check=check).collect()} == {(10, 10), (20, 10)}
    assert {tuple(r) for r in simhash.linked(prints, f"{tmp_path}/b").collect()} == {(10, 10), (20, 10), (30, 10)}
