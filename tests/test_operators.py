"""Small cases of the DataFrame operators and the streaming queries."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import location, relational, retrieval
from lectern.streaming import reading


def test_vector_top_and_fusion(spark):
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0]), (30, [0.7071, 0.7071])], "chunk_id long, v array<float>")
    best = retrieval.top(retrieval.vector_scores(vectors, [0.0, 1.0]), 2, ascending=False)
    assert [r.id for r in best.orderBy("pos").collect()] == [20, 30]
    lists = [spark.createDataFrame(list(zip(range(len(ids)), ids)), "pos int, id long") for ids in ([1, 2, 3], [2, 4, 5])]  # noqa: B905
    fused = [r.id for r in retrieval.fuse(lists).orderBy("place").collect()]
    assert fused[0] == 2 and set(fused) == {1, 2, 3, 4, 5}


def test_question_terms(spark):
    asked = spark.createDataFrame([('¿Qué dice el autor sobre la "memoria" episódica OR NEAR?',), ("¿Y qué?",)], "q string")
    assert [r.f for r in asked.select(retrieval.fts_query(F.col("q")).alias("f")).collect()] == ["memoria* OR episódica* OR near", None]
    assert retrieval.terms_of('¿Qué dice el autor sobre la "memoria" episódica OR NEAR?') == ["memoria*", "episódica*", "near"]


def test_text_score_counts_written_hits(spark):
    chunks = spark.createDataFrame([(1, "b", 1, 1, "abcd efgh ij mató"), (2, "b", 1, 1, "nada")], "id long, book_id string, start_page int, end_page int, text string")
    assert [(r.id, r.score) for r in retrieval.text_search(chunks, ["mat*", "mato"]).collect()] == [(1, -17.0)]


def test_stretches_of_a_hundred_pages(spark):
    parts = spark.createDataFrame([("START",), ("MIDDLE",), ("END",)], "part string")
    found = parts.select(location.stretch(F.lit(1), F.lit(100), F.col("part")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in found] == [(1, 25), (38, 62), (76, 100)]


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id long, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "id long, v int, x string")
    assert sorted(map(tuple, relational.upsert(old, new, ["id"], "v").collect())) == [(1, 2, "c"), (2, 5, "b"), (3, 1, "e")]


def test_streams_match_their_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 5), (1, t + dt.timedelta(milliseconds=300), 6), (1, t + dt.timedelta(seconds=5), 4), (2, t, 9)]
    spark.createDataFrame(rows, "reader long, ts timestamp, page int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("reader long, ts timestamp, page int").parquet(f"{tmp_path}/in")
    query = reading.max_page_stream(stream).writeStream.outputMode("complete").format("memory").queryName("most").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("most").collect())) == [(1, 6), (2, 9)]
    sink = reading.upsert_sink(f"{tmp_path}/out", ["reader"], "ts")
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.reader, r.page) for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()) == [(1, 4), (2, 9)]


def test_debounced_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 5), (1, t + dt.timedelta(milliseconds=300), 6), (1, t + dt.timedelta(seconds=5), 4), (9, t + dt.timedelta(hours=1), 1)]
    spark.createDataFrame(rows, "reader long, ts timestamp, page int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("reader long, ts timestamp, page int").parquet(f"{tmp_path}/in")
    query = reading.debounced_stream(stream).writeStream.outputMode("append").format("memory").queryName("quiet").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.reader, r.page) for r in spark.table("quiet").collect()) == [(1, 4), (1, 6)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_typography_of_lines(spark):
    from lectern.operators import text

    rows = []
    for page in range(4):
        for n in range(9):
            size = 18.0 if n == 0 else 14.2 if n == 3 else 10.0
            rows.append(("b", page, n, "x" * (3 + 7 * n), 50.0, 50.0 + 9 * n + page, 100 + 12.0 * n + (5 if n > 5 else 0), size, n == 2, 5.0))
    schema = "book_id string, page int, n int, text string, left double, right double, baseline double, size double, bold boolean, first_word double"
    lines = spark.createDataFrame(rows, schema)
    got = text.typography(lines).first()
    # Plain lines are 1, 2 and 4 to 8: they are 9 * 8 + page wide at most, and stand 12, 12, 17, 12 and 12 apart (24 over a heading).
    assert (got.body, got.headings, got.width, got.gap, got.bold_body) == (10.0, [18.0, 14.0], 74.0, 12.0, False)
    layouts = lines.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("n", *text.LINE_COLUMNS))).alias("lines"))
    blocks = text.layout_blocks(layouts, text.typography(lines)).where("page = 2").orderBy("number").collect()
    assert [(len(r.text), r.level) for r in blocks][:2] == [(3, 1), (10, 0)] and sum(len(r.text.replace("\n", "").replace(" ", "")) for r in blocks) == sum(3 + 7 * n for n in range(9))


def test_chapter_at_a_page(spark):
    chapters = spark.createDataFrame([("b", i, s) for i, s in enumerate((3, 5, 20, 700), 1)] + [("c", 1, 1)], "book_id string, number int, start_page int")
    rows = spark.createDataFrame([("b", 1), ("b", 3), ("b", 19), ("b", 300), ("b", 699), ("b", 5000), ("c", 40), ("d", 1)], "book_id string, page int")
    got = {(r.book_id, r.page): r.chapter for r in relational.chapter_at(rows, chapters, block_pages=8).collect()}
    assert got == {("b", 1): None, ("b", 3): 1, ("b", 19): 2, ("b", 300): 3, ("b", 699): 3, ("b", 5000): 4, ("c", 40): 1, ("d", 1): None}


def test_queries_of_whole_texts(spark, tmp_path):
    import hashlib

    from lectern.plans import text_queries

    texts = [". ".join(f"line {i} of {n} says {i * i}" for i in range(n)).replace(". ", "\n") for n in (2, 30, 900)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    joined = {r.doc_id: r.joined_sha256 for r in text_queries.join_overlap_text(spark, str(tmp_path)).collect()}
    assert joined == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    places = {r.passage_id: r for r in text_queries.passages_located(spark, str(tmp_path)).collect()}
    assert 400 < places[2][1] < 500, places


def test_components_of_long_chains(spark):
    """Chains in orders that a smaller label crosses node by node, all at once; as many rounds as the length has binary digits, and a few."""
    import random

    from lectern.operators import components
    from lectern.sources import scratch

    rng, n = random.Random(4), 5000
    down = [0, *range(n - 1, 0, -1)]
    zigzag = [x for pair in zip(range(n // 2), range(n - 1, n // 2 - 1, -1), strict=True) for x in pair]
    between = list(dict.fromkeys(x for k in range(n // 2, 0, -1) for x in (k + n // 2 - 1, k)))
    mixed = rng.sample(range(n), n)
    chains = [list(range(n)), down, zigzag, between, mixed]
    star = [[0, *rng.sample(range(1 + 70 * k, 71 + 70 * k), 70)] for k in range(70)]
    edges, shift = [], 0
    for chain in chains:
        edges += [(a + shift, b + shift) for a, b in zip(chain, chain[1:])]  # noqa: B905
        shift += n
    edges += [(a + shift, b + shift) for chain in star for a, b in zip(chain, chain[1:])] + [(-7, -3), (-3, 9_000_000), (-9, -9)]  # noqa: B905
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    path = scratch.workspace(spark, "t")
    found = components.connected_components(table, path)
    assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in parent}
    last = max(int(f.rsplit("round-", 1)[1].split("/")[0]) for f in found.inputFiles())
    assert last < 30
    assert components.connected_components(table.limit(0), scratch.workspace(spark, "t")).collect() == []
