"""Queries on vectors, jobs and injected models (deterministic stand-ins)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import embedding, models, unigram
from lectern.plans.registry import query
from lectern.sources import library, scratch
from lectern.sources.tables import table


def letter_counts():
    """An embedder that counts a text's letters a, e, i and all its characters."""
    return lambda texts: [[t.count("a"), t.count("e"), t.count("i"), len(t)] for t in texts]


@query(
    "documents_embedded",
    "SELECT doc_id AS id, [len(regexp_extract_all('passage: ' || text, 'a')), len(regexp_extract_all('passage: ' || text, 'e')), len(regexp_extract_all('passage: ' || text, 'i')), length('passage: ' || text)]::DOUBLE[] AS v FROM documents",
)
def documents_embedded(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.embedded(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), letter_counts)


@query(
    "vectors_built",
    f"""WITH {library.PAGES_SQL}, v AS (SELECT vec_id AS chunk_id, 'm' || label % 2 AS model_id, [label]::DOUBLE[] AS v FROM embeddings)
SELECT chunk_id, model_id, v FROM v WHERE model_id = 'm1' AND chunk_id IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'm1', [len(regexp_extract_all('passage: ' || text, 'a')), len(regexp_extract_all('passage: ' || text, 'e')), len(regexp_extract_all('passage: ' || text, 'i')), length('passage: ' || text)]::DOUBLE[]
FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM v WHERE model_id = 'm1')""",
)
def vectors_built(spark: SparkSession, folder: str) -> DataFrame:
    model = F.concat(F.lit("m"), (F.col("label") % 2).cast("string"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), model.alias("model_id"), F.array(F.col("label").cast("double")).alias("v"))
    return embedding.built(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), vectors, "m1", letter_counts)


@query(
    "vectors_pooled",
    """WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings), m AS (SELECT label, place, avg(x::DOUBLE) AS x FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label) SELECT label, list(round(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) ORDER BY place) AS v FROM m JOIN n USING (label) GROUP BY label""",
)
def vectors_pooled(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding.pooled(table(spark, folder, "embeddings").select("label", F.col("embedding").alias("v")), "label")
    return found.select("label", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


def word_pieces() -> embedding.UnigramTokenizer:
    pieces = ["▁", *"abcdefghijklmnopqrstuvwxyz", "▁the", "▁de", "the", "en", "er", "ion", "ti", "tion", "ou", "▁a", "qu", "que"]
    return embedding.UnigramTokenizer([("", 0.0)] * 4 + [(p, -8.0 + 1.5 * len(p) + k / 1000) for k, p in enumerate(pieces)], str.lower)


@query("unigram_pieces")
def unigram_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_pieces of every text by a small vocabulary of pieces, whole texts."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = word_pieces()  # once a task, with the words it remembers
        for texts in batches:
            yield pd.Series([len(tokenizer.encode(t or "", 1 << 60)) for t in texts])

    return table(spark, folder, "documents").select("doc_id", counted("text").alias("n_pieces"))


#: What the map of the query below puts in: letters without accents, ligatures as two letters, line ends as blanks.
RULES = {**dict(zip(library.ACCENTED, library.PLAIN, strict=True)), "ß": "ss", "œ": "oe", "\n": " ", "Ä": "Ae", "—": ""}


@query(
    "texts_normalised",
    f"""SELECT doc_id, length(n) AS length, md5(n) AS md5 FROM (SELECT doc_id,
  translate(replace(replace(replace(replace(replace(text, 'ß', 'ss'), 'œ', 'oe'), chr(10), ' '), 'Ä', 'Ae'), '—', ''), '{library.ACCENTED}', '{library.PLAIN}') AS n FROM documents)""",
)
def texts_normalised(spark: SparkSession, folder: str) -> DataFrame:
    done = unigram.normalised(table(spark, folder, "documents"), unigram.compiled(RULES), "doc_id")
    return done.select("doc_id", F.length("text").cast("long").alias("length"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query(
    "unigram_ids",
    """WITH RECURSIVE cut AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws FROM documents),
words AS MATERIALIZED (SELECT DISTINCT '▁' || unnest(ws) AS w FROM cut), starts AS (SELECT w, unnest(range(1, length(w) + 1)) AS a FROM words),
parts AS (SELECT w, a, unnest(list_transform(range(1, least(6, length(w) - a + 1) + 1), lambda n: substr(w, a, n))) AS piece FROM starts),
counted AS (SELECT piece, count(*) AS n FROM parts GROUP BY piece HAVING count(*) >= 20),
vocabulary AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n DESC, piece) AS id, piece, round(ln(n / (SELECT CAST(sum(n) AS DOUBLE) FROM counted)) * 1000) AS score FROM counted),
known AS MATERIALIZED (SELECT w, a - 1 AS b, a - 1 + length(piece) AS e, id, score FROM parts JOIN vocabulary USING (piece)),
edges AS MATERIALIZED (SELECT * FROM known UNION ALL SELECT w, a - 1, a, 0, (SELECT min(score) FROM vocabulary) - 10 FROM starts s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.w = s.w AND k.b = s.a - 1 AND k.e = s.a)),
way AS (SELECT w, 0::BIGINT AS place, [{'e': 0::BIGINT, 's': 0.0::DOUBLE, 'ids': []::BIGINT[]}] AS held FROM words
  UNION ALL SELECT w, place + 1, list_append(held, best) FROM (SELECT y.w, y.place, y.held, arg_min({'e': g.e, 's': y.held[g.b + 1].s + g.score, 'ids': CASE WHEN g.id = 0 AND y.held[g.b + 1].ids[-1] = 0 THEN y.held[g.b + 1].ids ELSE list_append(y.held[g.b + 1].ids, g.id) END},
    {'s': -(y.held[g.b + 1].s + g.score), 'b': g.b}) AS best FROM way y JOIN edges g ON g.w = y.w AND g.e = y.place + 1 GROUP BY y.w, y.place, y.held)),
done AS MATERIALIZED (SELECT w, held[-1].ids AS ids FROM way WHERE place = length(w)),
uses AS (SELECT doc_id, '▁' || unnest(ws) AS w, unnest(range(len(ws))) AS k FROM cut),
told AS (SELECT doc_id, list(ids ORDER BY k) AS ids FROM uses JOIN done USING (w) GROUP BY doc_id)
SELECT doc_id, len(flatten(coalesce(ids, []))) AS n_pieces, md5(array_to_string(flatten(coalesce(ids, [])), ' ')) AS md5 FROM documents LEFT JOIN told USING (doc_id)""",
)
def unigram_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every whole text by a vocabulary of the texts' own parts; white space as one blank."""
    docs = table(spark, folder, "documents")
    plain = docs.select(F.col("doc_id").alias("id"), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")).alias("text"))
    path = scratch.workspace(spark, "pieces")
    vocabulary = scratch.settled(unigram.trained(plain), f"{path}/vocabulary")
    found = unigram.encoded(plain, vocabulary, path)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("md5"))


def echo_client():
    def client(request: dict) -> dict:
        n = request["request_id"] % 4
        if n == 3:
            raise models.ModelError("Overloaded")
        if n == 2:
            return {"text": "", "blocked": True, "input": 1, "output": 0}
        return {"text": f"<{request['prompt']}>", "input": len(request["prompt"]), "output": 2}

    return client


def _no_wait(seconds: float) -> None:
    return None


@query(
    "requests_answered",
    """SELECT s_suppkey AS request_id, ['Complete', 'Complete', 'Refused', 'Overloaded'][s_suppkey % 4 + 1] AS outcome, CASE s_suppkey % 4 WHEN 2 THEN '' WHEN 3 THEN NULL ELSE '<' || s_name || '>' END AS text,
CAST(CASE s_suppkey % 4 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE length(s_name) END AS BIGINT) AS input, CAST(CASE WHEN s_suppkey % 4 < 2 THEN 2 ELSE 0 END AS BIGINT) AS output FROM supplier""",
)
def requests_answered(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_name").alias("prompt"))
    return models.answered(requests, echo_client, wait=_no_wait)


def points_client():
    def client(request: dict) -> dict:
        n = request["request_id"]
        if n % 5 == 0:
            return {"text": " ", "blocked": True}
        if n % 5 == 1:
            raise models.ModelError("RateLimited")
        return {"text": f'{{"points":[{{"text":"p{n}","page":{n}}}]}}'}

    return client


@query(
    "points_ensured",
    """SELECT c_custkey AS chapter_id, 'OLD' AS status, NULL AS page FROM customer WHERE c_custkey % 3 = 0 UNION ALL
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'REFUSED' ELSE 'READY' END, CASE WHEN c_custkey % 5 <> 0 THEN least(greatest(c_custkey, 20), 90) END FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 1""",
)
def points_ensured(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    chapters = table(spark, folder, "customer").select(key.alias("id"), F.col("c_name").alias("prompt"), F.lit(20).alias("start_page"), F.lit(90).alias("end_page"))
    none = F.array().cast("array<struct<text:string,page:int>>")
    saved = table(spark, folder, "customer").where(key % 3 == 0).select(key.alias("chapter_id"), F.lit("OLD").alias("status"), none.alias("points"))
    found = models.ensured_points(chapters, saved, points_client, _no_wait)
    return found.select("chapter_id", "status", F.get("points", F.lit(0))["page"].alias("page"))


@query(
    "jobs_queued",
    """WITH j AS (SELECT s_suppkey AS book_id, s_suppkey * 10 AS asked_at, ['WAITING', 'RUNNING', 'DONE'][s_suppkey % 3 + 1] AS state FROM supplier WHERE s_suppkey % 2 = 0), o AS (SELECT * FROM j WHERE state <> 'DONE'),
a AS (SELECT p_partkey % 90 AS book_id, min(2000 + p_partkey) AS first, max(CASE WHEN p_partkey % 7 = 0 THEN 2000 + p_partkey END) AS replaced FROM part WHERE p_partkey < 130 GROUP BY 1)
SELECT coalesce(o.book_id, a.book_id) AS book_id, coalesce(replaced, asked_at, first) AS asked_at, CASE WHEN replaced IS NOT NULL OR asked_at IS NULL THEN 'WAITING' ELSE state END AS state FROM o FULL JOIN a ON o.book_id = a.book_id""",
)
def jobs_queued(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    state = F.element_at(F.array(F.lit("WAITING"), F.lit("RUNNING"), F.lit("DONE")), (key % 3 + 1).cast("int"))
    jobs = table(spark, folder, "supplier").where("s_suppkey % 2 = 0").select(key.alias("book_id"), (key * 10).alias("asked_at"), state.alias("state"))
    part = F.col("p_partkey")
    asked = table(spark, folder, "part").where("p_partkey < 130").select((part % 90).alias("book_id"), (part + 2000).alias("asked_at"), (part % 7 == 0).alias("replace"))
    return models.queued(jobs, asked)


@query(
    "stage_guards",
    """WITH e AS (SELECT user_id AS book_id, event_type AS stage, event_id AS n, CASE WHEN event_id % 97 = 0 THEN 'update' WHEN event_id % 61 = 0 THEN 'unsupported' WHEN event_id % 3 = 0 THEN 'end' ELSE 'begin' END AS what FROM events),
r AS (SELECT book_id, stage, max(n) FILTER (what IN ('end', 'update')) AS cleared, max(n) FILTER (what = 'update') AS updated FROM e GROUP BY ALL)
SELECT book_id, stage, count(*) FILTER (what = 'begin' AND n > coalesce(cleared, -1)) AS crashes, count(*) FILTER (what = 'begin' AND n > coalesce(cleared, -1)) >= 2 OR count(*) FILTER (what = 'unsupported' AND n > coalesce(updated, -1)) > 0 AS skip
FROM e JOIN r USING (book_id, stage) GROUP BY book_id, stage""",
)
def stage_guards(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    what = F.when(n % 97 == 0, "update").when(n % 61 == 0, "unsupported").when(n % 3 == 0, "end").otherwise("begin")
    return models.guarded(table(spark, folder, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("stage"), n.alias("n"), what.alias("what")))
