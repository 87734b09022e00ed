"""Registered queries of the operators in this subpackage: thin digests over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    byte_bpe,
    decontaminate,
    embedding_dups,
    hamerly,
    license_scan,
    ngram_lm,
    oracle_sql,
    pii,
    quality,
    sequences,
    shared,
    simhash,
    token_files,
    toxicity,
    url_rules,
)
from lectern.sources.tables import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), shared.workspace(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), added_as_text=False
    )
    return token_files.read_token_digests(manifest)


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = shared.crc_remainder("doc_id", 10)
    model = ngram_lm.train(docs, remainder != 0, shared.workspace(spark, "lm"))
    return ngram_lm.score(docs, model).select(
        "doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared.workspace(spark, "leaks"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), shared.crc_remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (shared.crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"), shared.workspace(spark, "embedding-dups"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), shared.crc_remainder("doc_id", 4) != 2)
    return quality.score(docs, model).select(
        "doc_id", (shared.crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shared.workspace(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, centroids = hamerly.clustered(table(spark, sf_dir, "embeddings"), shared.workspace(spark, "clusters"), k=40, rounds=5, seed="2:", scale=256, dimension=64)
    return hamerly.with_inertia(near, centroids)


def op12_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sequences.frequent(_click_events(table(spark, sf_dir, "clicks")), shared.workspace(spark, "sequences"), gap=900_000_000, span=2_250_000_000, longest=4, share=(3, 10), least=2)
    return sequences.with_wider(kept).select(
        F.array_join("pattern", ">").alias("pattern"),
        F.size("pattern").alias("length"),
        F.col("support").cast("long"),
        F.col("clients_crc").cast("long"),
        F.col("n_wider").cast("long"),
        "closed",
    )


def _click_events(clicks: DataFrame) -> DataFrame:
    """The clicks; for those whose crc32(click_id) is divisible by 5 also open a second before and shut a second after."""
    plain = sequences.events(clicks, "client_id", "ts", "kind", "click_id")
    told = lambda shift, kind: F.struct((F.col("t") + shift).alias("t"), kind.alias("kind"))
    own = told(0, F.col("kind"))
    framed = F.array(own, told(-1_000_000, F.lit("open")), told(1_000_000, F.lit("shut")))
    marked = F.col("click_id").isNotNull() & (shared.crc_remainder("click_id", 5) == 0)
    return plain.select("client", F.explode(F.when(marked, framed).otherwise(F.array(own))).alias("event")).select("client", "event.t", "event.kind")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_ngram_lm": op2_ngram_lm,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_url_rules": op7_url_rules,
    "op8_embedding_dups": op8_embedding_dups,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_hamerly": op11_hamerly,
    "op12_sequences": op12_sequences,
    "op13_license_scan": op13_license_scan,
}

#: The others count by hash functions, tokenizers, models or patterns that SQL lacks; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op8_embedding_dups": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0 WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(node, label) AS (SELECT a, a FROM l UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.node WHERE r.label < l.b),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node), k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(label, vec_id) AS component_id, coalesce(label, vec_id) = vec_id AS kept FROM v LEFT JOIN k ON a = vec_id LEFT JOIN c ON node = vec_id""",
    "op11_hamerly": oracle_sql.clusters(),
    "op12_sequences": oracle_sql.sequences(),
    "op13_license_scan": oracle_sql.licenses(),
}
