"""Retrieval evaluation: ranks of the expected passages, recall at k, mean reciprocal rank.

Questions are a table and stay one. Documents are cut into words once; what is kept is which document holds which word of any question. A
document can only be among the best of a question if it holds one of its rarer words: if the depth best so far share n words, then not only the n - 1
commonest. So only documents with such a word are counted, and a word that all documents hold does not bring them all together with all questions.
The documents that hold an item's text are looked for among those that hold the longest word that stands whole in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.scratch import settled, workspace

KS = (1, 3, 8, 20)
LEAST = 3
_WORD = r"([\p{L}\p{N}]+)"


def _words(text: Column) -> Column:
    """Distinct words of LEAST characters or more."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(1))), lambda w: F.length(w) >= LEAST)


def _key(text: Column) -> Column:
    """The longest word that a text holds whole, so that a document with the text has it as a word; null if there is none."""
    inner = F.regexp_extract_all(F.lower(text), F.lit(r"(?<=[^\p{L}\p{N}])([\p{L}\p{N}]+)(?=[^\p{L}\p{N}])"), F.lit(1))
    return F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]


def _holding(docs: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """item_id, doc_id of the documents that hold an item's text, upper and lower case told apart."""
    keyed = items.withColumn("word", _key(F.col("text")))
    near = keyed.where("word IS NOT NULL").join(hits, "word").join(docs, "doc_id").where(F.contains("body", "text")).select("item_id", "doc_id")
    short = keyed.where("word IS NULL").select("item_id", "text")
    if short.isEmpty():
        return near
    # Texts of a word or two have no key: every document is read for each of them.
    return near.unionByName(docs.join(short, F.contains("body", "text")).select("item_id", "doc_id"))


def _best(asked: DataFrame, hits: DataFrame, depth: int, path: str) -> DataFrame:
    """item_id, doc_id, n (shared words), place (from 1) of the depth best documents of every question. asked: item_id, word; hits: word, doc_id."""
    common = hits.groupBy("word").agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy("item_id").orderBy("df", "word")
    held = asked.join(common, "word").withColumn("turn", F.row_number().over(by_rarity)).withColumn("upto", F.sum("df").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)))
    held = settled(held.withColumn("words", F.count("*").over(Window.partitionBy("item_id"))), f"{path}/asked")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "doc_id"))

    def counted(chosen: DataFrame) -> DataFrame:
        some = chosen.select("item_id", "word").join(hits, "word").select("item_id", "doc_id").distinct()
        return some.join(hits, "doc_id").join(held.select("item_id", "word"), ["item_id", "word"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))

    first = counted(held.where(F.coalesce("upto", F.lit(0)) < depth)).withColumn("place", place).where(F.col("place") == depth).select("item_id", F.col("n").alias("reached"))
    rare = held.join(first, "item_id", "left").where(F.col("turn") <= F.col("words") - F.coalesce("reached", F.lit(1)) + 1)
    return counted(rare).withColumn("place", place).where(F.col("place") <= depth)


def ranks(docs: DataFrame, questions: DataFrame, depth: int = 20) -> DataFrame:
    """item_id, rank (1-based, null beyond depth) of the first document that holds the item's text, of the answerable items.

    Documents are ranked by how many different words of three characters or more they share with the question
    (column question, else text); ties by doc_id. Items without text are left out; a null document is empty.
    """
    path = workspace(docs.sparkSession, "ranks")
    items = questions.withColumn("question", F.col("question") if "question" in questions.columns else F.col("text")).where("text IS NOT NULL").select("item_id", "text", F.coalesce("question", F.lit("")).alias("question"))
    bodies = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    asked = items.select("item_id", F.explode(_words(F.col("question"))).alias("word"))
    wanted = asked.select("word").union(items.select(_key(F.col("text")))).where("word IS NOT NULL").distinct()
    told = bodies.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(_WORD), F.lit(1)))).alias("word"))
    hits = settled(told.join(wanted, "word").distinct(), f"{path}/hits")
    expected = settled(_holding(bodies, items, hits).distinct(), f"{path}/expected")
    best = _best(asked, hits, depth, path).join(expected, ["item_id", "doc_id"], "left_semi").groupBy("item_id").agg(F.min("place").cast("long").alias("rank"))
    return expected.select("item_id").distinct().join(best, "item_id", "left").select("item_id", "rank")


def metrics(ranked: DataFrame) -> DataFrame:
    """One row: questions, recall at each k, mean reciprocal rank; zeros without questions."""
    share = lambda k: F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{k}")
    mrr = F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 9).alias("mrr")
    return ranked.agg(F.count("*").alias("questions"), *map(share, KS), mrr)
