"""Full-text and vector search, rank fusion, pruning, fragments, citations and question routing."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources import library

# Words that carry no meaning in a question, and the limits of a full-text query.
STOP_WORDS = (
    "que qué como cómo cual cuál cuales cuáles donde dónde cuando cuándo quien quién por para con sin sobre entre desde hasta los las una "
    "unos unas del al el la lo le les se su sus es son fue ser hay dice autor libro capítulo capitulo esto esta este eso esa ese más "
    "muy pero porque según también the and"
).split()
MIN_TERM, PREFIX_FROM, MAX_TERMS = 3, 5, 12
# Phrases of questions about a whole book, phrases that ask for a summary, words that point back in a conversation.
GLOBAL_PHRASES = (
    "de qué trata", "de que trata", "de qué va", "de que va", "resume", "resumen", "en general", "idea principal", "ideas principales", "tema principal",
    "temas principales", "tesis", "argumento del libro", "conclusión del libro", "conclusiones", "mensaje del libro", "estructura del libro",
)
SUMMARY_PHRASES = (
    "resum", "resúm", "de qué trata", "de que trata", "de qué va", "de que va", "qué pasa", "que pasa", "qué pasó", "que pasó", "que paso", "qué ocurr",
    "que ocurr", "qué sucede", "que sucede", "qué sucedió", "que sucedio", "cuéntame", "cuentame",
)
REFERENCE_WORDS = (
    "él ella ellos ellas eso esto ese esa esos esas este esta aquel aquella aquello su sus entonces luego después despues antes "
    "mismo misma anterior otro otra ahí allí allá"
).split()
RRF_K, TOP, MARGIN, SURE_TEXT_HITS, LEAST_KEPT = 60, 20, 0.08, 3, 4


def fts_terms(question: Column) -> Column:
    """Array of query terms, * for prefixes: significant words in order, distinct, at most MAX_TERMS."""
    words = F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(STOP_WORDS))
    return F.transform(F.slice(F.array_distinct(words), 1, MAX_TERMS), lambda w: F.when(F.length(w) >= PREFIX_FROM, F.concat(w, F.lit("*"))).otherwise(w))


def fts_query(question: Column) -> Column:
    terms = fts_terms(question)
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR "))


def terms_of(question: str) -> list[str]:
    """The same terms of one question, for plans that need them as constants."""
    words = [w for w in re.split(r"[^\w]+|_", question.lower()) if len(w) >= MIN_TERM and w not in STOP_WORDS]
    return [f"{w}*" if len(w) >= PREFIX_FROM else w for w in list(dict.fromkeys(words))[:MAX_TERMS]]


def _folded_term(term: str) -> str:
    return term.rstrip("*").lower().translate(str.maketrans(library.ACCENTED, library.PLAIN))


def _hits(text: Column, folded: Column, term: str, number: int) -> Column:
    """Length of '0 term offset length' of every token that the term matches (offset and length in UTF-8 bytes of the text).

    Folding keeps the number of characters, so the place of a match in the folded text is its place in the
    text. The regular expression only sees texts that hold the term's letters at all.
    """
    pattern = rf"(?<![\p{{L}}\p{{N}}]){_folded_term(term)}" + (r"[\p{L}\p{N}]*" if term.endswith("*") else "") + r"(?![\p{L}\p{N}])"
    found = F.regexp_extract_all(folded, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(folded, pattern, -1), F.length)
    sized = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), F.transform(found, F.length), lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sizes"))

    def step(state: Column, m: Column) -> Column:
        here = state["at"] + m["gap"]
        offset = F.octet_length(F.left(text, here))
        size = F.octet_length(F.substr(text, here + 1, m["n"]))
        written = F.length(F.concat_ws(" ", F.lit("0"), F.lit(str(number)), offset.cast("string"), size.cast("string")))
        return F.struct((here + m["n"]).alias("at"), F.concat(state["sizes"], F.array(written)).alias("sizes"))

    none = F.array().cast("array<int>")
    return F.when(F.contains(folded, F.lit(_folded_term(term))), F.aggregate(sized, start, step, lambda s: s["sizes"])).otherwise(none)


def text_search(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """id, score (double) of the chunks that any term matches: minus the length of the list of hits, as written with blanks between."""
    folded = F.col("folded")
    hits = F.concat(*[_hits(F.col("text"), folded, t, i) for i, t in enumerate(terms)]) if terms else F.array().cast("array<int>")
    holds = reduce(or_, (F.contains(folded, F.lit(_folded_term(t))) for t in terms), F.lit(False))
    near = chunks.select("id", "start_page", "end_page", "book_id", "text", library.fold(F.col("text")).alias("folded")).where(holds)
    scored = near.select("id", "start_page", "end_page", "book_id", hits.alias("hits")).where(F.size("hits") > 0)
    total = F.aggregate("hits", F.lit(0), lambda a, n: a + n) + F.size("hits") - 1
    return scored.select("id", "book_id", "start_page", "end_page", (-total).cast("double").alias("score"))


def vector_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """id, score: inner product with the query in double precision."""
    weights = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col("chunk_id").alias("id"), F.aggregate(F.zip_with("v", weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x).alias("score"))


def top(scored: DataFrame, k: int, ascending: bool, digits: int | None = 9) -> DataFrame:
    """id, score, pos (from 0) of the k best; ties by id. Only the k rows are numbered."""
    rounded = F.round("score", digits) if digits is not None else F.col("score")
    keyed = scored.select("id", rounded.alias("score"))
    order = [F.col("score") if ascending else F.col("score").desc(), F.col("id")]
    best = keyed.orderBy(*order).limit(k)
    return best.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """id, rrf, place (from 0), scores and positions (arrays by list, null where absent) of ids in ranked lists (id, score, pos).

    The sum of 1 / (k + pos + 1); ties by first appearance. Each list is evaluated once.
    """
    listed = None
    for number, ranking in enumerate(rankings):
        score = F.col("score") if "score" in ranking.columns else F.lit(None).cast("double")
        some = ranking.select("id", F.col("pos").cast("int").alias("pos"), score.alias("score"), F.lit(number).alias("list"))
        listed = some if listed is None else listed.unionByName(some)
    per_list = lambda c: F.array(*[F.min(F.when(F.col("list") == n, F.col(c))) for n in range(len(rankings))])
    fused = listed.groupBy("id").agg(
        F.round(F.sum(1.0 / (k + F.col("pos") + 1)), 12).alias("rrf"), F.min(F.struct("list", "pos")).alias("first"), per_list("score").alias("scores"), per_list("pos").alias("positions")
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("rrf").desc(), "first")  # at most the lists' lengths
    return fused.withColumn("place", F.row_number().over(order) - 1).select("id", "rrf", "place", "scores", "positions")


def prune(fused: DataFrame) -> DataFrame:
    """id, rrf, place of what stays of a fusion of vector hits (list 0) and text hits (list 1).

    Near the best vector hit or among the first text hits; at least LEAST_KEPT; all without vector hits.
    """
    whole = Window.partitionBy(F.lit(0))
    similarity, position = F.col("scores")[0], F.col("positions")[1]
    rated = fused.withColumn("best", F.max(similarity).over(whole))
    strong = F.coalesce(similarity >= F.col("best") - MARGIN, F.lit(False)) | F.coalesce(position < SURE_TEXT_HITS, F.lit(False))
    marked = rated.withColumn("strong", strong)
    counted = marked.withColumn("n_strong", F.count_if("strong").over(whole)).withColumn(
        "weak_place", F.row_number().over(Window.partitionBy("strong").orderBy("place"))
    )
    keep = F.col("best").isNull() | F.col("strong") | (F.col("weak_place") <= LEAST_KEPT - F.col("n_strong"))
    short = F.col("best").isNotNull() & (F.col("n_strong") < LEAST_KEPT)
    order = [F.when(short, (~F.col("strong")).cast("int")).otherwise(0), F.col("place")]
    return counted.where(keep).select("id", "rrf", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).alias("place"))


def hybrid(chunks: DataFrame, vectors: DataFrame, query: list[float], terms: list[str], k: int = 8) -> DataFrame:
    """id, rrf, place of the k chunks that hybrid retrieval returns."""
    by_vector = top(vector_scores(vectors, query), TOP, ascending=False)
    by_text = top(text_search(chunks, terms), TOP, ascending=True)
    return prune(fuse([by_vector, by_text])).where(F.col("place") < k)


def evenly_spaced(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Rows at floor(i * n / k) of each group by a gapless number from 0 on (column order), all of smaller groups."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    picks = sizes.select(group, F.explode(F.when(F.col("n") <= k, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("n") / k).cast("int")))).alias(order))
    return rows.join(picks, [group, order], "left_semi")


def merged_runs(hits: DataFrame) -> DataFrame:
    """Adjacent chunks of a book and chapter as one: book_id, chapter, start_page, end_page, n_chunks. A null chapter equals a null chapter."""
    near = Window.partitionBy("book_id").orderBy("ordinal")
    new = (F.col("ordinal") != F.lag("ordinal").over(near) + 1) | ~F.col("chapter").eqNullSafe(F.lag("chapter").over(near))
    runs = hits.withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(near))
    return runs.groupBy("book_id", "run").agg(
        F.first("chapter").alias("chapter"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.count("*").alias("n_chunks")
    )


def is_global(question: Column) -> Column:
    return F.exists(F.array(*map(F.lit, GLOBAL_PHRASES)), lambda p: F.contains(F.lower(question), p))


def is_summary(question: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SUMMARY_PHRASES)), lambda p: F.contains(F.lower(question), p))


def needs_context(question: Column) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return (F.size(words) < 4) | (F.try_element_at(words, F.lit(1)) == "y") | F.arrays_overlap(words, F.array(*map(F.lit, REFERENCE_WORDS)))


def cited_pages(answer: Column, start: Column, end: Column) -> Column:
    """Distinct first pages of the citations [p. a-b, c] of an answer that overlap the fragment start..end, in order."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[p\.\s*([0-9][^\]]*)\]"), F.lit(1))
    items = F.flatten(F.transform(groups, lambda g: F.split(g, r"[,;]")))
    ranges = F.transform(items, lambda i: F.transform(F.regexp_extract_all(i, F.lit(r"([0-9]+)"), F.lit(1)), lambda n: n.cast("int")))
    real = F.filter(ranges, lambda r: (F.size(r) > 0) & (r[0] <= end) & (F.element_at(r, -1) >= start))
    return F.array_distinct(F.transform(real, lambda r: r[0]))
