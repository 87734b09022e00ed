"""Retrieval for a table of questions: the best chunks of every question in one plan, by vectors, by words and by both.

Questions are rows, never values in the plan. Vectors are dealt out in groups of about GROUP, and every group meets all questions (a stated set,
sent to each group once, in rows); what leaves a group is the k best of each question, so the shuffle is bounded by groups, questions and k.
Within a group vectors are compared a tile at a time: a tile is passed over by the questions whose k-th best so far is above all that its centre and radius allow.

Defined results: null vectors and those with null or non-finite components, of questions or chunks, find nothing and are not found; vectors are only compared with
those of their dimension. Ties go to the smaller id. No questions or no vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import retrieval
from lectern.operators.posting_store import Store

GROUP = 16_384
TILE = 1024
DIGITS = 9
SLACK = 1e-9


def _sound(v: str) -> Column:
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _rows(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def best_of(ids: np.ndarray, vectors: np.ndarray, questions: np.ndarray, k: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores (rounded, a row a question, padded with -inf) of the k best inner products; and how many products were left out."""
    centre = vectors.mean(axis=0)
    axis = np.linalg.svd(vectors[:: max(1, len(vectors) // tile)] - centre, full_matrices=False)[2][0] if len(vectors) > tile else np.zeros(vectors.shape[1])
    order = np.lexsort([ids, vectors @ axis])
    lengths = np.linalg.norm(questions, axis=1)
    kept, scores = np.zeros((len(questions), 0), np.int64), np.zeros((len(questions), 0))
    worst = np.full(len(questions), -np.inf)
    left_out = 0
    tiles = []
    for at in range(0, len(order), tile):
        some = order[at : at + tile]
        middle = vectors[some].mean(axis=0)
        tiles.append((some, questions @ middle + lengths * np.linalg.norm(vectors[some] - middle, axis=1).max() * (1 + SLACK) + SLACK))
    for some, bound in sorted(tiles, key=lambda t: -float(t[1].max(initial=-np.inf))):
        open_ = np.flatnonzero(bound >= worst)
        left_out += (len(questions) - len(open_)) * len(some)
        if not len(open_):
            continue
        found = np.full((len(questions), len(some)), -np.inf)
        found[open_] = np.round(questions[open_] @ vectors[some].T, DIGITS)
        all_ids = np.hstack([kept, np.broadcast_to(ids[some], found.shape)])
        all_scores = np.hstack([scores, found])
        top = np.lexsort([all_ids, -all_scores], axis=1)[:, :k]
        kept, scores = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_scores, top, 1)
        if scores.shape[1] == k:
            worst = scores[:, -1] - SLACK  # a tie within the rounding is still looked at
    return kept, scores, left_out


def vector_top(vectors: DataFrame, asked: DataFrame, k: int = retrieval.TOP) -> DataFrame:
    """question, id, score, pos (from 0): the k chunks (chunk_id, v) with the largest inner products for every question (question, v)."""
    kind = asked.schema["question"].dataType
    some = vectors.select(F.col("chunk_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(_sound("v"))
    said = asked.select("question", F.col("v").cast("array<double>").alias("v")).where(_sound("v"))
    groups = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-some.count() // GROUP))
    dealt = some.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    everywhere = said.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    names = pa.schema([("question", _arrow(kind)), ("id", pa.int64()), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [names.empty_table()]
        ours, theirs = (np.diff(t["v"].combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, np.int64) for t in (left, right))
        for dimension in np.intersect1d(ours, theirs):
            here, asked_here = left.filter(pa.array(ours == dimension)), right.filter(pa.array(theirs == dimension))
            ids, scores, _ = best_of(here["id"].to_numpy(), _rows(here["v"], dimension), _rows(asked_here["v"], dimension), k)
            row, column = np.nonzero(scores > -np.inf)
            out.append(pa.table([asked_here["question"].take(pa.array(row)), pa.array(ids[row, column]), pa.array(scores[row, column])], schema=names))
        return pa.concat_tables(out)

    best = dealt.groupBy("group").cogroup(everywhere.groupBy("group")).applyInArrow(meet, f"question {kind.simpleString()}, id long, score double")
    return _first(best, k, F.desc("score"))


def _arrow(kind) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind.simpleString(), pa.int64())


def _first(scored: DataFrame, k: int, by: Column) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("question").orderBy(by, "id")) - 1
    return scored.withColumn("pos", pos).where(F.col("pos") < k).select("question", "id", "score", "pos")


def terms(asked: DataFrame) -> DataFrame:
    """question, number, term of questions (question, text): what a full-text search looks for."""
    return asked.select("question", F.posexplode(retrieval.fts_terms(F.coalesce("text", F.lit("")))).alias("number", "term"))


def fused(rankings: Sequence[DataFrame], k: int = retrieval.RRF_K) -> DataFrame:
    """question, id, rrf, place, scores, positions of ids in ranked lists (question, id, score, pos), as retrieval.fuse gives them for one question."""
    listed = None
    for number, ranking in enumerate(rankings):
        some = ranking.select("question", "id", F.col("pos").cast("int").alias("pos"), "score", F.lit(number).alias("list"))
        listed = some if listed is None else listed.unionByName(some)
    per_list = lambda c: F.array(*[F.min(F.when(F.col("list") == n, F.col(c))) for n in range(len(rankings))])
    rated = listed.groupBy("question", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("pos") + 1)), 12).alias("rrf"), F.min(F.struct("list", "pos")).alias("first"), per_list("score").alias("scores"), per_list("pos").alias("positions")
    )
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("rrf"), "first")) - 1
    return rated.withColumn("place", place).drop("first")


def pruned(fusion: DataFrame) -> DataFrame:
    """question, id, rrf, place of what stays of a fusion of vector hits (list 0) and text hits (list 1), by the rules of retrieval.prune."""
    whole = Window.partitionBy("question")
    similarity = F.col("scores")[0]
    best = F.max(similarity).over(whole)
    near = F.coalesce(similarity >= best - retrieval.MARGIN, F.lit(False))
    sure = F.coalesce(F.col("positions")[1] < retrieval.SURE_TEXT_HITS, F.lit(False))
    rated = fusion.withColumns({"blind": best.isNull(), "strong": near | sure})
    rated = rated.withColumns({"n_strong": F.count_if("strong").over(whole), "turn": F.row_number().over(Window.partitionBy("question", "strong").orderBy("place"))})
    short = F.col("n_strong") < retrieval.LEAST_KEPT
    stays = F.col("blind") | F.col("strong") | (F.col("turn") <= retrieval.LEAST_KEPT - F.col("n_strong"))
    weak_last = F.when(~F.col("blind") & short & ~F.col("strong"), 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("question").orderBy(weak_last, "place")) - 1
    return rated.where(stays).select("question", "id", "rrf", place.alias("place"))


def hybrid(store: Store, vectors: DataFrame, asked: DataFrame, path: str, k: int = 8) -> DataFrame:
    """question, id, rrf, place of the k chunks that hybrid retrieval returns for every question (question, text, v). path: a new folder."""
    by_vector = vector_top(vectors, asked)
    by_text = store.top_many(terms(asked), path)
    return pruned(fused([by_vector, by_text])).where(F.col("place") < k)
