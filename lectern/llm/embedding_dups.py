"""Embedding near-duplicates by PCA-ordered tiled comparison.

Exact copies are folded first. The distinct vectors, scaled to length one and turned to principal axes
(fitted on at most SAMPLE vectors; any orthogonal basis gives the same result, only slower or faster), are
dealt out by ranges of their leading coordinate; within a range, STRIP tiles at a time are halved along the axis in which
they are widest, of the first BOX axes, into blocks of at most TILE rows, written to the shared folder. Two blocks meet
only if their boxes in these axes are near enough for the threshold; block pairs come from a join on cells of
the first GRID axes. Within a pair, products are accumulated from the
leading axes on; what the rest can add is bounded by the product of the suffix norms, and a pair of blocks
is left as soon as no cosine can reach the threshold. What survives is settled by the plain cosine of the
given vectors in double precision.

Of a block pair only counts per vector and a shallow forest of the links leave the task, never the pairs.

Defined results: vectors that are null, of length zero or with null or non-finite components link with
nothing, and neither do vectors of different dimension. Rows that repeat a vec_id are vectors of their
own. A null vec_id counts as a link of the others, and has a null component of its own. Empty table: no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import components, shared

THRESHOLD = 0.95
TILE = 2048
PANEL = 8
SAMPLE = 10_000
BOX = 8
GRID = 3
STRIP = 8
STEPS = (12, 24, 40)
SLACK = 1e-9

_LEADS = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("named", pa.bool_()), ("lead", pa.float64()), ("v", pa.list_(pa.float64()))])
_META = pa.schema([("block", pa.string()), ("size", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and the lengths; scaled by the largest component first so that no square over- or underflows."""
    top = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / top
    norms = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / norms, norms


def link_matrix(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns (those that have a link) and the links between them. a, b: unit rows; turned: the same on principal axes."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), bool)
    partial, before = 0.0, 0
    for upto in sorted({min(s, a.shape[1]) for s in (*STEPS, a.shape[1])}):
        partial = partial + turned_a[:, before:upto] @ turned_b[:, before:upto].T
        rest = np.outer(np.sqrt((turned_a[:, upto:] ** 2).sum(axis=1)), np.sqrt((turned_b[:, upto:] ** 2).sum(axis=1)))
        possible = partial + rest >= threshold - SLACK
        rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
        if not len(rows):
            return none
        if len(rows) * len(columns) < possible.size // 4:
            break
        before = upto
    exact = (a[rows] @ b[columns].T >= threshold) & possible[np.ix_(rows, columns)]
    r, c = exact.any(axis=1), exact.any(axis=0)
    return rows[r], columns[c], exact[np.ix_(r, c)]


def _write_block(uri: str, nodes: np.ndarray, weights: np.ndarray, named: np.ndarray, rows: np.ndarray) -> None:
    shared.put_array(uri, np.frombuffer(b"".join(x.astype(np.int64).tobytes() for x in (nodes, weights, named)) + rows.astype(np.float64).tobytes(), np.uint8))


def _read_block(uri: str, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat = shared.mapped_array(uri, np.float64)
    n = len(flat) // (3 + dimension)
    return flat[:n].view(np.int64), flat[n : 2 * n].view(np.int64), flat[2 * n : 3 * n].view(np.int64) > 0, flat[3 * n :].reshape(n, dimension)


def halved(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in sets of at most most, halved at the median of the widest axis until they are small enough."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        some = todo.pop()
        if len(some) <= most:
            done.append(some)
            continue
        axis = int(np.ptp(points[some], axis=0).argmax())
        order = some[np.argsort(points[some, axis], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


def _axes(distinct: DataFrame, dimension: int) -> np.ndarray:
    rows = distinct.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    turned, _ = unit(matrix(rows, dimension))
    return np.linalg.eigh(turned.T @ turned)[1][:, ::-1].copy()


def _compared(distinct: DataFrame, dimension: int, path: str, threshold: float) -> DataFrame:
    """a, b, links: links > 0 is a count for node a; links 0 is an edge of the forest."""
    spark = distinct.sparkSession
    held = spark.sparkContext.broadcast(_axes(distinct, dimension))  # dimension squared
    blocks = max(1, -(-distinct.count() // TILE))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = unit(matrix(batch.column("v"), dimension)) if batch.num_rows else (np.zeros((0, dimension)), None)
            yield shared.batch_of(_LEADS, batch.column("node"), batch.column("weight"), batch.column("named"), rows @ held.value[:, 0], batch.column("v"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def blocks_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal k
            rows, _ = unit(matrix(table["v"].combine_chunks(), dimension))
            nodes, weights, named = (table[c].to_numpy() for c in ("node", "weight", "named"))
            places = rows @ held.value[:, :BOX]
            for some in halved(places, TILE):
                name = f"{part:07d}-{k:05d}"
                k += 1
                _write_block(f"{path}/blocks/{name}", nodes[some], weights[some], named[some], rows[some])
                yield shared.batch_of(_META, [name], [len(some)], [places[some].min(axis=0).tolist()], [places[some].max(axis=0).tolist()])

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, STRIP * TILE - size)
                batch = batch.slice(some.num_rows)
                waiting.append(some)
                size += some.num_rows
                if size == STRIP * TILE:
                    yield from blocks_of(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if size:
            yield from blocks_of(pa.Table.from_batches(waiting))

    leads = distinct.select("node", "weight", F.col("least").isNotNull().alias("named"), "v").mapInArrow(turned, "node long, weight long, named boolean, lead double, v array<double>")
    ordered = leads.repartitionByRange(max(1, blocks // STRIP, min(blocks, shared.shuffle_partitions(spark))), "lead").sortWithinPartitions("lead", "node")
    meta = shared.settled(ordered.mapInArrow(write, "block string, size long, low array<double>, high array<double>"), f"{path}/meta")

    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    grid = min(GRID, dimension)
    spans = [F.sequence(F.floor(F.col("low")[k] / reach), F.floor((F.col("high")[k] + reach) / reach)) for k in range(grid)]
    cells = meta
    for k, span in enumerate(spans):
        cells = cells.withColumn(f"cell_{k}", F.explode(span))
    one, two = cells.alias("one"), cells.alias("two")
    same_cell = [F.col(f"one.cell_{k}") == F.col(f"two.cell_{k}") for k in range(grid)]
    first_shared = [F.col(f"one.cell_{k}") == F.floor(F.greatest(F.col("one.low")[k], F.col("two.low")[k]) / reach) for k in range(grid)]
    gaps = F.transform(
        F.arrays_zip(F.col("one.low").alias("la"), F.col("one.high").alias("ha"), F.col("two.low").alias("lb"), F.col("two.high").alias("hb")),
        lambda x: F.greatest(x["la"] - x["hb"], x["lb"] - x["ha"], F.lit(0.0)),
    )
    far = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    near = one.join(two, reduce(and_, [*same_cell, F.col("one.block") <= F.col("two.block")])).where(reduce(and_, [*first_shared, far <= reach * reach]))
    panel = F.pmod(F.xxhash64("two.block"), F.lit(max(1, blocks // PANEL)))
    panels = near.groupBy(F.col("one.block").alias("block"), panel.alias("panel")).agg(F.sort_array(F.collect_list("two.block")).alias("others"))
    n = shared.shuffle_partitions(spark)
    dealt = panels.repartitionById(n, F.pmod(F.xxhash64("block", "panel"), F.lit(n)).cast("int"))  # by number, so that few panels are not put together in one task

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = held.value
        for batch in batches:
            for name, others in zip(batch.column("block").to_pylist(), batch.column("others").to_pylist(), strict=True):
                nodes, weights, named, rows = _read_block(f"{path}/blocks/{name}", dimension)
                turned_rows = rows @ axes
                for other in others:
                    nodes_b, weights_b, named_b, rows_b = (nodes, weights, named, rows) if other == name else _read_block(f"{path}/blocks/{other}", dimension)
                    r, c, links = link_matrix(rows, rows_b, turned_rows, turned_rows if other == name else rows_b @ axes, threshold)
                    if other == name:
                        links = links & (r[:, None] != c[None, :])
                    if not links.any():
                        continue
                    a = [nodes[r]]
                    n = [links @ weights_b[c]]
                    if other != name:
                        a.append(nodes_b[c])
                        n.append(links.T @ weights[r])
                    a, n = np.concatenate(a), np.concatenate(n)
                    yield shared.batch_of(_FOUND, a[n > 0], a[n > 0], n[n > 0])
                    one, two = named[r], named_b[c]  # vectors without an id hold nothing together
                    left, right = _forest(nodes[r][one], nodes_b[c][two], links[np.ix_(one, two)])
                    yield shared.batch_of(_FOUND, left, right, np.zeros(len(left), np.int64))

    return dealt.mapInArrow(compare, "a long, b long, links long")


def _forest(left: np.ndarray, right: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold together what the links between left and right nodes hold together."""
    n = len(left)

    def linked(item: int, unseen: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(unseen), bool)
        if item < n:
            others = unseen >= n
            hit[others] = links[item, unseen[others] - n]
        else:
            others = unseen < n
            hit[others] = links[unseen[others], item - n]
        return hit

    both = np.concatenate([left, right])
    edges = [components.forest(np.unique(both[group])) for group in components.linked_sets(len(both), linked)]
    return tuple(map(np.concatenate, zip(*edges, strict=True))) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_duplicates(vectors: DataFrame, path: str, threshold: float = THRESHOLD, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; path: a new folder in the shared folder."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    sound = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    good = named.where(sound)
    folded = good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # A vector that only rows without an id have gets a node of its own, so that it still counts for others.
    distinct = folded.select("v", "weight", F.col("least"), F.coalesce("least", F.xxhash64("v").bitwiseOR(F.lit(-(1 << 63)))).alias("node"))
    distinct = shared.settled(distinct, f"{path}/distinct")
    found = None
    for row in distinct.groupBy(F.size("v").alias("dimension")).count().collect():  # one row per dimension in use
        some = _compared(distinct.where(F.size("v") == row.dimension), row.dimension, f"{path}/d{row.dimension}", threshold)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, links long")
    found = shared.settled(found, f"{path}/found")
    counts = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("others"))
    labelled = components.connected_components(found.where("links = 0").select("a", "b"), f"{path}/components")
    classes = (
        distinct.join(counts, distinct.node == counts.a, "left")
        .join(labelled, distinct.node == labelled.node, "left")
        .select("v", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    classes = shared.settled(classes, f"{path}/classes")
    linked = good.join(classes, "v").select("vec_id", F.col("n_links").cast("long"), F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = named.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
