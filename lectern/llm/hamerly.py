"""Lloyd's clustering of integer vectors with Hamerly's bounds.

Vectors become integers, floor(scale * x) of each component, in blocks of at most BLOCK vectors, which lie in files in the shared folder and are
written once; vectors are never shuffled. What a round keeps is a table of a row a block: for each vector its cluster, one upper
bound of the distance to its centroid and one lower bound of the distance to any other. When centroids move, the upper bound grows by the
own centroid's way and the lower one shrinks by the longest way of any. A vector whose upper bound is below its lower bound, or below half
the way from its centroid to the nearest other, keeps its cluster and is not read; of the rest the distance to the own centroid is
worked out first, and those still open get a full scan of all centroids in exact integers (ties: the smaller number). Bounds are
rounded outwards, so they never decide what integers would decide otherwise.

Sums of a round are kept as changes: only vectors that changed their cluster are added and taken off, a row a cluster and task. The
driver holds the centroids alone (k times dimension). Cluster sums are exact at any count (decimals of 38 digits).

Defined results: only vectors of the told dimension count, without null or non-finite components and none of 2^27 or beyond
after scaling, whose squared distances would not fit into 64 bits; others have no row. Repeated rows are vectors of their own. A null vec_id keeps
its row, but never starts a cluster. Starts that share an id are ordered by their components. Fewer vectors than k: as many
clusters as vectors with ids; none of these: no cluster, and no rows. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

BLOCK = 4096
WIDEST = 1 << 27
FLOATS = 1 << 22  # below it, sums of products of components are exact in doubles (for up to 512 components)
OUTWARDS = 1e-12

_STATE = pa.schema(
    [("block", pa.string()), ("size", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("moved", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]
)
_STATE_DDL = "block string, size long, cluster binary, upper binary, lower binary, moved int, n long, sums array<long>"
_NEAR = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def exact_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, in int64. Products go through doubles where these hold every sum exactly."""
    small = rows.shape[1] <= 512 and max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) < FLOATS
    if small:
        products = (rows.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (rows * rows).sum(axis=1)[:, None] - 2 * products + (centroids * centroids).sum(axis=1)[None, :]
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def own_distances(rows: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    gap = rows - centroids[cluster]
    return (gap * gap).sum(axis=1)


def scanned(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), and squared distances to it and to the second nearest."""
    squared = exact_distances(rows, centroids)
    cluster = squared.argmin(axis=1).astype(np.int32)
    at = np.arange(len(rows))
    best = squared[at, cluster]
    squared[at, cluster] = np.iinfo(np.int64).max
    return cluster, best, squared.min(axis=1)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + OUTWARDS)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - OUTWARDS)


def reassigned(rows, centroids: np.ndarray, drift: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """cluster, upper, lower after the centroids moved by drift (an upper bound each), and how many rows got a full scan.

    rows(places) gives the vectors at these places; the others are not asked for.
    """
    upper = (upper + drift[cluster]) * (1 + OUTWARDS)
    lower = np.maximum((lower - drift.max(initial=0)) * (1 - OUTWARDS), 0)
    if len(centroids) > 1:
        between = exact_distances(centroids, centroids)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        half = below(between.min(axis=1)) / 2 * (1 - OUTWARDS)
    else:
        half = np.full(1, np.inf)
    clear = np.maximum(lower, half[cluster])
    open_ = np.flatnonzero(upper >= clear)
    scans = 0
    if len(open_):
        some = rows(open_)
        upper[open_] = above(own_distances(some, centroids, cluster[open_]))
        still = upper[open_] >= clear[open_]
        scans = int(still.sum())
        if scans:
            where = open_[still]
            cluster[where], best, second = scanned(some[still], centroids)
            upper[where], lower[where] = above(best), below(second)
    return cluster, upper, lower, scans


def integers(components: Column, scale: int) -> Column:
    return F.transform(components, lambda x: F.floor(x.cast("double") * scale))


def _sound(vectors: DataFrame, key: str, column: str, dimension: int, scale: int) -> DataFrame:
    named = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    plain = named.where((F.size("x") == dimension) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < WIDEST)))
    return plain.select("vec_id", integers(F.col("x"), scale).alias("v"))


def starts(sound: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and vec_id."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = sound.where("vec_id is not null").select(order.alias("turn"), "v").orderBy("turn", "v").limit(k).collect()  # k vectors
    return np.array([r.v for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def _components(path: str, name: str, dimension: int) -> np.ndarray:
    return shared.mapped_array(f"{path}/blocks/{name}.v", np.int32).reshape(-1, dimension)


def _written(sound: DataFrame, path: str, dimension: int) -> DataFrame:
    """Vectors in files of blocks: components, ids and which ids are null. A row a block; a task that runs again writes files of its own."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, k = f"{context.partitionId():07d}-{context.taskAttemptId()}", 0
        waiting: list[pa.RecordBatch] = []

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal k
            table = pa.Table.from_batches(rows)
            values = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            name, k = f"{task}-{k:06d}", k + 1
            shared.put_array(f"{path}/blocks/{name}.v", values.astype(np.int32))
            shared.put_array(f"{path}/blocks/{name}.id", table["vec_id"].fill_null(0).to_numpy().astype(np.int64))
            shared.put_array(f"{path}/blocks/{name}.null", table["vec_id"].is_null().to_numpy().astype(np.uint8))
            return shared.batch_of(_STATE, [name], [table.num_rows], [None], [None], [None], [None], [None], [None])

        size = 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK - size)
                batch = batch.slice(some.num_rows)
                waiting.append(some)
                size += some.num_rows
                if size == BLOCK:
                    yield block(waiting)
                    waiting, size = [], 0
        if size:
            yield block(waiting)

    return shared.settled(sound.mapInArrow(write, _STATE_DDL), f"{path}/state-start")


def _dealt(state: DataFrame) -> DataFrame:
    """Rows of blocks, evenly; they are small, whatever their vectors are."""
    n = shared.shuffle_partitions(state.sparkSession)
    return state.where("size is not null").repartitionById(n, F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))


def _round(state: DataFrame, path: str, number: int, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state after one assignment, and rows (moved, n, sums) by which clusters changed since the round before."""
    held = state.sparkSession.sparkContext.broadcast((centroids, drift))  # k times dimension
    k, dimension = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, drift = held.value
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)

        def moved(rows: np.ndarray, cluster: np.ndarray, sign: int) -> None:
            np.add.at(counts, cluster, sign)
            np.add.at(sums, cluster, sign * rows)

        for batch in batches:
            for name, size, cluster, upper, lower in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "cluster", "upper", "lower")), strict=True):
                stored = _components(path, name, dimension)
                take = lambda places, stored=stored: stored[places].astype(np.int64)
                if cluster is None:
                    rows = stored.astype(np.int64)
                    new, best, second = scanned(rows, centroids)
                    up, low = above(best), below(second)
                    moved(rows, new, 1)
                else:
                    old = np.frombuffer(cluster, np.int32)
                    new, up, low, _ = reassigned(take, centroids, drift, old.copy(), np.frombuffer(upper, np.float64), np.frombuffer(lower, np.float64))
                    changed = np.flatnonzero(new != old)
                    rows = take(changed)
                    moved(rows, old[changed], -1)
                    moved(rows, new[changed], 1)
                yield shared.batch_of(_STATE, [name], [size], [new.tobytes()], [up.tobytes()], [low.tobytes()], [None], [None], [None])
        used = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
        none = [None] * len(used)
        yield shared.batch_of(_STATE, none, none, none, none, none, used.astype(np.int32), counts[used], list(sums[used]))

    return shared.settled(_dealt(state).mapInArrow(assign, _STATE_DDL), f"{path}/state-{number}")


def _changes(state: DataFrame, k: int, dimension: int) -> tuple[list[int], list[list[int]]]:
    """By how much counts and sums of the clusters changed: k times dimension numbers."""
    rows = state.where("moved is not null").select("moved", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("at", "s"))
    counts, sums = [0] * k, [[0] * dimension for _ in range(k)]
    for r in rows.groupBy("moved", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        counts[r.moved] = int(r.n)
        sums[r.moved][r["at"]] = int(r.s)
    return counts, sums


def _distances(state: DataFrame, path: str, centroids: np.ndarray) -> DataFrame:
    held = state.sparkSession.sparkContext.broadcast(centroids)
    dimension = centroids.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cluster in zip(batch.column("block").to_pylist(), batch.column("cluster").to_pylist(), strict=True):
                own = np.frombuffer(cluster, np.int32)
                distance = own_distances(_components(path, name, dimension).astype(np.int64), held.value, own)
                ids = pa.array(shared.mapped_array(f"{path}/blocks/{name}.id", np.int64), mask=shared.mapped_array(f"{path}/blocks/{name}.null", np.uint8).astype(bool))
                yield shared.batch_of(_NEAR, ids, own, distance)

    return shared.settled(_dealt(state).mapInArrow(near, "vec_id long, cluster int, distance long"), f"{path}/near")


def clustered(
    vectors: DataFrame, path: str, k: int = 40, rounds: int = 5, seed: str = "2:", scale: int = 256, dimension: int = 64, key: str = "vec_id", column: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) for every vector that counts, and the final centroids; path: a new folder in the shared folder.

    Every round assigns all vectors and moves each centroid that has any to the componentwise floor of their mean; then they are assigned once more.
    """
    sound = _sound(vectors, key, column, dimension, scale)
    centroids = starts(sound, k, seed)
    if not len(centroids):
        return sound.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    k = len(centroids)
    state = _written(sound, path, dimension)
    counts, sums = [0] * k, [[0] * dimension for _ in range(k)]
    drift = np.zeros(k)
    for number in range(rounds + 1):
        before, state = number, _round(state, path, number, centroids, drift)
        if number == rounds:
            break
        if before:
            shared.removed(vectors.sparkSession, f"{path}/state-{before - 1}")
        n, s = _changes(state, k, dimension)
        counts = [a + b for a, b in zip(counts, n, strict=True)]
        sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, s, strict=True)]
        fresh = np.array([[x // c for x in total] if c else old.tolist() for total, c, old in zip(sums, counts, centroids, strict=True)], np.int64)
        drift = above(((fresh - centroids) ** 2).sum(axis=1))
        centroids = fresh
    return _distances(state, path, centroids), centroids


def with_inertia(near: DataFrame, centroids: np.ndarray) -> DataFrame:
    """near with cluster_inertia, inertia (distances summed over the cluster and over all) and centroid_sha256."""
    spark = near.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = near.agg(F.sum("distance").alias("inertia")).first()["inertia"]
    told = near.join(F.broadcast(sums), "cluster").join(F.broadcast(named), "cluster")  # a row a cluster
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
