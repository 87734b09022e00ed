"""Frequent sequences under gap and span limits, by pivot partitioning.

Events are (client, micros, type). A pattern is a list of types; a client supports it if it has events of these types in order, each more than 0
and at most gap after the one chosen before, first to last at most span. Types are ordered by the number of clients that have them; a
pattern's pivot is its rarest type, so each pattern belongs to one pivot alone and is counted there whole, without candidates.

Timelines are put together by client and stretch of time (a stretch holds STRETCH spans and is followed by one span of the next, so
that no occurrence is cut, and a client with a third of all events is many keys). From each, every pivot is sent a rewritten timeline: events of types at
least as common as the pivot and within one span of a pivot, cut where two follow at more than the gap, without pieces that hold no pivot.
Where a client's timelines for one pivot meet, patterns are grown type by type; for each event what is kept of a prefix is
the latest start of an occurrence that ends there, which decides everything later, so occurrences are never listed. Windows of gap
length are looked up in tables of maxima over 2^j events: many timelines are grown at once, in blocks of about BLOCK events.

A client with few events has all timelines of a pivot in one task, which counts it once; what leaves a task is a row a pattern. A client with
more than HEAVY events (and more than 1 / CLIENTS of all, so that there are never more than CLIENTS such clients, whose list is broadcast) is
dealt over many tasks, which send (pattern, client) instead, made distinct and counted by Spark.

Only types that enough clients have can be in a result; their names are the one list that the driver holds. At a support share of s and d types a
client on average there are at most d / s of them, whatever the input.

Defined results: rows with a null client, time or type are no events. Repeated events count once. Events of the same microsecond never
follow each other. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lectern.llm import shared

STRETCH = 8
BLOCK = 400_000
HEAVY = 50_000
CLIENTS = 10_000

_TIMELINES = pa.schema([("pivot", pa.int32()), ("client", pa.int64()), ("part", pa.int64()), ("times", pa.list_(pa.int64())), ("ranks", pa.binary())])
_FOUND = pa.schema([("pattern", pa.list_(pa.int32())), ("client", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])


def micros(ts: Column, local: bool) -> Column:
    """Microseconds since 1970. Times without a zone are taken as they stand, whatever the zone of the session."""
    if not local:
        return F.unix_micros(ts)
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
    return day + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def events(rows: DataFrame, client: str, ts: str, kind: str, *others: str) -> DataFrame:
    """client, t (microseconds), kind and the named further columns: the rows that have the first three."""
    local = isinstance(rows.schema[ts].dataType, TimestampNTZType)
    named = rows.select(F.col(client).cast("long").alias("client"), micros(F.col(ts), local).alias("t"), F.col(kind).cast("string").alias("kind"), *others)
    return named.where("client is not null and t is not null and kind is not null")


class Maxima:
    """The largest value of any stretch of an array: row j holds maxima of 2^j values in a row."""

    def __init__(self, values: np.ndarray, widest: int):
        self.rows = [values]
        step = 1
        while 2 * step <= widest:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-step], last[step:]) if len(last) > step else last[:0])
            step *= 2

    def of(self, low: np.ndarray, high: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Maxima of [low, high), never empty; level: the largest j with 2^j <= high - low."""
        found = np.empty(len(low), np.int64)
        for j, row in enumerate(self.rows):
            at = np.flatnonzero(level == j)
            if len(at):
                found[at] = np.maximum(row[low[at]], row[high[at] - (1 << j)])
        return found


def grown(times: np.ndarray, ranks: np.ndarray, pivot: int, gap: int, span: int, longest: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Every pattern with the type pivot that occurs, and the places of the events that end an occurrence.

    times: ascending, with more than gap + span between timelines; ranks: at most pivot.
    """
    types = range(pivot + 1)
    places = [np.flatnonzero(ranks == r) for r in types]
    clocks = [times[p] for p in places]
    windows: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}

    def window(a: int, b: int) -> tuple[np.ndarray, ...]:
        """Events of type b that have one of type a within the gap before: which, the range of these, its level."""
        if (a, b) not in windows:
            low, high = np.searchsorted(clocks[a], clocks[b] - gap, "left"), np.searchsorted(clocks[a], clocks[b], "left")
            some = np.flatnonzero(high > low)
            wide = high[some] - low[some]
            windows[a, b] = some, low[some], high[some], np.frexp(wide.astype(np.float64))[1] - 1, int(wide.max(initial=0))
        return windows[a, b]

    def follow(pattern: tuple[int, ...], starts: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """starts: for each event of the last type the latest start of an occurrence that ends there, or -1."""
        has = pivot in pattern
        last = pattern[-1]
        if has:
            yield pattern, places[last][starts >= 0]
        if len(pattern) == longest:
            return
        following = types if has or len(pattern) < longest - 1 else (pivot,)
        widest = max(window(last, b)[4] for b in following)
        if not widest:
            return
        maxima = Maxima(starts, widest)
        for b in following:
            some, low, high, level, _ = window(last, b)
            if not len(some):
                continue
            latest = maxima.of(low, high, level)
            sound = (latest >= 0) & (clocks[b][some] - latest <= span)
            if sound.any():
                ended = np.full(len(clocks[b]), -1, np.int64)
                ended[some[sound]] = latest[sound]
                yield from follow((*pattern, b), ended)

    for first in types:
        if len(clocks[first]) and (longest > 1 or first == pivot):
            yield from follow((first,), clocks[first].copy())


def pieces(client: np.ndarray, stretch: np.ndarray, t: np.ndarray, rank: np.ndarray, pivot: int, gap: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by client, stretch and t: which rows the pivot is sent, and at which of these a new piece begins."""
    n = len(t)
    fresh = np.ones(n, bool)
    fresh[1:] = (client[1:] != client[:-1]) | (stretch[1:] != stretch[:-1])
    group = np.cumsum(fresh)
    at = np.flatnonzero(rank == pivot)
    if not len(at):
        return at, at
    before = np.searchsorted(at, np.arange(n), "right") - 1
    left, right = at[np.maximum(before, 0)], at[np.minimum(before + 1, len(at) - 1)]
    close = ((before >= 0) & (group[left] == group) & (t - t[left] <= span)) | ((before + 1 < len(at)) & (group[right] == group) & (t[right] - t <= span))
    chosen = np.flatnonzero(close & (rank <= pivot))
    cut = np.ones(len(chosen), bool)
    cut[1:] = (group[chosen[1:]] != group[chosen[:-1]]) | (t[chosen[1:]] - t[chosen[:-1]] > gap)
    piece = np.cumsum(cut) - 1
    holds = np.zeros(piece[-1] + 1, bool)
    holds[piece[rank[chosen] == pivot]] = True
    kept = holds[piece]
    return chosen[kept], np.flatnonzero(cut[kept])


def _rewritten(events: DataFrame, types: int, gap: int, span: int) -> DataFrame:
    """pivot, client, part, times, ranks: the pieces of timelines that each pivot is sent. events: client, t, rank."""
    long = STRETCH * span
    own = F.floor(F.col("t") / long)
    overlapping = F.when(F.col("t") - own * long < span, F.array(own, own - 1)).otherwise(F.array(own))
    by_stretch = events.select("client", "t", "rank", F.explode(overlapping).alias("stretch")).repartition("client", "stretch").sortWithinPartitions("client", "stretch", "t")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _stretches(batches):
            client, stretch, t, rank = (table[c].to_numpy() for c in ("client", "stretch", "t", "rank"))
            for pivot in range(types):
                rows, cuts = pieces(client, stretch, t, rank, pivot, gap, span)
                if not len(rows):
                    continue
                offsets = pa.array(np.append(cuts, len(rows)), pa.int32())
                times = pa.ListArray.from_arrays(offsets, pa.array(t[rows]))
                small = rank[rows].astype(np.uint8 if types <= 256 else np.uint16)
                packed = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.array(np.append(cuts, len(rows)) * small.itemsize, pa.int32()).buffers()[1], pa.py_buffer(small.tobytes())])
                first = rows[cuts]
                yield shared.batch_of(_TIMELINES, np.full(len(cuts), pivot, np.int32), client[first], stretch[first], times, packed)

    return by_stretch.mapInArrow(rewrite, "pivot int, client long, part long, times array<long>, ranks binary")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about BLOCK rows that end where a client's stretch does."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        client, stretch = table["client"].to_numpy(), table["stretch"].to_numpy()
        changes = np.flatnonzero((client[1:] != client[:-1]) | (stretch[1:] != stretch[:-1]))
        if not len(changes):
            continue
        cut = int(changes[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def _mined(timelines: DataFrame, types: int, gap: int, span: int, longest: int) -> DataFrame:
    """pattern, client, n, crc: for light clients sums of a task (client null), for heavy ones a row a pattern and client."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, ...], list[int]] = {}

        def block(tables: list[pa.Table], pivot: int) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(tables)
            lists = table["times"].combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            t = lists.flatten().to_numpy()
            ranks = np.frombuffer(b"".join(table["ranks"].to_pylist()), np.uint8 if types <= 256 else np.uint16)
            firsts = np.cumsum(lengths) - lengths
            begun = t[firsts]
            apart = np.cumsum(t[firsts + lengths - 1] - begun + gap + span + 1)
            clock = t + np.repeat(np.append(0, apart[:-1]) - begun, lengths)
            clients, heavy = table["client"].to_numpy(), table["heavy"].to_numpy(zero_copy_only=False)
            ids, owner = np.unique(clients, return_inverse=True)
            crc = np.fromiter((zlib.crc32(str(c).encode()) for c in ids.tolist()), np.int64, len(ids))
            is_heavy = np.zeros(len(ids), bool)
            is_heavy[owner[heavy]] = True
            whose = np.repeat(owner, lengths)
            for pattern, places in grown(clock, ranks, pivot, gap, span, longest):
                who = np.unique(whose[places])
                light = who[~is_heavy[who]]
                if len(light):
                    total = counts.setdefault(pattern, [0, 0])
                    total[0] += len(light)
                    total[1] += int(crc[light].sum())
                dense = who[is_heavy[who]]
                if len(dense):
                    yield shared.batch_of(_FOUND, [list(pattern)] * len(dense), ids[dense], np.ones(len(dense), np.int64), crc[dense])

        held: list[pa.Table] = []
        size = 0
        for pivot, table in _by_pivot(batches):
            if held and held[0]["pivot"][0].as_py() != pivot:
                yield from block(held, held[0]["pivot"][0].as_py())
                held, size = [], 0
            held.append(table)
            size += len(table["times"].combine_chunks().flatten())
            if size >= BLOCK:
                yield from block(held, pivot)
                held, size = [], 0
        if held:
            yield from block(held, held[0]["pivot"][0].as_py())
        told = list(counts)
        yield shared.batch_of(_FOUND, [list(p) for p in told], [None] * len(told), [counts[p][0] for p in told], [counts[p][1] for p in told])

    return timelines.mapInArrow(mine, "pattern array<int>, client long, n long, crc long")


def _by_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Tables of one pivot and whole clients, from rows sorted by pivot and client."""
    for table in shared.sorted_runs(_keyed(batches), "key"):
        pivots = table["pivot"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(pivots[a]), table.slice(a, b - a)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a running number of their (pivot, client)."""
    number, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        pivot, client = batch.column("pivot").to_numpy(), batch.column("client").to_numpy()
        fresh = np.ones(batch.num_rows, bool)
        fresh[1:] = (pivot[1:] != pivot[:-1]) | (client[1:] != client[:-1])
        fresh[0] = (pivot[0], client[0]) != last
        keys = number + np.cumsum(fresh)
        number, last = int(keys[-1]), (pivot[-1], client[-1])
        yield batch.append_column("key", pa.array(keys))


def frequent(
    events: DataFrame, path: str, gap: int = 900_000_000, span: int = 2_250_000_000, longest: int = 4, share: tuple[int, int] = (3, 10), least: int = 2, heavy: int = HEAVY
) -> DataFrame:
    """pattern (array of types), support, clients_crc for the patterns that at least least clients and share (a fraction) of all clients support.

    events: client, t (microseconds), kind, as from events(); gap, span: microseconds; path: a new folder in the shared folder.
    """
    spark = events.sparkSession
    over, under = share
    profile = shared.settled(events.groupBy("client", "kind").agg(F.count("*").alias("n")), f"{path}/profile")
    by_client = profile.groupBy("client").agg(F.sum("n").alias("n"))
    clients, total = by_client.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    enough = (F.col("clients") >= least) & (F.col("clients") * under >= over * clients)
    names = [r.kind for r in profile.groupBy("kind").agg(F.count("*").alias("clients")).where(enough).orderBy(F.desc("clients"), "kind").collect()]  # at most types a client / share
    none = spark.createDataFrame([], "pattern array<string>, support long, clients_crc long")
    if not names:
        return none
    ranks = spark.createDataFrame(list(enumerate(names)), "rank int, kind string")
    told = events.join(F.broadcast(ranks), "kind").select("client", "t", "rank").distinct()
    pieces_of = _rewritten(told, len(names), gap, span)
    busy = by_client.where(F.col("n") > max(heavy, total // CLIENTS)).select("client", F.lit(True).alias("heavy"))  # at most CLIENTS rows
    marked = pieces_of.join(F.broadcast(busy), "client", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    salt = F.when(F.col("heavy"), F.col("part")).otherwise(F.lit(0))
    dealt = marked.withColumn("part", salt).repartition("pivot", "client", "part").sortWithinPartitions("pivot", "client")
    mined = shared.settled(_mined(dealt, len(names), gap, span, longest), f"{path}/mined")
    dense = mined.where("client is not null").distinct()
    counted = mined.where("client is null").unionByName(dense).groupBy("pattern").agg(F.sum("n").alias("support"), F.sum("crc").alias("clients_crc"))
    kept = counted.where((F.col("support") >= least) & (F.col("support") * under >= over * clients))
    listed = F.array(*[F.lit(n) for n in names])
    return kept.select(F.transform("pattern", lambda r: listed[r]).alias("pattern"), "support", "clients_crc")


def with_wider(kept: DataFrame) -> DataFrame:
    """kept with n_wider: the distinct longer patterns of equal support that become this one by deleting entries, and closed (there are none)."""
    narrower = F.transform(
        F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2), F.size("pattern")) - 2).cast("long")),
        lambda bits: F.filter("pattern", lambda _, i: F.getbit(bits, i) == 1),
    )
    wide = kept.where(F.size("pattern") > 1).select("support", F.explode(F.array_distinct(narrower)).alias("pattern"))
    counts = wide.groupBy("pattern", "support").agg(F.count("*").alias("n_wider"))
    return kept.join(counts, ["pattern", "support"], "left").withColumn("n_wider", F.coalesce("n_wider", F.lit(0))).withColumn("closed", F.col("n_wider") == 0)
