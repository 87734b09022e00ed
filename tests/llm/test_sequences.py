"""Frequent sequences against a search of all occurrences, with hot clients, edges of the limits, ties, repeats and nulls."""

import datetime as dt
import random
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lectern.llm import sequences, shared

EVENT = "client long, t long, kind string"


def occurrences(events, gap, span, longest):
    """client -> patterns, by extending every occurrence event by event."""
    found = {}
    for client in {c for c, _, _ in events}:
        own = sorted({(t, k) for c, t, k in events if c == client})
        held, reached = set(), {(t, t, (k,)) for t, k in own}
        while reached:
            held |= {p for _, _, p in reached}
            reached = {(a, t, (*p, k)) for a, b, p in reached if len(p) < longest for t, k in own if 0 < t - b <= gap and t - a <= span}
        found[client] = held
    return found


def wanted(events, gap, span, longest, share=(3, 10), least=2):
    by_client = occurrences(events, gap, span, longest)
    support = {}
    for client, patterns in by_client.items():
        for p in patterns:
            support.setdefault(p, []).append(client)
    return {p: (len(c), sum(zlib.crc32(str(x).encode()) for x in c)) for p, c in support.items() if len(c) >= least and len(c) * share[1] >= share[0] * len(by_client)}


def rows_of(frame):
    return {tuple(r.pattern): (r.support, r.clients_crc) for r in frame.collect()}


def random_events(seed, clients=9, most=40, kinds="abcde", wide=400):
    rng = random.Random(seed)
    events = []
    for c in range(clients):
        for _ in range(rng.randrange(1, most)):
            events.append((c * 7 - 3, rng.randrange(-wide, wide), rng.choice(kinds)))
    return events + events[: len(events) // 3]


@pytest.mark.parametrize("seed, heavy", [(1, 10**6), (2, 10), (3, 0)])
def test_equals_a_search_of_all_occurrences(spark, monkeypatch, seed, heavy):
    events = random_events(seed)
    table = spark.createDataFrame(events, EVENT).repartition(5)
    for gap, span, longest in ((10, 25, 4), (5, 5, 3), (30, 40, 2), (7, 100, 1)):
        got = sequences.frequent(table, shared.workspace(spark, "t"), gap, span, longest, heavy=heavy)
        assert rows_of(got) == wanted(events, gap, span, longest)


def test_limits_are_exact(spark):
    step, whole = 900_000_000, 2_250_000_000
    events = []
    for client, times in ((1, (0, step)), (2, (0, step + 1)), (3, (5, 5)), (4, (0, step, 2 * step, whole)), (5, (0, step, 2 * step, whole + 1)), (6, (whole * 8 - 1, whole * 8)), (7, (-1, 0))):
        events += [(client, t, k) for t, k in zip(times, "xyzw", strict=False)]
    got = rows_of(sequences.frequent(spark.createDataFrame(events, EVENT), shared.workspace(spark, "t"), share=(0, 1), least=1))
    who = lambda p: got.get(tuple(p), (0, 0))[1]
    crc = lambda *c: sum(zlib.crc32(str(x).encode()) for x in c)
    assert who("xy") == crc(1, 4, 5, 6, 7) and who("xyz") == crc(4, 5) and who("xyzw") == crc(4) and who("zw") == crc(4, 5) and ("y", "x") not in got


def test_timelines_cut_by_stretches_and_tasks(spark):
    """A client with most of the events, without a pause, over many stretches; blocks end anywhere."""
    rng = random.Random(5)
    events = [(1, 7 * i + rng.randrange(3), rng.choice("aab")) for i in range(1500)] + [(1, 5000, "c"), (2, 0, "a"), (2, 9, "c"), (3, 1, "c"), (3, 8, "a"), (3, 9, "c")]
    for heavy in (10**6, 100):
        got = sequences.frequent(spark.createDataFrame(events, EVENT), shared.workspace(spark, "t"), gap=9, span=21, longest=4, share=(2, 3), heavy=heavy)
        assert rows_of(got) == wanted(events, 9, 21, 4, share=(2, 3))


def test_closed_patterns(spark):
    kept = [("a", 5), ("b", 5), ("a>b", 5), ("a>a>b", 5), ("b>a", 4), ("a>a", 5), ("c", 2)]
    table = spark.createDataFrame([(p.split(">"), s) for p, s in kept], "pattern array<string>, support long")
    within = lambda p, q: any(tuple(p) == c for c in combinations(q, len(p)))
    for r in sequences.with_wider(table).collect():
        wide = [q for q, s in kept if s == r.support and len(q.split(">")) > len(r.pattern) and within(r.pattern, q.split(">"))]
        assert r.n_wider == len(wide) and r.closed == (not wide)


def test_nulls_times_without_a_zone_and_empty_tables(spark):
    t = dt.datetime(2024, 3, 31, 2, 30, 0, 123456)  # an hour that many zones skip
    rows = [(1, t, "a", 9), (1, None, "a", 9), (None, t, "a", 9), (1, t, None, 9), (1, t + dt.timedelta(seconds=1), "b", 9), (2, t, "a", 9)]
    table = spark.createDataFrame(rows, "client_id long, ts timestamp_ntz, kind string, rank int").withColumns({"client": F.lit(0), "t": F.lit(1), "part": F.lit("x")})
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", other)
            events = sequences.events(table, "client_id", "ts", "kind")
            at = int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
            assert sorted(map(tuple, events.collect())) == [(1, at, "a"), (1, at + 1_000_000, "b"), (2, at, "a")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert rows_of(sequences.frequent(events, shared.workspace(spark, "t"))) == {("a",): (2, zlib.crc32(b"1") + zlib.crc32(b"2"))}
    assert sequences.frequent(events.limit(0), shared.workspace(spark, "t")).collect() == []
