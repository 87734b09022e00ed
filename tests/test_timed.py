"""Streams with timers give what their batch forms give, however they are cut into triggers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import control, reading, timed

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, timed.STATE_STORE)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def streamed(spark, rows, schema, folder, build, seed, columns):
    """The rows of a streaming query over rows cut into a few triggers, somewhat out of order; ends with an event far ahead of all."""
    rng = random.Random(seed)
    near = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, 60)))
    cuts = sorted(rng.sample(range(1, len(near)), 2))
    ends = [("end", START + dt.timedelta(days=d), 10**9 + d, *rows[0][3:]) for d in (2, 3)]
    for part in (near[: cuts[0]], near[cuts[0] : cuts[1]], near[cuts[1] :], ends[:1], ends[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").start()
        query.processAllAvailable()
        query.stop()
    found = spark.read.parquet(f"{folder}/out")
    return sorted(tuple(r) for r in found.where(F.col(columns[0]) != "end").select(*columns).collect())


def events(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("ab"), START + dt.timedelta(microseconds=rng.randrange(300_000_000)), i) for i in range(n)], rng


@pytest.mark.parametrize("seed", [1, 2])
def test_throttled(rocks, tmp_path, seed):
    plain, rng = events(seed)
    rows = [(*e, min(1.0, rng.random() * 1.2)) for e in plain]
    schema = "key string, ts timestamp, event_id long, progress double"
    want = sorted((r.key, r.event_id) for r in control.throttled(rocks.createDataFrame(rows, schema), step=0.1).collect())
    assert streamed(rocks, rows, schema, tmp_path, lambda s: timed.throttled(s, step=0.1, late="70 seconds"), seed, ["key", "event_id"]) == want


def test_switched(rocks, tmp_path):
    plain, rng = events(3)
    rows = [(*e, *((None, rng.choice("xyz")) if rng.random() < 0.3 else (rng.choice("xyz"), None))) for e in plain]
    schema = "key string, ts timestamp, event_id long, topic string, chosen string"
    table = rocks.createDataFrame(rows, schema)
    outer = table.where("chosen IS NOT NULL").select("key", "ts", "event_id", F.col("chosen").alias("topic"))
    want = sorted((r.key, r.event_id, r.topic) for r in control.switched(outer, table.where("topic IS NOT NULL").drop("chosen")).collect())
    assert want and streamed(rocks, rows, schema, tmp_path, lambda s: timed.switched(s, late="70 seconds"), 3, ["key", "event_id", "topic"]) == want


def test_settled(rocks, tmp_path):
    plain, rng = events(4)
    rows = [(*e, rng.randrange(3)) for e in plain]
    schema = "reader string, ts timestamp, event_id long, page int"
    want = sorted((r.reader, r.event_id, r.page) for r in reading.settled(rocks.createDataFrame(rows, schema), 4.0).collect())
    assert want and streamed(rocks, rows, schema, tmp_path, lambda s: timed.settled(s, 4.0, late="70 seconds"), 4, ["reader", "event_id", "page"]) == want
