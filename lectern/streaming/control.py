"""How streams of states are put together, thinned out and passed on: as batch relations over a log, and for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = 0.01
PAGES_AT_ONCE = 25


def combined(log: DataFrame, sources: Sequence[str], key: str = "key") -> DataFrame:
    """log (key, ts, event_id, source, value) with the latest value of every source at each event, once all have one."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("source") == s, F.col("value")), ignorenulls=True).over(order).alias(s) for s in sources]
    return log.select("*", *latest).dropna(subset=list(sources))


def combined_stream(stream: DataFrame, sources: Sequence[str], key: str = "key") -> DataFrame:
    """key and a column for every source, a row for each event of a stream (key, ts, source, value: double) once all sources have a value; events of a trigger are taken in the order of ts."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = dict(zip(sources, state.get, strict=True)) if state.exists else dict.fromkeys(sources)
        rows = []
        for event in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            latest[event.source] = event.value
            if all(v is not None for v in latest.values()):
                rows.append((*keys, *latest.values()))
        state.update(tuple(latest.values()))
        yield pd.DataFrame(rows, columns=[key, *sources])

    kind = stream.schema[key].dataType.simpleString()
    columns = ", ".join(f"{s} double" for s in sources)
    return stream.select(key, "ts", "source", "value").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {columns}", columns, "append", GroupStateTimeout.NoTimeout)


def conflated(batch: DataFrame, *keys: str, ts: str = "ts") -> DataFrame:
    """The newest row of each key of a batch; a foreachBatch function puts it before its sink, so only the newest is handled."""
    others = [c for c in batch.columns if c not in keys and c != ts]
    newest = F.max(F.struct(ts, *others)).alias("row")
    return batch.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"row.{c}").alias(c) for c in (ts, *others)]).select(*batch.columns)


def switched(outer: DataFrame, inner: DataFrame, key: str = "key") -> DataFrame:
    """Events of inner (key, ts, event_id, topic, other columns) whose topic is the last that outer (key, ts, event_id, topic) chose before them (flat-map latest)."""
    marked = outer.select(key, "ts", "event_id", F.col("topic").alias("_chosen")).unionByName(inner.select(key, "ts", "event_id", "topic", F.lit(None).cast("string").alias("_chosen")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    current = marked.withColumn("_now", F.last("_chosen", ignorenulls=True).over(order)).where("topic IS NOT NULL AND topic = _now").select("event_id")
    return inner.join(current.distinct(), "event_id", "left_semi")


def throttled(log: DataFrame, key: str = "key", step: float = STEP) -> DataFrame:
    """Reports (key, ts, event_id, progress: 0 to 1) that are at least step beyond the last that was passed on, or the first that is done."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for progress in (ordered := rows.sort_values(["ts", "event_id"]))["progress"]:
            passes = last is None or progress - last >= step - 1e-9 or (progress >= 1 > last)
            last = progress if passes else last
            kept.append(passes)
        return ordered[kept]

    return log.groupBy(key).applyInPandas(run, log.schema)


def bounded(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files that takes at most so many at a time, however many wait."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def observed(view: Callable[[SparkSession], DataFrame], passed_on: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that works a view out again after each batch of changes, and passes it on if it is another than before."""
    seen: dict[str, int | None] = {}

    def write(batch: DataFrame, number: int) -> None:
        found = view(batch.sparkSession)
        row = F.xxhash64(F.to_json(F.struct(*found.columns)))
        digest = found.agg(F.bit_xor(row).alias("x"), F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
        if seen.get("digest") != tuple(digest):
            seen["digest"] = tuple(digest)
            passed_on(found)

    return write


def write_pages(texts: DataFrame, layouts: DataFrame, folder: str, at_once: int = PAGES_AT_ONCE) -> None:
    """Appends pages, at_once to a file at most, texts before layouts: a layout that is there tells that the page is done."""
    for name, rows in (("page_texts", texts), ("page_layouts", layouts)):
        part = F.floor((F.col("page") - 1) / at_once)
        rows.withColumn("_part", part).repartition("book_id", "_part").drop("_part").write.option("maxRecordsPerFile", at_once).mode("append").parquet(f"{folder}/{name}")


def stops_at(started: int, minutes: int | None, chapter_ends: int | None) -> int | None:
    """When a reading stops (seconds): after so many minutes, or with the chapter; the earlier of both."""
    ends = [t for t in (None if minutes is None else started + 60 * minutes, chapter_ends) if t is not None]
    return min(ends) if ends else None
