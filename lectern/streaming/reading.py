"""Reading state from event logs, as batch relations and as Structured Streaming queries.

Consecutive reports of the same page are dropped before any quiet time is measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEBOUNCE = "800 milliseconds"
DWELL = "4 seconds"


def changes(log: DataFrame, key: str = "reader", value: str = "page") -> DataFrame:
    """Events that report another value than the one before (distinct until changed)."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    return log.withColumn("_before", F.lag(value).over(order)).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def settled(log: DataFrame, quiet_seconds: float, key: str = "reader") -> DataFrame:
    """Changes after which nothing changed for the quiet time; the last of a reader is one (debounce, dwell)."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros(F.lead("ts").over(order).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return changes(log, key).withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= int(quiet_seconds * 1_000_000))).drop("_gap")


def running_max(log: DataFrame, key: str = "reader") -> DataFrame:
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("max_page", F.max("page").over(order))


def debounced_stream(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Last page of each burst of events without a pause of DEBOUNCE, by event time with a watermark."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("reader", F.session_window("ts", DEBOUNCE).alias("session"))
        .agg(F.max_by("page", "ts").alias("page"), F.max("ts").alias("ts"))
        .select("reader", "page", "ts")
    )


def max_page_stream(stream: DataFrame) -> DataFrame:
    """Highest page of each reader so far (update or complete mode)."""
    return stream.groupBy("reader").agg(F.max("page").alias("max_page"))


def usage_stream(stream: DataFrame, zone: str, late: str = "1 day") -> DataFrame:
    """Tokens and requests of each day of a time zone."""
    return stream.withWatermark("ts", late).groupBy(day_in(F.col("ts"), zone).alias("day")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))


def day_in(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def upsert_sink(path: str, keys: list[str], version: str):
    """A foreachBatch function that keeps the newest row per key in a table below path, one folder per batch (a repeated batch writes the same again)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/batch={number - 1}"
        rows = batch
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(before)
        if number > 0 and jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(before))
        others = [c for c in batch.columns if c not in keys]
        newest = F.max(F.struct(F.col(version), *[F.col(c) for c in others if c != version])).alias("row")
        rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"row.{c}").alias(c) for c in others]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def usage_level(tokens: Column, limit: Column) -> Column:
    return F.when(tokens >= limit, "OVER").when(tokens >= limit * 0.8, "NEAR").otherwise("OK")
