"""Queries on reading and usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.sources import library
from lectern.sources.tables import table
from lectern.streaming import reading

CHANGES_SQL = f"""{library.LOG_SQL}, lagged AS (SELECT *, lag(page) OVER (PARTITION BY reader ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY reader ORDER BY ts, event_id) AS rn FROM reading_log),
changes AS (SELECT * FROM lagged WHERE rn = 1 OR before IS DISTINCT FROM page), gaps AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY reader ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM changes)"""


@query("max_page_running", f"WITH {library.LOG_SQL} SELECT event_id, max(page) OVER (PARTITION BY reader ORDER BY ts, event_id) AS max_page FROM reading_log")
def max_page_running(spark: SparkSession, folder: str) -> DataFrame:
    return reading.running_max(library.reading_log(spark, folder)).select("event_id", "max_page")


@query("max_page_read", f"WITH {library.LOG_SQL} SELECT reader, coalesce(max(page), 0) AS max_page FROM reading_log GROUP BY reader")
def max_page_read(spark: SparkSession, folder: str) -> DataFrame:
    return library.reading_log(spark, folder).groupBy("reader").agg(F.coalesce(F.max("page"), F.lit(0)).alias("max_page"))


@query("page_changes", f"WITH {CHANGES_SQL} SELECT event_id, reader, page FROM changes")
def page_changes(spark: SparkSession, folder: str) -> DataFrame:
    return reading.changes(library.reading_log(spark, folder)).select("event_id", "reader", "page")


@query("dwell_read_pages", f"WITH {CHANGES_SQL} SELECT DISTINCT reader, page FROM gaps WHERE gap IS NULL OR gap >= 14400000000")
def dwell_read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages kept for four hours (the events are hours apart)."""
    return reading.settled(library.reading_log(spark, folder), 4 * 3600).select("reader", "page").distinct()


@query("debounced_positions", f"WITH {CHANGES_SQL} SELECT event_id, reader, page FROM gaps WHERE gap IS NULL OR gap >= 800000")
def debounced_positions(spark: SparkSession, folder: str) -> DataFrame:
    return reading.settled(library.reading_log(spark, folder), 0.8).select("event_id", "reader", "page")


DAILY_SQL = """daily AS (SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) AS requests FROM events GROUP BY 1)"""


@query("daily_usage", f"WITH {DAILY_SQL} SELECT day, tokens, requests, CASE WHEN tokens >= 15000 THEN 'OVER' WHEN tokens >= 12000 THEN 'NEAR' ELSE 'OK' END AS level FROM daily")
def daily_usage(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder).select("day", "tokens", "requests", reading.usage_level(F.col("tokens"), F.lit(15000)).alias("level"))


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    day = reading.day_in(F.col("ts"), "America/Los_Angeles")
    return events.groupBy(day.alias("day")).agg(F.sum(F.floor("value")).cast("long").alias("tokens"), F.count("*").alias("requests"))


@query(
    "budget_crossings",
    f"""WITH {DAILY_SQL}, l AS (SELECT day, CASE WHEN tokens >= 15000 THEN 2 WHEN tokens >= 12000 THEN 1 ELSE 0 END AS level FROM daily), p AS (SELECT day, level, lag(level) OVER (ORDER BY day) AS before FROM l)
SELECT day, level FROM p WHERE level > coalesce(before, 0)""",
)
def budget_crossings(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose level rises; a row per day after aggregation."""
    level = F.when(F.col("tokens") >= 15000, 2).when(F.col("tokens") >= 12000, 1).otherwise(0)
    rows = _daily(spark, folder).select("day", level.alias("level"))
    before = F.lag("level").over(Window.partitionBy(F.lit(0)).orderBy("day"))
    return rows.withColumn("before", before).where(F.col("level") > F.coalesce("before", F.lit(0))).select("day", "level")


@query("session_last_page", f"WITH {library.LOG_SQL}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY reader ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS new FROM reading_log),\n"
       "s AS (SELECT *, sum(new) OVER (PARTITION BY reader ORDER BY ts) AS session FROM g) SELECT reader, min(ts) AS started, arg_max(page, ts) AS page, count(*) AS n FROM s GROUP BY reader, session")  # fmt: skip
def session_last_page(spark: SparkSession, folder: str) -> DataFrame:
    log = library.reading_log(spark, folder)
    sessions = log.groupBy("reader", F.session_window("ts", "1 hour").alias("w")).agg(F.min("ts").alias("started"), F.max_by("page", "ts").alias("page"), F.count("*").alias("n"))
    return sessions.select("reader", "started", "page", "n")


@query("long_breaks", f"WITH {library.LOG_SQL}, l AS (SELECT reader, max(ts) AS ts, arg_max(page, (ts, event_id)) AS page FROM reading_log GROUP BY reader) SELECT reader FROM l WHERE ts < (SELECT max(ts) FROM reading_log) - INTERVAL 12 HOUR AND page > 1")
def long_breaks(spark: SparkSession, folder: str) -> DataFrame:
    log = library.reading_log(spark, folder)
    now = log.agg(F.max("ts").alias("now"))
    last = log.groupBy("reader").agg(F.max("ts").alias("ts"), F.max_by("page", F.struct("ts", "event_id")).alias("page"))
    return last.crossJoin(F.broadcast(now)).where("ts < now - INTERVAL 12 HOURS AND page > 1").select("reader")  # one row
