"""Queries on logs of states and on what is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.sources import importing
from lectern.sources.tables import table
from lectern.streaming import control, reading

LOG_SQL = "log AS (SELECT user_id AS key, ts, event_id, event_type AS source, CAST(floor(value) AS INTEGER) AS value FROM events)"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("source"), F.floor("value").cast("int").alias("value"))


@query(
    "combine_latest",
    f"""WITH {LOG_SQL}, c AS (SELECT event_id, last_value(CASE WHEN source = 'click' THEN value END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN source = 'view' THEN value END IGNORE NULLS) OVER w AS view
  FROM log WINDOW w AS (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT * FROM c WHERE click IS NOT NULL AND view IS NOT NULL""",
)
def combine_latest(spark: SparkSession, folder: str) -> DataFrame:
    return control.combined(_log(spark, folder), ["click", "view"]).select("event_id", "click", "view")


@query("conflated_values", f"WITH {LOG_SQL} SELECT key, source, arg_max(event_id, (ts, event_id)) AS event_id FROM log GROUP BY key, source")
def conflated_values(spark: SparkSession, folder: str) -> DataFrame:
    return control.conflated(_log(spark, folder).select("key", "source", "ts", "event_id"), "key", "source").select("key", "source", "event_id")


@query(
    "flat_map_latest",
    f"""WITH {LOG_SQL}, m AS (SELECT *, last_value(CASE WHEN source = 'signup' THEN value % 3 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chosen FROM log)
SELECT event_id, value FROM m WHERE source = 'view' AND value % 3 = chosen""",
)
def flat_map_latest(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).withColumn("topic", (F.col("value") % 3).cast("string"))
    return control.switched(log.where("source = 'signup'"), log.where("source = 'view'")).select("event_id", "value")


@query(
    "throttled_progress",
    f"""WITH {LOG_SQL}, r AS (SELECT event_id, key, ts, max(value) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS percent FROM log),
b AS (SELECT *, lag(percent) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM r) SELECT event_id, CAST(percent AS INTEGER) AS percent FROM b WHERE before IS NULL OR percent > before""",
)
def throttled_progress(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).select(F.col("key").alias("reader"), "ts", "event_id", F.col("value").alias("page"))
    progress = reading.running_max(log).select(F.col("reader").alias("key"), "ts", "event_id", (F.col("max_page") / 100).alias("progress"))
    return control.throttled(progress).select("event_id", F.round(F.col("progress") * 100).cast("int").alias("percent"))


@query(
    "books_imported",
    """SELECT s_suppkey AS id, s_name AS title, 'READY' AS index_status FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'my.' || s_name ELSE '.' || s_suppkey END, 'PENDING' FROM supplier WHERE s_suppkey % 3 <> 0""",
)
def books_imported(spark: SparkSession, folder: str) -> DataFrame:
    supplier, key = table(spark, folder, "supplier"), F.col("s_suppkey")
    zero = F.lit(0)
    books = supplier.where(key % 3 == 0).select(key.alias("id"), F.col("s_name").alias("title"), F.lit("/x").alias("file_path"), zero.alias("page_count"), F.lit("READY").alias("index_status"), zero.cast("float").alias("index_progress"), zero.alias("cleaner_version"), F.lit(5).alias("imported_at"))
    path = F.when(key % 2 == 0, F.concat(F.lit("file:/a.b/my."), "s_name", F.lit(".pdf"))).otherwise(F.concat(F.lit("/c/."), key.cast("string")))
    files = supplier.select(key.alias("id"), path.alias("path"), F.lit(10).alias("page_count"))
    return importing.imported(files, books, F.lit(7)).select("id", "title", "index_status")


@query(
    "page_lines",
    """WITH g AS (SELECT item_id AS book_id, text AS whole, unnest(range(length(text))) AS n FROM benchmark), x AS (SELECT book_id, n, substr(whole, n + 1, 1) AS c, n % 40 AS place, n // 40 AS line FROM g),
z AS (SELECT *, 10.0 + place * 5 AS left_edge, CASE WHEN n % 7 = 0 THEN 14.1 ELSE 9.9 END AS size, 100.0 + line * 12 + (n % 3) * 0.1 AS y, line % 2 = 0 OR n % 5 = 0 AS bold FROM x)
SELECT book_id, CAST(line AS BIGINT) AS line, string_agg(c, '' ORDER BY n) AS text, min(left_edge)::DOUBLE AS "left", (max(left_edge) + 4.5)::DOUBLE AS "right", round(list(y ORDER BY y)[count(*) // 2 + 1], 6)::DOUBLE AS baseline,
  CASE WHEN count(*) FILTER (n % 7 = 0) >= count(*) FILTER (n % 7 <> 0) THEN 14.0 ELSE 10.0 END::DOUBLE AS size, count(*) FILTER (bold) * 2 > count(*) AS bold FROM z GROUP BY book_id, line""",
)
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The characters of every benchmark item set forty to a line, some larger, some bold."""
    chars = F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("n", "c")
    each = table(spark, folder, "benchmark").select(F.col("item_id").alias("book_id"), chars).withColumn("line", F.floor(F.col("n") / 40))
    n, line = F.col("n"), F.col("line")
    glyphs = each.select(
        "book_id", F.lit(1).alias("page"), "line", "n", "c", (10.0 + (n % 40) * 5).alias("x"), F.lit(4.5).alias("width"), F.round(100.0 + line * 12 + (n % 3) * 0.1, 6).alias("y"),
        F.when(n % 7 == 0, 14.1).otherwise(9.9).alias("size"), ((line % 2 == 0) | (n % 5 == 0)).alias("bold"),
    )
    return importing.lines_of(glyphs).select("book_id", "line", "text", "left", "right", "baseline", "size", "bold")


@query(
    "sample_book",
    "SELECT CAST(p AS INTEGER) AS page, CAST(l AS INTEGER) AS line, CASE WHEN l = 1 AND (p - 1) % 10 = 0 THEN 'Capítulo ' || ((p - 1) // 10 + 1) ELSE 'Línea ' || l || ' de la página ' || p || '.' END AS text FROM range(1, 321) a(p), range(1, 39) b(l)",
)
def sample_book(spark: SparkSession, folder: str) -> DataFrame:
    return importing.sample_lines(spark)
