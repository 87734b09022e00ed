"""Smaller queries: containment and combination joins, neighbours in order, running sums, parts of outlines, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import chat, graph, key_points, location, relational
from lectern.plans.registry import query
from lectern.sources import library
from lectern.sources.tables import table


@query("chunks_in_ranges", f"WITH {library.CHUNKS_SQL} SELECT DISTINCT c.id FROM lib_chunks c JOIN (VALUES (2, 9), (5, 14)) r(first, last) ON c.start_page >= r.first AND c.end_page <= r.last")
def chunks_in_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ranges = library.books(spark, folder).select("book_id", F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((2, 9), (5, 14))])))
    return relational.contained(library.chunks(spark, folder), ranges).select("id")


@query("expected_page_in_chunk", f"WITH {library.CHUNKS_SQL} SELECT id, len(list_filter([3, 17, 40], lambda p: p BETWEEN start_page AND end_page)) > 0 AS relevant FROM lib_chunks")
def expected_page_in_chunk(spark: SparkSession, folder: str) -> DataFrame:
    pages = F.array(F.lit(3), F.lit(17), F.lit(40))
    return library.chunks(spark, folder).select("id", F.exists(pages, lambda p: p.between(F.col("start_page"), F.col("end_page"))).alias("relevant"))


@query(
    "characters_combined",
    f"""WITH {library.GRAPH_SQL}, r AS (SELECT from_id AS character_id, count(*) AS relations, min(page) AS first_page FROM graph GROUP BY 1), f AS (SELECT s_suppkey AS character_id, s_name AS name FROM supplier),
o AS (SELECT l_suppkey AS character_id, count(DISTINCT l_orderkey) AS facts FROM lineitem GROUP BY 1)
SELECT character_id, name, coalesce(relations, 0) AS relations, first_page, coalesce(facts, 0) AS facts FROM f LEFT JOIN r USING (character_id) LEFT JOIN o USING (character_id)""",
)
def characters_combined(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("character_id"), F.col("s_name").alias("name"))
    relations = library.graph(spark, folder).groupBy(F.col("from_id").alias("character_id")).agg(F.count("*").alias("relations"), F.min("page").alias("first_page"))
    facts = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("character_id")).agg(F.countDistinct("l_orderkey").alias("facts"))
    joined = people.join(relations, "character_id", "left").join(facts, "character_id", "left")
    return joined.select("character_id", "name", F.coalesce("relations", F.lit(0)).alias("relations"), "first_page", F.coalesce("facts", F.lit(0)).alias("facts"))


@query(
    "chapters_with_points",
    f"""WITH {library.CHAPTERS_SQL}, k AS (SELECT book_id, number, count(*) AS points FROM lib_chapters c JOIN lib_pages p USING (book_id) JOIN labels l ON l.doc_id = p.doc_id
  WHERE p.page BETWEEN c.start_page AND c.end_page AND l.toxic = 1 GROUP BY 1, 2) SELECT book_id, number, points, points IS NOT NULL AS ready FROM lib_chapters LEFT JOIN k USING (book_id, number)""",
)
def chapters_with_points(spark: SparkSession, folder: str) -> DataFrame:
    told = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    number = F.floor((F.col("page") - 1) / library.PAGES_PER_CHAPTER).cast("int") + 1
    points = library.pages(spark, folder).join(told, "doc_id").groupBy("book_id", number.alias("number")).agg(F.count("*").alias("points"))
    return library.chapters(spark, folder).join(points, ["book_id", "number"], "left").select("book_id", "number", "points", F.col("points").isNotNull().alias("ready"))


@query(
    "chapters_missing_points",
    f"""WITH {library.CHAPTERS_SQL}, k AS (SELECT DISTINCT book_id, (page - 1) // 20 + 1 AS number FROM lib_pages p JOIN labels l ON l.doc_id = p.doc_id WHERE l.toxic = 1)
SELECT book_id, number FROM lib_chapters c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.book_id = c.book_id AND k.number = c.number)""",
)
def chapters_missing_points(spark: SparkSession, folder: str) -> DataFrame:
    told = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    number = F.floor((F.col("page") - 1) / library.PAGES_PER_CHAPTER).cast("int") + 1
    name = lambda n: F.concat_ws("/", "book_id", n.cast("string"))
    saved = library.pages(spark, folder).join(told, "doc_id").select(name(number).alias("chapter_id")).distinct()
    chapters = library.chapters(spark, folder).withColumn("id", name(F.col("number")))
    return key_points.missing(chapters, saved).select("book_id", "number")


@query(
    "neighbour_turns",
    "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def neighbour_turns(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, folder, "conversations").select("conv_id", "turn", F.lag("turn").over(order).alias("previous"), F.lead("turn").over(order).alias("following"))


@query(
    "usage_running",
    """SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens FROM events""",
)
def usage_running(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "events").select("event_id", F.sum(F.floor("value")).over(order).cast("long").alias("tokens"))


@query("source_kind_counts", "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS answers, count(*) FILTER (WHERE role = 'user') AS questions FROM conversations GROUP BY conv_id")
def source_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("answers"), F.count_if(F.col("role") == "user").alias("questions"))


@query(
    "nearby_widest_page",
    f"""WITH {library.PAGES_SQL}, s AS (SELECT book_id, page, length(text) AS width FROM lib_pages) SELECT book_id, page, max(width) OVER (PARTITION BY book_id ORDER BY page ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS widest FROM s""",
)
def nearby_widest_page(spark: SparkSession, folder: str) -> DataFrame:
    """The widest of the pages from four before to three after. Each page tells its neighbours, so no book is one task's."""
    sizes = library.pages(spark, folder, "text").select("book_id", "page", F.length("text").alias("width"))
    told = sizes.select("book_id", F.explode(F.sequence(F.col("page") - 3, F.col("page") + 4)).alias("page"), "width")
    return told.groupBy("book_id", "page").agg(F.max("width").alias("widest")).join(sizes.select("book_id", "page"), ["book_id", "page"], "left_semi")


@query(
    "part_of_chapters",
    f"""WITH {library.CHAPTERS_SQL}, t AS (SELECT book_id, number, CASE WHEN number % 3 = 1 THEN 'Parte ' || number || '. Inicio' ELSE title END AS title FROM lib_chapters)
SELECT book_id, number, 'Parte ' || (number - (number - 1) % 3) AS part FROM t""",
)
def part_of_chapters(spark: SparkSession, folder: str) -> DataFrame:
    is_part = F.col("number") % 3 == 1
    titled = library.chapters(spark, folder).withColumn("title", F.when(is_part, F.concat(F.lit("Parte "), F.col("number").cast("string"), F.lit(". Inicio"))).otherwise(F.col("title")))
    return titled.select("book_id", "number", location.nearest_part(titled, F.col("title").startswith("Parte ")).alias("part"))


@query(
    "relations_ended",
    f"""WITH {library.GRAPH_SQL}, open AS (SELECT id, from_id, to_id, type, page FROM graph WHERE status = 'O'),
e AS (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, type FROM graph WHERE status = 'F'),
c AS (SELECT e.a, e.b, e.type, arg_max(o.id, (o.type = e.type, o.page, o.id)) AS id FROM e JOIN open o ON least(o.from_id, o.to_id) = e.a AND greatest(o.from_id, o.to_id) = e.b GROUP BY e.a, e.b, e.type)
SELECT o.id, m.ended_at FROM open o LEFT JOIN (SELECT DISTINCT id, 3000 AS ended_at FROM c) m ON m.id = o.id""",
)
def relations_ended(spark: SparkSession, folder: str) -> DataFrame:
    edges = library.graph(spark, folder)
    endings = edges.where("status = 'F'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type", F.lit(3000).alias("at")).distinct()
    still = edges.where("status = 'O'").select("id", "from_id", "to_id", "type", "page", F.lit(None).cast("int").alias("ended_at"))
    return graph.end_relations(still, endings).select("id", "ended_at")


@query(
    "chat_availability",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'BOOK_FAILED' WHEN doc_id % 5 = 0 THEN 'NO_KEY' WHEN doc_id % 3 = 0 THEN CASE WHEN n_chars > 500 THEN 'READY' ELSE 'NO_TEXT' END
WHEN doc_id % 3 = 1 AND n_chars > 500 THEN CASE WHEN doc_id % 2 = 0 THEN 'READY_INDEXING' ELSE 'READY_TEXT_ONLY' END WHEN n_chars > 1000 THEN 'INDEXING' ELSE 'WAITING' END AS state FROM documents""",
)
def chat_availability(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 7 == 0, "FAILED").when(i % 3 == 0, "READY").when(i % 3 == 1, "TEXT_READY").otherwise("PENDING")
    progress = F.when(F.col("n_chars") > 1000, 0.5).otherwise(0.0)
    return table(spark, folder, "documents").select("doc_id", chat.availability(status, progress, i % 5 != 0, i % 2 == 0, F.col("n_chars") > 500).alias("state"))


@query(
    "model_errors",
    """SELECT user_id, CASE WHEN k = 0 THEN 'Network' WHEN k = 1 THEN 'Unauthorized' WHEN k = 2 THEN 'RateLimited' WHEN k = 3 THEN 'Overloaded' ELSE 'Failed' END AS kind, count(*) AS n
FROM (SELECT user_id, event_id % 5 AS k FROM events WHERE event_type = 'error') GROUP BY ALL""",
)
def model_errors(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id") % 5
    code = F.when(k == 1, 401).when(k == 2, 429).when(k == 3, 503).when(k == 4, 400)
    return table(spark, folder, "events").where("event_type = 'error'").groupBy("user_id", chat.error_kind(code).alias("kind")).agg(F.count("*").alias("n"))


@query("analysis_progress", "SELECT source AS book_id, count(*) AS total, count(l.doc_id) AS scanned, count(*) > 0 AND count(l.doc_id) >= count(*) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def analysis_progress(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("done"))
    rows = table(spark, folder, "documents").select("doc_id", F.col("source").alias("book_id")).join(done, "doc_id", "left")
    sums = rows.groupBy("book_id").agg(F.count("*").alias("total"), F.count("done").alias("scanned"))
    return sums.withColumn("complete", (F.col("total") > 0) & (F.col("scanned") >= F.col("total")))


@query(
    "chapter_jumps",
    f"""WITH {library.CHAPTERS_SQL} SELECT p.doc_id, (SELECT min(c.start_page) FROM lib_chapters c WHERE c.book_id = p.book_id AND c.start_page > p.page) AS following,
(SELECT max(c.start_page) FROM lib_chapters c WHERE c.book_id = p.book_id AND c.start_page < p.page) AS previous FROM lib_pages p""",
)
def chapter_jumps(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of pages, so the starts before and after are arithmetic on the page and the book's last page."""
    size = library.PAGES_PER_CHAPTER
    rows = library.pages(spark, folder).join(library.books(spark, folder), "book_id")
    here = (F.floor((F.col("page") - 1) / size) * size + 1).cast("int")
    after = F.when(here + size <= F.col("page_count"), here + size)
    before = F.when(here < F.col("page"), here).when(here > 1, here - size)
    return rows.select("doc_id", after.alias("following"), before.alias("previous"))
