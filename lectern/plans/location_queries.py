"""Page ranges and outlines of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import index_upgrade, location, relational
from lectern.plans.registry import query
from lectern.sources import library

RANGES_SQL = f"""{library.CHUNKS_SQL}, ranges AS (SELECT book_id, start_page AS first, start_page + ordinal % 4 AS last FROM lib_chunks WHERE ordinal % 6 < 2)"""


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    return library.chunks(spark, folder).where("ordinal % 6 < 2").select("book_id", F.col("start_page").alias("first"), (F.col("start_page") + F.col("ordinal") % 4).alias("last"))


@query(
    "merged_ranges",
    f"""WITH {RANGES_SQL}, m AS (SELECT *, CASE WHEN first > coalesce(max(last) OVER (PARTITION BY book_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, -1) THEN 1 ELSE 0 END AS new FROM ranges),
i AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT book_id, min(first) AS first, max(last) AS last FROM i GROUP BY book_id, island""",
)
def merged_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return location.merge_ranges(_ranges(spark, folder)).select("book_id", "first", "last")


@query("limited_ranges", f"WITH {RANGES_SQL} SELECT book_id, first, least(last, 14) AS last FROM ranges WHERE first <= 14")
def limited_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return location.limited(_ranges(spark, folder), F.lit(14)).select("book_id", "first", "last")


@query(
    "chapter_overlap_ranges",
    f"WITH {library.CHAPTERS_SQL} SELECT book_id, number FROM lib_chapters c WHERE EXISTS (SELECT 1 FROM (VALUES (5, 9), (41, 44)) r(first, last) WHERE c.start_page <= r.last AND c.end_page >= r.first)",
)
def chapter_overlap_ranges(spark: SparkSession, folder: str) -> DataFrame:
    asked = library.books(spark, folder).select("book_id", F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((5, 9), (41, 44))])))
    return relational.overlapping(library.chapters(spark, folder), asked).select("book_id", "number")


@query(
    "stretch_ranges",
    f"""WITH {library.BOOKS_SQL}, s AS (SELECT book_id, page_count, part, CAST(greatest(1, least(ceil(page_count * 0.25), page_count)) AS INTEGER) AS width FROM lib_books, (VALUES ('START'), ('MIDDLE'), ('END')) p(part))
SELECT book_id, part, CAST(CASE part WHEN 'END' THEN page_count - width + 1 WHEN 'MIDDLE' THEN 1 + (page_count - width) // 2 ELSE 1 END AS INTEGER) AS first,
CAST(CASE part WHEN 'START' THEN width WHEN 'MIDDLE' THEN (page_count - width) // 2 + width ELSE page_count END AS INTEGER) AS last FROM s""",
)
def stretch_ranges(spark: SparkSession, folder: str) -> DataFrame:
    parts = library.books(spark, folder).withColumn("part", F.explode(F.array(*map(F.lit, ("START", "MIDDLE", "END")))))
    return parts.select("book_id", "part", location.stretch(F.lit(1), F.col("page_count"), F.col("part")).alias("r")).select("book_id", "part", "r.first", "r.last")


@query("page_blocks", f"WITH {library.CHAPTERS_SQL} SELECT book_id, number, start_page, end_page, title FROM lib_chapters")
def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return library.chapters(spark, folder).select("book_id", "number", "start_page", "end_page", "title")


ENTRY_SQL = f"""{library.CHUNKS_SQL}, entries AS (SELECT c.book_id, c.ordinal AS idx, c.start_page, CASE WHEN ordinal % 9 = 0 THEN 0 WHEN ordinal % 3 = 0 THEN 1 ELSE 2 END AS level, b.page_count
FROM lib_chunks c JOIN lib_books b USING (book_id) WHERE ordinal % 9 = 0 OR ordinal % 3 = 0 OR ordinal % 5 = 0)"""


@query(
    "chapter_bounds",
    f"""WITH {ENTRY_SQL} SELECT e.book_id, e.idx, CAST(sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY start_page, idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS number,
greatest(coalesce((SELECT min(n.start_page) FROM entries n WHERE n.book_id = e.book_id AND n.idx > e.idx AND n.level <= e.level) - 1, page_count), start_page) AS end_page FROM entries e""",
)
def chapter_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = library.chunks(spark, folder).where("ordinal % 9 = 0 OR ordinal % 3 = 0 OR ordinal % 5 = 0").join(library.books(spark, folder), "book_id")
    level = F.when(F.col("ordinal") % 9 == 0, 0).when(F.col("ordinal") % 3 == 0, 1).otherwise(2)
    entries = rows.select("book_id", F.col("ordinal").alias("idx"), "start_page", level.alias("level"), "page_count")
    return location.numbered_entries(entries, F.col("page_count")).select("book_id", "idx", "number", "end_page")


UPGRADE_SQL = f"""{library.CHUNKS_SQL}, w(w) AS (VALUES (0), (1), (2), (3)),
old AS (SELECT book_id || '-' || w AS book_id, number, title, start_page, end_page, CASE WHEN w = 3 AND number % 2 = 0 THEN 1 ELSE 0 END AS level, 'BLOCKS' AS source, w FROM lib_chapters, w),
found0 AS (SELECT book_id || '-' || w AS book_id, ordinal AS idx, start_page, CASE WHEN (w = 0 AND ordinal % 20 = 0) OR (w > 0 AND ordinal % 15 = 0) THEN 0 WHEN ordinal % 7 = 3 THEN 1 WHEN ordinal % 11 = 5 THEN 2 END AS level, w FROM lib_chunks, w),
found AS (SELECT book_id, idx, CASE WHEN start_page % 20 = 1 THEN 'Páginas ' || start_page || '–' || least(start_page + 19, page_count) ELSE 'E' || start_page // 30 END AS title, start_page, level, w, page_count
  FROM found0 JOIN (SELECT book_id || '-' || w AS book_id, page_count FROM lib_books, w) USING (book_id) WHERE level IS NOT NULL),
before AS (SELECT book_id, w, list_sort(list(start_page)) AS starts FROM old GROUP BY ALL HAVING max(level) = 0),
after AS (SELECT book_id, list_sort(list(start_page) FILTER (WHERE level = 0)) AS starts FROM found GROUP BY 1),
ways AS (SELECT book_id, CASE WHEN b.starts = a.starts THEN 'SECTIONS' WHEN w = 2 THEN 'INSERT' ELSE 'REBUILD' END AS way FROM before b JOIN after a USING (book_id)),
new AS (SELECT f.*, way FROM found f JOIN ways USING (book_id) WHERE way = 'REBUILD' OR (way = 'SECTIONS' AND level > 0)
  OR (way = 'INSERT' AND NOT EXISTS (SELECT 1 FROM old o WHERE o.book_id = f.book_id AND o.start_page = f.start_page AND o.title = f.title))),
every AS (SELECT book_id, idx, title, start_page, CASE WHEN way = 'INSERT' THEN greatest(level, 1) ELSE level END AS level, way, page_count, TRUE AS fresh FROM new
  UNION ALL SELECT o.book_id, -1, o.title, o.start_page, 0, way, b.page_count, FALSE FROM old o JOIN ways USING (book_id) JOIN (SELECT DISTINCT book_id, page_count FROM found) b USING (book_id) WHERE way <> 'REBUILD'),
placed AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY start_page, level, idx) AS k, greatest(1, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY start_page, level, idx ROWS UNBOUNDED PRECEDING)) AS number FROM every),
ended AS (SELECT p.*, greatest(p.start_page, coalesce((SELECT arg_min(n.start_page, n.k) FROM placed n WHERE n.book_id = p.book_id AND n.k > p.k AND n.level <= p.level) - 1, p.page_count)) AS end_page FROM placed p),
upgraded AS (SELECT book_id, number, title, start_page, end_page, level, source, way FROM old LEFT JOIN ways USING (book_id) WHERE way IS DISTINCT FROM 'REBUILD'
  UNION ALL SELECT book_id, number, title, start_page, end_page, level, 'OUTLINE', way FROM ended WHERE fresh)"""


def _upgraded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Chapters and chunks of four copies of every book after new entries were found: with the same chapters, with nothing that depends on them, with something, and with sections already."""
    copies = F.explode(F.array(*map(F.lit, range(4)))).alias("w")
    named = lambda df, *columns: df.select("*", copies).withColumn("book_id", F.concat_ws("-", "book_id", F.col("w").cast("string"))).select("book_id", "w", *columns)
    old = named(library.chapters(spark, folder), "number", "title", "start_page", "end_page")
    old = old.withColumn("level", F.when((F.col("w") == 3) & (F.col("number") % 2 == 0), 1).otherwise(0)).withColumn("source", F.lit("BLOCKS"))
    counts = named(library.books(spark, folder), "page_count")
    chunks = named(library.chunks(spark, folder), "id", "ordinal", "start_page").withColumn("chapter", F.lit(-1))
    n, page = F.col("ordinal"), F.col("start_page")
    level = F.when(F.when(F.col("w") == 0, n % 20).otherwise(n % 15) == 0, 0).when(n % 7 == 3, 1).when(n % 11 == 5, 2)
    block = F.concat(F.lit("Páginas "), page.cast("string"), F.lit("–"), F.least(page + 19, F.col("page_count")).cast("string"))
    title = F.when(page % 20 == 1, block).otherwise(F.concat(F.lit("E"), F.floor(page / 30).cast("string")))
    found = chunks.join(counts, ["book_id", "w"]).select("book_id", F.col("ordinal").alias("idx"), title.alias("title"), "start_page", level.alias("level"), F.lit("OUTLINE").alias("source")).where("level IS NOT NULL")
    chapters = index_upgrade.merged(old.drop("w"), found, old.where("w = 2").select("book_id"), counts.select("book_id", "page_count"))
    unique = chunks.withColumn("id", F.col("id") * 4 + F.col("w")).select("id", "book_id", "start_page", "chapter")
    return chapters, index_upgrade.keyed_anew(unique, chapters)


@query("indexes_merged", f"WITH {UPGRADE_SQL} SELECT book_id, CAST(number AS INTEGER) AS number, title, start_page, CAST(end_page AS INTEGER) AS end_page, level, source, way FROM upgraded")
def indexes_merged(spark: SparkSession, folder: str) -> DataFrame:
    return _upgraded(spark, folder)[0].withColumn("level", F.col("level").cast("int"))


@query(
    "chunks_keyed_anew",
    f"""WITH {UPGRADE_SQL} SELECT c.id * 4 + w AS id, CASE WHEN (SELECT way FROM ways x WHERE x.book_id = c.book_id || '-' || w) = 'REBUILD' THEN (SELECT CAST(arg_max(u.number, u.start_page) AS INTEGER) FROM upgraded u WHERE u.book_id = c.book_id || '-' || w AND u.level = 0 AND c.start_page BETWEEN u.start_page AND u.end_page) ELSE -1 END AS chapter
FROM lib_chunks c, w""",
)
def chunks_keyed_anew(spark: SparkSession, folder: str) -> DataFrame:
    return _upgraded(spark, folder)[1].select("id", "chapter")
