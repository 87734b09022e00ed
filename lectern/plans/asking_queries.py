"""Queries on what is asked of a book and what is read for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import asking
from lectern.plans.registry import query
from lectern.plans.text_queries import QUESTIONS
from lectern.sources import library, scratch
from lectern.sources.tables import table


def _told(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("number").cast("string")
    events = F.array(F.concat(F.lit("Llega la nave "), number), F.concat(F.lit("¡Arde el molino número "), number, F.lit("!")))
    return library.chapters(spark, folder).withColumn("events", F.when(F.col("number") % 4 == 0, F.array().cast("array<string>")).otherwise(events))


EVENTS_SQL = f"{library.CHAPTERS_SQL}, told AS (SELECT *, CASE WHEN number % 4 = 0 THEN [] ELSE ['Llega la nave ' || number, '¡Arde el molino número ' || number || '!'] END AS events FROM lib_chapters)"


@query(
    "event_lists",
    f"""WITH {EVENTS_SQL} SELECT book_id, string_agg('[' || number || '] ' || title || ' (p. ' || start_page || '–' || end_page || ')' || coalesce(array_to_string(list_transform(events, lambda e: chr(10) || '- ' || e), ''), ''), chr(10) || chr(10) ORDER BY start_page) AS events FROM told GROUP BY book_id""",
)
def event_lists(spark: SparkSession, folder: str) -> DataFrame:
    return asking.event_list(_told(spark, folder))


@query(
    "event_anchors",
    f"""WITH {EVENTS_SQL}, n AS (SELECT book_id, max(number) AS chapters FROM told GROUP BY 1), q AS (SELECT book_id, number, chapters, unnest(range(4)) AS way FROM told JOIN n USING (book_id))
SELECT book_id, number AS asked, CAST(way AS INTEGER) AS way, CASE WHEN way = 0 AND number % 4 <> 0 THEN number WHEN way = 0 THEN 1 WHEN way = 1 THEN CASE WHEN number + 1 <= chapters THEN number + 1 END END AS number,
  CASE WHEN way = 0 THEN 'AFTER' WHEN way = 1 AND number + 1 <= chapters THEN 'BEFORE' END AS relation FROM q""",
)
def event_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that quote an event, that only tell a chapter, that tell no relation, and that are no answer."""
    told = _told(spark, folder)
    n = F.col("number").cast("string")
    quoted = F.concat(F.lit('x {"hecho":"arde el MOLINO, numero '), n, F.lit('","relacion":" despues ","capitulo":1} y'))
    placed = F.concat(F.lit('{"hecho":"nada","relacion":"ANTES","capitulo":'), (F.col("number") + 1).cast("string"), F.lit("}"))
    answers = F.array(quoted, placed, F.lit('{"hecho":"nada","relacion":"NINGUNA","capitulo":1}'), F.lit("no sé"))
    asked = told.select("book_id", F.col("number").alias("asked"), F.posexplode(answers).alias("way", "answer"))
    return asking.event_anchors(asked, told).select("book_id", "asked", "way", "number", "relation")


@query("book_part_answers", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_part FROM documents")
def book_part_answers(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id") % 3
    answer = F.when(number == 0, 'Sí: {"parte_del_libro": true}.').when(number == 1, '{"parte_del_libro":false}').otherwise('{"otra":1}')
    return table(spark, folder, "documents").select("doc_id", asking.is_book_part(answer).alias("is_part"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    listed = library.chapters(spark, folder)
    number = F.col("number")
    said = F.array(*[F.replace(F.replace(F.lit(q), F.lit("{n}"), number.cast("string")), F.lit("{m}"), (number + 1).cast("string")) for q in (*QUESTIONS, "¿De qué trata el libro?")])
    return listed.join(library.books(spark, folder), "book_id").select("book_id", "number", F.col("start_page").alias("page"), "page_count", F.posexplode(said).alias("way_no", "question"))


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """Doubtful places are parts of the book where the chapter is odd; events are found in the chapter asked about."""
    part_judge = lambda rows: rows.withColumn("is_part", F.col("number") % 2 == 1)
    return asking.locate(_asked(spark, folder), library.chapters(spark, folder), F.col("page") + 25, part_judge, lambda rows: rows, path=scratch.workspace(spark, "located"))


LOCATED_SQL = f"""{library.CHAPTERS_SQL}, c AS (SELECT c.*, page_count, lead(end_page, 1, end_page) OVER w AS next_end, lag(start_page) OVER w AS before_start, lag(end_page) OVER w AS before_end,
  first_value(start_page) OVER (PARTITION BY book_id ORDER BY number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near_first, last_value(end_page) OVER (PARTITION BY book_id ORDER BY number ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS near_last
  FROM lib_chapters c JOIN lib_books USING (book_id) WINDOW w AS (PARTITION BY book_id ORDER BY number)),
q AS (SELECT c.*, unnest(range(8)) AS way_no FROM c),
r AS (SELECT *, CAST(greatest(1, ceil((end_page - start_page + 1) * 0.25)) AS INTEGER) AS of_chapter, CAST(greatest(1, ceil(page_count * 0.25)) AS INTEGER) AS of_book FROM q),
p AS (SELECT *, CASE WHEN way_no = 0 THEN end_page - of_chapter + 1 WHEN way_no = 1 OR (way_no = 3 AND number % 2 = 1) THEN page_count - of_book + 1 WHEN way_no = 2 THEN start_page WHEN way_no = 4 THEN before_start WHEN way_no = 6 THEN near_first END AS raw_first,
  CASE WHEN way_no = 0 THEN end_page WHEN way_no = 1 OR (way_no = 3 AND number % 2 = 1) THEN page_count WHEN way_no = 2 THEN next_end WHEN way_no = 4 THEN before_end WHEN way_no = 6 THEN near_last END AS raw_last FROM r),
located AS (SELECT *, raw_first IS NOT NULL AS placed, CASE WHEN raw_first <= start_page + 25 THEN raw_first END AS first, CASE WHEN raw_first <= start_page + 25 THEN least(raw_last, start_page + 25) END AS last FROM p)"""


@query("question_located", f"WITH {LOCATED_SQL} SELECT book_id, number, CAST(way_no AS INTEGER) AS way_no, placed, first, last FROM located")
def question_located(spark: SparkSession, folder: str) -> DataFrame:
    found = _located(spark, folder)
    return found.select("book_id", "number", "way_no", F.col("ranges").isNotNull().alias("placed"), F.get("ranges", F.lit(0))["first"].alias("first"), F.try_element_at("ranges", F.lit(-1))["last"].alias("last"))


@query(
    "fragment_plans",
    f"""WITH {LOCATED_SQL}, w AS (SELECT *, start_page + 25 AS lim, way_no IN (0, 2, 4, 6, 7) AS summary FROM located),
x AS (SELECT *, CASE WHEN placed AND first IS NULL THEN 'NOTHING' WHEN placed AND way_no = 4 AND before_start > lim THEN 'NOTHING' WHEN (placed AND summary) OR (NOT placed AND way_no IN (4, 7)) THEN 'KEY_POINTS' ELSE 'RETRIEVE' END AS way FROM w)
SELECT book_id, number, CAST(way_no AS INTEGER) AS way_no, way, CASE WHEN way = 'RETRIEVE' THEN 8 END AS k, CASE WHEN way = 'KEY_POINTS' THEN CASE WHEN placed THEN 'SPREAD' ELSE 'RETRIEVE' END END AS otherwise_way,
  CASE WHEN way = 'KEY_POINTS' THEN (SELECT count(*) FROM lib_chapters h WHERE h.book_id = x.book_id AND CASE WHEN placed THEN h.start_page <= x.last AND h.end_page >= x.first ELSE h.start_page <= lim END) END AS n_chapters FROM x""",
)
def fragment_plans(spark: SparkSession, folder: str) -> DataFrame:
    planned = asking.fragment_plan(_located(spark, folder), library.chapters(spark, folder), F.col("page") + 25)
    return planned.select("book_id", "number", "way_no", "way", "k", "otherwise_way", F.when(F.col("chapters").isNotNull(), F.size("chapters")).cast("long").alias("n_chapters"))


@query(
    "position_texts",
    f"""WITH {library.CHAPTERS_SQL}, c AS (SELECT *, lag(title) OVER w AS before_title, lag(start_page) OVER w AS before_start, lag(end_page) OVER w AS before_end FROM lib_chapters WINDOW w AS (PARTITION BY book_id ORDER BY number))
SELECT p.book_id, p.page, 'El lector está en la página ' || p.page || ', en el capítulo «' || title || '» (p. ' || start_page || '–' || end_page || ').' || CASE WHEN before_title IS NULL THEN '' ELSE ' El capítulo anterior es «' || before_title || '» (p. ' || before_start || '–' || before_end || ').' END
  || CASE p.page % 3 WHEN 0 THEN '' WHEN 1 THEN ' La pregunta se refiere a una parte del libro que el lector aún no ha leído.' ELSE ' La pregunta se refiere a las páginas 4, 7–9.' END AS position
FROM lib_pages p JOIN c ON c.book_id = p.book_id AND p.page BETWEEN c.start_page AND c.end_page""",
)
def position_texts(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda a, b: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    ranges = F.when(F.col("page") % 3 == 1, none).when(F.col("page") % 3 == 2, F.array(one(4, 4), one(7, 9)))
    asked = library.pages(spark, folder).select("book_id", "page", ranges.alias("ranges"))
    return asking.position_text(asked, library.chapters(spark, folder)).select("book_id", "page", "position")


@query("block_texts", f"WITH {library.PAGES_SQL} SELECT book_id, (page - 1) // 5 AS block, sha256(string_agg('[p. ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS text_sha256 FROM lib_pages GROUP BY ALL")
def block_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = library.pages(spark, folder, "text").withColumn("block", F.floor((F.col("page") - 1) / 5).cast("int"))
    return asking.block_text(pages).select("book_id", "block", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("recaps_current", f"WITH {library.PAGES_SQL} SELECT book_id, page, page * 7 % 40 AS until_page, page * 7 % 40 <= page AND (least(page, n) - 1) // 20 - (CASE WHEN page * 7 % 40 < 1 THEN -1 ELSE (least(page * 7 % 40, n) - 1) // 20 END) <= 1 AS current FROM lib_pages JOIN (SELECT book_id, count(*) AS n FROM lib_pages GROUP BY 1) USING (book_id)")
def recaps_current(spark: SparkSession, folder: str) -> DataFrame:
    recaps = library.pages(spark, folder).select("book_id", "page", (F.col("page") * 7 % 40).alias("until_page"))
    return asking.recap_is_current(recaps, library.chapters(spark, folder)).select("book_id", "page", "until_page", "current")


@query("cost_confirmations", "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 300 > greatest(200 - CAST(floor(value) AS BIGINT), 0) THEN event_id % 300 END AS estimate, CASE WHEN event_id % 5 <> 0 AND event_id % 300 > greatest(200 - CAST(floor(value) AS BIGINT), 0) THEN greatest(200 - CAST(floor(value) AS BIGINT), 0) END AS remaining FROM events")
def cost_confirmations(spark: SparkSession, folder: str) -> DataFrame:
    budget = F.when(F.col("event_id") % 5 != 0, F.lit(200).cast("long"))
    asked = asking.confirmation(F.col("event_id") % 300, F.floor("value"), budget)
    return table(spark, folder, "events").select("event_id", asked.alias("c")).select("event_id", "c.estimate", "c.remaining")


@query(
    "outline_levels",
    """WITH e AS (SELECT p_brand AS book_id, p_partkey AS id, CASE WHEN p_size < 3 AND p_partkey % 2 = 0 THEN 0 ELSE p_size % 6 + 1 END AS depth FROM part), t AS (SELECT book_id, min(depth) AS top FROM (SELECT book_id, depth FROM e GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1)
SELECT book_id, id, CAST(depth - top AS INTEGER) AS level FROM e JOIN t USING (book_id) WHERE depth BETWEEN top AND top + 2""",
)
def outline_levels(spark: SparkSession, folder: str) -> DataFrame:
    depth = F.when((F.col("p_size") < 3) & (F.col("p_partkey") % 2 == 0), 0).otherwise(F.col("p_size") % 6 + 1)
    return asking.outline_levels(table(spark, folder, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("id"), depth.alias("depth")))


@query(
    "chapter_sources",
    """WITH e AS (SELECT p_brand AS book_id, p_partkey AS id, ['OUTLINE', 'HEADINGS', 'HEURISTIC', 'LLM', 'BLOCKS'][CASE WHEN p_partkey % 40 = 0 THEN 1 WHEN p_size % 29 = 0 THEN 2 ELSE CAST(p_size % 3 AS INTEGER) + 3 END] AS source FROM part),
c AS (SELECT book_id, source, count(*) AS n, list_position(['OUTLINE', 'HEADINGS', 'HEURISTIC', 'LLM', 'BLOCKS'], source) AS rank FROM e GROUP BY ALL), b AS (SELECT book_id, arg_min(source, rank) AS source FROM c WHERE n >= 2 OR source <> 'LLM' GROUP BY 1)
SELECT book_id, CASE source WHEN 'HEADINGS' THEN 'HEURISTIC' ELSE source END AS kind, id FROM e JOIN b USING (book_id, source)""",
)
def chapter_sources(spark: SparkSession, folder: str) -> DataFrame:
    rank = F.when(F.col("p_partkey") % 40 == 0, 1).when(F.col("p_size") % 29 == 0, 2).otherwise(F.col("p_size") % 3 + 3)
    entries = table(spark, folder, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, asking.SOURCES)), rank.cast("int")).alias("source"))
    return asking.chosen_source(entries).select("book_id", "kind", "id")


@query(
    "index_upgrades",
    """WITH o AS (SELECT p_brand AS book_id, list_sort(list(DISTINCT p_size % 5)) AS starts FROM part GROUP BY 1), n AS (SELECT p_brand AS book_id, list_sort(list(DISTINCT CASE WHEN p_brand LIKE '%1' THEN p_size % 5 ELSE p_size % 7 END)) AS starts FROM part GROUP BY 1)
SELECT book_id, CASE WHEN o.starts = n.starts THEN 'SECTIONS' WHEN book_id NOT LIKE '%2' THEN 'REBUILD' ELSE 'INSERT' END AS way FROM o JOIN n USING (book_id)""",
)
def index_upgrades(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.col("p_brand").alias("book_id"), "p_size", F.lit(0).alias("level"))
    old = part.withColumn("start_page", F.col("p_size") % 5)
    new = part.withColumn("start_page", F.when(F.col("book_id").endswith("1"), F.col("p_size") % 5).otherwise(F.col("p_size") % 7))
    return asking.index_upgrade(old, new, part.where(F.col("book_id").endswith("2")))


@query(
    "chapter_answers",
    """SELECT p_partkey, unnest([CASE WHEN p_size > 12 THEN 3 ELSE p_size % 3 + 1 END, 12]) AS page, unnest(['A ' || p_name, 'Z']) AS title FROM part WHERE p_partkey % 7 <> 0""",
)
def chapter_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Out of order, one title blank, one page beyond the book, one page twice; every seventh tells one chapter only."""
    page = F.when(F.col("p_size") > 12, 3).otherwise(F.col("p_size") % 3 + 1).cast("string")
    first = F.concat(F.lit('{"title":" A '), "p_name", F.lit(' ","page":'), page, F.lit("}"))
    rest = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit('{"title":"Z","page":12},'), first, F.lit(',{"title":" ","page":5},{"title":"far","page":99},{"title":"again","page":12}'))).otherwise(first)
    told = asking.chapters_told(F.concat(F.lit("Claro: ["), rest, F.lit("] listo")), F.lit(20))
    return table(spark, folder, "part").select("p_partkey", F.explode(told).alias("c")).select("p_partkey", "c.page", "c.title")


@query("class_answers", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'LITERATURE' WHEN 1 THEN 'SCIENTIFIC' END AS kind FROM documents")
def class_answers(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id") % 4
    answer = F.when(n == 0, 'x {"tipo":" literature "}').when(n == 1, '{"tipo":"SCIENTIFIC"}').when(n == 2, '{"tipo":"POEM"}').otherwise("no")
    return table(spark, folder, "documents").select("doc_id", asking.document_type(answer).alias("kind"))


@query(
    "phrases_at",
    """WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(left(text, 400), ' +', ' ', 'g')), ' ') AS words FROM documents), s AS (SELECT doc_id, length(array_to_string(words[1:greatest(len(words) // 2, 1)], ' ')) AS at, len(words) AS n FROM t)
SELECT doc_id, CASE WHEN n < 2 THEN 0 ELSE n // 2 - 1 END AS phrase FROM s""",
)
def phrases_at(spark: SparkSession, folder: str) -> DataFrame:
    """Words as phrases: the one at the end of the first half of a text's start is the last of that half."""
    start = F.trim(F.regexp_replace(F.left("text", F.lit(400)), " +", " "))
    words = F.split(start, " ")
    half = F.length(F.array_join(F.slice(words, 1, F.greatest(F.floor(F.size(words) / 2).cast("int"), F.lit(1))), " "))
    told = table(spark, folder, "documents").select("doc_id", asking.phrase_starts(start, words).alias("starts"), half.alias("at"))
    return told.select("doc_id", asking.phrase_at(F.col("starts"), F.col("at") - 1).alias("phrase"))


@query(
    "chunks_spread",
    f"""WITH {library.CHUNKS_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ordinal) - 1 AS place, count(*) OVER (PARTITION BY book_id) AS n FROM lib_chunks c WHERE EXISTS (SELECT 1 FROM (VALUES (3, 12), (20, 90), (9, 5)) r(a, b) WHERE c.start_page >= a AND c.end_page <= b))
SELECT id FROM i WHERE n <= 16 OR place IN (SELECT CAST(floor(k * n / 16) AS BIGINT) FROM range(16) t(k))""",
)
def chunks_spread(spark: SparkSession, folder: str) -> DataFrame:
    ranges = library.books(spark, folder).select("book_id", F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((3, 12), (20, 90), (9, 5))])))
    return asking.spread(library.chunks(spark, folder), ranges, asking.CHAPTER_K).select("id")


@query("stale_indexes", "SELECT CAST(label AS VARCHAR) AS book_id, 'm' AS model FROM embeddings GROUP BY label HAVING count(*) <> 8 + label % 7 UNION ALL SELECT 'gone', 'm'")
def stale_indexes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("book_id"), F.lit("m").alias("model"))
    labels = table(spark, folder, "embeddings").select("label").distinct()
    counted = labels.select(F.col("label").cast("string").alias("book_id"), F.lit("m").alias("model"), (8 + F.col("label") % 7).alias("n"))
    gone = spark.createDataFrame([("gone", "m", 3)], "book_id string, model string, n int")
    return asking.stale(counted.unionByName(gone), vectors)
