"""Queries on people told by answers. Parts and orders stand in for what a model tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import characters, reading_order
from lectern.plans.registry import query
from lectern.sources import library, scratch
from lectern.sources.tables import table

ANSWER_SQL = """concat('text {"characters":[{"ref":" c', CAST(p_partkey % 60 AS VARCHAR(20)), '","names":[{"name":" ', p_name, ' ","kind":"', CASE WHEN p_size % 3 = 0 THEN 'nickname' ELSE 'odd' END, '","page":', CAST(p_size AS VARCHAR(20)),
'},{"name":" "}],"facts":[{"page":', CAST(p_size * 2 AS VARCHAR(20)), ',"text":" ', p_type, ' "},{"text":""}]}],"same":[["c1","c2"]]', CASE WHEN p_partkey % 10 = 3 THEN ', broken' ELSE '} end' END)"""
KNOWN_SQL = "known AS (SELECT p_partkey % 40 AS character_id, concat(p_name, CASE WHEN p_partkey % 40 < 20 THEN concat(' ', CAST(p_partkey % 40 AS VARCHAR(20))) ELSE '' END) AS name, p_size AS first_page FROM part WHERE p_partkey % 3 = 0)"


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("p_partkey") % 40
    name = F.concat("p_name", F.when(number < 20, F.concat(F.lit(" "), number.cast("string"))).otherwise(F.lit("")))
    return _parts(spark, folder).where("p_partkey % 3 = 0").select(number.alias("character_id"), name.alias("name"), F.col("p_size").alias("first_page"))


@query(
    "extraction_parsed",
    f"""WITH a AS (SELECT p_partkey, p_name, p_type, p_size, {ANSWER_SQL} AS answer FROM part) SELECT p_partkey AS extraction_id, 'c' || p_partkey % 60 AS ref, p_name AS name,
CASE WHEN p_size % 3 = 0 THEN 'NICKNAME' ELSE 'NAME' END AS kind, CASE WHEN p_size BETWEEN 10 AND 30 THEN p_size ELSE 30 END AS page, CASE WHEN p_size * 2 BETWEEN 10 AND 30 THEN p_size * 2 ELSE 30 END AS fact_page, p_type AS fact FROM a WHERE p_partkey % 10 <> 3""",
)
def extraction_parsed(spark: SparkSession, folder: str) -> DataFrame:
    answers = _parts(spark, folder).select(F.col("p_partkey").alias("extraction_id"), F.expr(ANSWER_SQL).alias("answer"), F.lit(10).alias("first"), F.lit(30).alias("last"))
    people = characters.told(answers).select("extraction_id", "ref", F.explode("names").alias("n"), "facts")
    return people.select("extraction_id", "ref", "n.name", "n.kind", "n.page", F.col("facts")[0]["page"].alias("fact_page"), F.col("facts")[0]["text"].alias("fact"))


@query(
    "entity_resolution",
    f"""WITH {KNOWN_SQL}, ids AS (SELECT DISTINCT character_id FROM known), owners AS (SELECT lower(name) AS key, min(character_id) AS owner FROM known GROUP BY 1 HAVING count(DISTINCT character_id) = 1),
p AS (SELECT p_partkey AS turn, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 60 END AS ref_id, p_type AS one, p_name || ' ' || p_partkey % 30 AS two FROM part),
f AS (SELECT turn, coalesce(i.character_id, owner) AS found FROM p LEFT JOIN ids i ON i.character_id = ref_id LEFT JOIN owners ON key = lower(two)),
n AS (SELECT turn, (SELECT max(character_id) FROM ids) + row_number() OVER (ORDER BY turn) AS fresh FROM f WHERE found IS NULL)
SELECT turn, coalesce(found, fresh) AS character_id, fresh IS NOT NULL AS is_new FROM f LEFT JOIN n USING (turn)""",
)
def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    ref = F.when(key % 5 == 0, F.concat(F.lit("c"), (key % 60).cast("string"))).otherwise(F.concat(F.lit("n"), key.cast("string")))
    names = F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.concat_ws(" ", "p_name", (key % 30).cast("string")).alias("name")))
    people = _parts(spark, folder).select(key.alias("turn"), ref.alias("ref"), names.alias("names"))
    return characters.resolved(people, _known(spark, folder), "turn").select("turn", "character_id", "is_new")


TELLING_SQL = """telling AS (SELECT p_partkey % 25 AS book_id, p_partkey AS turn, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 60 END AS ref_id,
  p_type || ' ' || p_size % 6 AS one, p_type || ' von ' || p_size % 11 AS two, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_partkey) AS k FROM part),
before AS (SELECT DISTINCT book_id, turn % 40 + 1 AS id, lower(one) AS key FROM telling WHERE turn % 9 = 0),
start AS (SELECT b.book_id, coalesce(list({'key': key, 'id': id}) FILTER (WHERE id IS NOT NULL), []) AS held, coalesce(max(id), 0) AS last FROM (SELECT DISTINCT book_id FROM telling) b LEFT JOIN before USING (book_id) GROUP BY b.book_id)"""
_OWNER = "(CASE WHEN len(list_distinct(list_transform(list_filter(held, lambda h: h.key = lower({0})), lambda h: h.id))) = 1 THEN list_filter(held, lambda h: h.key = lower({0}))[1].id END)"


@query(
    "entity_resolution_in_order",
    f"""WITH RECURSIVE {TELLING_SQL}, fold AS (SELECT book_id, CAST(0 AS BIGINT) AS k, held, last, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS who FROM start
UNION ALL SELECT book_id, k, list_concat(held, [{{'key': lower(one), 'id': who}}, {{'key': lower(two), 'id': who}}]), greatest(last, who), turn, who
  FROM (SELECT f.book_id, t.k, held, last, t.turn, one, two, coalesce(CASE WHEN list_contains(list_transform(held, lambda h: h.id), ref_id) THEN ref_id END, {_OWNER.format("one")}, {_OWNER.format("two")}, last + 1) AS who
    FROM fold f JOIN telling t ON t.book_id = f.book_id AND t.k = f.k + 1))
SELECT book_id, turn, who AS character_id, coalesce(who > lag(last) OVER (PARTITION BY book_id ORDER BY k), FALSE) AS is_new FROM fold QUALIFY k > 0""",
)
def entity_resolution_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as people told one after the other in 25 books: a reference now and then, two names each that others have as well."""
    key = F.col("p_partkey")
    told = _parts(spark, folder).select((key % 25).alias("book_id"), key.alias("turn"), F.concat_ws(" ", "p_type", (F.col("p_size") % 6).cast("string")).alias("one"), F.concat_ws(" von ", "p_type", (F.col("p_size") % 11).cast("string")).alias("two"))
    ref = F.when(F.col("turn") % 7 == 0, F.concat(F.lit("c"), (F.col("turn") % 60).cast("string"))).otherwise(F.lit("n1"))
    people = told.select("book_id", "turn", ref.alias("ref"), F.array(F.struct(F.col("one").alias("name")), F.struct(F.col("two").alias("name"))).alias("names"))
    before = told.where("turn % 9 = 0").select("book_id", (F.col("turn") % 40 + 1).alias("character_id"), F.col("one").alias("name"))
    return reading_order.resolved(people, before, "turn", scratch.workspace(spark, "telling")).select("book_id", "turn", "character_id", "is_new")


@query(
    "names_added",
    f"""WITH {KNOWN_SQL}, old AS (SELECT character_id, min(name) AS name, lower(name) AS key FROM known GROUP BY character_id, lower(name)),
new AS (SELECT p_partkey AS turn, p_partkey % 40 AS character_id, upper(p_name) AS name, lower(p_name) AS key, p_size AS page, CASE WHEN p_size % 9 = 0 THEN p_size END AS primary_from FROM part),
one AS (SELECT character_id, key, arg_min(name, turn) AS name, arg_min(primary_from, turn) FILTER (primary_from IS NOT NULL) AS primary_from FROM new GROUP BY ALL)
SELECT coalesce(o.character_id, n.character_id) AS character_id, coalesce(o.name, n.name) AS name, n.primary_from FROM old o FULL JOIN one n ON o.character_id = n.character_id AND o.key = n.key""",
)
def names_added(spark: SparkSession, folder: str) -> DataFrame:
    old = _known(spark, folder).groupBy("character_id", F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("character_id", "name", F.lit("NAME").alias("kind"), F.lit(1).alias("first_page"), F.lit(None).cast("int").alias("primary_from"))
    primary = F.when(F.col("p_size") % 9 == 0, F.col("p_size"))
    new = _parts(spark, folder).select((F.col("p_partkey") % 40).alias("character_id"), F.upper("p_name").alias("name"), F.lit("NAME").alias("kind"), F.col("p_size").alias("first_page"), primary.alias("primary_from"), F.col("p_partkey").alias("turn"))
    return characters.names_added(old, new).select("character_id", "name", "primary_from")


@query(
    "facts_added",
    """WITH old AS (SELECT p_partkey % 40 AS character_id, p_size AS page, p_type AS text FROM part WHERE p_partkey % 4 = 0),
new AS (SELECT p_partkey AS turn, p_partkey % 40 AS character_id, p_size AS page, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_name END AS text FROM part WHERE p_partkey % 4 <> 0),
one AS (SELECT character_id, arg_min(page, turn) AS page, arg_min(text, turn) AS text FROM new GROUP BY character_id, lower(text))
SELECT character_id, page, text FROM old UNION ALL SELECT character_id, page, text FROM one n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.character_id = n.character_id AND lower(o.text) = lower(n.text))""",
)
def facts_added(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    old = _parts(spark, folder).where("p_partkey % 4 = 0").select((key % 40).alias("character_id"), F.col("p_size").alias("page"), F.col("p_type").alias("text"))
    said = F.when(key % 2 == 0, F.lower("p_type")).otherwise(F.col("p_name"))
    new = _parts(spark, folder).where("p_partkey % 4 <> 0").select((key % 40).alias("character_id"), F.col("p_size").alias("page"), said.alias("text"), key.alias("turn"))
    return characters.facts_added(old, new)


@query(
    "relations_added",
    """WITH old AS (SELECT p_partkey AS id, p_partkey % 20 AS from_id, p_partkey % 23 AS to_id, CASE p_size % 3 WHEN 0 THEN 'FRIEND' WHEN 1 THEN 'ENEMY' ELSE 'OTHER' END AS type, p_name AS label, p_size AS page FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 20 <> p_partkey % 23),
raw AS (SELECT p_partkey AS turn, p_partkey % 23 AS from_id, p_partkey % 21 AS to_id, CASE p_size % 4 WHEN 0 THEN 'FRIEND' WHEN 1 THEN 'ENEMY' ELSE 'OTHER' END AS type, upper(p_name) AS label, p_size AS page, p_partkey % 50 = 1 AS ended FROM part WHERE p_partkey % 2 = 1),
new AS (SELECT * FROM raw WHERE from_id <> to_id), e AS (SELECT * FROM new WHERE ended),
c AS (SELECT e.turn, arg_max(o.id, (CASE WHEN o.type = e.type THEN 1 ELSE 0 END, o.page, o.id)) AS id, any_value(e.page) AS stop FROM e JOIN old o ON least(o.from_id, o.to_id) = least(e.from_id, e.to_id) AND greatest(o.from_id, o.to_id) = greatest(e.from_id, e.to_id) GROUP BY e.turn, e.type),
x AS (SELECT id, min(stop) AS stop FROM c GROUP BY id), closed AS (SELECT old.*, x.stop AS ended_at FROM old LEFT JOIN x USING (id)),
f AS (SELECT * FROM new n WHERE NOT ended AND NOT EXISTS (SELECT 1 FROM closed o WHERE ended_at IS NULL AND least(o.from_id, o.to_id) = least(n.from_id, n.to_id) AND greatest(o.from_id, o.to_id) = greatest(n.from_id, n.to_id) AND o.type = n.type AND lower(o.label) = lower(n.label))),
g AS (SELECT min(turn) AS turn FROM f GROUP BY least(from_id, to_id), greatest(from_id, to_id), type, lower(label)),
i AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY turn) AS id, from_id, to_id, type, label, page, NULL::INTEGER AS ended_at FROM g JOIN f USING (turn))
SELECT * FROM closed UNION ALL SELECT * FROM i""",
)
def relations_added(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = lambda m, wrong: F.when(size % m == 0, "FRIEND").when(size % m == 1, " enemy" if wrong else "ENEMY").otherwise("what" if wrong else "OTHER")
    old = _parts(spark, folder).where("p_partkey % 2 = 0 AND p_partkey % 20 <> p_partkey % 23").select(key.alias("id"), (key % 20).alias("from_id"), (key % 23).alias("to_id"), kind(3, False).alias("type"), F.col("p_name").alias("label"), size.alias("page"), F.lit(None).cast("int").alias("ended_at"))
    new = _parts(spark, folder).where("p_partkey % 2 = 1").select(key.alias("turn"), (key % 23).alias("from_id"), (key % 21).alias("to_id"), kind(4, True).alias("type"), F.concat(F.lit(" "), F.upper("p_name")).alias("label"), size.alias("page"), (key % 50 == 1).alias("ended"))
    return characters.relations_added(old, new)


@query(
    "known_characters",
    f"""WITH {KNOWN_SQL}, main AS (SELECT character_id FROM known GROUP BY character_id ORDER BY count(*) DESC, character_id LIMIT 20),
b AS (SELECT s_suppkey AS block_id, CASE s_suppkey % 3 WHEN 0 THEN 'A Small ring' WHEN 1 THEN 'of the Blue-bolt' ELSE 'nobody' END AS text FROM supplier),
w AS (SELECT DISTINCT character_id, unnest(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM known), h AS (SELECT block_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM b),
u AS (SELECT block_id, character_id FROM h JOIN w USING (word) WHERE length(word) >= 3 UNION SELECT block_id, character_id FROM b, main)
SELECT block_id, character_id FROM u QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY character_id DESC) <= 150""",
)
def known_characters(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("s_suppkey")
    text = F.when(number % 3 == 0, "A Small ring").when(number % 3 == 1, "of the Blue-bolt").otherwise("nobody")
    return characters.known_for(_known(spark, folder), table(spark, folder, "supplier").select(number.alias("block_id"), text.alias("text")))


@query(
    "character_scan_cost",
    f"""WITH {library.PAGES_SQL}, c AS (SELECT book_id, (page - 1) // 20 + 1 AS chapter, sum(length(text)) AS characters FROM lib_pages GROUP BY ALL)
SELECT book_id, CAST(sum(900 + characters // 4 + 40) AS BIGINT) AS input_tokens, count(*) * 1500 AS output_tokens FROM c WHERE chapter % 3 <> 0 GROUP BY book_id""",
)
def character_scan_cost(spark: SparkSession, folder: str) -> DataFrame:
    chapter = F.floor((F.col("page") - 1) / library.PAGES_PER_CHAPTER) + 1
    blocks = library.pages(spark, folder, "text").groupBy("book_id", chapter.alias("chapter")).agg(F.sum(F.length("text")).alias("characters"))
    return characters.scan_cost(blocks, blocks.where("chapter % 3 = 0"), 900, F.lit(40))


@query(
    "characters_in_limit",
    f"WITH {KNOWN_SQL}, s AS (SELECT character_id AS id, min(first_page) AS first_page, count(*) AS mentions FROM known GROUP BY 1) SELECT id, first_page, mentions, row_number() OVER (ORDER BY mentions DESC, first_page, id) AS place FROM s WHERE first_page <= least(4, 9)",
)
def characters_in_limit(spark: SparkSession, folder: str) -> DataFrame:
    people = _known(spark, folder).groupBy(F.col("character_id").alias("id")).agg(F.min("first_page").alias("first_page"), F.count("*").alias("mentions"))
    seen = characters.sorted_by(people.where(F.col("first_page") <= characters.page_limit(F.lit(4), F.lit(9))), "MENTIONS").limit(1000)
    order = Window.orderBy(F.desc("mentions"), "first_page", "id")  # one list of people on one screen
    return seen.withColumn("place", F.row_number().over(order))
