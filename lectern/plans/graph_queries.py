"""Queries on the page-gated graph of people. Parts and suppliers stand in for people, shipping days for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import graph, relational
from lectern.plans.registry import query
from lectern.sources import library, scratch
from lectern.sources.tables import table

LIMIT = 1200

NAMES_SQL = f"""{library.GRAPH_SQL}, firsts AS (SELECT to_id AS character_id, min(page) AS page FROM graph GROUP BY to_id),
names AS (SELECT character_id, p_brand || ' ' || character_id AS name, 'NAME' AS kind, page AS first_page, NULL::INTEGER AS primary_from FROM firsts JOIN part ON p_partkey = character_id
UNION ALL SELECT character_id, p_type, 'ALIAS', page + 300, CASE WHEN character_id % 3 = 0 THEN page + 400 END FROM firsts JOIN part ON p_partkey = character_id),
visible AS (SELECT character_id, trim(lower(name)) AS key, arg_min(name, (first_page, name)) AS name, min(first_page) AS first_page, min(CASE WHEN primary_from <= 1200 THEN primary_from END) AS primary_from, max(CASE WHEN kind = 'NAME' THEN 1 ELSE 0 END) AS is_name
  FROM names WHERE first_page <= 1200 GROUP BY 1, 2),
named AS (SELECT character_id, arg_max(name, (coalesce(primary_from, -1), is_name, -first_page, name)) AS name, min(first_page) AS first_page FROM visible GROUP BY character_id)"""


def _names(spark: SparkSession, folder: str) -> DataFrame:
    firsts = library.graph(spark, folder).groupBy(F.col("to_id").alias("character_id")).agg(F.min("page").alias("page"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("character_id"), "p_brand", "p_type")
    both = firsts.join(parts, "character_id")
    name = F.struct(F.concat_ws(" ", "p_brand", F.col("character_id").cast("string")).alias("name"), F.lit("NAME").alias("kind"), F.col("page").alias("first_page"), F.lit(None).cast("int").alias("primary_from"))
    primary = F.when(F.col("character_id") % 3 == 0, F.col("page") + 400)
    alias = F.struct(F.col("p_type").alias("name"), F.lit("ALIAS").alias("kind"), (F.col("page") + 300).alias("first_page"), primary.alias("primary_from"))
    return both.select("character_id", F.inline(F.array(name, alias)))


@query("spoiler_snapshot", f"WITH {NAMES_SQL} SELECT character_id, name, first_page FROM named")
def spoiler_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    visible = graph.visible_names(_names(spark, folder), F.lit(LIMIT))
    no_counts = visible.select("character_id", "key", F.lit(0).alias("mentions"))
    return graph.current_names(visible, no_counts).select("character_id", "name", "first_page")


@query("unique_visible_names", f"WITH {NAMES_SQL} SELECT character_id, key FROM visible WHERE length(key) >= 2 AND key IN (SELECT key FROM visible GROUP BY key HAVING count(DISTINCT character_id) = 1)")
def unique_visible_names(spark: SparkSession, folder: str) -> DataFrame:
    return graph.unique_names(graph.visible_names(_names(spark, folder), F.lit(LIMIT))).select("character_id", "key")


@query(
    "visible_relations",
    f"""WITH {NAMES_SQL} SELECT id, from_id, to_id, page, CASE WHEN page + 100 <= 1200 AND status = 'F' THEN page + 100 END AS ended_at FROM graph
WHERE page <= 1200 AND from_id IN (SELECT character_id FROM visible) AND to_id IN (SELECT character_id FROM visible)""",
)
def visible_relations(spark: SparkSession, folder: str) -> DataFrame:
    edges = library.graph(spark, folder).withColumn("ended_at", F.when(F.col("status") == "F", F.col("page") + 100))
    visible = graph.visible_names(_names(spark, folder), F.lit(LIMIT))
    return graph.visible_relations(edges, visible, F.lit(LIMIT)).select("id", "from_id", "to_id", "page", "ended_at")


PAIR_SQL = f"""{library.GRAPH_SQL}, pairs AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, arg_min({{'id': id, 'type': type, 'page': page}}, (-page, id)) AS r FROM graph GROUP BY 1, 2),
latest AS (SELECT a, b, r.id AS id, r.type AS type, r.page AS page FROM pairs)"""


@query("latest_relation_per_pair", f"WITH {PAIR_SQL} SELECT a, b, id, type, page FROM latest")
def latest_relation_per_pair(spark: SparkSession, folder: str) -> DataFrame:
    return graph.latest_per_pair(library.graph(spark, folder))


@query(
    "hide_minor_nodes",
    f"""WITH {PAIR_SQL}, mentions AS (SELECT l_suppkey AS character_id, count(*) AS mentions FROM lineitem GROUP BY l_suppkey),
major AS (SELECT * FROM mentions WHERE mentions >= (SELECT greatest(3, floor(max(mentions) * 0.05)) FROM mentions) AND character_id IN (SELECT a FROM latest UNION SELECT b FROM latest))
SELECT character_id, mentions FROM major UNION ALL SELECT character_id, mentions FROM mentions WHERE NOT EXISTS (SELECT 1 FROM major)""",
)
def hide_minor_nodes(spark: SparkSession, folder: str) -> DataFrame:
    mentions = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("character_id")).agg(F.count("*").alias("mentions"))
    return graph.without_minor(mentions, graph.latest_per_pair(library.graph(spark, folder)))


@query(
    "entity_merge_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_partkey + 1 AS b FROM lineitem WHERE l_partkey % 30 <> 29),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, label) AS (SELECT a, a FROM s UNION SELECT s.b, r.label FROM r JOIN s ON s.a = r.node)
SELECT node, min(label) AS component FROM r GROUP BY node""",
)
def entity_merge_components(spark: SparkSession, folder: str) -> DataFrame:
    """People told to be the same as the next one, in runs of thirty."""
    same = table(spark, folder, "lineitem").where("l_partkey % 30 <> 29").select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + 1).alias("b"))
    return graph.components(same.distinct(), scratch.workspace(spark, "merge"))


@query("entity_rekey", f"WITH {library.GRAPH_SQL}, m AS (SELECT id, CASE WHEN from_id % 10 = 0 THEN from_id // 10 ELSE from_id END AS from_id, to_id FROM graph) SELECT id, from_id, to_id FROM m WHERE from_id <> to_id")
def entity_rekey(spark: SparkSession, folder: str) -> DataFrame:
    edges = library.graph(spark, folder).select("id", "from_id", "to_id")
    mapping = edges.where("from_id % 10 = 0").select(F.col("from_id").alias("old_id"), F.floor(F.col("from_id") / 10).alias("new_id")).distinct()
    return relational.rekey(edges, mapping, "from_id").where("from_id <> to_id").select("id", "from_id", "to_id")


@query("relation_groups", f"WITH {library.GRAPH_SQL} SELECT CASE type WHEN 'A' THEN 'FAMILY' WHEN 'N' THEN 'ENEMY' ELSE 'OTHER' END AS grp, count(*) AS n FROM graph GROUP BY 1")
def relation_groups(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("type") == "A", "FAMILY").when(F.col("type") == "N", "ENEMY").otherwise("UNKNOWN")
    return library.graph(spark, folder).groupBy(graph.group_of(kind).alias("grp")).agg(F.count("*").alias("n"))


@query("first_appearances", f"WITH {library.GRAPH_SQL} SELECT from_id AS character_id, CAST(row_number() OVER (ORDER BY min((page, to_id)), from_id) - 1 AS INTEGER) AS place FROM graph GROUP BY from_id")
def first_appearances(spark: SparkSession, folder: str) -> DataFrame:
    mentions = library.graph(spark, folder).select(F.col("from_id").alias("character_id"), F.col("page").alias("text_no"), F.struct("to_id", "from_id").alias("start"))
    return graph.first_appearances(mentions)
