"""People and relations gated by the page read so far: names, facts, mentions, merging, graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.components import connected_components
from lectern.sources import library

# Relation types and their groups.
RELATION_GROUPS = {"FAMILY": "FAMILY", "SPOUSE": "LOVE", "ROMANCE": "LOVE", "FRIEND": "FRIEND", "ENEMY": "ENEMY", "ACQUAINTANCE": "OTHER", "MET": "OTHER", "WORKS_WITH": "OTHER", "OTHER": "OTHER"}

APPEARANCE_TEXTS = 1024


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(library.fold(name)), r"\s+", " ")


def visible_names(names: DataFrame, limit: Column) -> DataFrame:
    """character_id, key, name (the earliest), first_page, primary_from (the earliest within the limit) of the names seen by the limit."""
    seen = names.where(F.col("first_page") <= limit)
    return seen.groupBy("character_id", name_key(F.col("name")).alias("key")).agg(
        F.min_by("name", F.struct("first_page", "name")).alias("name"), F.min("first_page").alias("first_page"),
        F.min(F.when(F.col("primary_from") <= limit, F.col("primary_from"))).alias("primary_from"), F.max((F.col("kind") == "NAME").cast("int")).alias("is_name"),
    )


def unique_names(visible: DataFrame) -> DataFrame:
    """Visible names of two characters or more that belong to one character only."""
    owners = visible.groupBy("key").agg(F.countDistinct("character_id").alias("owners"))
    return visible.where(F.length("key") >= 2).join(owners.where("owners = 1"), "key", "left_semi")


def current_names(visible: DataFrame, counts: DataFrame) -> DataFrame:
    """character_id, name: the last that became primary, else the most mentioned, real names before others, earlier before later."""
    counted = visible.join(counts, ["character_id", "key"], "left")
    rank = F.struct(
        F.coalesce("primary_from", F.lit(-1)).alias("primary_from"), F.coalesce("mentions", F.lit(0)).alias("mentions"), F.col("is_name"), (-F.col("first_page")).alias("early"), "name"
    )
    return counted.groupBy("character_id").agg(F.max_by("name", rank).alias("name"), F.min("first_page").alias("first_page"))


def visible_relations(relations: DataFrame, visible_ids: DataFrame, limit: Column) -> DataFrame:
    """Relations up to the limit between visible characters; an end beyond the limit is not told."""
    ids = visible_ids.select(F.col("character_id").alias("_id")).distinct()
    seen = relations.where(F.col("page") <= limit)
    for end in ("from_id", "to_id"):
        seen = seen.join(ids, seen[end] == ids["_id"], "left_semi")
    return seen.withColumn("ended_at", F.when(F.col("ended_at") <= limit, F.col("ended_at")))


def latest_per_pair(relations: DataFrame) -> DataFrame:
    """One relation per unordered pair: the one of the latest page, the least id on a tie."""
    pair = relations.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    best = F.min_by(F.struct("id", "type", "page"), F.struct((-F.col("page")).alias("late"), F.col("id")))
    return pair.agg(best.alias("r")).select("a", "b", "r.id", "r.type", "r.page")


def without_minor(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """character_id, mentions of those mentioned at least max(3, 5 % of the most) times and linked; all if that leaves none."""
    linked = edges.select(F.col("a").alias("character_id")).union(edges.select(F.col("b"))).distinct()
    most = mentions.agg(F.greatest(F.lit(3), F.floor(F.max("mentions") * 0.05)).alias("least"))
    major = mentions.crossJoin(F.broadcast(most)).where("mentions >= least").join(linked, "character_id", "left_semi").select("character_id", "mentions")  # one row
    none = major.agg(F.count("*").alias("n"))
    return major.unionByName(mentions.crossJoin(F.broadcast(none)).where("n = 0").select("character_id", "mentions"))


def components(pairs: DataFrame, path: str) -> DataFrame:
    """node, component (least node) of pairs of people that are one; path: a new folder in the shared folder."""
    return connected_components(pairs.toDF("a", "b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), path)


def group_of(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RELATION_GROUPS.items() for x in pair])[kind], F.lit("OTHER"))


def end_relations(open_relations: DataFrame, endings: DataFrame) -> DataFrame:
    """The last open relation between a pair that an ending (a, b, type, at) closes: one of its type before others, then later page, then id."""
    pair = [F.least("from_id", "to_id").alias("_a"), F.greatest("from_id", "to_id").alias("_b")]
    told = endings.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), F.col("type").alias("_type"), F.col("at").alias("_at")).distinct()
    still = open_relations.where("ended_at IS NULL").select(*pair, F.col("type").alias("_type"), "page", "id")
    # The last of each pair and type, then those of each pair: endings meet one row a pair and one a pair and type, not the pair's relations.
    lasts = still.groupBy("_a", "_b", "_type").agg(F.max(F.struct("page", "id")).alias("_last"))
    any_type = lasts.groupBy("_a", "_b").agg(F.max("_last").alias("_of_any"), F.max(F.when(F.col("_type").isNotNull(), F.col("_last"))).alias("_of_typed"))
    met = told.join(any_type, ["_a", "_b"]).join(lasts.withColumnRenamed("_last", "_same"), ["_a", "_b", "_type"], "left")
    best = F.when(F.col("_type").isNull(), F.col("_of_any")).otherwise(F.coalesce("_same", "_of_typed", "_of_any"))
    closed = met.select(best["id"].alias("_id"), "_at")
    ends = closed.groupBy("_id").agg(F.min("_at").alias("_end"))
    return open_relations.join(ends, open_relations["id"] == ends["_id"], "left").withColumn("ended_at", F.coalesce("ended_at", "_end")).drop("_id", "_end")


def first_appearances(mentions: DataFrame) -> DataFrame:
    """character_id in the order of its first mention (place from 0); mentions: character_id, text_no, start.

    Characters are numbered within blocks of APPEARANCE_TEXTS texts, shifted by the counts of the blocks before.
    """
    first = mentions.groupBy("character_id").agg(F.min(F.struct("text_no", "start")).alias("first"))
    blocked = first.withColumn("_block", F.floor(F.col("first.text_no") / APPEARANCE_TEXTS))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    shifts = blocked.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", before)  # a row per block
    within = F.row_number().over(Window.partitionBy("_block").orderBy("first", "character_id"))
    placed = blocked.withColumn("_within", within).join(shifts, "_block")
    return placed.select("character_id", (F.col("_before") + F.col("_within") - 1).cast("int").alias("place"))
