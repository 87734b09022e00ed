"""People as a model tells them, chapter by chapter, put together with the people known so far.

An answer is one row (extraction_id, answer, first, last: the chapter's pages). Everything is done for all answers at
once: people, names, facts and relations are rows, and what is already known is found by joins on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import chat, graph
from lectern.operators.graph import name_key
from lectern.sources import library

# Limits of what is taken from an answer, and the kinds of names.
NAME_LENGTH, FACTS, FACT_LENGTH, LABEL_LENGTH = 80, 3, 300, 60
KNOWN, MAIN, WORD_LENGTH = 150, 20, 3
NAME_KINDS = ("NAME", "SURNAME", "NICKNAME", "TITLE")
BLOCK_CHARACTERS, OUTPUT_TOKENS = 80_000, 1500
PEOPLE = "array<struct<ref:string,names:array<struct<name:string,kind:string,page:int>>,renamedTo:struct<name:string,kind:string,page:int>,facts:array<struct<page:int,text:string>>>>"
TIES = "array<struct<from:string,to:string,type:string,label:string,page:int,ended:boolean>>"
SAME = "array<array<string>>"


def parsed(answer: Column) -> Column:
    """The extraction of an answer, lists empty where they are missing; null if nothing can be read."""
    body = chat.outer_json(answer)
    read = F.from_json(body, f"characters {PEOPLE}, relations {TIES}, same {SAME}, unread string", {"columnNameOfCorruptRecord": "unread"})
    whole = F.struct(*[F.coalesce(read[name], F.array().cast(kind)).alias(name) for name, kind in (("characters", PEOPLE), ("relations", TIES), ("same", SAME))])
    return F.when(body.isNotNull() & read["unread"].isNull(), whole)


def clamped(page: Column, first: Column, last: Column) -> Column:
    """A page within the chapter, else its last page."""
    return F.when(page.between(first, last), page).otherwise(last)


def told(extractions: DataFrame) -> DataFrame:
    """extraction_id, turn, ref, names, renamed, facts of every person told, with pages held within the chapter and names that are no names left out."""
    read = extractions.select("extraction_id", "first", "last", parsed(F.col("answer")).alias("x"))
    person = read.select("extraction_id", "first", "last", F.posexplode("x.characters").alias("turn", "c"))
    page = lambda n: clamped(F.coalesce(n["page"], F.lit(0)), F.col("first"), F.col("last")).alias("page")
    real = lambda n: (F.trim(F.coalesce(n["name"], F.lit(""))) != "") & (F.length(n["name"]) <= NAME_LENGTH)
    kind = lambda n: F.when(F.upper(F.trim(n["kind"])).isin(*NAME_KINDS), F.upper(F.trim(n["kind"]))).otherwise("NAME").alias("kind")
    names = F.transform(F.filter(F.coalesce("c.names", F.array().cast("array<struct<name:string,kind:string,page:int>>")), real), lambda n: F.struct(F.trim(n["name"]).alias("name"), kind(n), page(n)))
    renamed = F.when(F.col("c.renamedTo").isNotNull() & real(F.col("c.renamedTo")), F.struct(F.trim("c.renamedTo.name").alias("name"), page(F.col("c.renamedTo"))))
    full = F.filter(F.coalesce("c.facts", F.array().cast("array<struct<page:int,text:string>>")), lambda f: F.trim(F.coalesce(f["text"], F.lit(""))) != "")
    facts = F.transform(F.slice(full, 1, FACTS), lambda f: F.struct(page(f), F.left(F.trim(f["text"]), F.lit(FACT_LENGTH)).alias("text")))
    return person.select("extraction_id", "turn", F.trim(F.coalesce("c.ref", F.lit(""))).alias("ref"), names.alias("names"), renamed.alias("renamed"), facts.alias("facts"))


def known_id(ref: Column) -> Column:
    """The id in a reference to a known person (c12)."""
    return F.nullif(F.regexp_extract(F.trim(ref), "^c([0-9]{1,18})$", 1), F.lit("")).cast("long")


def resolved(people: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """people (ref, names: array of structs with name, the integer column order) with character_id and is_new.

    The person that the reference names, else the one that alone has one of the full names (a blank in it) told, else a new
    one, numbered after the known in the order given; nobody where no name is told either. names: character_id, name.
    """
    ids = names.select(F.col("character_id").alias("_known")).distinct()
    owners = names.groupBy(name_key(F.col("name")).alias("_key")).agg(F.countDistinct("character_id").alias("_n"), F.min("character_id").alias("_owner")).where("_n = 1").drop("_n")
    said = people.select(order, F.posexplode("names").alias("_place", "_name")).select(order, "_place", F.col("_name")["name"].alias("_name")).where(F.contains(F.trim("_name"), F.lit(" ")))
    by_name = said.withColumn("_key", name_key(F.col("_name"))).join(owners, "_key").groupBy(order).agg(F.min_by("_owner", "_place").alias("_owner"))
    asked = people.withColumn("_ref", known_id(F.col("ref")))
    found = asked.join(ids, asked["_ref"] == ids["_known"], "left").join(by_name, order, "left").withColumn("_found", F.coalesce("_known", "_owner"))
    last = ids.agg(F.coalesce(F.max("_known"), F.lit(0)).alias("_last"))
    fresh = found.where(F.col("_found").isNull() & (F.size("names") > 0)).select(order, F.lit(0).alias("_all"))
    numbers = library.numbered(fresh, "_all", order, "_place").crossJoin(F.broadcast(last)).select(order, (F.col("_last") + F.col("_place")).alias("_fresh"))  # one row
    joined = found.join(numbers, order, "left").withColumn("character_id", F.coalesce("_found", "_fresh")).withColumn("is_new", F.col("_fresh").isNotNull())
    return joined.select(*people.columns, "character_id", "is_new")


def names_added(names: DataFrame, new: DataFrame) -> DataFrame:
    """names (character_id, name, kind, first_page, primary_from) with those of new (and turn: their order) that the person does not have.

    A name that is there keeps its form; it becomes primary from the page first told, unless it was before.
    """
    keyed = names.withColumn("_key", name_key(F.col("name"))).withColumn("_old", F.lit(0)).withColumn("turn", F.lit(0).cast("long"))
    told_ = new.withColumn("_key", name_key(F.col("name"))).withColumn("_old", F.lit(1)).withColumn("turn", F.col("turn").cast("long"))
    both = keyed.unionByName(told_.select(*keyed.columns))
    first = lambda c: F.min_by(c, F.struct("_old", "turn", "name"))
    primary = F.min_by("primary_from", F.when(F.col("primary_from").isNotNull(), F.struct("_old", "turn", "name")))
    merged = both.groupBy("character_id", "_key").agg(*[first(c).alias(c) for c in ("name", "kind", "first_page")], primary.alias("primary_from"))
    return merged.select(*names.columns)


def facts_added(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts (character_id, page, text) and those of new (and turn) whose text, case, accents and spaces aside, the person does not have."""
    keyed = new.withColumn("_key", name_key(F.col("text")))
    first = keyed.groupBy("character_id", "_key").agg(F.min_by(F.struct("page", "text"), "turn").alias("f")).select("character_id", "_key", "f.page", "f.text")
    known = facts.select("character_id", name_key(F.col("text")).alias("_key")).distinct()
    return facts.unionByName(first.join(known, ["character_id", "_key"], "left_anti").select(*facts.columns))


def relations_added(relations: DataFrame, new: DataFrame) -> DataFrame:
    """relations (id, from_id, to_id, type, label, page, ended_at) after new (from_id, to_id, type, label, page, ended; turn: an integer order).

    Relations to oneself or to nobody go; unknown types are OTHER. Ends close the last open relation of the pair, of the same type first.
    What an open relation of the pair says already (type and label, case aside) is not said again.
    """
    kinds = list(graph.RELATION_GROUPS)
    kind = F.when(F.upper(F.trim("type")).isin(kinds), F.upper(F.trim("type"))).otherwise("OTHER")
    real = new.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id"))).withColumns({"type": kind, "label": F.left(F.trim("label"), F.lit(LABEL_LENGTH))})
    ended = real.where("ended").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type", F.col("page").alias("at"))
    closed = graph.end_relations(relations, ended)
    pair = [F.least("from_id", "to_id").alias("_a"), F.greatest("from_id", "to_id").alias("_b"), F.col("type").alias("_type"), F.lower("label").alias("_label")]
    said = closed.where("ended_at IS NULL").select(*pair).distinct()
    fresh = real.where("NOT ended").select("*", *pair).join(said, ["_a", "_b", "_type", "_label"], "left_anti")
    once = fresh.groupBy("_a", "_b", "_type", "_label").agg(F.min_by(F.struct("turn", "from_id", "to_id", "type", "label", "page"), "turn").alias("r")).select("r.*")
    last = relations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    placed = library.numbered(once.withColumn("_all", F.lit(0)), "_all", "turn", "_place").crossJoin(F.broadcast(last))  # one row
    return closed.unionByName(placed.withColumn("id", (F.col("_last") + F.col("_place")).cast("long")).withColumn("ended_at", F.lit(None).cast(closed.schema["ended_at"].dataType)).select(*closed.columns))


def words(text: Column) -> Column:
    """Distinct words of a text without case and accents."""
    return F.array_distinct(F.filter(F.split(library.fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def known_for(names: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_id, character_id of the known people that go with a block (block_id, text): those with a word of three letters or more of a name in it, and the MAIN with most names; the last KNOWN by id."""
    counts = names.groupBy("character_id").agg(F.count("*").alias("n"))
    main = counts.orderBy(F.desc("n"), "character_id").limit(MAIN).select("character_id")
    said = names.select("character_id", F.explode(words(F.col("name"))).alias("word")).where(F.length("word") >= WORD_LENGTH).distinct()
    held = blocks.select("block_id", F.explode(words(F.col("text"))).alias("word"))
    near = held.join(said, "word").select("block_id", "character_id")
    always = blocks.select("block_id", F.explode(F.array(*[F.lit(r.character_id) for r in main.collect()] or [F.lit(None).cast("long")])).alias("character_id")).where("character_id IS NOT NULL")  # at most MAIN
    both = near.unionByName(always).distinct()
    last = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("character_id")))
    return both.withColumn("_turn", last).where(F.col("_turn") <= KNOWN).drop("_turn")


def scan_cost(blocks: DataFrame, scanned: DataFrame, template_tokens: int, known_tokens: Column) -> DataFrame:
    """book_id, input_tokens, output_tokens over the blocks (book_id, chapter, characters) of chapters that are not scanned (book_id, chapter)."""
    left = blocks.join(scanned.select("book_id", "chapter"), ["book_id", "chapter"], "left_anti")
    each = F.lit(template_tokens) + F.floor(F.col("characters") / 4) + known_tokens
    return left.groupBy("book_id").agg(F.sum(each).cast("long").alias("input_tokens"), (F.count("*") * OUTPUT_TOKENS).alias("output_tokens"))


def page_limit(filtered: Column, most_read: Column) -> Column:
    """The page up to which people are told: the lesser of the reader's filter and the last page read."""
    return F.least(F.coalesce(filtered, most_read), most_read)


def sorted_by(people: DataFrame, mode: str) -> DataFrame:
    """people (id, first_page, mentions) by APPEARANCE or MENTIONS."""
    return people.orderBy(*([F.desc("mentions"), "first_page", "id"] if mode == "MENTIONS" else ["first_page", "id"]))
