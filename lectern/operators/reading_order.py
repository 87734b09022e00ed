"""Who is who, in reading order: each person told sees all persons told before, and what they were taken for.

The person that a reference names, else the one that alone owned one of the full names told (a blank in it) when the person was told, else somebody
new, numbered after the known in the order of telling; nobody where no name is told. All names told, a new one included, then belong to that person.

What a person is taken for depends on earlier persons only, so there is one assignment that agrees with the rule everywhere, and rounds that apply
the rule to all persons at once, with the assignment of the round before, reach it from any start: each round settles at least the next person that
was still wrong, and mostly all. Rounds go on until nothing changes. They start from the guess that persons who share a full name are one. A round
is joins and sums: of a name only its first two owners and since when they are owners count, so a name that a third of all rows tell is summed
where it lies.

Books are gone through in stretches, the first short, each many times longer. A name that had two owners before a stretch tells nobody in it, so persons who
tell only such names (and refer to nobody yet to come) are settled at once; rounds are for the others. What is settled does not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.characters import known_id
from lectern.operators.graph import name_key
from lectern.sources import library
from lectern.sources.scratch import removed, settled

BEFORE = -1  # the time of what was known before
FIRST, GROWTH = 1024, 32  # persons of a book that are settled first, and how much further each time


def _said(people: DataFrame, book: str, order: str) -> DataFrame:
    """book, at, place, key, full: every name of every person told."""
    named = people.select(F.col(book).alias("book"), F.col(order).cast("long").alias("at"), F.posexplode("names").alias("place", "n")).select("book", "at", "place", F.trim("n.name").alias("name"))
    return named.where("name <> ''").select("book", "at", "place", name_key(F.col("name")).alias("key"), F.contains("name", F.lit(" ")).alias("full"))


def _label(known: Column) -> Column:
    """A label of a known person; those of persons first told at a time are odd."""
    return known.cast("long") * 2


def _owners(held: DataFrame) -> DataFrame:
    """book, key, owner, since, upto: the first owner of each key and when another one came (null: never). held: book, key, at, label."""
    first = held.groupBy("book", "key", "label").agg(F.min("at").alias("at"))
    turn = F.row_number().over(Window.partitionBy("book", "key").orderBy("at", "label"))
    two = first.withColumn("turn", turn).where(F.col("turn") <= 2)
    return two.groupBy("book", "key").agg(F.min_by("label", "turn").alias("owner"), F.min("at").alias("since"), F.max(F.when(F.col("turn") == 2, F.col("at"))).alias("upto"))


def _held(said: DataFrame, labels: DataFrame) -> DataFrame:
    """book, key, at, label of the names that labelled persons told."""
    return said.join(labels.where("label IS NOT NULL"), ["book", "at"]).select("book", "key", "at", "label").distinct()


def _creators(labels: DataFrame) -> DataFrame:
    """book, at, nth of the persons who were new, numbered from 1 in a book."""
    return library.numbered(labels.where("label = at * 2 + 1").select("book", "at"), "book", "at", "nth").withColumn("nth", F.col("nth").cast("long"))


def _by_number(told: DataFrame, labels: DataFrame) -> DataFrame:
    """told with by_number: the label of the new person that a reference numbers, if told before."""
    numbered = _creators(labels).select("book", "nth", F.col("at").alias("_since"))
    some = told.where("nth IS NOT NULL").join(numbered, ["book", "nth"]).where("_since < at").select("book", "at", (F.col("_since") * 2 + 1).alias("by_number"))
    return told.join(some, ["book", "at"], "left")


def _stretch(said: DataFrame, told: DataFrame, held: DataFrame, settled_labels: DataFrame, path: str) -> DataFrame:
    """book, at, label of the persons told in one stretch; held and settled_labels: what is settled before it."""
    spark = said.sparkSession
    own = F.col("at") * 2 + 1
    owners = settled(_owners(held), f"{path}/owners")
    names = said.join(told.select("book", "at"), ["book", "at"], "left_semi")
    undecided = names.join(owners.where("upto IS NOT NULL").select("book", "key"), ["book", "key"], "left_anti").select("book", "at")
    counts = _creators(settled_labels).groupBy("book").agg(F.max("nth").alias("_count"))
    later = told.join(counts, "book", "left").where(F.col("nth") > F.coalesce("_count", F.lit(0))).select("book", "at")
    waiting = settled(undecided.unionByName(later).distinct(), f"{path}/waiting")
    sure = _by_number(told.join(waiting, ["book", "at"], "left_anti"), settled_labels)
    fixed = settled(sure.select("book", "at", F.coalesce("sure", "by_number", F.when(F.col("named"), own)).alias("label")), f"{path}/fixed")
    if waiting.isEmpty():
        return fixed
    told = settled(told.join(waiting, ["book", "at"], "left_semi"), f"{path}/told")
    names = settled(names.join(waiting, ["book", "at"], "left_semi"), f"{path}/names")
    held = settled(held.join(names.select("book", "key").distinct(), ["book", "key"], "left_semi"), f"{path}/held")
    full, numbers = names.where("full"), not told.where("nth IS NOT NULL").isEmpty()
    known = settled_labels.unionByName(fixed)

    def looked_up(owners: DataFrame, labels: DataFrame | None) -> DataFrame:
        """book, at, label by the rule, from who owned what."""
        real = (F.col("since") < F.col("at")) & (F.col("upto").isNull() | (F.col("upto") >= F.col("at")))
        by_name = full.join(owners, ["book", "key"]).where(real).groupBy("book", "at").agg(F.min_by("owner", "place").alias("by_name"))
        found = told.join(by_name, ["book", "at"], "left")
        if labels is None or not numbers:
            found = found.withColumn("by_number", F.lit(None).cast("long"))
        else:
            found = _by_number(found, known.unionByName(labels))
        label = F.coalesce("sure", "by_number", "by_name", F.when(F.col("named"), own))
        return found.select("book", "at", label.alias("label"))

    everyone = held.unionByName(names.select("book", "key", "at", own.alias("label")))
    alone = _owners(held).where("upto IS NULL").unionByName(_owners(everyone).join(held.select("book", "key").distinct(), ["book", "key"], "left_anti")).withColumn("upto", F.lit(None).cast("long"))
    labels = settled(looked_up(alone, None), f"{path}/round-0")
    number = 0
    while True:
        fresh = settled(looked_up(_owners(held.unionByName(_held(names, labels))), labels), f"{path}/round-{number + 1}")
        changed = not fresh.join(labels.withColumnRenamed("label", "was"), ["book", "at"]).where(~F.col("label").eqNullSafe(F.col("was"))).isEmpty()
        if number:
            removed(spark, f"{path}/round-{number}")
        labels, number = fresh, number + 1
        if not changed:
            return fixed.unionByName(labels)


def resolved(people: DataFrame, names: DataFrame, order: str, path: str, book: str = "book_id") -> DataFrame:
    """people (book, ref, names: array of structs with name, the integer column order from 0 on, unique in a book) with character_id and is_new.

    names: book, character_id, name of the people known before. path: a new folder in the shared folder.
    """
    spark = people.sparkSession
    said = settled(_said(people, book, order), f"{path}/said")
    known = names.select(F.col(book).alias("book"), F.col("character_id").cast("long").alias("id"), name_key(F.trim("name")).alias("key")).distinct()
    ids = known.select("book", "id").distinct()
    last = ids.groupBy("book").agg(F.max("id").alias("last"))
    before = known.select("book", "key", F.lit(BEFORE).cast("long").alias("at"), _label(F.col("id")).alias("label"))
    asked = people.select(F.col(book).alias("book"), F.col(order).cast("long").alias("at"), known_id(F.col("ref")).alias("ref_id")).join(said.select("book", "at").distinct().withColumn("named", F.lit(True)), ["book", "at"], "left")
    sure = asked.join(ids.select("book", F.col("id").alias("ref_id"), F.lit(True).alias("there")), ["book", "ref_id"], "left").join(last, "book", "left")
    refers = F.col("ref_id") - F.coalesce("last", F.lit(0).cast("long"))
    told = sure.select("book", "at", F.coalesce("named", F.lit(False)).alias("named"), F.when(F.col("there"), _label(F.col("ref_id"))).alias("sure"), F.when(refers > 0, refers).alias("nth"))
    told = settled(library.numbered(told, "book", "at", "rank"), f"{path}/told")
    most, low, high, number = told.agg(F.max("rank")).first()[0] or 0, 0, FIRST, 0
    labels = told.where("rank < 0").select("book", "at", F.lit(None).cast("long").alias("label"))
    while low < most:
        some, part = told.where(F.col("rank").between(low + 1, high)), f"{path}/stretch-{number}"
        held = before.unionByName(_held(said, labels)) if low else before
        labels = settled(labels.unionByName(_stretch(said, some, held, labels, part)), f"{path}/labels-{number}")
        if number:
            removed(spark, f"{path}/labels-{number - 1}")
        low, high, number = high, high * GROWTH, number + 1
    creators = _creators(labels).select("book", (F.col("at") * 2 + 1).alias("label"), "nth")
    taken = labels.join(creators, ["book", "label"], "left").join(last, "book", "left")
    fresh_id = F.coalesce("last", F.lit(0).cast("long")) + F.col("nth")
    who = taken.select("book", F.col("at").alias("_at"), F.when(F.col("label") % 2 == 0, (F.col("label") / 2).cast("long")).otherwise(fresh_id).alias("character_id"), F.coalesce(F.col("label") == F.col("at") * 2 + 1, F.lit(False)).alias("is_new"))
    return people.join(who, (people[book] == who["book"]) & (people[order] == who["_at"])).select(*[people[c] for c in people.columns], "character_id", "is_new")
