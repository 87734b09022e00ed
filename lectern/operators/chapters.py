"""References to chapters and places in books, looked up on the chapter table.

Each chapter knows what stands around it (windows over a book's chapters). A page finds its chapter in a join on the book and a bucket of pages, a
reference finds its chapter in a join on the book and what it says, so a book's outline is never put beside each question.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.functions import location as places
from lectern.operators import location
from lectern.sources import library

AROUND_EVENT = 2
BUCKET = 32  # pages that share a join key
RANGE = "struct<first:int,last:int>"
#: A reference: current, previous, next, last, number or titled:word; the number; the part.
REFERENCE = "struct<kind:string,number:int,part:int>"


@pandas_udf(T.StructType().add("part", T.IntegerType()).add("titled", T.IntegerType()))
def _numbers(title: pd.Series) -> pd.DataFrame:
    distinct = {t: (places.part_number(t or ""), places.chapter_number(t or "")) for t in title.unique()}
    return pd.DataFrame([distinct[t] for t in title], columns=["part", "titled"]).astype("Int32")


def told(chapters: DataFrame) -> DataFrame:
    """chapters with idx (from 0), part (the number of a part's heading), titled (the number a title says), heading, bare, and under: the idx of the last heading so far."""
    order = Window.partitionBy("book_id").orderBy("start_page", "number")
    opens = F.col("title").rlike(r"(?i)^\s*(parte|libro|part|book)\b")
    read = chapters.withColumn("_said", _numbers("title")).withColumns({"part": F.col("_said.part"), "titled": F.col("_said.titled"), "idx": F.row_number().over(order) - 1}).drop("_said")
    marked = read.withColumns({"heading": opens | F.col("part").isNotNull(), "bare": F.col("title").rlike(r"(?i)^\s*(parte|libro|part|book)\s+\S+\s*$")})
    return marked.withColumn("under", F.last(F.when(F.col("heading"), F.col("idx")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


CHAPTER = ("idx", "number", "title", "start_page", "end_page", "under")


def places_of(chapters: DataFrame) -> DataFrame:
    """told with chapter (a struct of CHAPTER), previous and next (the idx of the chapter before and after that is no bare heading), until (the page at which the next one starts; null in the last),

    following (where the next heading starts), under_title, before_title, before_start, before_end, before_under_title (of the chapter that previous tells), near_first and near_last (pages from AROUND_EVENT chapters before to as many after).
    """
    order, back = Window.partitionBy("book_id").orderBy("idx"), Window.partitionBy("book_id").orderBy(F.desc("idx"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)  # never unbounded to the end: that reads the rest of a book for each row
    proper = lambda value: F.when(~F.col("bare"), value)
    headed = told(chapters).withColumn("under_title", F.last(F.when(F.col("heading"), F.col("title")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last_proper = F.last(proper(F.struct("idx", "title", "start_page", "end_page", "under_title")), ignorenulls=True).over(before)
    return headed.withColumns({
        "chapter": F.struct(*CHAPTER), "_before": last_proper, "next": F.last(proper(F.col("idx")), ignorenulls=True).over(after), "until": F.lead("start_page").over(order),
        "following": F.last(F.when(F.col("heading"), F.col("start_page")), ignorenulls=True).over(after),
        "near_first": F.first("start_page").over(order.rowsBetween(-AROUND_EVENT, 0)), "near_last": F.last("end_page").over(order.rowsBetween(0, AROUND_EVENT)),
    }).withColumns({"previous": F.col("_before.idx"), **{f"before_{c}": F.col("_before")[c] for c in ("title", "start_page", "end_page", "under_title")}}).drop("_before")


def _buckets(a: Column, b: Column) -> Column:
    return F.sequence(F.floor(F.least(a, b) / BUCKET), F.floor(F.greatest(a, b) / BUCKET))


def at_page(asked: DataFrame, places: DataFrame, page: Column, name: str, *columns: str) -> DataFrame:
    """asked (book_id, other columns) with name: a struct of the columns of places for the last chapter that starts on the page or before it; null before the first."""
    spans = places.select(F.col("book_id").alias("_book"), F.col("start_page").alias("_from"), F.col("until").alias("_until"), F.struct(*columns).alias("_chapter"))
    inner = spans.where("_until > _from").withColumn("_bucket", F.explode(_buckets(F.col("_from"), F.col("_until") - 1)))
    final = spans.where("_until IS NULL").select(F.col("_book").alias("_book2"), F.col("_from").alias("_last_from"), F.col("_chapter").alias("_last"))
    keyed = asked.withColumn("_page", page).withColumn("_at", F.floor(F.col("_page") / BUCKET))
    met = keyed.join(inner, (F.col("book_id") == F.col("_book")) & (F.col("_at") == F.col("_bucket")) & (F.col("_from") <= F.col("_page")) & (F.col("_page") < F.col("_until")), "left")
    both = met.join(final, F.col("book_id") == F.col("_book2"), "left")
    return both.withColumn(name, F.when(F.col("_page") >= F.col("_last_from"), F.col("_last")).otherwise(F.col("_chapter"))).select(*asked.columns, name)


def part_labels(chapters: DataFrame) -> DataFrame:
    """chapters with label: the title, up to its first dot, of the part that each stands in."""
    marked = told(chapters)
    return marked.withColumn("label", location.nearest_part(marked, F.col("heading"), order="idx")).select(*chapters.columns, "label")


def _said(*parts) -> Column:
    """A key of text; null if a part is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.concat(F.lit(":"), p.cast("string")) for p in parts])


def _keys(reference: Column, now: Column, under: Column) -> Column:
    """What a REFERENCE asks for, the first that there is counts."""
    kind, number, part = reference["kind"], reference["number"], reference["part"]
    here = F.array(_said("here", number, F.coalesce(under, F.lit(-1))), _said("titled", number), _said("number", number))
    near = F.array(_said("current", now)), F.array(_said("previous", now)), F.array(_said("next", now)), F.array(F.lit("last"))
    return (
        F.when(kind == "current", near[0]).when(kind == "previous", near[1]).when(kind == "next", near[2]).when(kind == "last", near[3])
        .when((kind == "number") & part.isNotNull(), F.array(_said("part", number, part))).when(kind == "number", here)
        .otherwise(F.array(F.concat(F.lit("word:"), F.split_part(kind, F.lit(":"), F.lit(2)))))
    )


def _heads(places: DataFrame) -> DataFrame:
    """book_id, part, head: the idx of the first chapter that says a part's number."""
    return places.where("part IS NOT NULL").groupBy("book_id", "part").agg(F.min("idx").alias("head"))


def _lookup(places: DataFrame, asked: DataFrame) -> DataFrame:
    """book_id, key, chapter for every key that chapters answer, and those of words in asked (book_id, key)."""
    idx, titled = F.col("idx"), F.col("titled")
    proper = lambda key: F.when(~F.col("bare"), F.lit(key))
    pair = lambda key, found: F.struct(key.alias("key"), found.alias("found"))
    own = F.array(
        pair(_said("current", idx), idx), pair(_said("previous", idx), F.col("previous")), pair(_said("next", idx), F.col("next")), pair(_said("number", F.col("number")), idx),
        pair(_said("titled", titled), idx), pair(_said("here", titled, F.coalesce("under", F.lit(-1))), idx), pair(proper("last"), idx), pair(proper("next:-1"), idx),
    )
    each = places.select("book_id", F.inline(own)).where("key IS NOT NULL AND found IS NOT NULL")
    parted = places.where("titled IS NOT NULL").join(_heads(places).withColumnRenamed("part", "_part"), ["book_id"]).where("under = head").select("book_id", _said("part", titled, F.col("_part")).alias("key"), idx.alias("found"))
    folded = F.translate(F.lower("title"), library.LOCATION_ACCENTED, library.LOCATION_PLAIN)
    words = asked.where(F.startswith("key", F.lit("word:"))).select("book_id", "key").distinct()
    titles = words.join(places, "book_id").where(F.contains(folded, F.substr("key", F.lit(6)))).select("book_id", "key", idx.alias("found"))
    best = F.when(F.col("key") == "last", F.max("found")).otherwise(F.min("found"))
    found = each.unionByName(parted).unionByName(titles).groupBy("book_id", "key").agg(best.alias("idx"))
    return found.join(places.select("book_id", "idx", "chapter"), ["book_id", "idx"]).select("book_id", "key", "chapter")


def with_named(asked: DataFrame, places: DataFrame, refs: Column, name: str) -> DataFrame:
    """asked (book_id, page, other columns) with name: the chapters (structs of CHAPTER) that refs, an array of REFERENCE, names, in its order and without those that there are not; null if there is none."""
    known = at_page(asked.withColumn("_refs", refs), places, F.col("page"), "_place", "idx", "under")
    known = known.withColumns({"_now": F.coalesce("_place.idx", F.lit(-1)), "_asks": F.to_json("_refs")})
    each = known.where(F.size("_refs") > 0).select("book_id", "_now", "_asks", "_refs", "_place.under").distinct().select("book_id", "_now", "_asks", "under", F.posexplode("_refs").alias("_n", "_ref"))
    keys = each.select("book_id", "_now", "_asks", "_n", F.posexplode(_keys(F.col("_ref"), F.col("_now"), F.col("under"))).alias("_rank", "key")).where("key IS NOT NULL")
    found = keys.join(_lookup(places, keys), ["book_id", "key"]).groupBy("book_id", "_now", "_asks", "_n").agg(F.min_by("chapter", "_rank").alias("chapter"))
    listed = found.groupBy("book_id", "_now", "_asks").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "chapter"))), lambda x: x["chapter"]).alias(name))
    return known.join(listed, ["book_id", "_now", "_asks"], "left").select(*asked.columns, name)


def resolve(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """asked (book_id, page, reference: REFERENCE, other columns) with chapter: the number of the chapter meant."""
    found = with_named(asked, places_of(chapters), F.array("reference"), "_named")
    return found.withColumn("chapter", F.get("_named", F.lit(0))["number"]).select(*asked.columns, "chapter")


def _merged(ranges: Column) -> Column:
    """Ranges in order, put together where one starts at most a page after the others end; there are at most as many as references."""

    def step(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"))
        return F.when(r["first"] <= last["last"] + 1, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(f"array<{RANGE}>"), step)


def pages_of(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """asked with ranges: the pages of a place, or null where the book has no such place.

    asked: book_id, target (book, chapters or part), stretch, refs (array of REFERENCE), part, page, page_count, other columns.
    """
    places = places_of(chapters)
    heads = _heads(places).withColumnRenamed("head", "idx").join(places.select("book_id", "idx", "start_page", "following"), ["book_id", "idx"])
    heads = heads.select(F.col("book_id").alias("_book"), F.col("part").alias("_part"), F.struct("start_page", (F.col("following") - 1).alias("upto")).alias("_heading"))
    known = with_named(asked, places, F.col("refs"), "_found").join(heads, (F.col("book_id") == F.col("_book")) & (F.col("part") == F.col("_part")), "left")
    stretch = F.col("stretch")
    told_ranges = F.transform("_found", lambda c: F.struct(c["start_page"].cast("int").alias("first"), c["end_page"].cast("int").alias("last")))
    known = known.withColumn("_ranges", _merged(F.coalesce(told_ranges, F.array().cast(f"array<{RANGE}>"))))
    one = lambda first, last: F.array(location.stretch(first.cast("int"), last.cast("int"), stretch).cast(RANGE))
    of_chapters = F.when(stretch.isNull(), F.col("_ranges")).otherwise(one(F.get("_ranges", F.lit(0))["first"], F.try_element_at("_ranges", F.lit(-1))["last"]))
    ranges = (
        F.when(F.col("target") == "book", one(F.lit(1), F.col("page_count")))
        .when((F.col("target") == "part") & F.col("_heading").isNotNull(), one(F.col("_heading")["start_page"], F.coalesce(F.col("_heading")["upto"], "page_count")))
        .when((F.col("target") == "chapters") & (F.size("_ranges") > 0), of_chapters)
    )
    return known.withColumn("ranges", ranges).select(*asked.columns, "ranges")


def meeting(asked: DataFrame, places: DataFrame, ranges: Column, name: str) -> DataFrame:
    """asked (book_id, other columns) with name: the numbers of the chapters that share a page with one of the ranges, in order; null if none does."""
    known = asked.withColumn("_asks", F.to_json(ranges)).withColumn("_wanted", ranges)
    some = known.where(F.size("_wanted") > 0).select("book_id", "_asks", "_wanted").distinct().select("book_id", "_asks", F.inline("_wanted"))
    some = some.withColumn("_bucket", F.explode(_buckets(F.col("first"), F.col("last"))))
    held = places.select("book_id", "idx", "number", "start_page", "end_page", F.explode(_buckets(F.col("start_page"), F.col("end_page"))).alias("_bucket"))
    met = some.join(held, ["book_id", "_bucket"]).where("start_page <= last AND end_page >= first").select("book_id", "_asks", "idx", "number").distinct()
    listed = met.groupBy("book_id", "_asks").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "number"))), lambda x: x["number"]).alias(name))
    return known.join(listed, ["book_id", "_asks"], "left").select(*asked.columns, name)


def around_event(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """asked (book_id, number: the chapter in which something happens) with first and last page from two chapters before it to two after it."""
    near = places_of(chapters).groupBy("book_id", "number").agg(F.min_by(F.struct("near_first", "near_last"), "idx").alias("_near"))
    return asked.join(near, ["book_id", "number"], "left").select(*asked.columns, F.col("_near.near_first").alias("first"), F.col("_near.near_last").alias("last"))
