"""Words that a page's end cuts in two, put together on the earlier page, as if pages were mended one after the other.

A page that ends in a cut word takes the first word of the next page, if that begins with a small letter. Whether a page still ends in a cut word can
depend on whether it lost its own first word (a page of that word alone is empty then). So each page is a function of a truth value: it gives always, never,
or depending on what it lost; runs of pages of the last kind are looked through in order, and only these. Of a page two flags and its first word
travel to its neighbour, joined on (book, page); texts do not, and no book is put in order as a whole.

Defined results: pages (book_id, page: whole numbers, unique in a book, paragraphs) keep all their columns; the next page is page + 1. A null or empty list of
paragraphs gives and takes nothing. With a column levels (a number a paragraph) only paragraphs of level 0 give or take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import HYPHENS

_CUT = rf"(?sU)^(?:.+\s)?\w+[{HYPHENS}]\s*$"
_TAIL = rf"(?sU)[{HYPHENS}]\s*$"


def _word(paragraph: Column) -> Column:
    return F.regexp_extract(paragraph, r"(?U)^\s*(\S+)", 1)


def _rest(paragraph: Column) -> Column:
    """A paragraph without its first word."""
    return F.regexp_replace(paragraph, r"(?sU)^\s*\S+ *", "")


def _trimmed_rest(paragraph: Column) -> Column:
    return F.regexp_replace(_rest(paragraph), r"(?sU)\s+$", "")


def _without_first(paragraphs: Column) -> Column:
    rest = _trimmed_rest(F.get(paragraphs, F.lit(0)))
    others = F.slice(paragraphs, F.lit(2), F.size(paragraphs))
    return F.when(rest == "", others).otherwise(F.concat(F.array(rest), others))


def _joined(paragraphs: Column, word: Column) -> Column:
    last = F.concat(F.regexp_replace(F.try_element_at(paragraphs, F.lit(-1)), _TAIL, ""), word)
    return F.concat(F.slice(paragraphs, F.lit(1), F.size(paragraphs) - 1), F.array(last))


def taken(pages: DataFrame) -> DataFrame:
    """book_id, page, word: the pages that lose their first word to the page before."""
    some = pages.where(F.size("paragraphs") > 0)
    first, last, single = F.get("paragraphs", F.lit(0)), F.try_element_at("paragraphs", F.lit(-1)), F.size("paragraphs") == 1
    plain_first = plain_last = F.lit(True)
    if "levels" in pages.columns:
        plain_first, plain_last = F.get("levels", F.lit(0)) == 0, F.try_element_at("levels", F.lit(-1)) == 0
    edges = some.select(
        "book_id", "page", (last.rlike(_CUT) & plain_last).alias("gives"),
        F.when(single, _trimmed_rest(first).rlike(_CUT) & plain_last).otherwise(last.rlike(_CUT) & plain_last).alias("gives_less"),
        _word(first).alias("word"), plain_first.alias("plain"),
    )
    takes = edges.select("book_id", (F.col("page") - 1).alias("page"), F.col("word").alias("next"), (F.col("plain") & F.col("word").rlike(r"^\p{javaLowerCase}")).alias("takes"))
    met = edges.where("gives OR gives_less").join(takes.where("takes"), ["book_id", "page"]).select("book_id", "page", "next", "gives", "gives_less")
    sure = met.where("gives = gives_less").select("book_id", "page", "next")
    unsure = met.where("gives <> gives_less")
    # Unsure pages in runs of neighbours; what the page before a run does is sure.
    turn = Window.partitionBy("book_id").orderBy("page")
    runs = unsure.withColumn("run", F.col("page") - F.row_number().over(turn))
    within = Window.partitionBy("book_id", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost_before = sure.select("book_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("lost"))
    placed = runs.join(lost_before, ["book_id", "page"], "left").withColumns({"lost": F.first(F.coalesce("lost", F.lit(False))).over(within), "turns": F.sum(F.col("gives").cast("int")).over(within)})
    decided = placed.where(F.col("lost") != (F.col("turns") % 2 == 1)).select("book_id", "page", "next")
    return sure.unionByName(decided).select("book_id", (F.col("page") + 1).alias("page"), F.col("next").alias("word"))


def mended(pages: DataFrame) -> DataFrame:
    """pages with the words at their ends put together."""
    moved = taken(pages)
    lost = moved.select("book_id", "page", F.lit(True).alias("_lost"))
    won = moved.select("book_id", (F.col("page") - 1).alias("page"), F.col("word").alias("_won"))
    joined = pages.join(lost, ["book_id", "page"], "left").join(won, ["book_id", "page"], "left")
    short = F.when(F.col("_lost"), _without_first(F.col("paragraphs"))).otherwise(F.col("paragraphs"))
    if "levels" in pages.columns:
        gone = F.col("_lost") & (_trimmed_rest(F.get("paragraphs", F.lit(0))) == "")
        joined = joined.withColumn("levels", F.when(gone, F.slice("levels", F.lit(2), F.size("levels"))).otherwise(F.col("levels")))
    whole = joined.withColumn("paragraphs", short).withColumn("paragraphs", F.when(F.col("_won").isNotNull(), _joined(F.col("paragraphs"), F.col("_won"))).otherwise(F.col("paragraphs")))
    return whole.select(*pages.columns)
