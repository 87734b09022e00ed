"""From a question to what is read for it: where it points, what a judge answered, where the reader is, which fragments to take."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import chapters as ch
from lectern.operators import chat, retrieval, text
from lectern.sources import library
from lectern.sources.scratch import settled

# How many fragments, how long a quotation must be, what relations and document types are called.
SPECIFIC_K, GLOBAL_K, CHAPTER_K = 8, 12, 16
QUOTE_LENGTH, LEAST_TOLD = 10, 2
RELATIONS = {"ANTES": "BEFORE", "DURANTE": "DURING", "DESPUES": "AFTER"}
DOCUMENT_TYPES = ("LITERATURE", "SCIENTIFIC", "EDUCATIONAL", "GENERIC")
# What the model is told of the reader.
HERE, CHAPTER_HERE, CHAPTER_BEFORE, PART = "El lector está en la página ", ", en el capítulo ", " El capítulo anterior es ", " de «"
SCOPE, SCOPE_UNREAD = " La pregunta se refiere a las páginas ", " La pregunta se refiere a una parte del libro que el lector aún no ha leído."
SOURCES = ("OUTLINE", "HEADINGS", "HEURISTIC", "LLM", "BLOCKS")


def comparable(text_: Column) -> Column:
    """Letters and digits without case and accents, single blanks between."""
    folded = F.translate(F.lower(text_), library.LOCATION_ACCENTED, library.LOCATION_PLAIN)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{Nd}]+", " "))


# What a judge answers -------------------------------------------------------------------------------


def event_list(chapters: DataFrame) -> DataFrame:
    """book_id, events: the chapters (book_id, start_page, end_page, title, events) numbered from 1, each with its events. A book's outline is one value."""
    entry = F.struct("start_page", "end_page", "title", "events")
    listed = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    heading = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["title"], F.lit(" (p. "), c["start_page"].cast("string"), F.lit("–"), c["end_page"].cast("string"), F.lit(")"))
    lines = F.transform("all", lambda c, i: F.concat(heading(c, i), F.array_join(F.transform(c["events"], lambda e: F.concat(F.lit("\n- "), e)), "")))
    return listed.select("book_id", F.array_join(lines, "\n\n").alias("events"))


def is_book_part(answer: Column) -> Column:
    return F.from_json(chat.outer_json(answer), "parte_del_libro boolean")["parte_del_libro"]


def event_anchors(answers: DataFrame, chapters: DataFrame) -> DataFrame:
    """answers (book_id, answer, other columns) with number (the chapter of the event) and relation; nulls where there is none.

    The chapter is that of the event quoted, if one of the list (chapters: book_id, number, start_page, events) is it or holds
    it or the other way round, by whole words (number 1 is not in number 13), else the one whose place in the list is told.
    """
    said = F.from_json(chat.outer_json(F.col("answer")), "hecho string, relacion string, capitulo int")
    names = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    relation = F.try_element_at(names, F.upper(F.trim(F.coalesce(F.col("_said.relacion"), F.lit("")))))
    quote = comparable(F.coalesce(F.col("_said.hecho"), F.lit("")))
    known = answers.withColumn("_said", said).withColumns({"_relation": relation, "_quote": quote, "_place": F.col("_said.capitulo")})
    known = known.withColumn("_quote", F.when(F.length("_quote") >= QUOTE_LENGTH, F.col("_quote")))
    turn = F.row_number().over(Window.partitionBy("book_id").orderBy("start_page", "number"))
    listed = chapters.select("book_id", "number", "events", turn.alias("_place"))
    quotes = known.where("_quote IS NOT NULL AND _relation IS NOT NULL").select("book_id", "_quote").distinct()
    events = listed.select("book_id", "number", "_place", F.explode("events").alias("_event")).withColumn("_event", comparable(F.col("_event"))).where("_event <> ''")
    quoted = _told_together(quotes, events).groupBy("book_id", "_quote").agg(F.min_by("number", "_place").alias("_quoted"))
    by_place = listed.select("book_id", "_place", F.col("number").alias("_placed"))
    found = known.join(quoted, ["book_id", "_quote"], "left").join(by_place, ["book_id", "_place"], "left").withColumn("_number", F.coalesce("_quoted", "_placed"))
    told_ = F.col("_relation").isNotNull() & F.col("_number").isNotNull()
    return found.select(*answers.columns, F.when(told_, F.col("_number")).alias("number"), F.when(told_, F.col("_relation")).alias("relation"))


def _told_together(quotes: DataFrame, events: DataFrame) -> DataFrame:
    """book_id, _quote, number, _place of events (_event) of the book that are the quote or hold it or are held by it, by whole words (both comparable texts).

    What holds a text holds its rarest word in the book's events, so candidates meet by that word.
    """
    words = lambda df, c: df.withColumn("_word", F.explode(F.array_distinct(F.split(c, " "))))
    distinct = events.select("book_id", "_event").distinct()
    in_events = words(distinct, "_event")
    counts = in_events.groupBy("book_id", "_word").agg(F.count("*").alias("_n"))
    in_quotes = words(quotes, "_quote").join(counts, ["book_id", "_word"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = F.min_by("_word", F.struct("_n", "_word")).alias("_word")
    rare_events = in_events.join(counts, ["book_id", "_word"]).groupBy("book_id", "_event").agg(rarest)
    rare_quotes = in_quotes.groupBy("book_id", "_quote").agg(rarest)
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    held = in_quotes.join(rare_events, ["book_id", "_word"]).where(F.contains(padded("_quote"), padded("_event"))).select("book_id", "_quote", "_event")
    holding = rare_quotes.join(in_events, ["book_id", "_word"]).where(F.contains(padded("_event"), padded("_quote"))).select("book_id", "_quote", "_event")
    return held.unionByName(holding).distinct().join(events, ["book_id", "_event"]).select("book_id", "_quote", "number", "_place")


Judge = Callable[[DataFrame], DataFrame]


def locate(asked: DataFrame, chapters: DataFrame, limit: Column, part_judge: Judge | None = None, event_judge: Judge | None = None, literature: bool = True, path: str | None = None) -> DataFrame:
    """asked (book_id, page, page_count, question, other columns) with ranges and rest: the pages that the question is about, and the question without its place.

    ranges is null where no place is meant. Clear places count as they are; doubtful ones where part_judge says so, events where event_judge
    finds their chapter. part_judge gets rows with expression and adds is_part; event_judge adds number. Without a judge such places count for nothing.
    path: a new folder in the shared folder; with it, questions are read once.
    """
    found = text.located(asked, literature)
    if path is not None:
        found = settled(found, path)
    doubtful, event = F.col("kind") == "doubtful", F.col("kind") == "event"
    sure = found.where(~F.coalesce(doubtful | event, F.lit(False)))
    if part_judge is not None:
        judged = part_judge(found.where(doubtful))
        sure = sure.unionByName(judged.where("is_part").select(*found.columns)).unionByName(judged.where("NOT coalesce(is_part, false)").select(*_nowhere(found)))
    else:
        sure = sure.unionByName(found.where(doubtful).select(*_nowhere(found)))
    placed = ch.pages_of(sure, chapters)
    events = found.where(event)
    if event_judge is not None:
        near = ch.around_event(event_judge(events), chapters)
        ranged = near.withColumn("ranges", F.when(F.col("first").isNotNull(), F.array(F.struct("first", "last")).cast(f"array<{ch.RANGE}>")))
        placed = placed.unionByName(ranged.select(*placed.columns))
    else:
        placed = placed.unionByName(events.withColumn("ranges", F.lit(None).cast(f"array<{ch.RANGE}>")).select(*placed.columns))
    cut = F.filter(F.transform("ranges", lambda r: F.struct(r["first"].alias("first"), F.least(r["last"], F.coalesce(limit, r["last"])).alias("last"))), lambda r: r["first"] <= r["last"])
    rest = F.when(F.col("ranges").isNull(), F.col("question")).otherwise(F.col("rest"))
    return placed.select(*asked.columns, "kind", "target", "stretch", "refs", cut.alias("ranges"), rest.alias("rest"))


def _nowhere(found: DataFrame) -> list[Column]:
    """Columns of a question that turned out to name no place."""
    gone = ("kind", "target", "stretch")
    return [F.lit(None).cast("string").alias(c) if c in gone else F.col("question").alias("rest") if c == "rest" else F.col(c) for c in found.columns]


# Where the reader is --------------------------------------------------------------------------------


def _pages(ranges: Column) -> Column:
    one = lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat_ws("–", r["first"].cast("string"), r["last"].cast("string")))
    return F.array_join(F.transform(ranges, one), ", ")


def position_text(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """asked (book_id, page, ranges: null if no place is meant) with position: where the reader is, in words."""
    def described(title: str, start: str, end: str, heading: str) -> Column:
        part = F.nullif(F.trim(F.substring_index(heading, ".", 1)), F.lit(""))
        of = F.when(part.isNotNull() & ~F.startswith(title, part), F.concat(F.lit(PART), part, F.lit("»"))).otherwise(F.lit(""))
        return F.concat(F.lit("«"), title, F.lit("»"), of, F.lit(" (p. "), F.col(start).cast("string"), F.lit("–"), F.col(end).cast("string"), F.lit(")"))

    places = ch.places_of(chapters).withColumns({"_current": described("title", "start_page", "end_page", "under_title"), "_previous": described("before_title", "before_start_page", "before_end_page", "before_under_title")})
    told = ch.at_page(asked, places, F.col("page"), "_chapter", "_current", "_previous")
    here = F.concat(F.lit(HERE), F.col("page").cast("string"))
    current = F.coalesce(F.concat(F.lit(CHAPTER_HERE), F.col("_chapter._current")), F.lit(""))
    previous = F.when(F.col("_chapter").isNotNull(), F.concat(F.lit(CHAPTER_BEFORE), F.col("_chapter._previous"), F.lit(".")))
    scope = F.when(F.col("ranges").isNull(), "").when(F.size("ranges") == 0, SCOPE_UNREAD).otherwise(
        F.concat(F.lit(SCOPE), _pages(F.col("ranges")), F.lit("."))
    )
    return told.withColumn("position", F.concat(here, current, F.lit("."), F.coalesce(previous, F.lit("")), scope)).select(*asked.columns, "position")


# Which fragments ------------------------------------------------------------------------------------


def fragment_plan(located: DataFrame, chapters: DataFrame, limit: Column) -> DataFrame:
    """located (of locate, with book_id, page, question, rest, ranges, refs, target, stretch) with way, k, chapters, pages, otherwise_way, otherwise_k.

    way: NOTHING, RETRIEVE (the k best chunks for the question in pages) or KEY_POINTS (those of the chapters named, in pages if told);
    where key points come to nothing, otherwise_way: SPREAD (k chunks evenly over pages) or RETRIEVE.
    """
    places = ch.places_of(chapters)
    is_global = retrieval.is_global(F.col("question"))
    summary = retrieval.is_summary(F.col("question")) | is_global
    placed, read = F.col("ranges").isNotNull(), F.coalesce(limit, F.lit(2**31 - 1))
    one = (F.col("target") == "chapters") & F.col("stretch").isNull() & (F.size("refs") == 1)
    known = ch.with_named(located, places, F.when(one, F.col("refs")), "_named").withColumn("_whole", F.get("_named", F.lit(0)))
    whole = placed & summary & F.col("_whole").isNotNull()
    known = ch.meeting(known, places, F.when(placed & summary & ~whole, F.col("ranges")), "_meets")
    known = ch.at_page(known, places, read, "_read", "idx")
    outlines = places.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "number"))), lambda c: c["number"]).alias("_numbers"))  # a number a chapter
    known = known.join(outlines, "book_id", "left")
    none = F.array().cast(outlines.schema["_numbers"].dataType)
    nothing = placed & ((F.size("ranges") == 0) | (whole & (F.col("_whole")["start_page"] > read)))
    points = (placed & summary) | (~placed & is_global)
    upto = F.when(limit.isNotNull(), F.array(F.struct(F.lit(1).alias("first"), limit.cast("int").alias("last")).cast(ch.RANGE)))
    chapter_pages = F.array(F.struct(F.col("_whole")["start_page"].cast("int").alias("first"), F.least(F.col("_whole")["end_page"], read).cast("int").alias("last")).cast(ch.RANGE))
    wanted = F.when(whole, F.array(F.col("_whole")["number"])).when(placed, F.coalesce("_meets", none)).otherwise(F.slice("_numbers", F.lit(1), F.coalesce(F.col("_read.idx") + 1, F.lit(0))))
    way = F.when(nothing, "NOTHING").when(points, "KEY_POINTS").otherwise("RETRIEVE")
    return known.select(
        *located.columns, way.alias("way"), F.when(way == "RETRIEVE", SPECIFIC_K).alias("k"), F.when(way == "KEY_POINTS", wanted).alias("chapters"),
        F.when(nothing, F.lit(None)).when(whole, chapter_pages).when(placed, F.col("ranges")).otherwise(upto).alias("pages"),
        F.when(way == "KEY_POINTS", F.when(placed, "SPREAD").otherwise("RETRIEVE")).alias("otherwise_way"), F.when(way == "KEY_POINTS", F.when(placed, CHAPTER_K).otherwise(GLOBAL_K)).alias("otherwise_k"),
    )


def candidates(chunks: DataFrame, vectors: DataFrame | None, query: list[float] | None, terms: list[str]) -> list[DataFrame]:
    """The ranked lists (id, score, pos) that are fused: by vector, if there are any, and by text."""
    by_text = retrieval.top(retrieval.text_search(chunks, terms), retrieval.TOP, ascending=True)
    return [by_text] if vectors is None or query is None else [retrieval.top(retrieval.vector_scores(vectors, query), retrieval.TOP, ascending=False), by_text]


def spread(chunks: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """k chunks (book_id, ordinal, start_page, end_page) of each book evenly over those inside the ranges (book_id, first, last), in reading order; none where a range ends before it starts."""
    inside = chunks.join(ranges, (chunks["book_id"] == ranges["book_id"]) & (chunks["start_page"] >= ranges["first"]) & (chunks["end_page"] <= ranges["last"]), "left_semi")
    placed = library.numbered(inside, "book_id", "ordinal", "_place").withColumn("_place", F.col("_place") - 1)
    return retrieval.evenly_spaced(placed, "book_id", "_place", k).drop("_place")


def stale(counted: DataFrame, vectors: DataFrame) -> DataFrame:
    """book_id, model of the indexes (book_id, model, n) whose count is no longer that of their vectors (book_id, model)."""
    now = vectors.groupBy("book_id", "model").agg(F.count("*").alias("_now"))
    return counted.join(now, ["book_id", "model"], "left").where(F.coalesce("_now", F.lit(0)) != F.col("n")).select("book_id", "model")


# Outlines, answers and texts around them ------------------------------------------------------------


def chosen_source(entries: DataFrame) -> DataFrame:
    """The entries (book_id, source, other columns) of each book's first source in the order of SOURCES that has any (a model's: LEAST_TOLD), with kind: headings are told as HEURISTIC."""
    counts = entries.groupBy("book_id", "source").agg(F.count("*").alias("_n"))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    usable = counts.where((F.col("source") != "LLM") | (F.col("_n") >= LEAST_TOLD))
    best = usable.groupBy("book_id").agg(F.min_by("source", rank).alias("source"))
    kind = F.when(F.col("source") == "HEADINGS", "HEURISTIC").otherwise(F.col("source"))
    return entries.join(best, ["book_id", "source"], "left_semi").withColumn("kind", kind)


def outline_levels(entries: DataFrame, levels: int = 3) -> DataFrame:
    """Entries (book_id, depth, other columns) from each book's first depth that has two or more, for levels depths, as level 0 on."""
    counts = entries.groupBy("book_id", "depth").agg(F.count("*").alias("_n"))
    top = counts.where("_n >= 2").groupBy("book_id").agg(F.min("depth").alias("_top"))
    kept = entries.join(top, "book_id").where(F.col("depth").between(F.col("_top"), F.col("_top") + levels - 1))
    return kept.withColumn("level", (F.col("depth") - F.col("_top")).cast("int")).drop("_top", "depth")


def index_upgrade(old: DataFrame, new: DataFrame, dependents: DataFrame) -> DataFrame:
    """book_id, way: what to do with a book's old chapters when new entries are found (both book_id, start_page, level; dependents: book_id of books whose chapters others refer to).

    SECTIONS: the chapters start on the same pages, so only sections are inserted; REBUILD: nothing depends on them; INSERT: the new ones go in as sections.
    """
    starts = lambda df: df.where("level = 0").groupBy("book_id").agg(F.sort_array(F.collect_set("start_page")).alias("starts"))
    both = starts(old).join(starts(new).withColumnRenamed("starts", "found"), "book_id")
    marked = both.join(dependents.select("book_id").distinct().withColumn("used", F.lit(True)), "book_id", "left")
    return marked.select("book_id", F.when(F.col("starts") == F.col("found"), "SECTIONS").when(F.col("used").isNull(), "REBUILD").otherwise("INSERT").alias("way"))


def chapters_told(answer: Column, page_count: Column) -> Column:
    """Chapters (page, title) of a JSON list in an answer: real ones in page order, one a page; null for fewer than two."""
    body = F.nullif(F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.lit(""))
    read = F.from_json(body, "array<struct<title:string,page:int>>")
    real = F.filter(read, lambda c: (F.trim(F.coalesce(c["title"], F.lit(""))) != "") & c["page"].between(F.lit(1), page_count))
    placed = F.array_sort(F.transform(real, lambda c, i: F.struct(c["page"].alias("page"), i.alias("turn"), F.trim(c["title"]).alias("title"))))
    first = F.filter(F.transform(placed, lambda c, i: F.struct(c["page"].alias("page"), c["title"].alias("title"), (i > 0).alias("later"), F.get(placed, i - 1)["page"].alias("before"))), lambda c: ~c["later"] | (c["page"] != c["before"]))
    return F.when(F.size(first) >= 2, F.transform(first, lambda c: F.struct(c["page"].alias("page"), c["title"].alias("title"))))


def document_type(answer: Column) -> Column:
    told = F.upper(F.trim(F.from_json(chat.outer_json(answer), "tipo string")["tipo"]))
    return F.when(told.isin(*DOCUMENT_TYPES), told)


def block_text(pages: DataFrame) -> DataFrame:
    """book_id, block, text of the pages (book_id, block, page, text) of a block, each after its mark."""
    marked = F.struct("page", F.concat(F.lit("[p. "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")).alias("t"))
    return pages.groupBy("book_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["t"]), "\n\n").alias("text"))


def recap_is_current(recaps: DataFrame, chapters: DataFrame) -> DataFrame:
    """recaps (book_id, until_page, page, other columns) with current: made for pages read, and at most a chapter ago."""
    places = ch.places_of(chapters)
    known = ch.at_page(ch.at_page(recaps, places, F.col("page"), "_here", "idx"), places, F.col("until_page"), "_upto", "idx")
    near = F.coalesce("_here.idx", F.lit(-1)) - F.coalesce("_upto.idx", F.lit(-1)) <= 1
    return known.select(*recaps.columns, ((F.col("until_page") <= F.col("page")) & near).alias("current"))


def confirmation(estimate: Column, used: Column, budget: Column) -> Column:
    """(estimate, remaining) where an estimate is more than what remains of the budget; null where it need not be confirmed, or without a budget."""
    remaining = F.greatest(budget - used, F.lit(0))
    return F.when(budget.isNotNull() & (estimate > remaining), F.struct(estimate.alias("estimate"), remaining.alias("remaining")))


def phrase_at(starts: Column, offset: Column) -> Column:
    """The number (from 0) of the last phrase that starts at the offset or before it; the first if none does; null where there are no starts."""
    return F.when(starts.isNotNull(), F.greatest(F.size(F.filter(starts, lambda s: s <= offset)) - 1, F.lit(0)))


def starts_of(paragraph: str, phrases: Sequence[str | None]) -> list[int]:
    """phrase_starts of one paragraph, in one way through it. An empty phrase stands where the search is, a null one as if not found."""
    at, out = 0, []
    for phrase in phrases:
        found = -1 if phrase is None else paragraph.find(phrase, at)
        out.append(at if found < 0 else found)
        if found >= 0:
            at = found + len(phrase)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _phrase_starts(paragraphs: pd.Series, phrases: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or some is None else starts_of(p, some) for p, some in zip(paragraphs, phrases, strict=True)], dtype=object)


def phrase_starts(paragraph: Column, phrases: Column) -> Column:
    """Where the phrases stand in a paragraph, each looked for after the one before; one that is not found stands where the search was. Null where either is null."""
    return _phrase_starts(paragraph, phrases)
