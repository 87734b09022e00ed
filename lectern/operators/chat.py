"""Model answers as data: streamed lines, responses, errors, prompts, fragments; what a chat can do at the moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESPONSE = """struct<candidates:array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>,promptFeedback:struct<blockReason:string>,
usageMetadata:struct<promptTokenCount:int,candidatesTokenCount:int,cachedContentTokenCount:int>,error:struct<code:int,message:string>>"""
# Finish reasons that mean a refusal.
REFUSALS = ("SAFETY", "RECITATION", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII")


def response(body: Column) -> dict[str, Column]:
    """text, finish, block and error code of a JSON response; only the first candidate's parts that are no thoughts are text."""
    r = F.from_json(body, RESPONSE)
    first = F.try_element_at(r["candidates"], F.lit(1))
    said = F.filter(first["content"]["parts"], lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    text = F.coalesce(F.array_join(F.transform(said, lambda p: p["text"]), ""), F.lit(""))
    block = F.coalesce(r["promptFeedback"]["blockReason"], F.when(first["finishReason"].isin(*REFUSALS), first["finishReason"]))
    return {"text": text, "finish": first["finishReason"], "block": block, "error": r["error"]["code"], "input": r["usageMetadata"]["promptTokenCount"], "output": r["usageMetadata"]["candidatesTokenCount"]}


def folded_stream(lines: DataFrame) -> DataFrame:
    """One row per answer_id from its lines (answer_id, n, line): text in order, last finish, first block, last usage, outcome."""
    events = lines.where(F.col("line").startswith("data:")).select("answer_id", "n", *[c.alias(k) for k, c in response(F.trim(F.substr("line", F.lit(6)))).items()])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    whole = events.groupBy("answer_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"),
        last("finish").alias("finish"), F.min_by("block", F.when(F.col("block").isNotNull(), F.col("n"))).alias("block"), last("input").alias("input"), last("output").alias("output"), last("error").alias("error"),
    )
    blank = F.trim("text") == ""
    outcome = F.when(F.col("error").isNotNull() & blank, error_kind(F.col("error"))).when(F.col("error").isNotNull(), "Incomplete").when(F.col("block").isNotNull() & blank, "Refused")
    return whole.withColumn("outcome", outcome.when(F.col("finish").isNull(), "Incomplete").otherwise("Complete"))


def error_kind(code: Column) -> Column:
    return F.when(code.isNull(), "Network").when(code.isin(401, 403), "Unauthorized").when(code == 429, "RateLimited").when(code >= 500, "Overloaded").otherwise("Failed")


def outer_json(answer: Column) -> Column:
    """What stands between the first opening and the last closing brace."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def availability(status: Column, progress: Column, has_key: Column, model_ready: Column, has_chunks: Column) -> Column:
    """What the chat says of a book: the first rule that applies."""
    return (
        F.when(status == "FAILED", "BOOK_FAILED").when(~has_key, "NO_KEY").when(status == "READY", F.when(has_chunks, "READY").otherwise("NO_TEXT"))
        .when((status == "TEXT_READY") & has_chunks, F.when(model_ready, "READY_INDEXING").otherwise("READY_TEXT_ONLY")).when(progress > 0, "INDEXING").otherwise("WAITING")
    )


def fragments(merged: DataFrame, chapters: DataFrame) -> DataFrame:
    """Merged chunks (book_id, start_page, end_page, text) numbered from 1 with the title of the first chapter that contains their first page.

    The chunks are those of an answer, so a book has few.
    """
    titles = chapters.select(F.col("book_id").alias("_book"), F.col("start_page").alias("_first"), F.col("end_page").alias("_last"), "number", "title")
    inside = (F.col("book_id") == F.col("_book")) & F.col("start_page").between(F.col("_first"), F.col("_last"))
    first = merged.join(titles, inside, "left").groupBy("book_id", "start_page", "end_page", "text").agg(F.min_by("title", "number").alias("chapter"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("book_id").orderBy("start_page", "end_page")))


def rendered(number: Column, first: Column, last: Column, chapter: Column, text: Column) -> Column:
    """One fragment as it stands in a prompt."""
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    title = F.coalesce(F.concat(F.lit(' capitulo="'), F.replace(chapter, F.lit('"'), F.lit("'")), F.lit('"')), F.lit(""))
    return F.concat(F.lit('<fragmento n="'), number.cast("string"), F.lit('" paginas="'), pages, F.lit('"'), title, F.lit(">\n"), text, F.lit("\n</fragmento>"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


def cited(citations: Column, first: Column, last: Column) -> Column:
    return F.exists(citations, lambda p: (p >= first) & (p <= last))


def response_schema(fields: dict) -> dict:
    """A structured-output schema from {name: kind}: kinds are string, integer, boolean, a list of values, [kind] for arrays or a dict; a name that ends in ? may be missing."""

    def kind(value) -> dict:
        if isinstance(value, dict):
            return response_schema(value)
        if isinstance(value, list) and len(value) == 1:
            return {"type": "ARRAY", "items": kind(value[0])}
        if isinstance(value, list | tuple):
            return {"type": "STRING", "enum": list(value)}
        return {"type": value.upper()}

    names = {n.rstrip("?"): (kind(v) | ({"nullable": True} if n.endswith("?") else {})) for n, v in fields.items()}
    return {"type": "OBJECT", "properties": names, "required": [n for n in fields if not n.endswith("?")], "propertyOrdering": list(names)}
