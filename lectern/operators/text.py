"""Text operators on DataFrames: native where one expression says it, Arrow-batched Python where order decides."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lectern.functions import layout
from lectern.functions import location as places
from lectern.functions import text as plain

# Frequent words of two languages.
SPANISH = "de la que el en y los se del las un por con no una su para es al lo como más pero sus le ya o fue este ha sí porque".split()
ENGLISH = "the of and to in is that it was for on with as his he be at by i you had her she which not but are this have from they".split()
MIN_HITS = 20
MARGIN_LINES, REPEAT_RATIO = 4, 0.35
TEXTS_AT_ONCE, PAGES_AT_ONCE = 200, 64
# What kinds of documents look like (one line at a time).
SCIENTIFIC_SECTIONS = (
    r"(?i)^\s*(abstract|resumen)\s*$", r"(?i)^\s*([0-9]+\.?\s*)?(introducci[oó]n|introduction)\s*$",
    r"(?i)^\s*([0-9]+\.?\s*)?(m[eé]todos?|metodolog[ií]a|materiales y m[eé]todos|methods)\s*$", r"(?i)^\s*([0-9]+\.?\s*)?(resultados|results)\s*$",
    r"(?i)^\s*([0-9]+\.?\s*)?(discusi[oó]n|discussion)\s*$", r"(?i)^\s*(referencias|bibliograf[ií]a|references)\s*$",
)
DIALOGUE = r"^\s*[—–―«“\"]"
KEYWORDS = r"(?i)(palabras clave|keywords)\s*:"
DOI = r"(?i)\bdoi\s*:?\s*10\.[0-9]{4,}"
AUTHOR_YEAR = r"\(\p{Lu}[\p{L}'-]+(?: et al\.| y \p{Lu}[\p{L}'-]+)?,? (?:19|20)[0-9]{2}[a-z]?\)"
NUMBERED_CITATION = r"\[[0-9]{1,3}(?:[,–-]\s*[0-9]{1,3})*\]"
EDUCATIONAL = r"(?i)^\s*(tema|unidad|lecci[oó]n|m[oó]dulo)\s+[0-9]+|^\s*(ejercicios|actividades|autoevaluaci[oó]n|objetivos( de aprendizaje)?|soluciones|recuerda|para saber m[aá]s)\b"
NUMBERED_QUESTION = r"^\s*[0-9]{1,2}[.)]\s+.{5,200}\?\s*$"


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, "[ \n]"), lambda w: F.trim(w) != ""))
    return F.greatest(F.lit(1), F.floor(words * F.lit(1.3)).cast("int"))


def language_hits(text: Column) -> tuple[Column, Column]:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    return hits(SPANISH), hits(ENGLISH)


def language(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, es, en, language of all texts of a key together; counts are partial sums, so large keys are no hot task."""
    es, en = language_hits(F.col("text"))
    counts = texts.select(*keys, es.alias("es"), en.alias("en")).groupBy(*keys).agg(F.sum("es").alias("es"), F.sum("en").alias("en"))
    return counts.withColumn("language", F.when((F.col("en") >= MIN_HITS) & (F.col("en") > F.col("es")), "ENGLISH").otherwise("SPANISH"))


def _line_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(line), r"\s+", " "))


def repeated_margin_lines(pages: DataFrame) -> DataFrame:
    """book_id, place (top or bottom), line, n: lines that the first or last four non-blank lines of enough pages share, digits aside or not."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cut = pages.select("book_id", lines.alias("lines"))
    sides = F.array(
        F.struct(F.lit("top").alias("place"), F.slice("lines", 1, MARGIN_LINES).alias("some")),
        F.struct(F.lit("bottom").alias("place"), F.slice("lines", F.greatest(F.size("lines") - (MARGIN_LINES - 1), F.lit(1)), MARGIN_LINES).alias("some")),
    )
    each = cut.select("book_id", F.inline(sides)).select("book_id", "place", F.explode("some").alias("line"))
    number = r"(?i)^\s*(?:(?:p[áa]g(?:\.|ina)?\.?\s*)?[0-9]+\s*(?:de\s+[0-9]+)?|[-–—]\s*[0-9]+\s*[-–—]|[0-9]+\s*/\s*[0-9]+)\s*$"
    key = _line_key(F.col("line"))
    keys = F.array_distinct(F.array(key, F.regexp_replace(key, "[0-9]+", "#")))
    counts = each.where(~F.col("line").rlike(number)).select("book_id", "place", F.explode(keys).alias("line")).groupBy("book_id", "place", "line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy("book_id").agg(F.greatest(F.lit(2), F.floor(F.count("*") * REPEAT_RATIO)).alias("least"))
    return counts.join(sizes, "book_id").where((F.col("n") >= F.col("least")) & F.length("line").between(2, 160)).select("book_id", "place", "line", "n")


def running_heads(heads: DataFrame) -> DataFrame:
    """Candidate chapter heads (book_id, page, head): not lower case, not repeated three times and on over 30 % of the pages."""
    short = heads.withColumn("head", F.left(F.trim("head"), F.lit(80))).where("head <> ''")
    counts = short.groupBy("book_id", F.lower("head").alias("key")).agg(F.count("*").alias("n"))
    totals = short.groupBy("book_id").agg(F.count("*").alias("total"))
    often = counts.join(totals, "book_id").where("n >= 3 AND n > 0.3 * total").select("book_id", "key")
    return short.where(~F.col("head").rlike(r"^\p{Ll}")).withColumn("key", F.lower("head")).join(often, ["book_id", "key"], "left_anti").drop("key")


def document_scores(pages: DataFrame) -> DataFrame:
    """book_id with the literature, scientific and educational scores and the type of all pages (book_id, text) together.

    Everything is counted line by line and summed, so no book's text is put together.
    """
    lines = pages.select("book_id", F.explode(F.split("text", "\n")).alias("line"))
    found = lambda pattern: F.col("line").rlike(pattern)
    count = lambda pattern: F.regexp_count("line", F.lit(pattern))
    full = F.trim("line") != ""
    sums = lines.groupBy("book_id").agg(
        F.count_if(full).alias("paragraphs"), F.count_if(full & found(DIALOGUE)).alias("dialogue"),
        *[F.max(found(p).cast("int")).alias(f"section_{i}") for i, p in enumerate(SCIENTIFIC_SECTIONS)],
        F.max(found(KEYWORDS).cast("int")).alias("keywords"), F.max(found(DOI).cast("int")).alias("doi"),
        F.sum(count(AUTHOR_YEAR) + count(NUMBERED_CITATION)).alias("citations"), F.count_if(found(EDUCATIONAL)).alias("headings"), F.count_if(found(NUMBERED_QUESTION)).alias("questions"),
    )
    share = F.try_divide("dialogue", "paragraphs")
    literature = F.when(share >= 0.12, 3.0).when(share >= 0.04, 2.0).otherwise(0.0)
    cited = F.when(F.col("citations") >= 15, 3.0).when(F.col("citations") >= 4, 1.0).otherwise(0.0)
    scientific = sum((F.col(f"section_{i}") for i in range(len(SCIENTIFIC_SECTIONS))), F.lit(0.0)) + F.col("keywords") + 2 * F.col("doi") + cited
    educational = F.least("headings", F.lit(3)) + F.when(F.col("questions") >= 8, 2.0).otherwise(0.0)
    scored = sums.select("book_id", "paragraphs", literature.alias("literature"), scientific.alias("scientific"), educational.alias("educational"))
    ranked = F.sort_array(F.array(*[F.struct(F.col(k).alias("score"), F.lit(3 - i).alias("turn"), F.lit(k.upper()).alias("kind")) for i, k in enumerate(("literature", "scientific", "educational"))]), False)
    best, second = ranked[0], ranked[1]
    kind = F.when((F.col("paragraphs") == 0) | (best["score"] < 1), "GENERIC").otherwise(best["kind"])
    sure = (F.col("paragraphs") == 0) | ((best["score"] >= 3) & (best["score"] - second["score"] >= 1.5))
    return scored.select("book_id", "literature", "scientific", "educational", kind.alias("kind"), sure.alias("conclusive"))


def sampled_pages(pages: DataFrame, page_counts: DataFrame, first: int = 30, spread: int = 20) -> DataFrame:
    """The first pages and about spread of the rest, evenly."""
    step = F.greatest(F.lit(1), F.floor((F.col("page_count") - first) / spread))
    joined = pages.join(page_counts, "book_id")
    return joined.where((F.col("page") <= first) | ((F.col("page") - first - 1) % step == 0)).drop("page_count")


# Python where order decides ------------------------------------------------------------------------


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches: Python objects are made of so many rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@pandas_udf(T.ArrayType(T.StringType()))
def sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: plain.sentences(t or ""))


@pandas_udf(T.ArrayType(T.StringType()))
def paragraphs(text: pd.Series, headers: pd.Series, footers: pd.Series) -> pd.Series:
    listed = lambda x: [] if x is None else list(x)
    return pd.Series([plain.paragraphs(t or "", listed(h), listed(f)) for t, h, f in zip(text, headers, footers, strict=True)])


@pandas_udf(T.StringType())
def mend_hyphens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain.mend_hyphens(t))


@pandas_udf(T.StringType())
def spoken(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain.spoken(t))


@pandas_udf(T.StringType())
def join_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([plain.join_overlap(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(T.BooleanType())
def heading(text: pd.Series) -> pd.Series:
    return text.map(lambda t: plain.is_heading(t or ""))


@pandas_udf(T.StringType())
def name_key(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else plain.name_key(t))


def citations(fragments: list[tuple[int, int]]):
    """A function of an answer column: (text, pages) with only the citations of these fragments."""

    @pandas_udf("text string, pages array<int>")
    def rewritten(answer: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plain.rewrite_citations(a or "", fragments) for a in answer], columns=["text", "pages"])

    return rewritten


def mentions(texts: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, start, end, name of every name found. names is the list of one book's people."""
    finder = plain.NameFinder(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TEXTS_AT_ONCE):
            rows = [(i, a, b, names[n]) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for a, b, n in finder.find(t or "")]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "start", "end", "name"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, start int, end int, name string")


def packed_chunks(paragraphs_of_chapters: DataFrame, target: int = 350) -> DataFrame:
    """(book_id, chapter, page, paragraph_no, text) packed in order, one chapter at a time: chapters are a bounded run of pages."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["page", "paragraph_no"])
        found = plain.chunks(list(zip(ordered["page"], ordered["text"], strict=True)), target)
        return pd.DataFrame([(key[0], key[1], i, c.text, c.start_page, c.end_page, c.char_start, c.char_end, c.tokens) for i, c in enumerate(found)], columns=_CHUNK_COLUMNS)

    return paragraphs_of_chapters.groupBy("book_id", "chapter").applyInPandas(pack, _CHUNK_SCHEMA)


_CHUNK_SCHEMA = "book_id string, chapter int, number int, text string, start_page int, end_page int, char_start long, char_end long, tokens int"
_CHUNK_COLUMNS = [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]


def packed_blocks(pages: DataFrame, most: int) -> DataFrame:
    """(book_id, chapter, page, text): whole pages of a chapter packed into blocks of at most most characters."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("page")
        blocks = plain.page_blocks(list(zip(ordered["page"], ordered["text"], strict=True)), most)
        return pd.DataFrame([(*key, i, b[0][0], b[-1][0], sum(len(t) for _, t in b)) for i, b in enumerate(blocks)], columns=["book_id", "chapter", "block", "first", "last", "characters"])

    return pages.groupBy("book_id", "chapter").applyInPandas(pack, "book_id string, chapter int, block int, first int, last int, characters long")


def outlines(headings: DataFrame, page_count: int) -> DataFrame:
    """(book_id, page, level, idx, text) headings as outline entries, one book at a time."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["page", "idx"])
        return pd.DataFrame([(*key, *e) for e in plain.outline(list(zip(ordered["page"], ordered["level"], ordered["text"], strict=True)), page_count)], columns=["book_id", "page", "depth", "title"])

    return headings.groupBy("book_id").applyInPandas(build, "book_id string, page int, depth int, title string")


_PLACE = "kind string, target string, stretch string, expression string, rest string, refs array<struct<kind:string,number:int,part:int>>, part int"


def located(questions: DataFrame, literature: bool) -> DataFrame:
    """questions (question, other columns) with kind, target, stretch, expression, rest (the question without its place), refs and part; nulls where it names no place."""

    @pandas_udf(_PLACE)
    def read(question: pd.Series) -> pd.DataFrame:
        rows, known = [], {q: places.detect(q or "", literature) for q in question.unique()}
        for q in question:
            p = known[q]
            refs = [{"kind": k, "number": n, "part": part} for k, n, part in p.chapters] if p else []
            rows.append((p.kind, p.target, p.stretch, p.expression, places.strip_place(q, p.span), refs, p.part) if p else (None, None, None, None, q, refs, None))
        found = pd.DataFrame(rows, columns=[c.split()[0] for c in ("kind", "target", "stretch", "expression", "rest", "refs", "part")])
        return found.astype({"part": "Int32"})

    dealt = questions.repartition(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few small partitions of chapters make many questions
    return dealt.withColumn("_place", read("question")).select(*questions.columns, "_place.*")


LINE_COLUMNS = ("text", "left", "right", "baseline", "size", "bold", "first_word")


def typography(lines: DataFrame) -> DataFrame:
    """book_id, body, headings, width, gap, bold_body of each book's lines (book_id, page, n and LINE_COLUMNS).

    Sums by half-point size, then medians over plain lines; only sizes and distinct distances of a book meet in one task.
    """
    bucket = F.floor(F.col("size") * 2 + 0.5) / 2
    full = lines.where((F.trim("text") != "") & (F.col("size") > 0)).withColumn("bucket", bucket)
    letters = F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("letters")
    bold = F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).alias("bold_letters")
    sizes = full.groupBy("book_id", "bucket").agg(letters, bold)
    most = F.max_by(F.struct("bucket", "letters", "bold_letters"), F.struct(F.col("letters"), -F.col("bucket")))
    books = sizes.groupBy("book_id").agg(most.alias("_most"), F.sort_array(F.collect_list(F.struct("bucket", "letters")), False).alias("all"))
    large = F.filter("all", lambda x: (x["bucket"] >= F.col("_most.bucket") * layout.HEADING_RATIO) & (x["letters"] < F.col("_most.letters") * layout.HEADING_SHARE))

    def cluster(found: Column, x: Column) -> Column:
        near = (F.size(found) > 0) & (F.try_element_at(found, F.lit(-1)) - x["bucket"] <= layout.HEADING_CLUSTER)
        return F.when(near, F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(x["bucket"]))).otherwise(F.concat(found, F.array(x["bucket"])))

    headings = F.aggregate(large, F.array().cast("array<double>"), cluster)
    books = books.select("book_id", F.col("_most.bucket").alias("body"), headings.alias("headings"), (F.col("_most.bold_letters") * 2 > F.col("_most.letters")).alias("bold_body"))
    plain_lines = full.join(books.select("book_id", "body"), "book_id").where("bucket = body")
    gap = F.col("baseline") - F.lag("baseline").over(Window.partitionBy("book_id", "page").orderBy("n"))
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    gaps = plain_lines.withColumn("gap", gap).where(F.col("gap").between(F.col("body") * layout.GAP_RANGE[0], F.col("body") * layout.GAP_RANGE[1]))
    widths = plain_lines.groupBy("book_id", "page").agg((F.max("right") - F.min("left")).alias("width"), F.count("*").alias("n")).where(F.col("n") >= layout.EDGE_LINES)
    joined = books.join(gaps.groupBy("book_id").agg(upper("gap").alias("gap")), "book_id", "left").join(widths.groupBy("book_id").agg(upper("width").alias("width")), "book_id", "left")
    return joined.select("book_id", "body", "headings", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("gap", F.col("body") * layout.LEADING).alias("gap"), "bold_body")


def layout_blocks(pages: DataFrame, types: DataFrame) -> DataFrame:
    """book_id, page, number, text, level: the blocks of pages (book_id, page, lines: an array of structs of LINE_COLUMNS), read with their book's typography."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, PAGES_AT_ONCE):
            found = []
            for row in part.to_pylist():
                kind = layout.Typography(row["body"], tuple(row["headings"]), row["width"], row["gap"], bool(row["bold_body"]))
                lines = [layout.Line(*(line[c] for c in LINE_COLUMNS)) for line in row["lines"]]
                found += [(row["book_id"], row["page"], *b) for b in layout.numbered(layout.blocks(lines, kind))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["book_id", "page", "number", "text", "level"])

    typed = pages.select("book_id", "page", "lines").join(types, "book_id")
    return typed.mapInArrow(run, "book_id string, page int, number int, text string, level int")


def passages(asked: DataFrame) -> DataFrame:
    """(passage_id, passage, segments array<string>) as passage_id, segment, start, end of what each passage covers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *span) for i, p, s in zip(batch["passage_id"], batch["passage"], batch["segments"], strict=True) for span in layout.locate(p, list(s))]
            yield pd.DataFrame(rows, columns=["passage_id", "segment", "start", "end"])

    return asked.select("passage_id", "passage", "segments").mapInPandas(run, "passage_id long, segment int, start int, end int")
