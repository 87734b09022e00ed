"""Text queries over the library's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as plain
from lectern.operators import chapters, name_tables, page_edges, text
from lectern.plans.registry import query
from lectern.sources import library, scratch
from lectern.sources.tables import table



def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _trimmed(text: Column) -> Column:
    """As SQL's trim: without blanks of any width at its ends. (F.trim itself takes the place in an array for the characters to trim.)"""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+$", "")


@query("token_estimates", "SELECT doc_id, CAST(greatest(1, floor(len(list_filter(string_split_regex(text, '[ \n]'), lambda w: trim(w) <> '')) * 1.3::DOUBLE)) AS INTEGER) AS tokens FROM documents")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


LANGUAGE_SQL = f"""hits AS (SELECT source AS book_id, len(list_filter(words, lambda w: list_contains([{_quoted(text.SPANISH)}], w))) AS es, len(list_filter(words, lambda w: list_contains([{_quoted(text.ENGLISH)}], w))) AS en
  FROM (SELECT source, regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM documents))"""


@query("detect_language", f"WITH {LANGUAGE_SQL}, s AS (SELECT book_id, CAST(sum(es) AS BIGINT) AS es, CAST(sum(en) AS BIGINT) AS en FROM hits GROUP BY book_id) SELECT book_id, es, en, CASE WHEN en >= 20 AND en > es THEN 'ENGLISH' ELSE 'SPANISH' END AS language FROM s")
def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    return text.language(table(spark, folder, "documents").select(F.col("source").alias("book_id"), "text"), "book_id")


HEADED_SQL = "headed AS (SELECT source AS book_id, doc_id, 'Vol. ' || doc_id % 5 || '  of ' || source || chr(10) || text || chr(10) || 'Printed for ' || source || chr(10) || '- ' || doc_id || ' -' AS text FROM documents)"


def _headed(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a running head, a running foot and a page number."""
    number, book = F.col("doc_id").cast("string"), F.col("source")
    head = F.concat(F.lit("Vol. "), (F.col("doc_id") % 5).cast("string"), F.lit("  of "), book)
    return table(spark, folder, "documents").select(book.alias("book_id"), F.concat_ws("\n", head, "text", F.concat(F.lit("Printed for "), book), F.concat(F.lit("- "), number, F.lit(" -"))).alias("text"))


@query(
    "header_footer_lines",
    rf"""WITH {HEADED_SQL}, l AS (SELECT book_id, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM headed),
e AS (SELECT book_id, 'top' AS place, unnest(lines[1:4]) AS line FROM l UNION ALL SELECT book_id, 'bottom', unnest(lines[greatest(len(lines) - 3, 1):]) FROM l),
k AS (SELECT book_id, place, lower(regexp_replace(trim(line), '\s+', ' ', 'g')) AS line FROM e WHERE NOT regexp_matches(line, '^\s*(?:(?:p[áa]g(?:\.|ina)?\.?\s*)?[0-9]+\s*(?:de\s+[0-9]+)?|[-–—]\s*[0-9]+\s*[-–—]|[0-9]+\s*/\s*[0-9]+)\s*$', 'i')),
f AS (SELECT book_id, place, unnest(list_distinct([line, regexp_replace(line, '[0-9]+', '#', 'g')])) AS line FROM k),
c AS (SELECT book_id, place, line, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT book_id, greatest(2, floor(count(*) * 0.35)) AS least FROM headed GROUP BY book_id)
SELECT book_id, place, line, n FROM c JOIN s USING (book_id) WHERE n >= least AND length(line) BETWEEN 2 AND 160""",
)
def header_footer_lines(spark: SparkSession, folder: str) -> DataFrame:
    return text.repeated_margin_lines(_headed(spark, folder))


@query(
    "running_heads",
    r"""WITH h AS (SELECT source AS book_id, doc_id, left(trim(string_split(text, chr(10))[1]), 80) AS head FROM documents), s AS (SELECT * FROM h WHERE head <> ''),
c AS (SELECT *, count(*) OVER (PARTITION BY book_id, lower(head)) AS n, count(*) OVER (PARTITION BY book_id) AS total FROM s)
SELECT book_id, doc_id, head FROM c WHERE NOT (n >= 3 AND n > 0.3 * total) AND NOT regexp_matches(head, '^\p{Ll}')""",
)
def running_heads(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "documents").select(F.col("source").alias("book_id"), "doc_id", F.split("text", "\n")[0].alias("head"))
    return text.running_heads(heads).select("book_id", "doc_id", "head")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CLASS_SQL = f"""lines AS (SELECT source AS book_id, unnest(string_split(text, chr(10))) AS line FROM documents),
sums AS (SELECT book_id, count(*) FILTER (trim(line) <> '') AS paragraphs, count(*) FILTER (trim(line) <> '' AND regexp_matches(line, {_sql(text.DIALOGUE)})) AS dialogue,
  {" + ".join(f"max(CAST(regexp_matches(line, {_sql(p)}) AS INTEGER))" for p in text.SCIENTIFIC_SECTIONS)} + max(CAST(regexp_matches(line, {_sql(text.KEYWORDS)}) AS INTEGER)) + 2 * max(CAST(regexp_matches(line, {_sql(text.DOI)}) AS INTEGER)) AS found,
  sum(len(regexp_extract_all(line, {_sql(text.AUTHOR_YEAR)})) + len(regexp_extract_all(line, {_sql(text.NUMBERED_CITATION)}))) AS citations,
  count(*) FILTER (regexp_matches(line, {_sql(text.EDUCATIONAL)})) AS headings, count(*) FILTER (regexp_matches(line, {_sql(text.NUMBERED_QUESTION)})) AS questions FROM lines GROUP BY book_id),
scored AS (SELECT book_id, paragraphs, CASE WHEN paragraphs > 0 AND dialogue / paragraphs >= 0.12 THEN 3.0 WHEN paragraphs > 0 AND dialogue / paragraphs >= 0.04 THEN 2.0 ELSE 0.0 END::DOUBLE AS literature,
  (found + CASE WHEN citations >= 15 THEN 3.0 WHEN citations >= 4 THEN 1.0 ELSE 0.0 END)::DOUBLE AS scientific, (least(headings, 3) + CASE WHEN questions >= 8 THEN 2.0 ELSE 0.0 END)::DOUBLE AS educational FROM sums),
ranked AS (SELECT *, list_reverse_sort([literature, scientific, educational]) AS best FROM scored)"""


@query(
    "classify_documents",
    f"""WITH {CLASS_SQL} SELECT book_id, literature, scientific, educational,
  CASE WHEN paragraphs = 0 OR best[1] < 1 THEN 'GENERIC' WHEN literature = best[1] THEN 'LITERATURE' WHEN scientific = best[1] THEN 'SCIENTIFIC' ELSE 'EDUCATIONAL' END AS kind,
  paragraphs = 0 OR (best[1] >= 3 AND best[1] - best[2] >= 1.5) AS conclusive FROM ranked""",
)
def classify_documents(spark: SparkSession, folder: str) -> DataFrame:
    return text.document_scores(table(spark, folder, "documents").select(F.col("source").alias("book_id"), "text"))


COST_SQL = f"""{library.CHUNKS_SQL}, t AS (SELECT c.book_id, h.number, sum(length(c.text)) // 4 AS tokens FROM lib_chunks c JOIN lib_chapters h ON h.book_id = c.book_id AND c.start_page BETWEEN h.start_page AND h.end_page GROUP BY 1, 2)"""


@query(
    "key_point_cost",
    f"""WITH {COST_SQL} SELECT book_id, number, CAST(tokens AS BIGINT) AS tokens, CAST(tokens + 1000 * ceil(tokens / 30000.0) AS BIGINT) AS input_tokens, CAST(300 * ceil(tokens / 30000.0) AS BIGINT) AS output_tokens,
CASE WHEN pages <= 2 THEN 1 ELSE 2 END AS least_points, CAST(least(greatest((pages + 1) // 2, 3), 15) AS INTEGER) AS most_points FROM t JOIN (SELECT book_id, number, end_page - start_page + 1 AS pages FROM lib_chapters) USING (book_id, number) WHERE tokens > 0""",
)
def key_point_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters are blocks of pages, so a page's chapter is arithmetic and the sizes are partial sums."""
    pages = library.pages(spark, folder, "text")
    number = F.floor((F.col("page") - 1) / library.PAGES_PER_CHAPTER).cast("int") + 1
    sums = pages.groupBy("book_id", number.alias("number")).agg(F.floor(F.sum(F.length("text")) / 4).alias("tokens"), F.count("*").alias("pages"))
    blocks = F.ceil(F.col("tokens") / 30000)
    return sums.where("tokens > 0").select(
        "book_id", "number", "tokens", (F.col("tokens") + 1000 * blocks).alias("input_tokens"), (300 * blocks).alias("output_tokens"),
        F.when(F.col("pages") <= 2, 1).otherwise(2).alias("least_points"), F.least(F.greatest(F.floor((F.col("pages") + 1) / 2), F.lit(3)), F.lit(15)).cast("int").alias("most_points"),
    )


def _by_chapter(spark: SparkSession, folder: str) -> DataFrame:
    chapter = F.floor((F.col("page") - 1) / library.PAGES_PER_CHAPTER).cast("int") + 1
    return library.pages(spark, folder, "text").select("book_id", chapter.alias("chapter"), "page", "text")


@query(
    "key_point_blocks",
    f"""WITH RECURSIVE {library.PAGES_SQL}, p AS (SELECT book_id, (page - 1) // 20 + 1 AS chapter, page, length(text) AS n FROM lib_pages),
r AS (SELECT book_id, chapter, page, n, 0 AS block, n AS size FROM p WHERE (page - 1) % 20 = 0
  UNION ALL SELECT p.book_id, p.chapter, p.page, p.n, CASE WHEN r.size + p.n <= 20000 THEN r.block ELSE r.block + 1 END, CASE WHEN r.size + p.n <= 20000 THEN r.size + p.n ELSE p.n END
  FROM r JOIN p ON p.book_id = r.book_id AND p.chapter = r.chapter AND p.page = r.page + 1)
SELECT book_id, CAST(chapter AS INTEGER) AS chapter, CAST(block AS INTEGER) AS block, CAST(min(page) AS INTEGER) AS first, CAST(max(page) AS INTEGER) AS last, CAST(sum(n) AS BIGINT) AS characters FROM r GROUP BY ALL""",
)
def key_point_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return text.packed_blocks(_by_chapter(spark, folder), 20_000)


_PACKED = "lambda acc, x: CASE WHEN length(string_split(acc, chr(1))[-1]) + length(x) + 1 <= 300 THEN acc || ' ' || x ELSE acc || chr(1) || x END"


def _tokens(t: str) -> str:
    return f"CAST(greatest(1, floor(len(list_filter(string_split_regex({t}, '[ \n]'), lambda w: trim(w) <> '')) * 1.3::DOUBLE)) AS INTEGER)"


def _sentences(words: str) -> str:
    """SQL for the sentences of a list of words."""
    before = f"regexp_extract({words}[i - 1], '^(.*?)([.?!…])[.?!…»\"”'')\\]]*$', 1)"
    mark = f"regexp_extract({words}[i - 1], '^(.*?)([.?!…])[.?!…»\"”'')\\]]*$', 2)"
    stem = f"regexp_extract({before}, '[\\p{{L}}º]*$')"
    short = f"((length({stem}) = 1 AND {stem} <> lower({stem})) OR lower({stem}) IN ({_quoted(plain.ABBREVIATIONS)}))"
    ends = f"{mark} <> '' AND regexp_matches(left({words}[i], 1), '[\\p{{Lu}}\\p{{Nd}}¿¡«\"“—('']') AND ({mark} <> '.' OR NOT {short})"
    put = f"lambda i: CASE WHEN i = 1 THEN {words}[1] WHEN {ends} THEN chr(2) || {words}[i] ELSE ' ' || {words}[i] END"
    return f"string_split(array_to_string(list_transform(range(1, len({words}) + 1), {put}), ''), chr(2))"


@query(
    "chunks_packed",
    rf"""WITH RECURSIVE {library.PAGES_SQL}, l AS (SELECT book_id, (page - 1) // 20 + 1 AS chapter, page, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM lib_pages),
w AS (SELECT *, {_tokens("text")} AS tokens, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS words FROM l WHERE trim(text) <> ''),
s AS (SELECT *, {_sentences("words")} AS sentences FROM w),
u0 AS (SELECT book_id, chapter, page, n, unnest(CASE WHEN tokens <= 350 THEN [text] ELSE sentences END) AS text, unnest(CASE WHEN tokens <= 350 THEN [sentences[-1]] ELSE sentences END) AS last, unnest(range(CASE WHEN tokens <= 350 THEN 1 ELSE len(sentences) END)) AS k FROM s),
u1 AS (SELECT *, CASE WHEN length(last) <= 300 THEN last ELSE string_split(list_reduce(string_split(regexp_replace(last, '([,;:]) ', '\1' || chr(1), 'g'), chr(1)), {_PACKED}), chr(1))[-1] END AS part FROM u0),
u2 AS (SELECT *, CASE WHEN length(part) <= 300 THEN part ELSE string_split(list_reduce(string_split(part, ' '), {_PACKED}), chr(1))[-1] END AS tail FROM u1),
u AS (SELECT *, {_tokens("text")} AS tokens, {_tokens("tail")} AS tail_tokens FROM u2),
c AS (SELECT book_id, chapter, list(text ORDER BY page, n, k) AS texts, list(page ORDER BY page, n, k) AS pages, list(tail ORDER BY page, n, k) AS tails, list(tail_tokens ORDER BY page, n, k) AS tt, list(tokens ORDER BY page, n, k) AS tk, count(*) AS units FROM u GROUP BY ALL),
d AS (SELECT *, list_prepend(0, list_transform(range(1, units + 1), lambda i: CAST(list_sum(tk[1:i]) AS BIGINT))) AS sums FROM c),
r AS (SELECT book_id, chapter, 0 AS number, 0::BIGINT AS first, false AS repeated, 0 AS extra, least(units, greatest(list_max(list_filter(range(0, units + 1), lambda i: sums[i + 1] <= 350)), 1)) AS after FROM d
  UNION ALL SELECT book_id, chapter, number, first, repeated, extra, least(units, greatest(list_max(list_filter(range(0, units + 1), lambda i: sums[i + 1] <= sums[first + 1] + 350 - extra)), first + CASE WHEN repeated THEN 1 ELSE 2 END)) AS after
  FROM (SELECT r.book_id, r.chapter, r.number + 1 AS number, r.after AS first, d.tt[r.after] < 175 AS repeated, CASE WHEN d.tt[r.after] < 175 THEN d.tt[r.after] ELSE 0 END AS extra, d.units, d.sums FROM r JOIN d ON r.book_id = d.book_id AND r.chapter = d.chapter WHERE r.after < d.units) x),
t AS (SELECT r.*, array_to_string(list_concat(CASE WHEN repeated THEN [tails[first]] ELSE [] END, texts[first + 1:after]), chr(10) || chr(10)) AS text, CASE WHEN repeated THEN pages[first] ELSE pages[first + 1] END AS start_page, pages[after] AS end_page,
  CAST(extra + sums[after + 1] - sums[first + 1] AS INTEGER) AS tokens FROM r JOIN d USING (book_id, chapter)),
k AS (SELECT * FROM t WHERE NOT (NOT repeated AND after - first = 1 AND number > 0 AND tokens < 175))
SELECT book_id, CAST(chapter AS INTEGER) AS chapter, CAST(number AS INTEGER) AS number, text, CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page,
  CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS char_start, CAST(sum(length(text)) OVER w AS BIGINT) AS char_end, tokens FROM k WINDOW w AS (PARTITION BY book_id, chapter ORDER BY number)""",
)
def chunks_packed(spark: SparkSession, folder: str) -> DataFrame:
    parts = _by_chapter(spark, folder).select("book_id", "chapter", "page", F.posexplode(F.split("text", "\n")).alias("paragraph_no", "text")).where("trim(text) <> ''")
    return text.packed_chunks(parts)


@query(
    "phrases",
    rf"""WITH a AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS ln FROM a),
w AS (SELECT doc_id, ln, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS i FROM l WHERE line <> ''),
m AS (SELECT *, regexp_extract(word, '^(.*?)([.?!…])[.?!…»"”'')\]]*$', 2) AS mark, regexp_extract(regexp_extract(word, '^(.*?)([.?!…])[.?!…»"”'')\]]*$', 1), '[\p{{L}}º]*$') AS stem,
  left(lead(word) OVER (PARTITION BY doc_id, ln ORDER BY i), 1) AS following FROM w),
b AS (SELECT *, CAST(mark <> '' AND regexp_matches(following, '[\p{{Lu}}\p{{Nd}}¿¡«"“—(''\x{{0000}}]') AND (mark <> '.' OR NOT ((length(stem) = 1 AND stem <> lower(stem)) OR lower(stem) IN ({_quoted(plain.ABBREVIATIONS)}))) AS INTEGER) AS ends FROM m),
g AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, ln ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM b),
s AS (SELECT doc_id, ln, sentence, string_agg(word, ' ' ORDER BY i) AS text FROM g GROUP BY ALL),
c AS (SELECT doc_id, ln, sentence, CASE WHEN length(text) <= 300 THEN [text] ELSE flatten(list_transform(string_split(list_reduce(string_split(regexp_replace(text, '([,;:]) ', '\1' || chr(1), 'g'), chr(1)), {_PACKED}), chr(1)),
  lambda p: CASE WHEN length(p) <= 300 THEN [p] ELSE string_split(list_reduce(string_split(p, ' '), {_PACKED}), chr(1)) END)) END AS parts FROM s),
u AS (SELECT doc_id, ln, sentence, unnest(parts) AS phrase, unnest(range(len(parts))) AS k FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ln, sentence, k) - 1 AS INTEGER) AS number, phrase FROM u""",
)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("number", "phrase"))


@query("page_paragraphs")
def page_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", ""), r"<[^>]*>", "\n")
    none = F.array().cast("array<string>")
    return table(spark, folder, "pages").select("page_id", F.posexplode(text.paragraphs(plain, none, none)).alias("number", "paragraph"))


@query(
    "heading_outline",
    r"""WITH f AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS book_id, CAST(page_id AS INTEGER) AS page, regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>') AS tags FROM pages),
e AS (SELECT book_id, page, unnest(tags) AS tag, unnest(range(len(tags))) AS idx FROM f),
h AS (SELECT book_id, page, idx, CAST(substr(tag, 3, 1) AS INTEGER) AS level, trim(regexp_replace(tag, '<[^>]*>', '', 'g')) AS text FROM e),
a AS (SELECT *, length(text) <= 30 AND regexp_full_match(trim(text), '(?i)(cap[ií]tulo|parte|libro|tema|unidad|chapter|part|book)\s+[\p{L}\p{N}_.]+') AS label FROM h WHERE regexp_matches(text, '[\p{L}\p{N}]')),
b AS (SELECT *, label AND lead(page) OVER w = page AND lead(level) OVER w >= level AS joins, lead(text) OVER w AS following FROM a WINDOW w AS (PARTITION BY book_id ORDER BY page, idx)),
u AS (SELECT book_id, page, idx, level, CASE WHEN joins THEN text || '. ' || following ELSE text END AS text FROM (SELECT *, coalesce(lag(joins) OVER (PARTITION BY book_id ORDER BY page, idx), false) AS taken FROM b) WHERE NOT taken),
n AS (SELECT book_id, level, count(*) AS n, count(DISTINCT page) AS pages FROM u GROUP BY ALL), t AS (SELECT book_id, min(level) AS top FROM n WHERE pages >= 2 AND n <= 500 GROUP BY book_id),
v AS (SELECT n.*, top, row_number() OVER w - 1 AS depth, sum(n) OVER w AS upto FROM n JOIN t USING (book_id) WHERE level >= top WINDOW w AS (PARTITION BY book_id ORDER BY level)),
k AS (SELECT book_id, level, top, depth FROM v WHERE depth = 0 OR (depth <= 2 AND upto <= 600)),
o AS (SELECT u.*, depth, top, bool_or(u.level = top) OVER (PARTITION BY u.book_id ORDER BY page, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started FROM u JOIN k ON k.book_id = u.book_id AND k.level = u.level)
SELECT book_id, page, CAST(CASE WHEN started THEN depth ELSE 0 END AS INTEGER) AS depth, rtrim(trim(left(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.\.\s', '. ', 'g'), 120)), ':;,') AS title FROM o""",
)
def heading_outline(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>"), F.lit(0))
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    each = table(spark, folder, "pages").select(host.alias("book_id"), F.col("page_id").cast("int").alias("page"), F.posexplode(found).alias("idx", "tag"))
    heads = each.select("book_id", "page", "idx", F.substr("tag", F.lit(3), F.lit(1)).cast("int").alias("level"), F.trim(F.regexp_replace("tag", "<[^>]*>", "")).alias("text"))
    return text.outlines(heads, 1000)


@query(
    "mentions_by_name",
    r"""WITH n AS (SELECT strip_accents(lower(w)) AS key, min(w) AS name FROM (SELECT regexp_extract(text, '^(\p{Lu}\p{L}{3,})', 1) AS w FROM benchmark) WHERE w <> '' GROUP BY 1),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS pages FROM w JOIN n ON strip_accents(lower(word)) = key WHERE regexp_matches(word, '^\p{Lu}') GROUP BY name""",
)
def mentions_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions in all pages of a cast: the words that open the benchmark's items, one an item at most."""
    openings = table(spark, folder, "benchmark").select(F.regexp_extract("text", r"^(\p{Lu}\p{L}{3,})", 1).alias("w")).where("w <> ''").distinct()
    found = text.mentions(table(spark, folder, "documents"), sorted(r.w for r in openings.collect()))
    return found.groupBy("name").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("pages"))


#: Questions about each chapter of each book; {n} is its number, {m} the next.
QUESTIONS = (
    "¿Qué pasa al final del capítulo {n}?", "¿Cómo termina el libro?", "Resume los capítulos {n} y {m}", "¿Quién muere al final?", "¿De qué trata el capítulo anterior?",
    "¿Qué hace por fin Ana?", "¿Qué pasó después del crimen?",
)


@query(
    "locate_question",
    f"""WITH {library.CHAPTERS_SQL}, c AS (SELECT c.*, page_count, lead(end_page, 1, end_page) OVER w AS next_end, lag(start_page) OVER w AS before_start, lag(end_page) OVER w AS before_end
  FROM lib_chapters c JOIN lib_books USING (book_id) WINDOW w AS (PARTITION BY book_id ORDER BY number)),
q AS (SELECT c.*, unnest(range(7)) AS way FROM c),
r AS (SELECT *, CAST(greatest(1, ceil((end_page - start_page + 1) * 0.25)) AS INTEGER) AS of_chapter, CAST(greatest(1, ceil(page_count * 0.25)) AS INTEGER) AS of_book FROM q)
SELECT book_id, number, CAST(way AS INTEGER) AS way, ['clear', 'clear', 'clear', 'doubtful', 'clear', NULL, 'event'][way + 1] AS kind, ['chapters', 'book', 'chapters', 'book', 'chapters', NULL, 'event'][way + 1] AS target,
  ['END', 'END', NULL, 'END', NULL, NULL, NULL][way + 1] AS stretch, ['¿Qué pasa?', '¿Cómo?', 'Resume', '¿Quién muere?', '¿De qué trata?', '¿Qué hace por fin Ana?', '¿Qué pasó?'][way + 1] AS rest,
  CASE way WHEN 0 THEN end_page - of_chapter + 1 WHEN 1 THEN page_count - of_book + 1 WHEN 3 THEN page_count - of_book + 1 WHEN 2 THEN start_page WHEN 4 THEN before_start END AS first,
  CASE way WHEN 0 THEN end_page WHEN 1 THEN page_count WHEN 3 THEN page_count WHEN 2 THEN next_end WHEN 4 THEN before_end END AS last FROM r""",
)
def locate_question(spark: SparkSession, folder: str) -> DataFrame:
    """Questions about every chapter, asked on its first page, read and looked up in the book."""
    listed = library.chapters(spark, folder)
    number = F.col("number")
    said = F.array(*[F.replace(F.replace(F.lit(q), F.lit("{n}"), number.cast("string")), F.lit("{m}"), (number + 1).cast("string")) for q in QUESTIONS])
    asked = listed.join(library.books(spark, folder), "book_id").select("book_id", "number", F.col("start_page").alias("page"), "page_count", F.posexplode(said).alias("way", "question"))
    found = chapters.pages_of(scratch.settled(text.located(asked, literature=True), scratch.workspace(spark, "located")), listed)
    return found.select("book_id", "number", "way", "kind", "target", "stretch", "rest", F.get("ranges", F.lit(0))["first"].alias("first"), F.try_element_at("ranges", F.lit(-1))["last"].alias("last"))


@query(
    "citation_rewrite",
    """WITH k AS (SELECT doc_id, doc_id BETWEEN 5 AND 8 OR doc_id BETWEEN 100 AND 400 AS kept FROM documents) SELECT doc_id,
  CASE WHEN kept THEN 'Uno [p. ' || doc_id || '], dos [p. 7-9, ' || doc_id || '].' ELSE 'Uno, dos [p. 7-9].' END AS text, CASE WHEN kept THEN list_sort(list_distinct([CAST(doc_id AS INTEGER), 7])) ELSE [7] END AS pages FROM k""",
)
def citation_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    answer = F.concat(F.lit("Uno [p. "), number, F.lit("] , dos [p. 7-9, "), number, F.lit("] ."))
    rewritten = text.citations([(5, 8), (100, 400)])(answer)
    return table(spark, folder, "documents").select("doc_id", rewritten.alias("r")).select("doc_id", "r.text", F.array_sort("r.pages").alias("pages"))


@query(
    "join_overlap_text",
    """WITH p AS (SELECT doc_id, left(text, length(text) // 2 + least(greatest(length(text) // 4, 10), 1500)) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents),
n AS (SELECT *, list_max(list_filter(range(10, least(length(a), length(b), 1500) + 1), lambda n: right(a, n) = left(b, n))) AS n FROM p)
SELECT doc_id, sha256(CASE WHEN n IS NULL THEN a || chr(10) || chr(10) || b ELSE a || substr(b, n + 1) END) AS joined_sha256 FROM n""",
)
def join_overlap_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in two parts that overlap by a quarter of it, within the 10 to 1,500 characters that are looked for."""
    half, overlap = F.floor(F.length("text") / 2).cast("int"), F.least(F.greatest(F.floor(F.length("text") / 4), F.lit(10)), F.lit(1500)).cast("int")
    joined = text.join_overlap(F.left("text", half + overlap), F.substr("text", half + 1))
    return table(spark, folder, "documents").select("doc_id", F.sha2(joined.cast("binary"), 256).alias("joined_sha256"))


def _replaced(column: str) -> str:
    for written, said in plain.SPOKEN["es"]:
        column = f"replace({column}, '{written}', '{said}')"
    return column


@query(
    "spoken_phrases",
    rf"""WITH digits AS (SELECT ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'] AS d),
rom AS (SELECT n, repeat('M', CAST(n // 1000 AS BIGINT)) || translate(d[n // 100 % 10 + 1], 'IVX', 'CDM') || translate(d[n // 10 % 10 + 1], 'IVX', 'XLC') || d[n % 10 + 1] AS roman FROM digits, range(1, 4000) t(n)),
tab AS (SELECT map(list(roman), list(CAST(n AS VARCHAR))) AS values_of FROM rom),
a AS (SELECT conv_id, turn, rtrim(text, ' ' || chr(10)) LIKE '%.' AS closed, {_replaced("text")} AS said FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN closed AND rtrim(said, ' ' || chr(10)) NOT LIKE '%.' THEN rtrim(said, ' ' || chr(10)) || '.' ELSE said END AS said FROM a),
c AS (SELECT *, list_distinct(regexp_extract_all(said, '(?i)\b(?:cap[ií]tulo|parte|libro|tomo|siglo|volumen|acto|escena|lecci[oó]n)\s+[IVXLCDM]+\b')) AS found FROM b)
SELECT conv_id, turn, list_reduce(list_prepend(said, list_transform(list_reverse_sort(list_transform(found, lambda m: lpad(CAST(length(m) AS VARCHAR), 5, '0') || m)), lambda m: substr(m, 6))),
  lambda acc, m: CASE WHEN values_of[upper(regexp_extract(m, '[IVXLCDMivxlcdm]+$'))] IS NULL THEN acc ELSE replace(acc, m, regexp_extract(m, '^(\S+)', 1) || ' ' || values_of[upper(regexp_extract(m, '[IVXLCDMivxlcdm]+$'))]) END) AS spoken FROM c, tab""",
)
def spoken_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", text.spoken("text").alias("spoken"))


def _layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pages with a plain geometry: the first of a page is large, letters are five points wide."""
    texts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def line(t, n):
        return F.struct(
            t.alias("text"), F.lit(50.0).alias("left"), (50 + F.least(F.length(t), F.lit(60)) * 5.0).alias("right"), (100 + n * 12.0).alias("baseline"),
            F.when(n == 0, 16.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(20.0).alias("first_word"),
        )

    return library.pages(spark, folder, "text").select("book_id", "page", F.transform(texts, line).alias("lines"))


def _typography(layouts: DataFrame) -> DataFrame:
    each = layouts.select("book_id", "page", F.posexplode("lines").alias("n", "line")).select("book_id", "page", "n", "line.*")
    return text.typography(each)


TYPOGRAPHY_SQL = f"""{library.PAGES_SQL}, t AS (SELECT book_id, page, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS texts FROM lib_pages),
l AS (SELECT book_id, page, unnest(texts) AS text, unnest(range(len(texts))) AS n FROM t),
z AS (SELECT *, CASE WHEN n = 0 THEN 16.0 ELSE 10.0 END::DOUBLE AS size, 50.0 + least(length(text), 60) * 5.0 AS edge, 100 + n * 12.0 AS baseline FROM l),
s AS (SELECT book_id, size, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS letters FROM z GROUP BY ALL),
m AS (SELECT book_id, arg_max(size, letters * 1000 - size) AS body, max(letters) AS most FROM s GROUP BY book_id),
h AS (SELECT s.book_id, list(size ORDER BY size DESC) AS headings FROM s JOIN m USING (book_id) WHERE size >= body * 1.12 AND letters < most * 0.5 GROUP BY s.book_id),
p AS (SELECT z.*, body, baseline - lag(baseline) OVER (PARTITION BY z.book_id, page ORDER BY n) AS gap FROM z JOIN m USING (book_id) WHERE size = body),
g AS (SELECT book_id, list(gap ORDER BY gap) AS gaps FROM p WHERE gap BETWEEN body * 0.8 AND body * 3.0 GROUP BY book_id),
w AS (SELECT book_id, page, max(edge) - 50.0 AS width FROM p GROUP BY book_id, page HAVING count(*) >= 5), v AS (SELECT book_id, list(width ORDER BY width) AS widths FROM w GROUP BY book_id),
typo AS (SELECT book_id, body, coalesce(headings, []) AS headings, coalesce(widths[len(widths) // 2 + 1], 0.0)::DOUBLE AS width, coalesce(gaps[len(gaps) // 2 + 1], body * 1.2)::DOUBLE AS gap, false AS bold_body
FROM m LEFT JOIN h USING (book_id) LEFT JOIN g USING (book_id) LEFT JOIN v USING (book_id))"""


@query("typography", f"WITH {TYPOGRAPHY_SQL} SELECT * FROM typo")
def typography(spark: SparkSession, folder: str) -> DataFrame:
    return _typography(_layouts(spark, folder))


@query(
    "layout_blocks",
    rf"""WITH {TYPOGRAPHY_SQL},
b0 AS (SELECT t.book_id, t.page, n, trim(regexp_replace(l.text, '\s+', ' ', 'g')) AS text, CASE WHEN n = 0 THEN 16.0 ELSE 10.0 END AS size, 50.0 + least(length(l.text), 60) * 5.0 AS edge, 100 + n * 12.0 AS baseline, body, headings, width, gap
  FROM l JOIN t USING (book_id, page) JOIN typo ON typo.book_id = t.book_id),
b1 AS (SELECT *, size >= body * 1.5 AND regexp_full_match(text, '\p{{L}}{{1,2}}') AS large, lead(text) OVER o AS after, lag(text) OVER o AS before, lag(size) OVER o AS size_before, lag(body) OVER o AS b FROM b0 WINDOW o AS (PARTITION BY book_id, page ORDER BY n)),
b2 AS (SELECT * REPLACE (CASE WHEN n = 1 AND size_before >= body * 1.5 AND regexp_full_match(before, '\p{{L}}{{1,2}}') AND regexp_matches(text, '^\p{{Ll}}') AND NOT large THEN before || text ELSE text END AS text) FROM b1
  WHERE NOT (large AND coalesce(regexp_matches(after, '^\p{{Ll}}') AND NOT (10.0 >= body * 1.5 AND regexp_full_match(after, '\p{{L}}{{1,2}}')), false))),
b3 AS (SELECT book_id, page, n, text, size, edge, baseline, body, width, gap, CASE WHEN size >= body * 1.12 AND len(list_filter(headings, lambda h: size >= h - 0.01)) > 0 THEN least(list_position(headings, list_filter(headings, lambda h: size >= h - 0.01)[1]), 4) ELSE 0 END AS level FROM b2),
b4 AS (SELECT *, greatest(max(CASE WHEN level = 0 THEN edge END) OVER p, 50 + width, CASE WHEN count(*) FILTER (level = 0) OVER p = 0 THEN max(edge) OVER p END) AS reach,
  lag(text) OVER o AS above, lag(level) OVER o AS level_above, lag(edge) OVER o AS edge_above, baseline - lag(baseline) OVER o AS down FROM b3 WINDOW p AS (PARTITION BY book_id, page), o AS (PARTITION BY book_id, page ORDER BY n)),
b5 AS (SELECT *, CASE WHEN above IS NULL OR level <> level_above THEN 'P' WHEN abs(down) < size * 0.3 THEN 'F'
  WHEN down > CASE WHEN level > 0 THEN size * 2.2 ELSE gap * size / body * 1.45 END OR (level = 0 AND regexp_matches(text, '^([•·▪●○◦■□►▸‣⁃✓✔\-–—*](\s+|$)|\(?[0-9]{{1,2}}[.)]\s+|\(?[a-z]\)\s+)')) THEN 'P'
  WHEN (regexp_matches(above, '\p{{L}}[-‐‑]$') AND regexp_matches(text, '^\p{{Ll}}')) OR reach - edge_above <= 20 + size * 0.6 THEN 'F' WHEN regexp_matches(above, '[.!?…:][»"''”’)\]]*$') THEN 'P' ELSE 'V' END AS joint FROM b4),
b6 AS (SELECT *, sum(CASE WHEN joint = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, page ORDER BY n) - 1 AS number,
  CASE WHEN joint = 'P' THEN '' WHEN joint = 'V' THEN chr(10) WHEN regexp_matches(above, '\p{{L}}[-‐‑]$') AND regexp_matches(text, '^\p{{Ll}}') THEN chr(1) ELSE ' ' END AS between FROM b5),
b7 AS (SELECT book_id, page, number, regexp_replace(string_agg(between || text, '' ORDER BY n), '.\x01', '', 'g') AS text, first(level ORDER BY n) AS level, count(*) AS lines FROM b6 GROUP BY ALL)
SELECT book_id, page, CAST(number AS INTEGER) AS number, text, CAST(CASE WHEN level > 0 AND (length(text) > 200 OR lines > 4) THEN 0 ELSE level END AS INTEGER) AS level FROM b7""",
)
def layout_blocks(spark: SparkSession, folder: str) -> DataFrame:
    layouts = _layouts(spark, folder)
    return text.layout_blocks(layouts, _typography(layouts))


@query("passages_located")
def passages_located(spark: SparkSession, folder: str) -> DataFrame:
    """The middle of every page found again in the page's lines."""
    docs = table(spark, folder, "documents")
    start = F.greatest(F.floor((F.length("text") - 300) / 2).cast("int") + 1, F.lit(1))
    return text.passages(docs.select(F.col("doc_id").alias("passage_id"), F.substr("text", start, F.lit(300)).alias("passage"), F.split("text", "\n").alias("segments")))


@query(
    "words_across_pages",
    f"""WITH RECURSIVE {library.PAGES_SQL}, own AS (SELECT book_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM lib_pages),
cut AS (SELECT book_id, page, CASE WHEN len(ps) = 0 THEN ps WHEN page % 7 IN (3, 4) THEN [lower(string_split(ps[1], ' ')[1]) || '-'] WHEN page % 3 > 0 THEN list_append(ps[1:len(ps) - 1], rtrim(ps[-1], '.') || '-') ELSE ps END AS raw FROM own),
pages AS (SELECT book_id, page, CASE WHEN page % 2 = 0 AND len(raw) > 0 THEN list_prepend(lower(raw[1]), raw[2:]) ELSE raw END AS ps FROM cut),
fold AS (SELECT book_id, page, ps AS cur, CAST(NULL AS VARCHAR[]) AS done FROM pages WHERE page = 1
  UNION ALL SELECT book_id, page + 1, CASE WHEN NOT meets THEN ps WHEN rest = '' THEN ps[2:] ELSE list_prepend(rest, ps[2:]) END, CASE WHEN meets THEN list_append(cur[1:len(cur) - 1], regexp_replace(cur[-1], '[-‐‑–—]\\s*$', '') || word) ELSE cur END
  FROM (SELECT f.book_id, f.page, cur, ps, string_split(ps[1], ' ')[1] AS word, ltrim(substr(ps[1], length(string_split(ps[1], ' ')[1]) + 1)) AS rest,
    coalesce(len(cur) > 0 AND len(ps) > 0 AND regexp_matches(cur[-1], '^(.*\\s)?[\\p{{L}}\\p{{N}}\\p{{M}}_]+[-‐‑–—]\\s*$') AND regexp_matches(ps[1], '^\\p{{Ll}}'), FALSE) AS meets FROM fold f JOIN pages p ON p.book_id = f.book_id AND p.page = f.page + 1)),
last AS (SELECT book_id, max(page) AS page FROM pages GROUP BY 1),
final AS (SELECT book_id, page - 1 AS page, done AS ps FROM fold WHERE page > 1 UNION ALL SELECT f.book_id, f.page, cur FROM fold f JOIN last USING (book_id, page))
SELECT book_id, CAST(page AS INTEGER) AS page, len(ps) AS n_paragraphs, md5(array_to_string(ps, chr(10))) AS md5 FROM final""",
)
def words_across_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of every book with words cut at most of their ends, some of one word alone, put together."""
    none = F.array().cast("array<string>")
    own = library.pages(spark, folder, "text").select("book_id", "page", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _trimmed), lambda p: p != "").alias("ps"))
    ps, page = F.col("ps"), F.col("page")
    alone = F.array(F.concat(F.lower(F.split(ps[0], " ")[0]), F.lit("-")))
    hyphen = F.concat(F.slice(ps, F.lit(1), F.size(ps) - 1), F.array(F.concat(F.rtrim(F.element_at(ps, -1), F.lit(".")), F.lit("-"))))
    raw = F.when(F.size(ps) == 0, none).when((page % 7).isin(3, 4), alone).when(page % 3 > 0, hyphen).otherwise(ps)
    cut = own.select("book_id", "page", raw.alias("ps"))
    small = F.when((page % 2 == 0) & (F.size(ps) > 0), F.concat(F.array(F.lower(ps[0])), F.slice(ps, F.lit(2), F.size(ps)))).otherwise(ps)
    found = page_edges.mended(cut.select("book_id", "page", small.alias("paragraphs")))
    return found.select("book_id", "page", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.md5(F.array_join("paragraphs", "\n").cast("binary")).alias("md5"))


CAST_SQL = r"""opening AS (SELECT source AS book_id, doc_id, regexp_extract(text, '^(\p{Lu}\p{L}{3,})', 1) AS name FROM documents), casting AS (SELECT book_id, name, doc_id % 5 AS character_id FROM opening WHERE name <> ''),
keyed AS (SELECT book_id, strip_accents(lower(name)) AS key, min(name) AS name, CASE WHEN count(DISTINCT character_id) = 1 THEN min(character_id) END AS character_id FROM casting GROUP BY 1, 2),
parted AS (SELECT source AS book_id, doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+') AS ws, string_split_regex(text, '[\p{L}\p{N}\p{M}_]+') AS gs FROM documents),
each AS (SELECT book_id, doc_id, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap, unnest(range(len(ws))) AS k FROM parted),
spoken AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) - length(word) AS start FROM each),
finds AS (SELECT s.book_id, doc_id, CAST(start AS INTEGER) AS start, CAST(start + length(word) AS INTEGER) AS "end", name, character_id FROM spoken s JOIN keyed k ON k.book_id = s.book_id AND strip_accents(lower(word)) = key WHERE regexp_matches(word, '^\p{Lu}'))"""


def _cast(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The pages of every book, and a cast of its own: the words that open its pages."""
    docs = table(spark, folder, "documents").select(F.col("source").alias("book_id"), "doc_id", "text")
    names = docs.select("book_id", F.regexp_extract("text", r"^(\p{Lu}\p{L}{3,})", 1).alias("name"), (F.col("doc_id") % 5).alias("character_id")).where("name <> ''")
    return docs, names


@query("names_in_books", f'WITH {CAST_SQL} SELECT book_id, doc_id, start, "end", name FROM finds')
def names_in_books(spark: SparkSession, folder: str) -> DataFrame:
    return name_tables.found(*_cast(spark, folder)).select("book_id", "doc_id", "start", "end", "name")


@query(
    "people_in_pages",
    f"""WITH {CAST_SQL}, firsts AS (SELECT book_id, doc_id, character_id, min(start) AS start FROM finds WHERE character_id IS NOT NULL GROUP BY ALL)
SELECT book_id, doc_id, character_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, character_id) - 1 AS INTEGER) AS place FROM firsts""",
)
def people_in_pages(spark: SparkSession, folder: str) -> DataFrame:
    return name_tables.people_in(*_cast(spark, folder)).select("book_id", "doc_id", "character_id", F.col("place").cast("int").alias("place"))
