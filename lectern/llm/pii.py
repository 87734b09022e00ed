"""Personal data, with DataFrame functions alone.

Regular expressions propose spans, validators confirm them, and context words nearby adjust the score.
Positions come from splitting a text at its matches: the lengths of the pieces between and of the matches
add up to each match's start, in code points.

Base kinds (always kept when their check holds, whatever the context): email; ip, four parts of at most
255; card, 12 to 19 digits that pass Luhn; phone, + and 9 to 15 digits. Further kinds, kept at a score of
LEAST or more: iban (letters and digits with remainder 1 modulo 97: 0.9), ssn (three, two and four digits
with hyphens, no impossible group: 0.4) and national phone (three, three and four digits: 0.4); a context
word of the kind within CONTEXT characters before it adds 0.35, within as many after it 0.2. Kinds of secrets: key
(identifiers and tokens of known forms: 0.9) and password (what is assigned to a name for secrets, eight characters or
more with a letter and a digit: 0.9). A further span that overlaps a base span is dropped.

Everything is linear in the matches of a text, or nearly: places are running sums over blocks of BLOCK matches (folds that copy
what they hold only grow to that), overlaps are found in the order of the spans, and pieces of a text are
taken from chunks of CHUNK characters.

The patterns equal the base definitions but never scan a run twice: a run of characters that could start
a match is entered at its first character (or where the match before ended), and repeated groups are
possessive, which for these patterns changes no match; so very long tokens take linear time and no stack.

Defined results: a null or empty text has no span. Repeated rows give repeated results, a null doc_id
stays null. Empty table: no rows. Other columns are ignored (find) or kept (redact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

KINDS = ("email", "ip", "card", "phone")
FURTHER = ("iban", "ssn", "national", "key", "password")
CONTEXT = 40
LEAST = 0.6
BLOCK = 128
CHUNK = 1024

# What the kinds look like.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9_])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9_-])",
    "password": r"(?i)(?<=(?:password|passwd|secret|api_key|apikey|api-key|token)[\x20\t]{0,4}[=:][\x20\t]{0,4}[\"']?)[^\s\"'<>]{8,}+",
    "national": r"(?<![0-9+(-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
# What a text must hold for a pattern to be tried: each is a part of every match of its pattern.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "key": lambda t: t.rlike(r"A[KS]IA[A-Z0-9]|gh[pousr]_|AIza|xox[abprs]-"),
    "password": lambda t: t.rlike(r"(?i)(?:password|passwd|secret|api_key|apikey|api-key|token)[\x20\t]{0,4}[=:]"),
    "national": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
CONTEXT_WORDS = {
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|sozialversicherung|seguridad social)\b",
    "key": r"(?i)\b(?:key|token|aws|access)\b",
    "password": r"(?i)\b(?:login|user|account)\b",
    "national": r"(?i)\b(?:phone|tel|telephone|telefon|mobile|cell|call|fax|appel|llame)\b",
}
BASE_SCORE = {"iban": 0.9, "ssn": 0.4, "national": 0.4, "key": 0.9, "password": 0.9}
SPAN = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """From the last digit on, every second one doubled, less 9 if over 9; the sum is a multiple of 10."""
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int") * (i % 2 + 1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda total, n: total + n) % 10 == 0


def _mod97(value: Column) -> Column:
    """The first four characters go to the end, letters count from 10 on; digit by digit the remainder must be 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    codes = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), F.ascii)
    step = lambda rest, c: F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)
    return (F.aggregate(codes, F.lit(0), step) == 1) & F.length(plain).between(15, 34)


def _count(value: Column) -> Column:
    return F.length(_digits(value))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: ~v.rlike(r"(?:^|\.)0*(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[1-9][0-9]{3,})(?:\.|$)"),
    "card": lambda v: _count(v).between(12, 19) & _luhn(v),
    "phone": lambda v: _count(v).between(9, 15),
    "iban": _mod97,
    "ssn": lambda v: F.lit(True),
    "national": lambda v: F.lit(True),
    "key": lambda v: F.lit(True),
    "password": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"),
}


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine, start: Column) -> Column:
    """For each of values what combine makes of start and all values before it, in order.

    A fold that collects copies what it has so far, so it is done within blocks of BLOCK values, from what the blocks before come to.
    """

    def scan(some: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(some, state, step, lambda s: s["out"])

    def blocked(all_of: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_of, k * BLOCK + 1, F.lit(BLOCK)))
        whole = lambda bs: F.transform(bs, lambda b: F.aggregate(b, start, combine))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(whole(bs), start), scan)))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<int>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, value): every match of the pattern, in order."""
    pattern = PATTERNS[kind]
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    placed = F.zip_with(F.slice(between, 1, F.greatest(F.size(values), F.lit(0))), values, lambda gap, v: F.struct(F.length(gap).alias("gap"), F.length(v).alias("n"), v.alias("value")))

    def started(found: Column) -> Column:
        before = running(F.transform(found, lambda m: m["gap"] + m["n"]), _sum, F.lit(0))
        return F.zip_with(found, before, lambda m, at: F.struct((at + m["gap"]).alias("start"), m["value"].alias("value")))

    return let(placed, started)


def _spans(text: Column, kind: str) -> Column:
    def span(m: Column) -> Column:
        end = m["start"] + F.length(m["value"])
        if kind in KINDS:
            sure = F.lit(1.0)
        else:
            before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
            after = F.substring(text, end + 1, F.lit(CONTEXT))
            words = CONTEXT_WORDS[kind]
            sure = F.lit(BASE_SCORE[kind]) + F.when(before.rlike(words), 0.35).otherwise(0.0) + F.when(after.rlike(words), 0.2).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), end.alias("end"), F.least(sure, F.lit(1.0)).alias("score"), m["value"].alias("value"))

    valid = F.filter(_matches(text, kind), lambda m: VALID[kind](m["value"]))
    found = F.transform(valid, span)
    if kind in FURTHER:
        found = F.filter(found, lambda s: s["score"] >= LEAST)
    return F.when(HINTS[kind](text), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def spans(text: Column) -> tuple[Column, Column]:
    """The base spans and the further ones that overlap none of them, each ordered by start, then kind as listed."""
    base = _in_order(F.concat(*[_spans(text, k) for k in KINDS]))
    further = _in_order(F.concat(*[_spans(text, k) for k in FURTHER]))
    return base, further


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: arrays of (kind, start, end, score, value); spans has the base ones too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base, further = spans(F.col("text"))
    both = named.select("doc_id", base.alias("base"), further.alias("further"))
    return both.select("doc_id", "base", _merged(F.col("base"), F.col("further")).alias("spans"))


def _in_order(found: Column) -> Column:
    """Spans by start, then kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, *FURTHER)) for x in (F.lit(k), F.lit(i))])
    return F.transform(F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s.alias("span")))), lambda k: k["span"])


def _merged(base: Column, further: Column) -> Column:
    """Base spans, and the further ones that are clear of them, by start, then kind as listed.

    In this order a base span that overlaps a further one starts before it and ends after its start, or starts after
    it and before its end.
    """
    far = F.lit(2**31 - 1)
    is_base = lambda s: s["kind"].isin(*KINDS)

    def clear(found: Column) -> Column:
        reached = running(F.transform(found, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
        following = F.reverse(running(F.reverse(F.transform(found, lambda s: F.when(is_base(s), s["start"]).otherwise(far))), lambda a, b: F.least(a, b), far))
        told = F.arrays_zip(found.alias("span"), reached.alias("reached"), following.alias("following"))
        kept = F.filter(told, lambda t: is_base(t["span"]) | ((t["reached"] <= t["span"]["start"]) & (t["following"] >= t["span"]["end"])))
        return F.transform(kept, lambda t: t["span"])

    both = _in_order(F.concat(base, further))
    return F.when(F.size(further) == 0, base).otherwise(let(both, clear))


def written(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets; overlapping spans are replaced as one, by the kind of the first. Other columns stay as they are."""
    base, further = spans(F.coalesce(F.col("text"), F.lit("")))
    name = shared.free_name(docs, "spans")
    found = docs.withColumn(name, F.struct(base.alias("base"), further.alias("further")))
    clean = F.when(F.size(f"{name}.base") + F.size(f"{name}.further") > 0, _replaced(F.col("text"), _merged(F.col(f"{name}.base"), F.col(f"{name}.further")))).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)


def _replaced(text: Column, found: Column) -> Column:
    """text with its spans (in order) replaced, put together from what lies between them."""

    def between(chunks: Column, first: Column, after: Column) -> Column:
        """Characters first (from 0) to after, from the chunks that hold them."""
        start = F.floor(first / CHUNK).cast("int")
        some = F.slice(chunks, start + 1, F.floor((after - 1) / CHUNK).cast("int") - start + 1)
        return F.when(after > first, F.substr(F.array_join(some, ""), first - start * CHUNK + 1, after - first)).otherwise(F.lit(""))

    def put(chunks: Column, told: Column, last: Column) -> Column:
        parts = F.transform(F.filter(told, lambda t: t["start"] >= t["at"]), lambda t: F.concat(between(chunks, t["at"], t["start"]), F.lit("<"), t["kind"], F.lit(">")))
        return F.concat(F.array_join(parts, ""), between(chunks, last, F.length(text)))

    def opened(all_of: Column) -> Column:
        """Spans with the place (at) that those before them reach; where one starts before it, it overlaps."""
        at = running(F.transform(all_of, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        return F.zip_with(all_of, at, lambda s, a: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), a.alias("at")))

    chunks = F.regexp_extract_all(text, F.lit(r"(?s)(.{1,%d})" % CHUNK), F.lit(1))
    return let(chunks, lambda c: let(opened(found), lambda told: let(F.array_max(F.transform(told, lambda t: t["end"])), lambda last: put(c, told, last))))
