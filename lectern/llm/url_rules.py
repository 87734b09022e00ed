"""URL filtering by association rules, with DataFrame functions and Spark's own FP-growth.

A listed rule (host, path prefix, verdict) decides a URL whose host is the rule's host or below it and
whose path starts with the rule's path; the longest such rule wins. A URL that no listed rule fits is
judged by mined rules: URLs with a label are sets of tokens (domain suffixes, host words, path words), and a
combination of tokens that enough blocked URLs hold, and that implies blocked with enough confidence, is a rule.
The rules are the least such combinations: one that holds another rule fires nothing that this does not.
They match through an inverted index from token to rules: a rule fires when all its parts are found.

Only least combinations are wanted, so mining is kept small without losing any: a token that is a rule by itself
is left out of what FP-growth sees, as every combination with it holds a rule; tokens that too few blocked URLs
hold are in no rule; tokens that occur in exactly the same labelled URLs are one item, any of which will do; and
FP-growth only gets the blocked URLs, which give a combination's support, while its confidence comes from
counting it in all labelled URLs through the inverted index. So deep paths, repeated or not, add one item. What is left
to grow is the number of frequent combinations of tokens that are each common among allowed URLs as well.

Labels of URLs are the verdicts of the listed rules (label_by_rules), or any table with url and blocked.

Defined results: host and path of a null url, or of one without ://, are empty, no listed rule fits, and
without tokens it is allowed. Repeated page_ids are judged row by row; a null page_id stays null. Without
labels, or with none blocked, nothing is mined and the method allows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import shared

# The listed rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BLOCK = "=block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_BLOCKED = 3
REPEATED = 100_000
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased (no other letter changes)."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parts(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def listed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest listed rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the last one, two and three parts of the host, the words of the host's parts, the words of the path without its numbers."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    top = F.when(n >= 1, F.concat(F.lit("top:"), F.element_at(labels, -1)))
    site = F.when(n >= 2, F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")))
    whole = F.when(n >= 3, F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")))
    words = F.transform(F.filter(F.split(host, r"[.\-_]"), lambda x: F.length(x) > 1), lambda x: F.concat(F.lit("word:"), x))
    steps = F.transform(F.filter(F.split(F.lower(path), r"[/.\-_]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("path:"), x))
    all_of = F.concat(F.array(top, site, whole), words, steps)
    return F.array_distinct(F.filter(all_of, lambda x: x.isNotNull()))


def label_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """url, blocked of the pages that a listed rule decides."""
    ruled = parts(pages).withColumn("fit", listed_rule(F.col("host"), F.col("path"), rules))
    return ruled.where("fit is not null").select("url", (F.col("fit.verdict") == "block").alias("blocked"))


def _counted(baskets: DataFrame) -> DataFrame:
    """token, n, blocked, mark: how many labelled URLs hold it, how many of these are blocked, and a sum that is the same only for tokens of the same URLs."""
    wide = lambda seed: F.xxhash64(F.lit(seed), "url").cast("decimal(38,0)")
    marked = baskets.select(F.explode("tokens").alias("token"), "blocked", wide(1).alias("one"), wide(2).alias("two"))
    mark = F.concat_ws(":", F.sum("one").cast("string"), F.sum("two").cast("string")).alias("mark")
    return marked.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), mark)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, n_parts, confidence, support, part, token: a row for each token that may stand for a part of a rule.

    Equal transactions cannot be weighted in FP-growth, so blocked rows stay rows; its shuffle holds conditional
    transactions, which its own map-side counting shrinks.
    """
    spark = labelled.sparkSession
    baskets = labelled.where("blocked is not null").select(F.coalesce("url", F.lit("")).alias("url"), tokens(host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "blocked")
    counts = baskets.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
    if not counts.blocked:
        return _no_rules(spark)
    least = max(math.ceil(min_support * counts.n), MIN_BLOCKED)
    frequent = _counted(baskets).where(F.col("blocked") >= least).withColumn("confidence", F.col("blocked") / F.col("n"))
    frequent = shared.settled(frequent, shared.workspace(spark, "url-tokens"))
    single = frequent.where(F.col("confidence") >= min_confidence)
    alone = single.select(
        F.xxhash64("token").alias("rule_id"), F.lit(1).alias("n_parts"), "confidence", (F.col("blocked") / counts.n).alias("support"), F.col("token").alias("part"), "token"
    )
    same = Window.partitionBy("n", "blocked", "mark")
    items = frequent.where(F.col("confidence") < min_confidence).select(F.min("token").over(same).alias("item"), "token")
    # URLs with their items: tokens that are no item fall away, and with them whole URLs.
    urls = baskets.groupBy("url").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.count_if("blocked").alias("blocked"))
    held = urls.select("url", "n", "blocked", F.explode("tokens").alias("token")).join(items, "token").groupBy("url", "n", "blocked").agg(F.sort_array(F.collect_set("item")).alias("items"))
    sets = shared.settled(held.groupBy("items").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")), shared.workspace(spark, "url-sets"))
    rows = _repeated(sets.where("blocked > 0 AND size(items) > 1"))
    blocked_rows = sets.where("size(items) > 1").agg(F.sum("blocked")).first()[0] or 0
    if blocked_rows < least:
        return alone
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / blocked_rows).fit(rows).freqItemsets.where("size(items) > 1")
    combos = found.select(F.array_sort("items").alias("parts"), F.col("freq").alias("blocked")).withColumn("rule_id", F.xxhash64("parts")).withColumn("n_parts", F.size("parts"))
    combos = shared.settled(combos, shared.workspace(spark, "url-combinations"))
    index = combos.select("rule_id", "n_parts", F.explode("parts").alias("item"))
    hits = sets.select(F.xxhash64("items").alias("set_id"), "n", F.explode("items").alias("item")).join(index, "item")
    whole = hits.groupBy("set_id", "rule_id", "n_parts").agg(F.count("*").alias("found"), F.first("n").alias("n")).where("found = n_parts")
    sure = whole.groupBy("rule_id").agg(F.sum("n").alias("n"))
    rules = combos.join(sure, "rule_id").withColumn("confidence", F.col("blocked") / F.col("n")).where(F.col("confidence") >= min_confidence)
    # The least ones: a rule goes when another lies within it. Joined on a part they share.
    inner = rules.select(F.explode("parts").alias("part"), F.col("parts").alias("inner"), F.col("n_parts").alias("inner_n"))
    within = (F.col("inner_n") < F.col("n_parts")) & (F.size(F.array_except("inner", "parts")) == 0)
    implied = rules.select(F.explode("parts").alias("part"), "rule_id", "parts", "n_parts").join(inner, "part").where(within).select("rule_id").distinct()
    kept = rules.join(implied, "rule_id", "left_anti").select("rule_id", "n_parts", "confidence", (F.col("blocked") / counts.n).alias("support"), F.explode("parts").alias("part"))
    return alone.unionByName(kept.join(items.withColumnRenamed("item", "part"), "part").select(*alone.columns))


def _repeated(sets: DataFrame, most: int = REPEATED) -> DataFrame:
    """items, a row for each of blocked: counts are cut into parts of most and these dealt out, so no count is one task's or one array's."""
    parts_of = sets.select("items", "blocked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocked") - 1, F.lit(most).cast("long"))).alias("at"))
    dealt = parts_of.withColumn("n", F.least(F.lit(most), F.col("blocked") - F.col("at"))).repartition("items", "at")
    return dealt.select("items", F.explode(F.array_repeat(F.lit(True), F.col("n").cast("int"))).alias("one")).select("items")


def _no_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rule_id long, n_parts int, confidence double, support double, part string, token string")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """set, confidence: the distinct token sets (column set of urls) that fire a mined rule, with the confidence of the surest.

    Only the distinct token sets take part, so a host with a third of all pages is counted once per set.
    """
    sets = urls.select("set").distinct().withColumn("set_id", F.xxhash64("set"))
    hits = sets.select("set_id", "set", F.explode("set").alias("token")).join(rules.select("rule_id", "n_parts", "confidence", "part", "token"), "token")
    parts_found = F.size(F.collect_set("part"))  # at most the parts of a rule
    whole = hits.groupBy("set_id", "set", "rule_id", "n_parts", "confidence").agg(parts_found.alias("found")).where("found = n_parts")
    return whole.groupBy("set").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; confidence of the mined rule where one decided."""
    named = parts(pages).withColumn("fit", listed_rule(F.col("host"), F.col("path"), rules))
    mined = mine(label_by_rules(pages, rules) if labelled is None else labelled, **limits)
    open_ones = named.where("fit is null").select("page_id", "host", "path", tokens(F.col("host"), F.col("path")).alias("set"))
    # A token set that a third of all pages have is dealt over SALTS keys.
    blocked = fired(open_ones, mined).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    dealt = open_ones.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int"))
    by_method = dealt.join(blocked, ["set", "salt"], "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow").alias("verdict"), "confidence"
    )
    by_list = named.where("fit is not null").select("page_id", "host", "path", "fit.rule", "fit.verdict", F.lit(None).cast("double").alias("confidence"))
    return by_list.unionByName(by_method)
