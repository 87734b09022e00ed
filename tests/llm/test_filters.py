"""Decontamination, classifiers, personal data and URL rules: brute force, held-out accuracy and edge cases."""

import random
import re
import zlib

from pyspark.sql import functions as F

from lectern.llm import decontaminate, pii, quality, queries, shared, toxicity, url_rules

QUESTION = "Maria buys 12 apples at 3 dollars each and later Maria sells 12 apples to Peter for 40 dollars in total. What is the profit that she makes?"
RETOLD = "Lucia buys 15 apples at 7 dollars each and later Lucia sells 15 apples to Omar for 90 dollars in total. What is the profit that she makes?"
MUDDLED = "Lucia buys 15 apples at 7 dollars each and later Maria sells 99 apples to Omar for 90 dollars in total. What is the profit that she makes?"


def test_leaks(spark):
    items = spark.createDataFrame([(1, f"So {QUESTION}"), (1, f"So {QUESTION}"), (2, "two words"), (3, None), (4, "a b c d e f g h"), (None, QUESTION), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"xx yy. So {QUESTION} zz", 0), (2, f"hello there So {RETOLD}", 0), (3, f"So {MUDDLED}", 0), (4, "the two words here", 0), (5, None, 0), (6, "", 0),
         (None, QUESTION, 0), (7, "a b c x e f g h", 0), (8, "q a b c d e f g h q", 0), (9, RETOLD[:60], 0), (10, "pad " * 100_000 + "a b c d e f g h", 0)],
        "doc_id long, text string, hash int",
    )
    for bits in (decontaminate.FILTER_BITS, 64):  # a filter of one word lets nearly all windows pass
        found = sorted((r.doc_id or 0, r.item_id, r.kind) for r in decontaminate.leaks(docs, items, shared.workspace(spark, "t"), filter_bits=bits).collect())
        assert found == [(0, 1, "exact"), (1, 1, "exact"), (2, 1, "restated"), (4, 2, "exact"), (8, 4, "exact"), (10, 4, "exact")]
    kept = decontaminate.without_leaks(docs, items, shared.workspace(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i or 0)) == [3, 5, 6, 7, 9]
    clean = spark.createDataFrame([(None, "nothing of the kind", 1), (None, None, 2), (None, "", 3)], docs.schema)
    assert decontaminate.without_leaks(clean, items, shared.workspace(spark, "t")).count() == 3
    assert decontaminate.leaks(docs, items.limit(0), shared.workspace(spark, "t")).collect() == []
    assert decontaminate.leaks(docs.limit(0), items, shared.workspace(spark, "t")).collect() == []


def test_leaks_with_names_that_open_sentences(spark):
    told = ["Tom has 12 apples. Tom gives 5 apples to Anna. How many apples does Tom have now?", "Maria buys 12 pens at 3 dollars each. Maria then sells all pens for 50 dollars. What does Maria gain?", QUESTION]
    again = ["Sam has 15 apples. Sam gives 7 apples to Lucy. How many apples does Sam have now?", "Lucia buys 15 pens at 4 dollars each. Lucia then sells all pens for 90 dollars. What does Lucia gain?", RETOLD]
    items = spark.createDataFrame(list(enumerate(told)), "item_id long, text string")
    texts = [*again, *[t.upper() for t in told], *[f"see here: {t.lower()}" for t in told], QUESTION.upper().replace("12", "17"), MUDDLED, told[0].replace("How", "So she wonders how").replace("12", "9"), "Sam has 15 apples. Tom gives 7 apples to Lucy. How many pears does Sam have now?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(docs, items, shared.workspace(spark, "t")).collect())
    copies = [(k, k % 3, "exact") for k in range(3, 9)]
    assert found == [(0, 0, "restated"), (1, 1, "restated"), (2, 2, "restated"), *copies, (9, 2, "restated")]


def test_leaks_of_items_with_little_content(spark):
    sequence = "2, 4, 8, 16, 32, 64, 128, 256"
    names = "Anna Berta Carla Dora Emma Frida Greta Hanna"
    asked = f"Continue the following sequence of {sequence}, 512, 1024, 2048"
    items = spark.createDataFrame([(1, sequence), (2, f"The {names}"), (3, asked)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"x {sequence} y"), (2, "x 3, 9, 27, 81, 243, 729, 2187, 6561 y"), (3, f"list The {names}. End"), (4, "list The Ada Bea Cleo Dina Ella Fay Gwen Hedy"),
         (5, "Continue the following sequence of 3, 9, 27, 81, 243, 729"), (6, f"x {asked} y")],
        "doc_id long, text string",
    )
    for bits in (decontaminate.FILTER_BITS, 64):
        found = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(docs, items, shared.workspace(spark, "t"), filter_bits=bits).collect())
        assert found == [(1, 1, "exact"), (3, 2, "exact"), (6, 1, "exact"), (6, 3, "exact")]


def test_leaks_equal_a_search(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(t.split())
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, shared.workspace(spark, "t")).collect()}
    assert found == want


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = queries.QUERIES["op5_toxicity"](spark, folder)
    told = scored.where("held_out").join(labels, "doc_id").toPandas()
    assert (told.predicted == told.toxic).mean() > 0.95
    assert scored.count() == docs.count()


def test_toxicity_of_long_texts(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = shared.crc_remainder("doc_id", 5) == 0
    model = toxicity.train(docs, labels, ~held_out)
    told = docs.where(held_out & F.col("text").isNotNull()).join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    clean = [r.text for r in told if r.toxic == 0]
    scored = toxicity.scores(model, [r.text for r in told], toxicity.weigher(model))
    toxic = [r.text for r, s in zip(told, scored, strict=True) if r.toxic == 1 and s >= 0.9]
    random.seed(2)
    long, wanted = [], []
    for sentences in (2000, 5000, 10_000, 20_000):
        for _ in range(4):
            parts, n = [], 0
            while n < sentences:
                parts.append(random.choice(clean))
                n += len(toxicity._SENTENCE.split(parts[-1]))
            long += [". ".join(parts), ". ".join([*parts, random.choice(toxic)]), "All is well. " * sentences]
            wanted += [0, 1, 0]
    found = toxicity.scores(model, long, toxicity.weigher(model))
    assert ((found >= 0.5).astype(int) == wanted).all(), found


def test_toxic_sentences_are_located(spark):
    rows = [(i, "calm words here. all is well today. nothing more to say.", 0) for i in range(60)] + [(100 + i, "calm words here. you nasty scoundrel. nothing more to say.", 1) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "well " * 50_000), (None, "you nasty scoundrel")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(found[i] < 0.5 for i, _, y in rows if not y) and all(found[i] >= 0.5 for i, _, y in rows if y)
    assert found[900] < 0.5 and found[901] < 0.5 and found[902] < 0.5 and found[None] >= 0.5
    spans = toxicity.offending_sentences(docs.where("doc_id = 100"), model).collect()
    assert [(s.sentence, rows[60][1][s.start : s.end].strip()) for s in spans] == [(1, "you nasty scoundrel")]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, y in rows if not y} | {900, 901, 902}
    untold = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, untold).collect()} == {0.0}


def test_toxicity_equals_direct_formulas():
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(1, 5, 12)
    doc_of, toxic = np.repeat(np.arange(12), counts), rng.integers(0, 2, 12)
    z = rng.normal(-1, 2, len(doc_of))
    slope = toxicity.pulls(z, doc_of, toxic) / 12
    for k in range(len(z)):
        step = np.zeros(len(z))
        step[k] = 1e-6
        numeric = (toxicity.likelihood(z + step, doc_of, toxic) - toxicity.likelihood(z - step, doc_of, toxic)) / 2e-6
        assert abs(numeric - slope[k]) < 1e-6
    weights = np.zeros(toxicity.DIMENSIONS, np.float32)
    for word in ("nasty", "bad", "mean"):
        weights[list(toxicity.word_features(word))] += 1.5
    model = toxicity.Model(weights, -4.0, None, 0.03, 0.05)
    texts = ["nasty bad. fine day. mean", "", "a b c", "bad! " * 40, ". . .", "Nasty, MEAN\nbad"]
    found = toxicity.scores(model, texts, toxicity.weigher(model))
    for text, score in zip(texts, found, strict=True):
        sentences = [s.split() for s in re.split(r"[.!?\n]+", text) if s.split()] or [[]]
        logits = [-4.0 + sum(float(weights[list(toxicity.word_features(w))].sum()) for w in s) for s in sentences]
        p = [1 / (1 + math.exp(-x)) for x in logits]
        leak = 0.03 * len(p) + toxicity.LEAK_SPREAD * 0.05 * math.sqrt(len(p))
        direct = 1 - math.exp(-max(-sum(math.log(1 - x) for x in p) - leak, 0))
        assert abs(score - max(direct, max(p))) < 1e-9


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b" * 900), (3, "c"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0), (3, 0), (3, 1), (4, 0), (None, 1), (9, 1), (2, 7)], "doc_id long, toxic int")
    whole = shared.labelled_sample(docs, labels, "toxic", F.lit(True), 100, 10_000)
    assert sorted(map(tuple, whole.collect())) == [(1, 1, "text 0"), (2, 0, "b" * 900), (3, 0, "c"), (3, 1, "c"), (4, 0, "")]
    assert all(r.doc_id != 2 for r in shared.labelled_sample(docs, labels, "toxic", F.col("doc_id") != 2, 100, 10_000).collect())
    assert sum(len(r.text) for r in shared.labelled_sample(docs, labels, "toxic", F.lit(True), 100, 500).collect()) <= 500
    assert shared.labelled_sample(docs, labels, "toxic", F.lit(True), 2, 10_000).count() <= 2
    assert shared.labelled_sample(docs.limit(0), labels, "toxic", F.lit(True), 5, 10).collect() == []


def test_quality_votes_equal_a_direct_search():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        near = rng.integers(0, 6, (4, 30)) / 5
        want = [sorted(range(30), key=lambda j, r=row: (-r[j], j))[:7] for row in near.tolist()]
        assert [sorted(b) for b in quality.nearest(near, 7).tolist()] == [sorted(w) for w in want]
    remembered = quality.Remembered()
    texts = [f"word{i % 7} and {'BUY ' * (i % 3)} number {i % 4}" for i in range(60)]
    labels = np.array([i % 3 == 0 for i in range(60)], np.int64)
    terms = [quality.term_counts(t, remembered) for t in texts]
    sizes = np.array([len(t) for t, _ in terms], np.int64)
    model = quality.fit(labels, np.concatenate([t for t, _ in terms]).astype(np.int64), np.concatenate([c for _, c in terms]), sizes, rank=8)
    asked = ["word3 and BUY number 2", "", "word1", "BUY BUY BUY", "zz qq"]
    for text, score in zip(asked, quality.scores(model, asked, remembered), strict=True):
        t, c = quality.term_counts(text, remembered)
        vector = np.zeros(model.axes.shape[1])
        for half in (t < quality.WORD_TERMS, t >= quality.WORD_TERMS):
            w = np.log1p(c[half]) * model.rarity[t[half]]
            if len(w):
                vector += (w / max(np.sqrt((w * w).sum()), 1e-12)) @ model.axes[t[half]]
        cosines = [float(vector @ v) / max(float(np.linalg.norm(vector)), 1e-12) for v in model.vectors]
        best = sorted(range(60), key=lambda j: (-round(cosines[j], 9), j))[: quality.NEAREST]
        pull = [max(cosines[j], 0.0) ** quality.SHARPNESS for j in best]
        want = sum(p * model.labels[j] for p, j in zip(pull, best, strict=True)) / sum(pull) if sum(pull) > 0 else model.share
        kept = sorted(cosines, reverse=True)
        if len(text.split()) and kept[quality.NEAREST - 1] - kept[quality.NEAREST] < 1e-9:
            continue  # which of equal neighbours vote hangs on rounding
        assert abs(score - want) < 1e-6


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    told = queries.QUERIES["op9_quality"](spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    assert (told.predicted == told.quality).mean() > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} in a row", 1) for i in range(40)] + [(50 + i, f"BUY!! NOW!! {i}$$$", 0) for i in range(20)], "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (4, None)], "doc_id long, quality int"))
    model = quality.train(docs, labels, F.lit(True))
    asked = spark.createDataFrame([(1, "plain words in a row"), (2, "BUY!! NOW!!"), (3, None), (4, ""), (None, "x " * 80_000)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in quality.score(asked, model).collect()}
    assert found[1] > 0.9 and found[2] < 0.1 and abs(found[3] - 40 / 60) < 1e-9 and found[3] == found[4] and 0 <= found[None] <= 1
    assert {r.score for r in quality.score(asked, quality.train(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    count = lambda v: sum(c.isdigit() for c in v)
    valid = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 12 <= count(v) <= 19 and luhn(v), "phone": lambda v: 9 <= count(v) <= 15}
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid[k](m[0])]
    return ",".join(s for _, _, s in sorted(found))


def test_personal_data_equals_the_base_definitions(spark, data):
    random.seed(1)
    odd = ["a@b.com_x@y.co.uk", "é😀 a.b@c.de x", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-2030.", None, "", "+1+12345678901", "1.1.1.0000000000000000000000000000000001"]
    odd += ["".join(random.choice("ab1.@-+ 5(){}\n_é") for _ in range(60)) for _ in range(1500)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(5000 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.find(docs).select("doc_id", pii.written(F.col("base")).alias("b")).collect()}
    assert got == {i: base_spans(t) for i, t in rows}


def test_personal_data_in_context_and_redacted(spark):
    text = "call tel 555-123-4567 now DE89 3704 0044 0532 0130 00 ssn 123-45-6789 or 555-123-4567x mail a@b.com"
    docs = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (2, None, "k"), (None, "x", "k"), (3, "q" * 200_000 + "@" + "1" * 200_000, "k")], "doc_id long, text string, spans string")
    found = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert found[1].startswith("national:9:21,iban:26:53,ssn:58:69") and found[1].endswith(f"email:{text.index('a@b')}:{len(text)}")
    assert found[2] == found[None] == ""
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1].startswith("call tel <national> now <iban> ssn <ssn> or") and texts[1].endswith("mail <email>") and texts[2] is None
    assert pii.find(docs.limit(0)).collect() == []


def test_personal_data_in_very_many_places(spark):
    import time

    mails = " ".join(f"u{i}@h{i % 7}.org 10.0.0.{i % 300} née" for i in range(20_000))
    docs = spark.createDataFrame([(1, mails), (2, "x@y.z"), (3, "")], "doc_id long, text string")
    started = time.time()
    got = {r.doc_id: r.b for r in pii.find(docs).select("doc_id", pii.written(F.col("spans")).alias("b")).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - started < 60
    assert got[1] == base_spans(mails) and got[1].count(",") > 30_000
    want = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", mails)
    want = re.sub(r"[0-9]+(\.[0-9]+){3}", lambda m: "<ip>" if all(int(x) <= 255 for x in m[0].split(".")) else m[0], want)
    assert clean == {1: want, 2: "<email>", 3: ""}


def test_secrets_and_overlaps(spark):
    key = "AKIA" + "XTQHNXKENDED6G3Y"
    rows = [(1, f"the {key} and password=1cfe32532b58 end", "s"), (2, "password=longwordonly token:a@b.com1234 xAKIA", "s"), (3, "password=ab12cd34@x.org tel 212 555 0100 10.1.2.3", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SPANS string")
    got = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert got == {1: "key:4:24,password:38:50", 2: "email:28:39", 3: "email:9:23,national:28:40,ip:41:49"}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and {r.doc_id: (r.text, r.SPANS) for r in clean.collect()} == {
        1: ("the <key> and password=<password> end", "s"), 2: ("password=longwordonly token:<email> xAKIA", "s"), 3: ("password=<email> tel <national> <ip>", "s"),
    }


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark, data):
    odd = [None, "", "no scheme/org/", "http://", "HTTP://A.Example.ORG/es/1#x", "http://org", "http://org/", "x://y.example.org/en/1?u=http://a.com/de/", "http://norg/", "http://a.com/fr", "http://ÀB.com/de/"]
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{data}/pages.parquet").collect()] + [(900 + i, u) for i, u in enumerate(odd)] + [(None, "http://x.org/")]
    pages = spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, host int")
    got = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert len(got) == len(rows)
    for page_id, url in rows:
        host, path, rule, verdict = judged(url)
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_rules.judge(pages.limit(0)).collect() == []


def test_mined_rules_judge_what_no_rule_lists(spark):
    good = [(f"http://site{i % 9}.net/news/{i}", False) for i in range(60)]
    bad = [(f"http://casino.site{i % 9}.net/win/{i}", True) for i in range(40)]
    labelled = spark.createDataFrame(good + bad, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://casino.other.net/win/9"), (2, "http://site3.net/news/5"), (3, None)], "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_rules.judge(pages, labelled).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow"}


def test_mined_rules_of_many_tokens(spark):
    steps = ["aa", "bb", "cc", "dd"]
    bad = [(f"http://s.net/{'/'.join(steps)}/{i}", True) for i in range(40)]
    good = [(f"http://s.net/{'/'.join(x for x in steps if x != left)}/{i}", False) for left in steps for i in range(60)]
    labelled = spark.createDataFrame(bad + good, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://s.net/dd/cc/bb/aa"), (2, "http://s.net/aa/bb/cc")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge(pages, labelled).collect()} == {1: "block", 2: "allow"}


def test_mined_rules_equal_all_subsets(spark):
    """Verdicts of the least rules against every subset of tokens, tried one by one."""
    from itertools import combinations

    random.seed(9)
    words = ["aa", "bb", "cc", "dd", "ee"]

    def url(k):
        some = [w for w in words if random.random() < 0.6]
        if "aa" in some and random.random() < 0.9:
            some.append("with-aa")
        return f"http://s{k % 3}.net/{'/'.join(some)}/{k % 4}"

    rows = [(u, ("bb" in u and "cc" in u) != (random.random() < 0.15)) for u in map(url, range(300))]
    rows += [(None, True), ("http://s1.net/aa", None), ("no scheme", False)] + [("http://s9.net/deep/er", True)] * 3
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    asked = sorted({u for u, _ in rows if u} | {f"http://x.org.au/{a}/{b}" for a in words for b in words} | {"http://q.com/er", "http://q.com/zz"})
    cut = {r.url: frozenset(r.t) for r in spark.createDataFrame([(u,) for u in asked], "url string").select("url", url_rules.tokens(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("t")).collect()}
    told = [(cut.get(u, frozenset()), y) for u, y in rows if y is not None]
    for support, confidence in ((0.02, 0.6), (0.05, 0.75)):
        least = max(support * len(told), url_rules.MIN_BLOCKED)

        def blocks(tokens, least=least, confidence=confidence):
            for n in range(1, len(tokens) + 1):
                for some in map(frozenset, combinations(sorted(tokens), n)):
                    labels = [y for t, y in told if some <= t]
                    if sum(labels) >= least and sum(labels) >= confidence * len(labels):
                        return True
            return False

        pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
        found = {r.page_id: r.verdict for r in url_rules.judge(pages, labelled, rules=(), min_support=support, min_confidence=confidence).collect()}
        want = {i: "block" if blocks(cut[u]) else "allow" for i, u in enumerate(asked)}
        assert found == want and len(set(want.values())) == 2


def test_mined_rules_of_deep_urls(spark):
    path = "/".join(f"w{k}x" for k in range(60))
    near = [f"http://example.org/es/{path.replace(f'w{k}x', 'other')}/" for k in range(5)]
    rows = [f"http://example.org/es/{path}/"] * 5 + near + ["http://example.org/de/plain"] * 20 + [f"http://a.com/fr/{path}/{k}" for k in range(3)]
    pages = spark.createDataFrame([(7, u) for u in rows] + [(8, f"http://new.net/{path}"), (9, "http://new.net/plain")], "page_id long, url string")
    found = {(r.page_id, r.verdict) for r in url_rules.judge(pages).collect() if r.page_id > 7}
    assert found == {(8, "block"), (9, "allow")}


def test_hashes_are_crc32(spark):
    got = spark.range(50).select("id", shared.crc_remainder("id", 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)
