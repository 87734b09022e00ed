"""License statements in texts, by diagonal voting, with DataFrame functions alone.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased. All rolling word k-grams of all texts
(k is 2 for phrases, GRAM for longer templates) are hashed and joined to the places of the same hashes in the templates; each
hit votes for the diagonal place in the text less place in the template. Votes are summed by diagonal. A phrase stands
wherever one diagonal has all of its grams, so its places are exact, overlapping ones included. For longer templates,
diagonals that lie within an eighth of the template's length of the next are merged (words put in or left out move
the rest by their number), and a span counts if AGREEMENT of the template's grams are found in it. A hit only votes if the words
themselves are equal, so no collision of hashes can count.

The templates are values given by the caller, so their table is small and is broadcast; what is shuffled is a row a
document and a row a hit. Whole texts are read, of any length; one text's hits meet in one task, as its words do.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows give repeated results (rows are told
apart by a number of their own), a null doc_id stays null. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_GRAM = 2
GRAM = 3
AGREEMENT = 0.8
SHIFT = 8  # a template of n words takes up diagonals up to n / SHIFT apart

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Statements by which texts say under which terms they stand.
STATEMENTS = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mit-release", "Released under the MIT License"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(f"({WORD})"), F.lit(1))


def _rolled(some: Column, length: int) -> Column:
    """For each word a struct of it and the length - 1 words after it (null beyond the end)."""
    return F.arrays_zip(*[(some if k == 0 else F.slice(some, F.lit(k + 1), F.size(some))).alias(f"w{k}") for k in range(length)])


def _hash(row: str, length: int) -> Column:
    """The hash of a gram of length words; null where the text ends before."""
    return F.when(F.col(f"{row}.w{length - 1}").isNotNull(), F.xxhash64(*[F.col(f"{row}.w{k}") for k in range(length)]))


def _gram(row: str, length: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"{row}.w{k}") for k in range(length)])


def templates(docs: DataFrame, phrases: Mapping[str, str], statements: Sequence[tuple[str, str]]) -> DataFrame:
    """template, label, exact, words, length: the caller's phrases (exact) and statements, cut into words as texts are."""
    told = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in statements]
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"), F.lit(text).alias("text")) for k, (label, text, exact) in enumerate(told)])
    listed = docs.sparkSession.range(1).select(F.inline(rows))
    return listed.select("template", "label", "exact", words(F.col("text")).alias("words")).withColumn("length", F.size("words"))


def grams(listed: DataFrame, length: int) -> DataFrame:
    """hash, hits: the places (template, at, gram) of every gram of the templates."""
    rolled = listed.select("template", F.posexplode(_rolled(F.col("words"), length)).alias("at", "row"))
    placed = rolled.select(_hash("row", length).alias("hash"), F.struct("template", "at", _gram("row", length).alias("gram")).alias("hit"))
    return placed.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.collect_list("hit").alias("hits"))


def hits(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """row, doc_id, n_words, pos, template, at: a row for every gram that a text shares with a template, and one with
    template null for the first word of each text (or for a text without words)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    rolled = numbered.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(_rolled(F.col("words"), max(GRAM, PHRASE_GRAM))).alias("pos", "gram"))
    found = rolled.select("row", "doc_id", "n_words", "pos", "gram", _hash("gram", PHRASE_GRAM).alias("short"), _hash("gram", GRAM).alias("long"))
    for column, length, exact in (("short", PHRASE_GRAM, F.col("exact")), ("long", GRAM, ~F.col("exact"))):
        table = grams(listed.where(exact), length).select(F.col("hash").alias(column), F.col("hits").alias(f"{column}_hits"))
        found = found.join(F.broadcast(table), column, "left")  # as large as the caller's templates
    found = found.where("short_hits is not null or long_hits is not null or pos = 0 or pos is null")
    none = F.array().cast("array<struct<template:int,at:int,gram:string>>")

    def equal(column: str, length: int) -> Column:
        return F.filter(F.coalesce(column, none), lambda h: h["gram"] == _gram("gram", length))

    same = [equal("short_hits", PHRASE_GRAM), equal("long_hits", GRAM)]
    first = F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.array(F.struct(F.lit(None).cast("int").alias("template"), F.lit(0).alias("at"), F.lit("").alias("gram")))).otherwise(none)
    return found.select("row", "doc_id", "n_words", "pos", F.explode(F.concat(first, *same)).alias("hit")).select("row", "doc_id", "n_words", "pos", "hit.template", "hit.at")


def spans(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, statements: Sequence[tuple[str, str]] = STATEMENTS) -> DataFrame:
    """row, doc_id, n_words, template, label, exact, start, end (words from 0, end exclusive), agreement (0 to 1).

    One row for each place of a phrase and each merged span of a statement, however weak, and one with template null for each row of docs.
    """
    listed = templates(docs, phrases, statements)
    known = F.broadcast(listed.select("template", "label", "exact", "length"))  # as large as the caller's templates
    dealt = hits(docs, listed).repartition(F.col("row"))  # the groups below are all within a row
    votes = dealt.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("row", "doc_id", "n_words", "template", "diagonal")
    voted = votes.agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last")).join(known, "template", "left")
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.col("exact") | apart.isNull() | (apart > F.floor(F.col("length") / SHIFT))
    merged = voted.withColumn("span", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    size = F.when(F.col("exact"), PHRASE_GRAM).otherwise(GRAM)
    told = merged.groupBy("row", "doc_id", "n_words", "template", "span", "label", "exact", "length").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("seen"), F.min("first").alias("start"), F.max("last").alias("last")
    )
    agreement = F.col("seen") / (F.col("length") - size + 1)
    placed = told.select("row", "doc_id", "n_words", "template", "label", "exact", F.col("start").cast("long"), (F.col("last") + size).cast("long").alias("end"), agreement.alias("agreement"))
    return placed.where("template is null or not exact or agreement = 1")


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, statements: Sequence[tuple[str, str]] = STATEMENTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    score is 1 where a phrase stands, else how much of a statement is found at best.
    """
    for text in (*phrases, *(s for _, s in statements)):
        assert len(text.split()) >= PHRASE_GRAM, f"a template has {PHRASE_GRAM} words at least: {text!r}"
    base = F.col("exact")
    sound = base | (F.col("agreement") >= AGREEMENT)

    def joined(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        spans(docs, phrases, statements)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(sound).alias("labels"),
            F.coalesce(F.max("agreement"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
