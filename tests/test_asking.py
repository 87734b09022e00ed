"""Phrases of a paragraph: where they stand, and which one a place belongs to."""

from pyspark.sql import functions as F

from lectern.operators import asking


def test_phrases_are_found_in_one_way_through_a_paragraph(spark):
    rows = [(1, "a b a b", ["a", "b", "x", None, "a", "b"]), (2, "ab ab", ["ab", "", "ab"]), (3, None, ["a"]), (4, "a", None), (5, "", []), (6, "😀 á 😀", ["á", "😀"])]
    told = spark.createDataFrame(rows, "id long, text string, phrases array<string>").withColumn("starts", asking.phrase_starts(F.col("text"), F.col("phrases")))
    got = {r.id: (r.starts, r.phrase) for r in told.select("id", "starts", asking.phrase_at(F.col("starts"), F.lit(3)).alias("phrase")).collect()}
    assert got == {1: ([0, 2, 3, 3, 4, 6], 3), 2: ([0, 2, 3], 2), 3: (None, None), 4: (None, None), 5: ([], 0), 6: ([2, 4], 0)}


def test_a_long_paragraph_takes_time_in_proportion():
    words = [f"w{n}" for n in range(200_000)]
    assert asking.starts_of(" ".join(words), words)[-1] == sum(len(w) + 1 for w in words[:-1])
