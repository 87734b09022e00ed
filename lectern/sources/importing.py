"""New books and what is read off their pages: import, lines from glyphs, sound from WAV bytes, a generated book."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.readers import title_of

HALF_POINT = 2


def imported(files: DataFrame, books: DataFrame, now: Column) -> DataFrame:
    """books (id, title, file_path, page_count, index_status, index_progress, cleaner_version, imported_at) with the files (id, path, page_count) that are new; all of them wait to be indexed."""
    rows = files.select(
        "id", title_of(F.col("path")).alias("title"), F.col("path").alias("file_path"), "page_count", F.lit("PENDING").alias("index_status"), F.lit(0.0).cast("float").alias("index_progress"),
        F.lit(0).alias("cleaner_version"), now.alias("imported_at"),
    )
    return books.unionByName(rows.join(books.select("id"), "id", "left_anti").select(*books.columns))


def lines_of(glyphs: DataFrame) -> DataFrame:
    """book_id, page, line, text, left, right, baseline, size, bold, first_word of glyphs (book_id, page, line, n, c, x, width, y, size, bold).

    The size is that of most glyphs in half points (the greater on a tie), the baseline the upper median, bold where most glyphs are. A page's line is a bounded group.
    """
    keys = ("book_id", "page", "line")
    bucket = F.floor(F.col("size") * HALF_POINT + 0.5) / HALF_POINT
    sizes = glyphs.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("k")).groupBy(*keys).agg(F.max_by("bucket", F.struct("k", "bucket")).alias("size"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda g: g[c])
    rows = glyphs.withColumn("end", F.col("x") + F.col("width")).groupBy(*keys).agg(
        F.array_join(in_order("c"), "").alias("text"), F.min("x").alias("left"), F.max("end").alias("right"), F.sort_array(F.collect_list("y")).alias("ys"),
        (F.count_if("bold") * 2 > F.count("*")).alias("bold"), in_order("end").alias("ends"),
    )
    first = F.length(F.regexp_extract("text", r"^\S*", 0))
    word = F.when(first > 0, F.element_at("ends", first) - F.col("left")).otherwise(0.0)
    median = F.element_at("ys", F.floor(F.size("ys") / 2).cast("int") + 1)
    return rows.join(sizes, list(keys)).select(*keys, "text", "left", "right", median.alias("baseline"), "size", "bold", word.alias("first_word"))


def sample_lines(spark: SparkSession, pages: int = 320, lines: int = 38, headed: int = 10) -> DataFrame:
    """A book for measurements: page, line, text; every headed-th page opens with a heading."""
    numbers = spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page"), F.explode(F.sequence(F.lit(1), F.lit(lines))).alias("line"))
    chapter = F.concat(F.lit("Capítulo "), (F.floor((F.col("page") - 1) / headed) + 1).cast("string"))
    plain = F.concat(F.lit("Línea "), F.col("line").cast("string"), F.lit(" de la página "), F.col("page").cast("string"), F.lit("."))
    return numbers.select("page", "line", F.when((F.col("line") == 1) & ((F.col("page") - 1) % headed == 0), chapter).otherwise(plain).alias("text"))


def pcm(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (-1 to 1, channels averaged) of WAV bytes: 8 or 16 bit numbers or 32 bit floats; a data size of 0 or less goes to the end."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<i", content, at + 4)[0]
        body = at + 8
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", content, body)
        elif name == b"data":
            if form is None:
                raise ValueError("sound before its format")
            raw = content[body:] if size <= 0 else content[body : body + size]
            return form[2], _samples(raw, form[0], form[5], form[1])
        at = body + size + (size & 1)
    raise ValueError("no sound")


def _samples(raw: bytes, code: int, bits: int, channels: int) -> np.ndarray:
    kinds = {(1, 8): ("u1", 128.0, 128.0), (1, 16): ("<i2", 0.0, 32768.0), (3, 32): ("<f4", 0.0, 1.0)}
    if (code, bits) not in kinds:
        raise ValueError(f"no reader for format {code} of {bits} bits")
    kind, middle, scale = kinds[code, bits]
    flat = np.frombuffer(raw[: len(raw) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], kind).astype(np.float32)
    frames = flat[: len(flat) // channels * channels].reshape(-1, channels)
    return (frames.mean(axis=1) - middle) / scale
