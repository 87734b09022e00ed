"""Readers and codecs besides Parquet: documents as files, evaluation sets, outlines, JSON and binary columns, settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.schema import ADDED, SCHEMAS

EVAL_SCHEMA = "books array<struct<title:string,questions:array<struct<question:string,pages:array<int>>>>>"


def entity(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An entity table with the current schema; columns that its files lack get what migrations give them."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    schema = T.StructType.fromDDL(SCHEMAS[name])
    filled = ADDED.get(name, {})
    missing = [f for f in schema.fields if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.expr(filled.get(f.name, "null")).cast(f.dataType) for f in missing}) if missing else rows
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def page_files(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """book_id (file name without its ending), page, raw_text of files, by an injected parser of one file's bytes."""
    files = spark.read.format("binaryFile").load(path).select(title_of(F.col("path")).alias("book_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(b, i, t) for b, c in zip(batch["book_id"], batch["content"], strict=True) for i, t in enumerate(pages_of(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["book_id", "page", "raw_text"])

    return files.mapInPandas(run, "book_id string, page int, raw_text string")


def title_of(path: Column) -> Column:
    """File name up to its last dot, or all of it if nothing is before that."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("")), name)


def metadata(title: Column, author: Column, file_title: Column, current: Column) -> tuple[Column, Column]:
    """Title and author as found: blanks are nothing, and a title replaces only the one that the file name gave."""
    found = F.nullif(F.trim(title), F.lit(""))
    return F.when(current == file_title, F.coalesce(found, current)).otherwise(current), F.nullif(F.trim(author), F.lit(""))


def is_scanned(raw: Column) -> Column:
    return F.length(F.trim(F.coalesce(raw, F.lit("")))) < 20


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """title, question, pages of an evaluation file; unknown keys are ignored."""
    books = spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path).select(F.explode("books").alias("b"))
    return books.select("b.title", F.explode("b.questions").alias("q")).select("title", "q.question", "q.pages")


def flat_outline(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """title, page, depth, place of a tree (node_id, parent_id, ord, title, page) in pre-order; blank titles go, their children stay."""
    nodes.createOrReplaceTempView("lectern_outline_nodes")
    walked = spark.sql("""
        WITH RECURSIVE walk(node_id, title, page, depth, path) AS (
          SELECT node_id, title, page, 0, array(ord) FROM lectern_outline_nodes WHERE parent_id IS NULL
          UNION ALL
          SELECT n.node_id, n.title, n.page, w.depth + 1, concat(w.path, array(n.ord)) FROM lectern_outline_nodes n JOIN walk w ON n.parent_id = w.node_id)
        SELECT title, page, depth, path AS place FROM walk WHERE trim(coalesce(title, '')) <> ''""")
    return walked


def json_array(column: Column, kind: str) -> Column:
    """An array of JSON text; unreadable text is an empty array."""
    return F.coalesce(F.from_json(column, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def packed_floats(vector: Column) -> Column:
    """Little-endian 32-bit floats, byte by byte from their bits (no Python)."""
    bits = F.transform(vector, lambda x: F.conv(F.lpad(F.hex(_float_bits(x)), 8, "0"), 16, 10).cast("long"))
    byte = lambda n, k: F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.unhex(F.array_join(F.transform(bits, lambda n: F.concat(*[byte(n, k) for k in range(4)])), ""))


def _float_bits(x: Column) -> Column:
    """IEEE 754 bits of a finite 32-bit float."""
    value = F.abs(x.cast("double"))
    power = F.when(value == 0, F.lit(-127)).otherwise(F.greatest(F.floor(F.log2(value)), F.lit(-126))).cast("int")
    power = F.when((value > 0) & (F.pow(F.lit(2.0), power.cast("double")) > value), power - 1).otherwise(power)
    power = F.when(F.pow(F.lit(2.0), (power + 1).cast("double")) <= value, power + 1).otherwise(power)
    small = value < 2.0**-126
    mantissa = F.when(small, value * 2.0**149).otherwise((value / F.pow(F.lit(2.0), power.cast("double")) - 1) * 2.0**23).cast("long")
    exponent = F.when(small, F.lit(0)).otherwise(power + 127).cast("long")
    sign = F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long")
    return sign + F.shiftleft(exponent, 23) + mantissa


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked_floats(blob: pd.Series) -> pd.Series:
    import numpy as np

    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4").copy())


# Limits of settings.
SPEED, SCALE = (0.75, 2.0), (0.8, 1.6)


def settings(values: DataFrame) -> DataFrame:
    """Settings (user_id, model, speed, scale, spoilers_off array<string>) with defaults and limits; model ids have to start with gemini-."""
    clamp = lambda c, limits, default: F.when(F.col(c).isNull(), default).otherwise(F.least(F.greatest(F.col(c), F.lit(limits[0])), F.lit(limits[1]))).alias(c)
    return values.select("user_id", F.when(F.col("model").startswith("gemini-"), F.col("model")).alias("model"), clamp("speed", SPEED, 1.0), clamp("scale", SCALE, 1.0), F.coalesce("spoilers_off", F.array().cast("array<string>")).alias("spoilers_off"))


def spoilers_hidden(opted_out: Column, book_id: Column) -> Column:
    return ~F.array_contains(opted_out, book_id)
