"""What the operators here have in common: the shared folder, Arrow helpers and word splitting.

All inputs are read by column name and narrowed at once, so extra columns, whatever their names,
never clash with the columns an operator adds.
"""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.scratch import removed, settled, shared_folder, workspace  # noqa: F401


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads; a null text counts as empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def crc_remainder(column: str, modulus: int):
    """crc32 of an id written as decimal text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def lowered_words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at space and \\x09-\\x0D: for ASCII bytes that is what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole keys from batches that are sorted by key (rows with the same key stay together)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        first, last = keys[0], keys[len(keys) - 1]
        if held and held[-1].column(key)[held[-1].num_rows - 1] != first:
            yield pa.Table.from_batches(held)
            held = []
        if first == last:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1], side="left"))
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


# Files in the shared folder, from Python code on any machine -------------------------------------


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


def put_file(uri: str, write) -> None:
    """write(stream) goes to a file that appears whole or not at all; a repeated task writes the same again."""
    store, path = file_system(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    partial = f"{path}.{uuid.uuid4().hex[:8]}.partial"
    with store.open_output_stream(partial) as stream:
        write(stream)
    store.move(partial, path)


def put_array(uri: str, values: np.ndarray) -> None:
    put_file(uri, lambda stream: stream.write(memoryview(np.ascontiguousarray(values)).cast("B") if values.size else b""))


def file_bytes(uri: str) -> bytes:
    store, path = file_system(uri)
    with store.open_input_stream(path) as stream:
        return stream.read()


def mapped_array(uri: str, dtype) -> np.ndarray:
    """A memory-mapped array. From a store without local paths the file is fetched first; its name goes at once."""
    store, path = file_system(uri)
    if not isinstance(store, pafs.LocalFileSystem):
        handle, local = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as stream:
            shutil.copyfileobj(stream, out)
        values = _mapped(local, dtype)
        os.unlink(local)
        return values
    return _mapped(path, dtype)


def _mapped(path: str, dtype) -> np.ndarray:
    if not Path(path).stat().st_size:
        return np.empty(0, dtype)
    with open(path, "rb") as file:
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), dtype)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or the first longer name that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int, characters: int) -> DataFrame:
    """doc_id, label, text of at most rows labels and at most characters of text, in the order of a hash of doc_id.

    Labels other than 0 and 1, repeated ones and those without doc_id are left out; of documents that share a doc_id the least
    text counts. The sample is written to the shared folder, so the documents are read once.
    """
    spark = docs.sparkSession
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = told.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & usable).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    chosen = settled(chosen, workspace(spark, f"labels-{label}"))  # at most rows rows
    texts = id_text(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = settled(chosen.join(texts, "doc_id"), workspace(spark, f"sample-{label}"))
    lengths = sample.select("doc_id", "label", F.length("text").cast("long").alias("n"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label")  # at most rows rows
    within = lengths.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= characters).select("doc_id", "label")
    return sample.join(F.broadcast(within), ["doc_id", "label"]).select("doc_id", "label", "text")
