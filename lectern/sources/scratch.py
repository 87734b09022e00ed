"""Tables on the way: written below the folder that driver and executors share, read again, removed when done."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset (tests on one machine) a temporary folder is made and set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def workspace(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder for one run of one operator."""
    return f"{shared_folder(spark)}/lectern-{what}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, path: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, in whatever store Spark has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders of a folder, in whatever store Spark has it; none if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def signature(spark: SparkSession, path: str) -> str:
    """Tells whether the files at path are what they were: a digest of their names, sizes and times."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    told = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in listed)
    return hashlib.sha256(repr(told).encode()).hexdigest()[:16]
