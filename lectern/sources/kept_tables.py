"""Tables that are kept in a folder and changed in place: rows lie in buckets of their key, and a change rewrites the buckets it touches.

A version says for every table and bucket in which folder its rows lie. A transaction writes the buckets that its changes touch into new folders and
then one version, for all tables at once; until that is written, readers see the version before, so a change that fails changes nothing. Files of buckets
that were not touched stay as they are. Rows that refer to a deleted row go with it (CASCADE) or forget it (SET NULL), through any number of tables.

Buckets are told by a hash of the key, so no key makes one large; take as many as a table needs for a bucket to be one task's work. The
driver holds numbers of buckets and names of folders. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.scratch import names_below, removed

CASCADE, SET_NULL = "cascade", "set null"
_BUCKET = "_bucket"
_VERSION = "name string, bucket int, folder string"


@dataclass(frozen=True)
class Kept:
    """A table: its columns, its primary key, in how many buckets it lies."""

    name: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 16

    @property
    def columns(self) -> list[str]:
        return [c.strip().split()[0] for c in self.schema.split(",")]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Reference:
    """column of child holds the key of a row of parent; action: what becomes of the row when that one goes."""

    child: str
    column: str
    parent: str
    action: str


class Tables:
    """The tables in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str, tables: Sequence[Kept], references: Sequence[Reference] = ()):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {t.name: t for t in tables}
        self.references = list(references)

    def version(self) -> int:
        """The number of the newest complete version, 0 before the first."""
        done = [int(n) for n in names_below(self.spark, f"{self.path}/versions") if "_SUCCESS" in names_below(self.spark, f"{self.path}/versions/{n}")]
        return max(done, default=0)

    def places(self, version: int | None = None) -> dict[tuple[str, int], str]:
        """The folder of each bucket that has rows."""
        number = self.version() if version is None else version
        if not number:
            return {}
        rows = self.spark.read.schema(_VERSION).parquet(f"{self.path}/versions/{number:09d}").collect()  # a row a bucket
        return {(r.name, r.bucket): r.folder for r in rows}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.rows(name, self.places(version))

    def rows(self, name: str, places: dict[tuple[str, int], str], buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a table as places has them, of all buckets or some."""
        table = self.tables[name]
        files = [f"{self.path}/data/{folder}/{_BUCKET}={b}" for (n, b), folder in sorted(places.items()) if n == name and (buckets is None or b in buckets)]
        if not files:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*files)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def sweep(self) -> int:
        """Removes folders that no bucket of the newest version lies in and older versions; returns how many folders went."""
        newest, used = self.version(), set(self.places().values())
        for n in names_below(self.spark, f"{self.path}/versions"):
            if int(n) != newest:
                removed(self.spark, f"{self.path}/versions/{n}")
        gone = [n for n in names_below(self.spark, f"{self.path}/data") if n not in used]
        for n in gone:
            removed(self.spark, f"{self.path}/data/{n}")
        return len(gone)


class Transaction:
    """Changes that become visible together, in the order in which they are made, or not at all."""

    def __init__(self, tables: Tables):
        self.on = tables
        self.places = tables.places()

    def read(self, name: str) -> DataFrame:
        """Rows of a table with the changes of this transaction."""
        return self.on.rows(name, self.places)

    def put(self, name: str, rows: DataFrame, newer: str | None = None) -> Transaction:
        """Rows put in, in place of those with their keys; newer: a column, of whose rows the greatest stays. Of equal keys in rows one stays."""
        table = self.on.tables[name]
        typed = self._typed(table, rows)
        others = [c for c in table.columns if c not in table.keys]
        order = F.struct(*([newer] if newer else []), *[c for c in others if c != newer])

        def one_each(some: DataFrame) -> DataFrame:
            return some.groupBy(*table.keys).agg(F.max(order).alias("r")).select(*[c if c in table.keys else F.col(f"r.{c}").alias(c) for c in table.columns]) if others else some.distinct()

        fresh = one_each(typed)

        def merged(old: DataFrame) -> DataFrame:
            if newer:
                return one_each(old.unionByName(fresh))
            return old.join(fresh.select(*table.keys), list(table.keys), "left_anti").select(*table.columns).unionByName(fresh)

        return self._rewritten(table, fresh, merged)

    def add(self, name: str, rows: DataFrame) -> Transaction:
        """Rows of new keys. A key that is there already, or twice in rows, is an error."""
        table = self.on.tables[name]
        typed = self._typed(table, rows)
        twice = typed.groupBy(*table.keys).count().where("count > 1").select(*table.keys)
        if not twice.isEmpty() or not typed.join(self.rows_at(table, typed), list(table.keys), "left_semi").isEmpty():
            raise ValueError(f"rows of {name} have keys that are there already")
        return self._rewritten(table, typed, lambda old: old.unionByName(typed))

    def delete(self, name: str, keys: DataFrame) -> Transaction:
        """Rows with these keys go, and what refers to them goes or forgets them."""
        table = self.on.tables[name]
        gone = self._typed(table, keys, table.keys).distinct()
        for reference in self.on.references:
            if reference.parent == name:
                self._follow(reference, gone)
        return self._rewritten(table, gone, lambda old: old.join(gone, list(table.keys), "left_anti").select(*table.columns))

    def commit(self) -> int:
        """Makes the changes visible; returns the number of the version."""
        if self.on.version() and self.on.places() == self.places:
            return self.on.version()
        tried = [int(n) for n in names_below(self.on.spark, f"{self.on.path}/versions")]
        number = max(tried, default=0) + 1
        rows = [(name, bucket, folder) for (name, bucket), folder in sorted(self.places.items())]
        self.on.spark.createDataFrame(rows, _VERSION).coalesce(1).write.parquet(f"{self.on.path}/versions/{number:09d}")
        return number

    def rows_at(self, table: Kept, rows: DataFrame) -> DataFrame:
        """What the buckets of these rows hold now."""
        return self.on.rows(table.name, self.places, self._touched(table, rows))

    def _typed(self, table: Kept, rows: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
        kinds = {c.strip().split()[0]: c.strip().split(None, 1)[1] for c in table.schema.split(",")}
        return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns or table.columns])

    def _touched(self, table: Kept, rows: DataFrame) -> list[int]:
        return [r.b for r in rows.select(table.bucket().alias("b")).distinct().collect()]  # at most the table's buckets

    def _follow(self, reference: Reference, gone: DataFrame) -> None:
        child = self.on.tables[reference.child]
        (parent_key,) = self.on.tables[reference.parent].keys
        lost = gone.select(F.col(parent_key).alias(reference.column))
        hit = self.read(child.name).select(*dict.fromkeys([*child.keys, reference.column])).join(lost, reference.column, "left_semi")
        if reference.action == CASCADE:
            self.delete(child.name, hit.select(*child.keys))
            return
        forgotten = lost.withColumn("_lost", F.lit(True))
        null = F.when(F.col("_lost").isNull(), F.col(reference.column)).alias(reference.column)
        self._rewritten(child, hit, lambda old: old.join(forgotten, reference.column, "left").select(*[null if c == reference.column else c for c in child.columns]))

    def _rewritten(self, table: Kept, touching: DataFrame, change) -> Transaction:
        """Writes change(old rows) of the buckets that touching has rows of."""
        touched = self._touched(table, touching)
        if not touched:
            return self
        folder = f"{table.name}-{uuid.uuid4().hex[:12]}"
        where = f"{self.on.path}/data/{folder}"
        old = self.on.rows(table.name, self.places, touched)
        change(old).withColumn(_BUCKET, table.bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(where)
        written = {int(n.split("=")[1]) for n in names_below(self.on.spark, where) if n.startswith(f"{_BUCKET}=")}
        self.places = {k: f for k, f in self.places.items() if k[0] != table.name or k[1] not in touched} | {(table.name, b): folder for b in written}
        return self
