"""Tables with versions: upserts and deletes rewrite the buckets that they touch and leave older versions to their readers.

A row lies in the bucket of its key's hash. A manifest says in which folder each
bucket's rows are; a change writes the touched buckets to a folder of its own and
publishes the next manifest, so that a reader sees all of it or nothing. Files
are sorted by key and carry Bloom filters of it: a point read opens one bucket,
and in it what may hold the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.operators.relational import first_of, upsert
from quillon.sources import manifests

#: Buckets of a new table; rows of a change or keys of a read that are broadcast.
BUCKETS, MOST_BROADCAST = 32, 200_000
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Versioned:
    """A version of a table: for each bucket that has rows, the folder they are in."""

    spark: SparkSession
    path: str
    version: int
    key: str
    buckets: int
    schema: str
    at: dict[str, str]

    @property
    def _fields(self) -> StructType:
        import json

        return StructType.fromJson(json.loads(self.schema))

    def _of(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/{_BUCKET}={b}" for b, folder in self.at.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self._fields).parquet(*paths) if paths else self.spark.createDataFrame([], self._fields)

    def read(self) -> DataFrame:
        """All rows of this version."""
        return self._read()

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._of(F.col(self.key))).distinct().collect())  # one number a bucket at most

    def get(self, *keys) -> DataFrame:
        """The rows of a few keys, from their buckets; the keys are pushed to the scan."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self._fields[self.key]]))
        return self._read(self._touched(asked)).filter(F.col(self.key).isin(*keys))

    def _written(self, rows: DataFrame, name: str) -> str:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        dealt = rows.withColumn(_BUCKET, self._of(F.col(self.key))).repartition(_BUCKET).sortWithinPartitions(_BUCKET, self.key)
        dealt.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        return folder

    def _next(self, touched: list[int], folder: str | None) -> Versioned:
        there = {n.split("=")[1] for n in manifests.names(self.spark, f"{self.path}/{folder}") if "=" in n} if folder else set()
        at = {b: f for b, f in self.at.items() if int(b) not in touched} | {b: folder for b in there}
        new = Versioned(self.spark, self.path, self.version + 1, self.key, self.buckets, self.schema, at)
        manifests.publish(self.spark, self.path, new.version, {"version": new.version, "key": new.key, "buckets": new.buckets, "schema": new.schema, "at": at})
        return new

    def upsert(self, rows: DataFrame, order: list[Column | str] | None = None) -> Versioned:
        """The next version, with ``rows`` in place of those with the same keys. Of rows with equal keys the first in ``order`` is taken; rows without a key are left out."""
        rows = rows.filter(F.col(self.key).isNotNull()).select(*self._fields.names)
        new = first_of(rows, [self.key], order or [F.xxhash64(*rows.columns)])
        touched = self._touched(rows)
        return self._next(touched, self._written(upsert(self._read(touched), new, [self.key]), "upsert")) if touched else self

    def delete(self, keys: DataFrame) -> Versioned:
        """The next version, without the rows of ``keys``; the same version if no bucket is touched."""
        keys = keys.filter(F.col(self.key).isNotNull()).select(self.key).distinct()
        touched = [b for b in self._touched(keys) if str(b) in self.at]
        few = keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        return self._next(touched, self._written(self._read(touched).join(F.broadcast(keys) if few else keys, self.key, "left_anti"), "delete")) if touched else self

    def replace(self, predicate: Column, rows: DataFrame) -> Versioned:
        """The next version: ``rows`` in place of those that satisfy ``predicate``, all in one step; a row with a key that stays takes its place."""
        rows = first_of(rows.filter(F.col(self.key).isNotNull()).select(*self._fields.names), [self.key], [F.xxhash64(*self._fields.names)])
        held = self._read().filter(predicate)
        touched = sorted({*self._touched(held), *self._touched(rows)})
        kept = self._read(touched).filter(~F.coalesce(predicate, F.lit(False)))
        return self._next(touched, self._written(upsert(kept, rows, [self.key]), "replace")) if touched else self

    def reindex(self, suffix: str, make: Callable[[DataFrame], DataFrame], buckets: int | None = None) -> Versioned:
        """A table beside this one, at its path with ``suffix``, of what ``make`` makes of the rows."""
        made = make(self.read())
        return create(self.spark, f"{self.path}{suffix}", made, self.key, buckets or self.buckets)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests older than the last ``keep`` versions, and the folders that only they name; their readers lose them."""
        old = [v for v in manifests.versions(self.spark, self.path) if v <= self.version - keep]
        named = {f for v in manifests.versions(self.spark, self.path) if v not in old for f in manifests.read(self.spark, self.path, v)["at"].values()}
        for v in old:
            manifests.remove(self.spark, f"{self.path}/manifests/{v}")
        for n in manifests.names(self.spark, f"{self.path}/data"):
            if f"data/{n}" not in named:
                manifests.remove(self.spark, f"{self.path}/data/{n}")


def create(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = BUCKETS) -> Versioned:
    """A new table with ``rows``, as its first version."""
    if manifests.versions(spark, path):
        raise ValueError(f"{path} is a table already")
    return Versioned(spark, path, 0, key, buckets, rows.schema.json(), {}).upsert(rows) if not rows.isEmpty() else Versioned(spark, path, 0, key, buckets, rows.schema.json(), {})._next([], None)


def open_table(spark: SparkSession, path: str, version: int | None = None) -> Versioned:
    """The newest version, or a given one."""
    known = manifests.versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"{path} has no version {version or ''}")
    return Versioned(spark, path, **manifests.read(spark, path, version or known[-1]))
