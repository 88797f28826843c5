"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and nothing else (SQL ``lower`` would also change É to é).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (Spark's names ignore case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


#: Settings for the jobs that run inside small_batches.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows in the jobs that start inside: little memory outside the JVM's heap, however long the rows are."""
    before = {k: spark.conf.get(k, None) for k in _BATCHES}
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _there.add(path)
    return out


#: Paths of tables of written() that haven't been dropped.
_there: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _there.discard(path)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


@contextmanager
def released(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables that were written inside when the block ends, but for those put into the list that it is given.

    Put it around what builds an operator's result and reads it: what an
    operator returns may read its tables when an action starts.
    """
    before, keep = set(_there), []
    try:
        yield keep
    finally:
        for path in _there - before - {df.written_to for df in keep}:
            _delete(spark, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="quillon-ship-")
    atexit.register(shutil.rmtree, folder, True)
    out = os.path.join(folder, "quillon_package.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "quillon").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def per_row(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., tuple]], schema: str, rows: str = "all") -> DataFrame:
    """Applies a Python function to Arrow batches of ``columns``.

    make() is called once a task; what it returns gets the columns' lists and
    gives a list for each column of schema.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    out = spark.createDataFrame([], schema).schema
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            made = f(*[b.column(i).to_pylist() for i in range(len(columns))])
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(made, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in schema.split(","))])


class Bounded(dict):
    """A cache of about ``limit`` results; it starts anew when full, so that it follows the data."""

    def __init__(self, make: Callable, limit: int = 500_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        v = self[key] = self.make(key)
        return v

    def fill(self, keys, many: Callable[[list], Iterable]) -> None:
        """Has all keys at hand after this call; many() makes the results of a list of keys in one go."""
        keys = {*keys}
        missing = [k for k in keys if k not in self]
        if missing:
            if len(self) + len(missing) > self.limit:
                self.clear()
                missing = list(keys)
            self.update(zip(missing, many(missing), strict=True))


_worker: dict = {}


def worker_cache(key: str, make: Callable):
    """An object that lives on in the Python worker, which serves many tasks, until another kind is asked for."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = make()
    return _worker[key]
