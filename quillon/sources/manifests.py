"""Numbered manifests of a folder: what a version of a table or index is made of, written last and in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = files(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = files(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none of one that isn't there."""
    p, fs = files(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{path}/manifests") if n.isdigit())


def read(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifests/{version}").first().value)


def publish(spark: SparkSession, path: str, version: int, said: dict) -> None:
    """Writes a version's manifest aside and renames it: of two writers of one version the second fails, and no reader sees half of one."""
    aside, at = f"{path}/manifests/_{uuid.uuid4().hex}", f"{path}/manifests/{version}"
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(aside)
    (a, fs), (b, _) = files(spark, aside), files(spark, at)
    if fs.exists(b) or not fs.rename(a, b):
        fs.delete(a, True)
        raise RuntimeError(f"version {version} of {path} was written by another")
