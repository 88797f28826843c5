"""Versioned tables: what is rewritten, what readers see, point reads."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import manifests
from quillon.sources import versioned as v


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def folders(path):
    return {os.path.basename(p) for p in glob.glob(f"{path}/data/*")}


def test_upsert_delete_and_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(400).select("id", F.concat(F.lit("a"), "id").alias("x"))
    one = v.create(spark, path, first, "id", buckets=16)
    old = one.read()
    assert rows(old) == rows(first) and one.version == 1
    changes = spark.createDataFrame([(3, "new"), (3, "new"), (1000, "added"), (None, "no key")], "id long, x string")
    two = one.upsert(changes)
    want = {r[0]: r[1] for r in rows(first)} | {3: "new", 1000: "added"}
    assert dict(rows(two.read())) == want
    # only the touched buckets are written anew
    moved = {b for b in two.at if two.at[b] != one.at.get(b)}
    assert 1 <= len(moved) <= 2 and all(one.at[b] == two.at[b] for b in one.at if b not in moved)
    # the reader that was open before, and one of the old version, see the old rows
    assert rows(old) == rows(first) == rows(v.open_table(spark, path, 1).read())
    three = two.delete(spark.createDataFrame([(3,), (5,), (77777,), (None,)], "id long"))
    assert dict(rows(three.read())) == {k: x for k, x in want.items() if k not in (3, 5)}
    assert v.open_table(spark, path) == three and rows(v.open_table(spark, path, 2).read()) == rows(two.read())
    # of two writers of one version the second fails and leaves the table as it is
    with pytest.raises(RuntimeError):
        two.upsert(changes)
    assert rows(v.open_table(spark, path).read()) == rows(three.read())
    four = three.replace(F.col("x").startswith("a1"), spark.createDataFrame([(1, "one"), (2000, "two thousand")], "id long, x string"))
    left = {k: x for k, x in dict(rows(three.read())).items() if not x.startswith("a1")} | {1: "one", 2000: "two thousand"}
    assert dict(rows(four.read())) == left
    before = folders(path)
    four.vacuum(keep=1)
    assert manifests.versions(spark, path) == [4] and dict(rows(v.open_table(spark, path).read())) == left
    assert folders(path) < before and folders(path) == {f.split("/")[1] for f in four.at.values()}


def test_point_reads_open_one_bucket(spark, tmp_path):
    t = v.create(spark, str(tmp_path / "p"), spark.range(5000).select("id", (F.col("id") * 2).alias("y")), "id", buckets=32)
    one = t.get(77)
    assert rows(one) == [(77, 154)] and len(one.inputFiles()) == 1 and len(t.read().inputFiles()) >= 32
    assert rows(t.get(1, 2, 99999)) == [(1, 2), (2, 4)] and len(t.get(1, 2, 99999).inputFiles()) <= 3
    assert "EqualTo(id,77)" in one._jdf.queryExecution().executedPlan().toString()


def test_reindex_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "r")
    t = v.create(spark, path, spark.createDataFrame([], "id string, x int"), "id")
    assert t.read().count() == 0 and t.get("a").count() == 0
    t = t.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int"))
    again = t.reindex("_v2", lambda df: df.withColumn("z", F.col("x") * 10), buckets=4)
    assert rows(again.read()) == [("a", 1, 10), ("b", 2, 20)] and rows(t.read()) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        v.create(spark, path, t.read(), "id")
    with pytest.raises(ValueError):
        v.open_table(spark, path, 99)
    assert t.delete(spark.createDataFrame([], "id string")) is t
