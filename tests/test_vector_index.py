"""The inverted file of vectors: recall against the exact search, pruned lists, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import vector_index as vi
from quillon.operators.retrieval import dense


@pytest.fixture(scope="module")
def clustered(spark):
    r = random.Random(2)
    centers = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [c + r.gauss(0, 0.35) for c in centers[i * i % 37 % 40]], i % 3) for i in range(6000)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int").repartition(6).persist()


def exact(vectors, queries, k=20):
    return {(r.query_id, r.vec_id) for r in dense(vectors, queries, key="vec_id", vector="embedding", query="query_id", query_vector="q", k=k).collect()}


def asked(vectors, every=20):
    return vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_recall_and_pruning(spark, clustered, tmp_path):
    index = vi.build_index(clustered, str(tmp_path / "a"), lists=30, sample=2000)
    assert index.vectors.select(F.sum(F.size("ids"))).first()[0] == 6000 and index.probes < 15
    q = asked(clustered)
    got = {(r.query, r.key) for r in vi.search(index, q).collect()}
    want = exact(clustered, q)
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    # all lists are the exact search, scores and ranks included
    every = vi.search(index, q, probes=30, k=5)
    assert sorted((r.query, r.key, r.rank) for r in every.collect()) == sorted((r.query_id, r.vec_id, r.rank) for r in dense(clustered, q, key="vec_id", vector="embedding", query="query_id", query_vector="q", k=5).collect())
    # one query opens its own lists only, as partitions of the scan
    one = vi.search(index, q.limit(1), probes=2)
    assert one.count() == 20
    lists = {r.list for r in index.vectors.select("list").distinct().collect()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert len(lists) > 20 and "PartitionFilters: [list" in plan and " IN (" in plan
    again = vi.open_index(spark, str(tmp_path / "a"))
    assert (again.dim, again.lists, again.probes) == (16, index.lists, index.probes)


def test_odd_rows(spark, tmp_path):
    nan = float("nan")
    rows = [(i, [float(i % 5), 1.0, 0.5]) for i in range(50)] + [(None, [1.0, 1.0, 1.0]), (100, None), (101, [1.0]), (102, [nan, 1.0, 1.0]), (103, [None, 1.0, 1.0]), (104, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vi.build_index(v, str(tmp_path / "b"), lists=4, sample=30)
    assert index.vectors.select(F.sum(F.size("ids"))).first()[0] == 51
    found = vi.search(index, spark.createDataFrame([(1, [0.0, 1.0, 0.5]), (2, None), (3, [1.0, 2.0])], "query_id long, q array<double>"), k=3, probes=4).collect()
    assert [(r.query, r.key, r.rank) for r in sorted(found, key=lambda r: r.rank)] == [(1, 0, 1), (1, 5, 2), (1, 10, 3)]
    with pytest.raises(ValueError):
        vi.build_index(v.filter("false"), str(tmp_path / "c"))


def test_equal_vectors_in_one_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "A_TASK", 100)
    monkeypatch.setattr(vi, "MATRIX", 64)
    monkeypatch.setattr(vi, "MOST_BROADCAST", 0)
    v = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(1.0)).alias("embedding"))
    index = vi.build_index(v, str(tmp_path / "d"), sample=200)
    got = vi.search(index, asked(v, 250), k=4).collect()
    assert sorted((r.query, r.key) for r in got) == [(q, i) for q in (0, 250, 500, 750) for i in range(4)]


def test_recall_of_the_tables_vectors(spark):
    from quillon.plans import QUERIES
    from tests.oracle import DATA

    for sf in (DATA, f"{DATA}/../sf0.1"):
        want = {(r.query_id, r.vec_id) for r in QUERIES["r03_dense_top20"](spark, sf).collect()}
        got = {(r.query_id, r.vec_id) for r in QUERIES["r03_index_top20"](spark, sf).collect()}
        assert len(got & want) >= 0.9 * len(want)
