"""Approximate dense search: an inverted file of vectors.

Centroids are fitted on a bounded sample; every vector goes to the list of the
centroid it is closest to, and a list's vectors lie together as matrices in a
partition of a Parquet table. A query reads the lists of its closest centroids
only. How many lists that takes for a wanted recall is measured against the
exact search when the index is built. ``retrieval.dense`` remains the exact way.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.relational import topk
from quillon.operators.retrieval import dense

#: Vectors that centroids are fitted on, vectors of a list on average (but MOST_LISTS lists at most), queries that the recall is measured with, and the recall wanted.
SAMPLE, LIST, MOST_LISTS, MEASURED, RECALL = 50_000, 1000, 16_384, 200, 0.95
#: Vectors of a stored matrix; rows of a list that one task writes.
MATRIX, A_TASK = 1024, 200_000
#: Matrices of packed queries that are broadcast.
MOST_BROADCAST = 64


@dataclass
class VectorIndex:
    """An index in a folder: ``lists/list=…/`` with the vectors, ``centroids`` (list, centroid), and the number of lists that a query reads."""

    spark: SparkSession
    path: str
    dim: int
    lists: int
    probes: int

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("ids array<long>, matrix binary, list int").parquet(f"{self.path}/lists")

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")


def _scaler():
    """A function that scales a matrix's rows to length 1; nested, like the others here, so that it travels to the workers by value."""

    def unit(m):
        import numpy as np

        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    return unit


def _nearest(centroids, n: int, name: str):
    """Adds to rows (key, vector) their n closest lists, as an array."""
    unit = _scaler()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = centroids.value
        for whole in batches:
            for at in range(0, whole.num_rows, MATRIX):
                b = whole.slice(at, MATRIX)
                score = unit(np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, c.shape[1])) @ c.T
                best = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < c.shape[0] else np.tile(np.arange(c.shape[0]), (b.num_rows, 1))
                offsets = np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, best.ravel().astype(np.int32))], names=[*b.schema.names, name])

    return run


def _packer():
    """Rows (key, vector, list), sorted by list, to matrices of unit vectors of one list."""
    unit = _scaler()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(at, ids, v):
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([unit(np.array(v, float)).astype("<f4").tobytes()]), pa.array([at], pa.int32())], names=["ids", "matrix", "list"])

        at, ids, v = None, [], []
        for b in batches:
            for k, x, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (of != at or len(ids) == MATRIX):
                    yield out(at, ids, v)
                    ids, v = [], []
                at = of
                ids.append(k)
                v.append(x)
        if ids:
            yield out(at, ids, v)

    return run


def _usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(f"key IS NOT NULL AND size(v) = {dim} AND forall(v, x -> x IS NOT NULL AND x > double('-Infinity') AND x < double('Infinity'))")


def build_index(vectors: DataFrame, path: str, *, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL, measured: int = MEASURED, k: int = 20) -> VectorIndex:
    """Writes an index of all ``vectors`` under ``path`` and measures how many lists reach ``recall`` of the best ``k``.

    Fitted on the ``sample`` vectors with the least hashes of their keys. Rows
    without a key, or whose vector is null, of another length than most of the
    sample, or has a null or non-finite component, aren't indexed. Every list of
    more than A_TASK rows is written by several tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    first = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).select(key, vector).limit(sample).persist()
    dim = first.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        raise ValueError("there are no vectors")
    dim, rows = dim.d, _usable(vectors, key, vector, dim.d)
    n = rows.count()
    fit = _usable(first, key, vector, dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = fit.select(array_to_vector(F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-300)))).alias("features"))
    lists = lists or min(MOST_LISTS, n // LIST, fit.count() // 8)
    model = KMeans(k=max(2, lists), seed=7, maxIter=12, distanceMeasure="euclidean").fit(unit)
    import numpy as np

    centers = _scaler()(np.array(model.clusterCenters()))  # lists times dim numbers, bounded by MOST_LISTS
    first.unpersist()
    lists = len(centers)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centers)
    dealt = rows.mapInArrow(_nearest(shared, 1, "near"), "key long, v array<double>, near array<int>").select("key", "v", F.col("near")[0].alias("list"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = max(1, math.ceil(n / A_TASK))  # a list that holds everything still is written by this many tasks
    salted = dealt.repartition(parts, "list", F.pmod(F.xxhash64("key"), F.lit(several))).sortWithinPartitions("list", "key")
    salted.mapInArrow(_packer(), "ids array<long>, matrix binary, list int").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    index = VectorIndex(spark, path, dim, lists, lists)
    index.probes = _probes(index, rows, recall, measured, k)
    spark.createDataFrame([(json.dumps({"dim": dim, "lists": lists, "probes": index.probes}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return VectorIndex(spark, path, meta["dim"], meta["lists"], meta["probes"])


def _probes(index: VectorIndex, rows: DataFrame, recall: float, measured: int, k: int) -> int:
    """The least number of lists with which the measured queries find ``recall`` of their exact best ``k``.

    The queries are the vectors with the greatest hashes of their keys, which
    the centroids weren't fitted on if there are more than the sample.
    """
    asked = rows.orderBy(F.desc(F.xxhash64("key")), "key").limit(measured).select(F.col("key").alias("query"), F.col("v").alias("q"))
    best = dense(rows, asked, key="key", vector="v", query="query", query_vector="q", k=k)
    # the place, among a query's lists, of the list that holds each of its best
    centers, unit = index.spark.sparkContext.broadcast(_centers(index)), _scaler()

    def ranked(batches):
        import numpy as np
        import pyarrow as pa

        c = centers.value
        for b in batches:
            score = unit(np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, c.shape[1])) @ c.T
            place = np.argsort(np.argsort(-score, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place.tolist(), pa.list_(pa.int32()))], names=["query", "place"])

    held = index.vectors.select(F.explode("ids").alias("key"), "list")
    places = best.join(F.broadcast(asked.mapInArrow(ranked, "query long, place array<int>")), "query").join(held, "key").select(F.element_at("place", F.col("list") + 1).alias("p"))
    counts = places.groupBy("p").count().orderBy("p").collect()  # one row a list at most
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= recall * total:
            return r.p + 1
    return index.lists


def _centers(index: VectorIndex):
    import numpy as np

    rows = sorted(index.centroids.collect())
    return np.array([r.centroid for r in rows], float).reshape(len(rows), index.dim)


def search(index: VectorIndex, queries: DataFrame, *, query: str = "query_id", query_vector: str = "q", k: int = 20, probes: int | None = None) -> DataFrame:
    """Rows of (query, key, score, rank): the best ``k`` by cosine in the lists that each query reads, ties to the lower key.

    Lists that no query reads aren't opened: their numbers are pushed to the
    scan as partitions. Queries are packed by list, so that a list's matrix and
    all that ask for it meet in one product. Queries that can't be indexed find nothing.
    """
    spark = index.spark
    probes = min(probes or index.probes, index.lists)
    centers = spark.sparkContext.broadcast(_centers(index))
    asked = _usable(queries, query, query_vector, index.dim).mapInArrow(_nearest(centers, probes, "near"), "key long, v array<double>, near array<int>")
    each = asked.select("key", "v", F.explode("near").alias("list"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = each.repartition(parts, "list").sortWithinPartitions("list", "key").mapInArrow(_packer(), "ids array<long>, matrix binary, list int").select(F.col("ids").alias("asked"), F.col("matrix").alias("q"), "list").persist()
    wanted = [r.list for r in packed.select("list").distinct().collect()]  # one number a list
    found = index.vectors.filter(F.col("list").isin(wanted)).select("ids", "matrix", "list")
    small = packed.count() <= MOST_BROADCAST
    dim = index.dim

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for ids, m, who, q in zip(*(b.column(c).to_pylist() for c in ("ids", "matrix", "asked", "q")), strict=True):
                ids, who = np.array(ids), np.array(who)
                score = (np.frombuffer(q, "<f4").reshape(-1, dim).astype(float) @ np.frombuffer(m, "<f4").reshape(-1, dim).astype(float).T).round(6)
                n = min(k, len(ids))
                floor = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n]
                row, col = np.nonzero(score >= floor[:, None])  # ties stay until all lists are known
                s = score[row, col]
                order = np.lexsort((ids[col], -s, row))
                row, col, s = row[order], col[order], s[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.RecordBatch.from_arrays([pa.array(who[row[keep]], pa.int64()), pa.array(ids[col[keep]], pa.int64()), pa.array(s[keep])], names=["query", "key", "score"])

    joined = found.join(F.broadcast(packed) if small else packed, "list").select("ids", "matrix", "asked", "q")
    scored = joined.mapInArrow(best, "query long, key long, score double")
    return topk(scored, ["query"], [F.desc("score"), "key"], k, rank="rank")
