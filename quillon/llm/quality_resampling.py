"""Quality by importance resampling.

Two generative models, bags of hashed word unigrams and bigrams, are counted: of
the target (good labelled documents, at most TARGETS of them) and of all texts.
A text's weight is the log ratio of its likelihoods; the Gumbel top-k trick then
samples a fraction of the rows without replacement. The k-th largest key is
found exactly by four passes of 16 bits over the written keys, no sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import Bounded, ship, table, worker_cache, written
from quillon.llm.lm_scoring import mixed

BUCKETS, TARGETS, SEED = 10_000, 20_000, 17
#: Sampled share of all rows.
FRACTION = 0.85
U = np.uint64


def buckets(text: str | None, words: Bounded) -> np.ndarray:
    """Buckets of a text's word unigrams and bigrams, lower-cased in A-Z."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.array([], np.int64)
    h = np.fromiter(map(words.__getitem__, w), U, len(w))
    two = mixed(h[:-1] * U(0xD1342543DE82EF95) + h[1:])
    return (np.concatenate([h, two]) % U(BUCKETS)).astype(np.int64)


def _words() -> Bounded:
    import xxhash

    return worker_cache("lm words", lambda: Bounded(lambda w: xxhash.xxh3_64_intdigest(w), 400_000))


def gumbel(ids: list, seed: int) -> np.ndarray:
    """Noise that depends on a row's key and the seed alone."""
    import xxhash

    u = (np.array([xxhash.xxh3_64_intdigest(b"" if i is None else str(i).encode(), seed) >> 11 for i in ids], float) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def ordered(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, unsigned in order, as the doubles are; returned as their high and low halves' bits in a signed long."""
    b = (x + 0.0).view(np.int64)
    return np.where(b < 0, ~b, b ^ np.int64(-(1 << 63)))


def counted(docs: DataFrame, target: DataFrame, *, text: str, key: str) -> np.ndarray:
    """(2, BUCKETS) counts: of all rows, and of those whose key is in ``target`` (a bounded table)."""
    ship(docs.sparkSession)
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(target.select(F.col(target.columns[0]).alias("k"), F.lit(True).alias("good"))), "k", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = _words(), np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for t, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = np.bincount(buckets(t, words), minlength=BUCKETS)
                n[0] += k
                if good:
                    n[1] += k
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at], pa.int64()), pa.array(n[1, at], pa.int64())], names=["bucket", "every", "good"])

    out = np.zeros((2, BUCKETS), np.int64)
    for r in marked.mapInArrow(run, "bucket int, every long, good long").groupBy("bucket").agg(F.sum("every"), F.sum("good")).collect():  # at most BUCKETS rows
        out[:, r[0]] = r[1:]
    return out


def kth_largest(rows: DataFrame, order: str, k: int) -> int | None:
    """The k-th largest value of a long column read as unsigned; None if there are fewer rows."""
    prefix: Column | None = None
    high = 0
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned(F.col(order), shift).bitwiseAND(F.lit(0xFFFF))
        own = rows if prefix is None else rows.filter(prefix)
        n = dict(own.groupBy(part.cast("int").alias("p")).count().collect())  # at most 65,536 rows
        for p in sorted(n, reverse=True):
            if k <= n[p]:
                break
            k -= n[p]
        else:
            return None
        high = high << 16 | p
        prefix = F.shiftrightunsigned(F.col(order), shift) == F.lit(high if shift or high < 1 << 63 else high - (1 << 64))
    return high


def resample(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", good: Column | None = None, fraction: float = FRACTION, targets: int = TARGETS, seed: int = SEED) -> DataFrame:
    """Per row: key, n_grams, log_ratio, sample_key, kept.

    ``good`` picks the labels' target rows (by default quality 1, toxic 0); the
    first ``targets`` of them by a hash of their key are used. A null or empty
    text has no n-grams and log ratio 0. ceil(fraction * rows) rows are kept,
    and all that tie with the last. Equal rows have equal keys. Null keys share
    their noise. Without target rows all ratios are those of a flat model. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    good = good if good is not None else (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    target = labels.filter(good & F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(targets)
    n = counted(docs, target, text=text, key=key)
    total = n.sum(axis=1, keepdims=True)
    p = np.log((n + 1) / (total + BUCKETS))
    ratio = spark.sparkContext.broadcast(p[1] - p[0])
    schema = T.StructType([docs.schema[key], T.StructField("n_grams", T.LongType()), T.StructField("log_ratio", T.DoubleType()), T.StructField("sample_key", T.DoubleType()), T.StructField("order", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, r = _words(), ratio.value
        for b in batches:
            each = [buckets(t, words) for t in b.column(1).to_pylist()]
            score = np.array([float(r[x].sum()) for x in each], float)
            keys = score + gumbel(b.column(0).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array(score, pa.float64()), pa.array(keys, pa.float64()), pa.array(ordered(keys), pa.int64())], names=schema.names)

    rows = written(docs.select(key, text).mapInArrow(run, schema), "resampling")
    k = -int(-fraction * rows.count() // 1)
    least = kth_largest(rows, "order", k) if k else None
    signed = (least or 0) - (1 << 63)
    kept = (F.col("order").bitwiseXOR(F.lit(-(1 << 63))) >= F.lit(signed)) if least is not None else F.lit(False)
    return rows.select(key, "n_grams", "log_ratio", "sample_key", kept.alias("kept"))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
