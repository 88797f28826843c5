"""Helpers that several operators are made of."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.sinks import scratch


def topk(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each partition's groups to k before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the first in ``order``."""
    return topk(df, keys, order, 1)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; the keys of ``new`` are distinct."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)


def numbered(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """``df`` with each row's place in ``order``, from 0, without sorting in one task.

    The rows are dealt by ranges and written; prefix sums over the ranges' counts
    (one number a range) give each its offset.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{scratch(spark)}/numbered-{uuid.uuid4().hex}"
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dict(dealt.groupBy("_part").count().collect())  # one row a range
    before, offsets = 0, {}
    for p in sorted(counts):
        offsets[p] = before
        before += counts[p]
    if not offsets:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_part")
    base = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn(name, (F.element_at(base, F.col("_part")) + inside).cast("long")).drop("_part")
