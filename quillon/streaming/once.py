"""Batches of a stream that are safe to repeat: done ids are skipped, and near copies of what is there aren't inserted."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a shingle, minima and bands of a signature, per cent of shared shingles from which a text is a near copy.
WORDS, MINIMA, BANDS, SIMILAR = 5, 24, 8, 80
#: Rows of a bucket that are decided in one round, and about the rows a side of a block; shingles that are compared at once.
FRONT, TOKENS = 256, 4096


def _before(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What earlier batches have written; not what a broken-off run of this one left."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    there = spark.read.schema(f"{schema}, batch long").parquet(path)
    return there.filter(F.col("batch") < batch).drop("batch")


def each_once(stream: DataFrame, root: str, key: str, work: Callable[[DataFrame], DataFrame], *, crash: Callable[[int, str], None] = lambda batch, step: None):
    """Starts a query that applies ``work`` to rows of ``stream`` whose key hasn't been done, and returns it.

    A batch writes its results, then its keys, each under its number; a batch
    that is repeated after a crash replaces both, so that no row is there
    twice and none is lost. Keys done by earlier batches, or twice in a batch,
    are left out; rows without a key are left out. Results are read by results().
    ``crash`` is called before each write, for tests.
    """
    schema = f"{key} {stream.schema[key].dataType.simpleString()}"

    def batch_of(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        done = _before(spark, f"{root}/done", schema, i)
        fresh = df.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(done, key, "left_anti").persist()
        crash(i, "results")
        work(fresh).write.mode("overwrite").parquet(f"{root}/results/batch={i}")
        crash(i, "done")
        fresh.select(key).write.mode("overwrite").parquet(f"{root}/done/batch={i}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(batch_of).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def results(spark: SparkSession, root: str, part: str = "results") -> DataFrame:
    return spark.read.parquet(f"{root}/{part}").drop("batch")


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the distinct shingles of a text's lower-cased words; of all of them, if there are fewer; none without words."""
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
    # the same as the hash of a slice, which needn't be made; a word beyond the end is null and counts for nothing
    hashes = lambda w: F.array_distinct(F.transform(starts(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)])))
    # the words are a variable of an outer lambda: a text is split once, not again for each of its shingles
    each = F.transform(F.array(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(hashes(w)))
    return F.element_at(each, 1)


def with_bands(rows: DataFrame, minima: int = MINIMA, bands: int = BANDS) -> DataFrame:
    """``rows`` (key, at, s; keys are distinct) with a key for each band of minima; none of an empty set."""
    of = minima // bands
    least = rows.select("key", F.explode("s").alias("x")).groupBy("key").agg(*[F.min(F.xxhash64("x", F.lit(i))).alias(f"m{i}") for i in range(minima)])
    keys = least.select("key", F.array(*[F.xxhash64(F.lit(b), *[f"m{b * of + i}" for i in range(of)]) for b in range(bands)]).alias("bands"))
    return rows.join(keys, "key", "left").withColumn("bands", F.coalesce("bands", F.array().cast("array<bigint>")))


def similar(a: Column, b: Column, threshold: int = SIMILAR) -> Column:
    both = F.size(F.array_intersect(a, b))
    return (both > 0) & (100 * both >= threshold * (F.size(a) + F.size(b) - both))


_KEPT = "key {kind}, at timestamp, s array<bigint>, bands array<bigint>"


def skip_near_copies(stream: DataFrame, root: str, *, key: str, text: str, time: str, horizon: str = "90 days", threshold: int = SIMILAR, crash: Callable[[int, str], None] = lambda batch, step: None):
    """Starts a query that keeps of ``stream`` what isn't a near copy of a row kept within ``horizon``, and returns it.

    Rows are taken by time, then key, within a batch: one is kept unless it is
    similar to one that is kept. Kept rows are written with all their columns
    (results()), their signatures (``kept``) by day, so that a batch reads the
    days around its own only; those are the state, and days older than the
    horizon may be deleted. A batch that is repeated after a crash replaces what
    it wrote. Texts without words are kept; rows without key or time are left out.
    Pairs that no band finds, 1 in 200 at a similarity of 0.8, stay.
    """
    kind = stream.schema[key].dataType.simpleString()
    schema = _KEPT.format(kind=kind) + ", day date"

    def batch_of(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        own = f"{root}/work/batch={i}"
        far = F.expr(f"INTERVAL {horizon}")
        near = (F.col("at") <= F.col("_at") + far) & (F.col("_at") <= F.col("at") + far)

        def kept_as(made: DataFrame, name: str) -> DataFrame:
            made.write.mode("overwrite").parquet(f"{own}/{name}")
            return spark.read.schema(made.schema).parquet(f"{own}/{name}")

        rows = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("at"), shingles(F.col(text)).alias("s"))
        rows = kept_as(rows.groupBy("key").agg(F.min(F.struct("at", "s")).alias("r")).select("key", "r.*"), "sets")
        rows = kept_as(with_bands(rows).select("key", "at", "s", "bands"), "rows")
        gone = []
        span = rows.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
        if span.a is not None:
            known = _before(spark, f"{root}/kept", schema, i)
            known = known.filter(F.col("day").between(F.expr(f"date(timestamp'{span.a}' - INTERVAL {horizon})"), F.expr(f"date(timestamp'{span.b}' + INTERVAL {horizon})")))
            gone.append(kept_as(_copies(rows, known, near, threshold), "copies"))
        # rows without company in any bucket are kept; the others are open
        bucket = rows.select("key", F.explode("bands").alias("band"))
        company = bucket.join(bucket.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band"), "band").select("key").distinct()
        rest = rows.join(company, "key", "left_semi")
        for g in gone:
            rest = rest.join(g, "key", "left_anti")
        step = 0
        while True:
            # the first rows of each bucket are compared with each other; of those that stand in front in all their buckets, all earlier copies are known
            rest = kept_as(rest, f"open-{step}")
            if rest.isEmpty():
                break
            first = F.row_number().over(Window.partitionBy("band").orderBy("at", "key"))
            front = rest.select("key", "at", F.size("bands").alias("of"), F.explode("bands").alias("band")).withColumn("rank", first).filter(F.col("rank") <= FRONT)
            front = kept_as(front.select("band", "key", (F.count("*").over(Window.partitionBy("key")) == F.col("of")).alias("known")), f"front-{step}")
            whole = kept_as(front.filter("known").select("key").distinct(), f"whole-{step}")
            earlier = near & (F.struct("_at", "_key") < F.struct("at", "key"))
            pairs = _pairs(front.select("band", "key", F.lit(True).alias("a"), F.col("known").alias("b")), rest.select("key", F.lit(True).alias("a"), "at", "s"), threshold).filter(earlier)
            links = pairs.select("key", "_key").distinct().join(whole.select(F.col("key").alias("_key"), F.lit(True).alias("known")), "_key", "left")
            links = kept_as(links.select("key", "_key", F.coalesce("known", F.lit(False)).alias("known")), f"links-{step}")
            found, turn = [], 0
            while True:
                # what has no open earlier copy is kept, and its copies go
                heads = links.filter("known").select("_key").distinct().join(links.select(F.col("key").alias("_key")), "_key", "left_anti")
                now = kept_as(links.join(heads, "_key", "left_semi").select("key").distinct(), f"gone-{step}-{turn}")
                if now.isEmpty():
                    break
                found.append(now)
                turn += 1
                links = kept_as(links.join(now, "key", "left_anti").join(now.withColumnRenamed("key", "_key"), "_key", "left_anti"), f"links-{step}-{turn}")
            gone += found
            if whole.count() == rest.count():
                break
            kept = whole.join(links.select("key"), "key", "left_anti")  # the links that are left wait for rows behind the front
            for g in found:
                kept = kept.join(g, "key", "left_anti")
            kept = kept_as(kept, f"kept-{step}")
            behind = rest.join(whole, "key", "left_anti")
            gone.append(kept_as(_copies(behind, rest.join(kept, "key", "left_semi"), near, threshold), f"copies-{step}"))
            for g in [*found, kept, gone[-1]]:
                rest = rest.join(g, "key", "left_anti")
            step += 1
        accepted = rows
        for g in gone:
            accepted = accepted.join(g, "key", "left_anti")
        crash(i, "kept")
        # by ranges, as each task would write a file for each of its days
        dealt = accepted.withColumn("day", F.to_date("at")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "day", "key")
        dealt.write.mode("overwrite").partitionBy("day").parquet(f"{root}/kept/batch={i}")
        crash(i, "results")
        keys = spark.read.schema(schema).parquet(f"{root}/kept/batch={i}").select(F.col("key").alias(key), F.col("at").alias("_at"))
        whole = df.join(keys, (df[key] == keys[key]) & (df[time].cast("timestamp") == keys["_at"]), "left_semi").dropDuplicates([key])
        whole.write.mode("overwrite").parquet(f"{root}/results/batch={i}")
        p = spark._jvm.org.apache.hadoop.fs.Path(own)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return stream.writeStream.foreachBatch(batch_of).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def _copies(rows: DataFrame, kept: DataFrame, near: Column, threshold: int) -> DataFrame:
    """Keys of ``rows`` that are similar to any of ``kept`` with which they share a band."""
    side = lambda df, a: df.select(F.explode("bands").alias("band"), "key", F.lit(a).alias("a"), F.lit(not a).alias("b"))
    sets = lambda df, a: df.select("key", F.lit(a).alias("a"), "at", "s")
    pairs = _pairs(side(kept, True).unionAll(side(rows, False)), sets(kept, True).unionAll(sets(rows, False)), threshold)
    return pairs.filter(near).select("key").distinct()


def _pairs(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Rows (key, at, _key, _at), some more than once: of ``members`` (band, key, a, b) pairs of a row with b and another, with a, that share a band and whose ``sets`` (key, a, at, s) are similar.

    A bucket is compared in blocks of about FRONT rows a side, to which sets are
    dealt; of buckets with the same rows one. A row with a and b stands in a
    bucket of at most FRONT rows.
    """
    spark = sets.sparkSession
    same = [F.bit_xor(F.xxhash64(F.lit(i), "key", "a", "b")).alias(f"x{i}") for i in range(2)]
    each = members.groupBy("band").agg(F.count("*").alias("n"), F.count_if("a").alias("na"), F.count_if("b").alias("nb"), *same).filter("n > 1 AND na > 0 AND nb > 0")
    each = each.dropDuplicates(["n", "na", "nb", "x0", "x1"]).select("band", *[F.ceil(F.col(c) / FRONT).cast("int").alias(c) for c in ("na", "nb")])
    block = lambda of, n: F.when(F.col(of), F.array(F.pmod(F.xxhash64("key"), F.col(n)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = members.join(each, "band").select("band", "key", "a", "b", "nb", F.explode(block("a", "na")).alias("i")).select("band", "i", F.explode(block("b", "nb")).alias("j"), "a", "b", "key")
    dealt = dealt.join(sets, ["key", "a"]).select("band", "i", "j", "a", "b", "key", "at", "s")
    schema = T.StructType([T.StructField(n, sets.schema[n.strip("_")].dataType) for n in ("key", "at", "_key", "_at")])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(lambda b: _similar(b, threshold), schema)


def _similar(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """The similar pairs of blocks of rows (band, i, j, a, b, key, at, s), sorted by the first three."""

    def pairs(block: pa.Table) -> pa.Table | None:
        a, b = (np.flatnonzero(block[c].to_numpy()) for c in "ab")
        if not len(a) or not len(b):
            return None
        s = block["s"].combine_chunks()
        n = s.value_lengths().to_numpy()
        _, token, many = np.unique(s.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(n)), n), many > 1
        token, row = (np.cumsum(shared) - 1)[token[shared[token]]], row[shared[token]]
        order = np.argsort(token, kind="stable")
        token, row, both = token[order], row[order], np.zeros((len(a), len(b)), np.int64)
        for t in range(0, int(shared.sum()), TOKENS):
            x, at = np.zeros((len(n), TOKENS), np.float32), slice(*np.searchsorted(token, [t, t + TOKENS]))
            x[row[at], token[at] - t] = 1
            both += (x[a] @ x[b].T).astype(np.int64)
        i, j = np.nonzero((both > 0) & (100 * both >= threshold * (n[a][:, None] + n[b] - both)))
        i, j = a[i], b[j]
        i, j = i[i != j], j[i != j]
        return pa.table([block["key"].take(j), block["at"].take(j), block["key"].take(i), block["at"].take(i)], names=["key", "at", "_key", "_at"]) if len(i) else None

    rest, out = None, []
    for whole in itertools.chain(batches, [None]):
        rows = rest if whole is None else pa.Table.from_batches([whole]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([whole])])
        if rows is None or not len(rows):
            continue
        ids = [rows[c].to_numpy() for c in ("band", "i", "j")]
        starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], axis=0)]))
        ends = np.append(starts[1:], len(rows))
        rest = None if whole is None else rows.slice(starts[-1])  # may go on in the next batch
        out += [p for s, e in list(zip(starts, ends, strict=True))[: None if whole is None else -1] if e - s > 1 and (p := pairs(rows.slice(s, e - s))) is not None]
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out = []
