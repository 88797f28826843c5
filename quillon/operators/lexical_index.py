"""A maintained lexical index: postings by bucket of the term, in segments, with deletes, merges and bounds of blocks.

A folder holds segments and manifests. A segment has, for the documents that one
insert brought, the postings (bucketed by term; in a task's file by falling weight within a term,
in blocks of BLOCK), the bounds of the blocks, the changes of the terms'
document counts, and the documents with their terms. A delete is a segment of
count changes and of documents that are gone up to it; nothing is rewritten. A
manifest names the segments and the collection's figures; a new one is written
last, under the next number, so that a reader sees the index before or after a
change. search() reads the buckets of the queries' terms only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quillon.functions.text import bm25_tokens
from quillon.operators.relational import topk
from quillon.operators.retrieval import EPSILON, K1, MOST_BROADCAST, B, _ranked, counted, each_term, repeated
from quillon.sources import manifests

#: Buckets of terms and of documents of a new index, postings of a block, terms that are pushed to the scan as values.
BUCKETS, BLOCK, MOST_PUSHED = 32, 256, 500
#: Keys of documents that may be broadcast (about 30 bytes each); beyond that the rows that they are joined with are shuffled.
MOST_KEYS = 4_000_000


@dataclass
class LexicalIndex:
    """A version of an index: its segments, the last one, and n documents of ``tokens`` tokens; ``mean`` is that of the terms' raw weights."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: list[int] = field(default_factory=list)
    n: int = 0
    tokens: int = 0
    gone: int = 0
    mean: float = 0.0
    buckets: int = BUCKETS

    def bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    @property
    def avgdl(self) -> float:
        return self.tokens / self.n if self.n else 0.0

    def read(self, part: str, schema: str, segments: list[int] | None = None) -> DataFrame:
        """A part of all segments, of those that have it."""
        paths = [p for s in (self.segments if segments is None else segments) if manifests.exists(self.spark, p := f"{self.path}/{part}/segment={s}")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        return self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.path}/{part}").parquet(*paths)


POSTINGS = "term string, doc long, tf long, dl int, block long, bucket int"
BOUNDS = "term string, block long, rows long, most_tf long, least_tf long, most_dl int, least_dl int, bucket int"
TERMS = "term string, df long, bucket int"
DOCS = "doc long, dl int, terms array<string>, tfs array<long>, bucket int"


def open_lexical(spark: SparkSession, path: str, buckets: int = BUCKETS) -> LexicalIndex:
    """The newest version; of a new index an empty one, with so many buckets."""
    known = manifests.versions(spark, path)
    return LexicalIndex(spark, path, **manifests.read(spark, path, known[-1])) if known else LexicalIndex(spark, path, buckets=buckets)


def _publish(old: LexicalIndex, segments: list[int], gone: int) -> LexicalIndex:
    """The next version, with its figures."""
    spark, new = old.spark, LexicalIndex(old.spark, old.path, old.version + 1, segments, gone=gone, buckets=old.buckets)
    live = alive(new).agg(F.count("*").alias("n"), F.sum("dl").alias("t")).first()
    new.n, new.tokens = live.n, live.t or 0
    raw = F.log(F.lit(new.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    new.mean = term_counts(new).agg(F.avg(raw)).first()[0] or 0.0
    manifests.publish(spark, old.path, new.version, {"version": new.version, "segments": segments, "n": new.n, "tokens": new.tokens, "gone": gone, "mean": new.mean, "buckets": new.buckets})
    return new


def term_counts(index: LexicalIndex) -> DataFrame:
    """Rows of (term, df) of the documents that are there."""
    return index.read("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def tombstones(index: LexicalIndex) -> DataFrame:
    """Rows of (doc, upto): what was deleted, from segments before ``upto``."""
    return index.read("gone", "doc long").groupBy("doc").agg(F.max("segment").alias("upto"))


def _live(index: LexicalIndex, rows: DataFrame) -> DataFrame:
    """``rows`` (doc, segment, …) without those of deleted documents."""
    if not index.gone:
        return rows
    dead = tombstones(index)
    dead = F.broadcast(dead) if index.gone <= MOST_KEYS else dead
    return rows.join(dead, (rows["doc"] == dead["doc"]) & (rows["segment"] < dead["upto"]), "left_anti")


def alive(index: LexicalIndex) -> DataFrame:
    return _live(index, index.read("docs", DOCS))


def _next(index: LexicalIndex) -> int:
    """A number that no segment has, published or not."""
    used = [int(n.split("=")[1]) for part in ("docs", "gone") for n in manifests.names(index.spark, f"{index.path}/{part}")]
    used += [0, *index.segments]
    return max(used) + 1


def _write_postings(index: LexicalIndex, each: DataFrame, segment: int) -> None:
    """(term, doc, tf, dl) as postings and bounds: each task sorts its own and cuts them into blocks, so that no posting is shuffled."""
    order = ["bucket", "term", F.desc("tf"), "dl", "doc"]
    path = f"{index.path}/postings/segment={segment}"
    placed = each.withColumn("bucket", index.bucket("term")).sortWithinPartitions(*order)
    # a row's place in its task, with the task's number above it: blocks of one term don't lie in two tasks
    placed.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}")).write.partitionBy("bucket").parquet(path)
    there = index.spark.read.schema(POSTINGS).parquet(path)
    bounds = there.groupBy("bucket", "term", "block").agg(F.count("*").alias("rows"), F.max("tf").alias("most_tf"), F.min("tf").alias("least_tf"), F.max("dl").alias("most_dl"), F.min("dl").alias("least_dl"))
    bounds.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.path}/bounds/segment={segment}")


def _write_docs(index: LexicalIndex, docs: DataFrame, segment: int) -> None:
    docs.write.partitionBy("bucket").parquet(f"{index.path}/docs/segment={segment}")


def _write_terms(index: LexicalIndex, changes: DataFrame, segment: int) -> None:
    sums = changes.groupBy("term").agg(F.sum("df").alias("df")).withColumn("bucket", index.bucket("term"))
    sums.repartition("bucket").write.partitionBy("bucket").parquet(f"{index.path}/terms/segment={segment}")


def _bury(index: LexicalIndex, keys: DataFrame, segment: int) -> DataFrame:
    """Writes which documents of ``keys`` (doc) end before ``segment``, and gives them as (doc, terms). Reads the documents' buckets, no posting."""
    wanted, found = keys.distinct(), alive(index)
    n = wanted.count()
    if n <= MOST_KEYS:
        wanted = F.broadcast(wanted)
    if n < index.buckets:
        found = found.filter(F.col("bucket").isin([r[0] for r in wanted.select(index.bucket("doc")).distinct().collect()]))
    path = f"{index.path}/gone/segment={segment}"
    found.join(wanted, "doc", "left_semi").select("doc", "terms").write.parquet(path)
    return index.spark.read.schema("doc long, terms array<string>").parquet(path)


_minus = lambda dead: dead.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))


def insert(index: LexicalIndex, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> LexicalIndex:
    """A version with ``docs`` in place of those with the same keys.

    A null text has no tokens; rows without a key are left out; of rows with
    equal keys the one with the least hash of its tokens stays.
    """
    segment, spark = _next(index), index.spark
    named = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc"), bm25_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    twice = repeated(named, "doc")
    n = twice.count()
    if n:  # only rows with equal keys are brought together
        twice = F.broadcast(twice) if n <= MOST_KEYS else twice
        named = named.join(twice, "doc", "left_anti").unionAll(named.join(twice, "doc", "left_semi").groupBy("doc").agg(F.min_by("t", F.xxhash64("t")).alias("t")))
    _write_docs(index, counted(named, "doc").withColumn("bucket", index.bucket("doc")), segment)  # texts are parsed once
    there = spark.read.schema(DOCS).parquet(f"{index.path}/docs/segment={segment}")
    dead = _bury(index, there.select("doc"), segment) if index.n else None
    _write_postings(index, each_term(there, "doc"), segment)
    counts = spark.read.schema(BOUNDS).parquet(f"{index.path}/bounds/segment={segment}").groupBy("term").agg(F.sum("rows").alias("df"))
    _write_terms(index, counts if dead is None else counts.unionAll(_minus(dead)), segment)
    return _publish(index, [*index.segments, segment], index.gone + (dead.count() if dead is not None else 0))


def delete(index: LexicalIndex, keys: DataFrame, doc: str = "doc_id") -> LexicalIndex:
    """A version without the documents of ``keys``; keys that aren't there change nothing."""
    segment = _next(index)
    dead = _bury(index, keys.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc")), segment)
    _write_terms(index, _minus(dead), segment)
    return _publish(index, [*index.segments, segment], index.gone + dead.count())


def merge(index: LexicalIndex) -> LexicalIndex:
    """A version of one segment, without what was deleted. Older versions' files stay until vacuum()."""
    segment = _next(index)
    parts = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    _write_docs(index, alive(index).drop("segment").repartition("bucket"), segment)
    left = _live(index, index.read("postings", POSTINGS)).select("term", "doc", "tf", "dl")
    # by ranges, so that one term isn't one task
    _write_postings(index, left.repartitionByRange(parts, index.bucket("term"), "term", F.desc("tf"), "dl", "doc"), segment)
    _write_terms(index, term_counts(index).select("term", "df"), segment)
    return _publish(index, [segment], 0)


def vacuum(index: LexicalIndex) -> None:
    """Deletes segments that ``index``, the newest version, doesn't name; older readers lose theirs."""
    for part in ("postings", "bounds", "terms", "docs", "gone"):
        for n in manifests.names(index.spark, f"{index.path}/{part}"):
            if int(n.split("=")[1]) not in index.segments:
                manifests.remove(index.spark, f"{index.path}/{part}/{n}")


def _weight(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(index: LexicalIndex, queries: DataFrame, *, query: str, query_text: str, k: int = 20, skip: bool = True) -> DataFrame:
    """Rows of (query, doc, score, rank), those of retrieval.bm25 over the documents that are there.

    Only the buckets of the queries' terms are read. A query's floor is what k
    documents of one of its terms' blocks reach at least; postings that can't
    reach it with the best of all its other terms are skipped. What is left is
    dealt by document, once for a block of queries with about MOST_BROADCAST
    terms, and scored there.
    """
    ids = StructType([StructField(query, queries.schema[query].dataType), StructField("doc", LongType()), StructField("score", DoubleType())])
    asked = queries.select(query, F.explode(bm25_tokens(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    blocks = max(1, -(-asked.count() // MOST_BROADCAST)) if index.n else 0
    out = index.spark.createDataFrame([], ids)
    for i in range(blocks):
        part = _scored(index, asked.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == i), query, ids, k, skip)
        out = out.unionAll(part) if i else part
    return topk(out.withColumn("score", F.round("score", 6)), [query], [F.desc("score"), "doc"], k, rank="rank")


def _scored(index: LexicalIndex, asked: DataFrame, query: str, ids: StructType, k: int, skip: bool) -> DataFrame:
    """Each task's best k of the queries ``asked`` (query, term, qtf), about MOST_BROADCAST rows."""
    terms = asked.select("term").distinct()
    buckets = sorted(r[0] for r in terms.select(index.bucket("term")).distinct().collect())  # one number a bucket at most
    some = [r[0] for r in terms.limit(MOST_PUSHED + 1).collect()]
    pushed = F.col("term").isin(some) if len(some) <= MOST_PUSHED else F.lit(True)
    of = lambda part, schema: index.read(part, schema).filter(F.col("bucket").isin(buckets) & pushed)
    counts = of("terms", TERMS).join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    raw = F.log(F.lit(index.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighted = asked.join(counts, "term").select(query, "term", (F.col("qtf") * F.when(raw < 0, EPSILON * index.mean).otherwise(raw)).alias("w"))
    # of each term, for a weight of 1: the most that a posting gives, and what k documents reach at least
    bound = of("bounds", BOUNDS).join(F.broadcast(terms), "term", "left_semi").withColumn("high", _weight(F.col("most_tf"), F.col("least_dl"), index.avgdl)).withColumn("low", _weight(F.col("least_tf"), F.col("most_dl"), index.avgdl))
    reached = F.sum("rows").over(Window.partitionBy("term").orderBy(F.desc("low"), "segment", "block"))
    best = bound.withColumn("sure", F.when(reached >= k + index.gone, F.col("low"))).groupBy("term").agg(F.max("high").alias("best"), F.max("sure").alias("sure"))
    by = Window.partitionBy(query)
    floor, rest = F.max(F.col("w") * F.col("sure")).over(by), F.sum(F.col("w") * F.col("best")).over(by) - F.col("w") * F.col("best")
    least = F.when((F.min("w").over(by) > 0) & floor.isNotNull() & F.lit(skip), (floor - 1e-5 - rest) / F.col("w")).otherwise(float("-inf"))
    rows = weighted.join(best, "term").select(query, "term", "w", least.alias("least")).orderBy(query, "term").collect()  # about MOST_BROADCAST rows
    number, lowest = {}, {}
    for _, term, _, least in rows:
        number.setdefault(term, len(number))
        lowest[term] = min(least, lowest.get(term, least))
    wanted = index.spark.createDataFrame([(t, n, lowest[t]) for t, n in number.items()], "term string, no int, least double")
    hits = of("postings", POSTINGS).join(F.broadcast(wanted), "term").filter(_weight(F.col("tf"), F.col("dl"), index.avgdl) >= F.col("least"))
    dealt = _live(index, hits).select("doc", "dl", "no", "tf").repartition("doc").sortWithinPartitions("doc")
    asks = index.spark.sparkContext.broadcast([(q, number[t], w, index.avgdl) for q, t, w, _ in rows])
    return dealt.mapInArrow(_ranked(asks, ids.names, k, inverted=True), ids)
