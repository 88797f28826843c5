"""Benchmark decontamination with DataFrame expressions only.

Items are cut into windows of 13 normalised words (a shorter item is one
window). A hash set of the distinct windows is broadcast; a pass over the
documents hashes every window of their words, of each length that the set has,
and probes the set. Each hit is verified word by word. Only hits, and one row a
document, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, drop, fresh, table, written

WINDOW = 13
#: Words of the windows that are broadcast at once, removed documents and distinct sets of items that are.
MOST_CELLS, MOST_BAD, MOST_NAMED = 4_000_000, 1_000_000, 100_000
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20


def words(c: Column) -> Column:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], lower-cased in A-Z; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows of (w, hash, items), the distinct windows, each with a number for the items that have it; and rows of (items, item).

    Windows with the same items share their number, so that a passage that many
    items have lists them once; no row holds a list of items.
    """
    w = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    one = w.select("item", F.explode(F.array_distinct(F.transform(starts, lambda s: F.slice("w", s, window)))).alias("w")).distinct().withColumn("hash", F.xxhash64("w"))
    mixed = lambda seed: F.sum(F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(1 << 31)))
    each = one.groupBy("w", "hash").agg(F.xxhash64(F.count("*"), mixed(1), mixed(2), mixed(3)).alias("items"))
    found = written(each, "windows")
    first = found.groupBy("items").agg(F.min(F.struct("hash", "w")).alias("f")).select("items", "f.w")
    return found, one.select("w", "item").join(first, "w").select("items", "item")


def _probed(each: DataFrame, found: DataFrame, lengths: list[int], rows: bool) -> DataFrame:
    """Verified hits of (k, mark, words) as rows (k, mark, n, s, items); with ``rows``, one with a null s for each document as well.

    ``found`` is broadcast. The hashes are made in the document's row first, so that
    the generator and the probe are compiled into one stage, in which the words
    beside the hashes aren't copied.
    """
    many = lambda n: F.greatest(F.size("words") - (n - 1), F.lit(0))
    hashes_of = lambda n: F.transform(F.when(many(n) > 0, F.sequence(F.lit(1), many(n))).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice("words", i, n)))
    each = each.withColumn("hashes", F.concat(F.array(F.lit(0).cast("long")), *map(hashes_of, lengths)))
    table = found.select("hash", "w", "items")
    if rows:  # what the first place of each document meets
        table = table.unionAll(found.sparkSession.sql("SELECT 0L AS hash, CAST(NULL AS array<string>) AS w, CAST(NULL AS bigint) AS items"))
    # outer, as Spark would else add a filter on the array's size, for which it makes all hashes once more
    at = each.select("k", "mark", "words", F.posexplode_outer("hashes").alias("pos", "hash")).join(F.broadcast(table), "hash")
    before, start = F.lit(0), F.lit(0)
    for n in lengths:
        start = F.when(F.size("w") == n, F.col("pos") - before).otherwise(start)
        before = before + many(n)
    true = (F.col("w").isNull() & (F.col("pos") == 0)) | ((start >= 1) & (F.slice("words", F.greatest(start, F.lit(1)), F.size("w")) == F.col("w")))
    return at.filter(true).select("k", "mark", F.size("words").cast("long").alias("n"), F.when(F.col("w").isNotNull(), F.struct(start.alias("a"), F.size("w").alias("l"))).alias("s"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, most: int = MOST_CELLS) -> DataFrame:
    """Per row: key, ``mark`` (a fingerprint of the text), n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and isn't contaminated; items without
    words or id are left out, repeated items count once. Rows with the same key
    and text give as many equal rows; null keys are keys. An empty benchmark
    hits nothing. Other columns aren't read. A table of more than ``most``
    words is broadcast in parts, with a pass over the documents for each: no
    window of a document is shuffled unless it hits. Items come in after that,
    once for all documents that hit windows with the same items.
    """
    spark = docs.sparkSession
    found, listed = windows(benchmark, item=item, text=item_text, window=window)
    size = found.groupBy(F.size("w").alias("l")).agg(F.sum(F.size("w")).alias("cells")).collect()  # at most ``window`` rows
    lengths, parts = sorted(r.l for r in size), max(1, -(-sum(r.cells for r in size) // most))
    each = docs.select(F.col(key).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"), words(F.col(text)).alias("words"))
    kept = None
    for i in range(parts):
        part = found if parts == 1 else found.filter(F.pmod("hash", F.lit(parts)) == i)
        some = _probed(each, part, lengths, i == 0)
        kept = some if kept is None else kept.unionAll(some)
    hit = F.size(F.array_distinct(F.flatten(F.transform("s", lambda s: F.sequence(s["a"], s["a"] + s["l"] - 1))))).cast("long")
    by = kept.groupBy("k", "mark").agg(F.max("n").alias("n_words"), F.count_if(F.col("s").isNull()).alias("rows"), F.collect_set("s").alias("s"), F.array_sort(F.collect_set("items")).alias("items"))
    by = written(by.select("k", "mark", "n_words", "rows", hit.alias("n_hit"), "items"), "hit")
    # what each set of numbers stands for
    several = by.filter(F.size("items") > 0).select("items").distinct().select("items", F.explode("items").alias("i"))
    named = several.join(listed.withColumnRenamed("items", "i"), "i").groupBy("items").agg(F.array_sort(F.collect_set("item")).alias("names"))
    named = written(named.select("items", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256")), "named_items")
    out = by.join(F.broadcast(named) if named.count() <= MOST_NAMED else named, "items", "left").select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    out = out.select(F.col("k").alias(key), F.col("mark").alias("mark" if key.lower() != "mark" else "_mark"), "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
    drop(found)
    return out if size else out.withColumn("contaminated", F.lit(False))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, unchanged.

    The keys and fingerprints of the others are written and counted; up to
    MOST_BAD of them are broadcast, so that no text is shuffled.
    """
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    bad = written(hits(own, benchmark, key="k", window=window, share=share).filter("contaminated").select("k", "mark").distinct(), "contaminated")
    mark = fresh(docs, "mark")
    left = docs.withColumn(mark, F.coalesce(F.xxhash64(text), F.lit(0)))
    named = bad.select(F.col("k").alias(fresh(left, "k")), F.col("mark").alias(fresh(left, "bad_mark")))
    return left.join(F.broadcast(named) if bad.count() <= MOST_BAD else named, left[key].eqNullSafe(named[named.columns[0]]) & (left[mark] == named[named.columns[1]]), "left_anti").drop(mark)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[s : s + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, s, l, array_to_string(w[s : s + l - 1], ' ') AS g
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), h AS (
  SELECT r, s, dw.l, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT r, s, l FROM h)) GROUP BY r
), i AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
