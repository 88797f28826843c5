"""The maintained index gives bm25's rows after inserts, deletes and merges."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import lexical_index as li
from quillon.operators.retrieval import bm25
from tests.oracle import DATA


def plain(docs, queries, k=20):
    return sorted((r.item_id, r.doc_id, r.score, r["rank"]) for r in bm25(docs, queries, doc="doc_id", text="text", query="item_id", query_text="q", k=k).collect())


def indexed(index, queries, k=20, **kw):
    return sorted((r.item_id, r.doc, r.score, r["rank"]) for r in li.search(index, queries, query="item_id", query_text="q", k=k, **kw).collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", F.col("text").alias("q"))


def test_inserts_deletes_and_merges(spark, queries, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "i")
    one = li.insert(li.open_lexical(spark, path, 4), docs.filter("doc_id % 3 < 2"))
    assert indexed(one, queries) == plain(docs.filter("doc_id % 3 < 2"), queries)
    two = li.insert(one, docs.filter("doc_id % 3 = 2"))
    assert indexed(two, queries) == plain(docs, queries) and (two.n, two.version) == (200, 2)
    three = li.delete(two, docs.filter("doc_id % 7 = 0").select("doc_id").unionAll(spark.createDataFrame([(999999,), (None,)], "doc_id long")))
    left = docs.filter("doc_id % 7 <> 0")
    assert indexed(three, queries) == plain(left, queries)
    changed = spark.createDataFrame([(1, "section 302 of the penal code"), (7, "a text that comes back"), (5000, None), (None, "no key")], "doc_id long, text string")
    four = li.insert(three, changed)
    now = left.filter("doc_id <> 1").unionAll(changed.filter("doc_id IS NOT NULL").na.fill("", ["text"]))
    ask = queries.unionAll(spark.createDataFrame([(-1, "section 302 comes back back"), (-2, None), (-3, "zzz nothing")], "item_id long, q string"))
    assert indexed(four, ask) == plain(now, ask)
    # older versions are still there, and the newest is what is opened
    assert indexed(three, queries) == plain(left, queries) and li.open_lexical(spark, path, 4) == four
    five = li.merge(four)
    assert len(five.segments) == 1 and five.gone == 0 and indexed(five, ask) == plain(now, ask)
    li.vacuum(five)
    assert indexed(li.open_lexical(spark, path, 4), ask) == plain(now, ask)
    with pytest.raises(RuntimeError):
        li.delete(four, docs.select("doc_id"))  # another wrote the next version already


def test_blocks_are_skipped_and_buckets_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 8)
    r = random.Random(4)
    rows = [(i, " ".join(["rare"] * (i % 40 == 0) * r.randint(1, 4) + ["often"] * r.randint(0, 6) + [f"w{r.randrange(300)}" for _ in range(r.randint(5, 60))])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = li.insert(li.open_lexical(spark, str(tmp_path / "j"), 4), docs)
    ask = spark.createDataFrame([(1, "rare often"), (2, "w5 w6 w7"), (3, "often")], "item_id long, q string")
    for k in (3, 20):
        got = li.search(index, ask, query="item_id", query_text="q", k=k)
        assert indexed(index, ask, k) == plain(docs, ask, k) == indexed(index, ask, k, skip=False)
        text = got._jdf.queryExecution().optimizedPlan().toString()
        assert "documents" not in text
    one = li.search(index, spark.createDataFrame([(1, "rare")], "item_id long, q string"), query="item_id", query_text="q")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    # with a delete the floor must be reached by as many more documents
    gone = li.delete(index, docs.filter("doc_id % 40 = 0"))
    assert indexed(gone, ask, 3) == plain(docs.filter("doc_id % 40 <> 0"), ask, 3)


def test_skipped_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 8)
    rows = [(i, "term " * (1 + (i < 30) * 9) + "x " * (20 + i % 9)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = li.insert(li.open_lexical(spark, str(tmp_path / "k"), 4), docs)
    ask = spark.createDataFrame([(1, "term")], "item_id long, q string")
    read = []
    for skip in (True, False):
        df = li.search(index, ask, query="item_id", query_text="q", k=5, skip=skip)
        read.append(sorted((r.doc, r.score) for r in df.collect()))
    assert read[0] == read[1] and len(read[0]) == 5


def shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    nothing = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(nothing, False, False, gateway.new_array(jvm.double, 0), nothing)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_neither_postings_nor_pairs_are_shuffled(spark, tmp_path):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(str(r.randrange(40)) for _ in range(400))) for i in range(2000)], "doc_id long, text string").repartition(2)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    before = shuffled(spark)
    index = li.insert(li.open_lexical(spark, str(tmp_path / "l"), 4), docs)
    assert shuffled(spark) - before < 200_000  # 80,000 postings
    ask = spark.createDataFrame([(i, " ".join(map(str, range(40)))) for i in range(50)], "item_id long, q string")
    before = shuffled(spark)
    li.search(index, ask, query="item_id", query_text="q", k=3).collect()
    assert shuffled(spark) - before < 2_000_000  # 80,000 postings once, not 4 million parts of scores


def test_equal_keys(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "a a"), (None, "a"), (3, None), (3, None)], "doc_id long, text string")
    index = li.insert(li.open_lexical(spark, str(tmp_path / "m"), 4), docs)
    assert index.n == 3 and index.tokens in (3, 4)  # of texts with one key either stays
    assert index.read("postings", li.POSTINGS).filter("doc = 2").select("term", "tf").collect() == [("a", 2)]
