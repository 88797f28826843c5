"""What a ranking is joined with stays where it lies: neither documents nor amendments are shuffled for its few rows."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics as m
from quillon.operators import retrieval as x
from quillon.plans import QUERIES
from tests.oracle import DATA


@pytest.fixture
def no_luck(spark):
    """The test tables are small enough for Spark to broadcast them unasked; large ones aren't."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(df):
    """The scanned columns that are shuffled with no join or aggregate before."""
    out = []

    def look(node, under):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return look(node.executedPlan(), under)
        if name.startswith("Scan parquet") and under:
            out.append(node.output().mkString(" "))
        below = node.children().size() == 1 and not name.endswith("Aggregate") and (under or name == "Exchange")
        for i in range(node.children().size()):
            look(node.children().apply(i), below)

    look(df._jdf.queryExecution().executedPlan(), False)
    return [c for c in out if ("doc_id" in c or "event_id" in c) and "rank" not in c]  # not the ranking itself


@pytest.mark.parametrize("name", ["r05_post_filter", "r07_rerank", "r16_context"])
def test_documents_are_not_shuffled(no_luck, name):
    assert shuffled(QUERIES[name](no_luck, DATA)) == []


@pytest.mark.parametrize("name", ["r13_retrieve", "r16_context"])
def test_only_wanted_amendments_are_grouped(no_luck, name):
    plan = QUERIES[name](no_luck, DATA)._jdf.queryExecution().executedPlan().toString()
    assert any("BroadcastHashJoin [act_name" in line and "LeftSemi" in line for line in plan.splitlines())


def test_acts_and_cases_are_not_shuffled(no_luck):
    ids = no_luck.range(50).select(F.col("id").alias("doc_id"))
    ids.write.mode("overwrite").parquet(f"{(path := x.scratch(no_luck))}/ids")
    ids = no_luck.read.parquet(f"{path}/ids")
    acts = ids.select(F.col("doc_id").alias("id"), F.lit("Indian Penal Code 1860").alias("act_name"), F.col("doc_id").cast("string").alias("section_number"))
    cases = ids.select(F.col("doc_id").alias("case_id"), F.concat(F.lit("AIR "), "doc_id").alias("citation"))
    truth = no_luck.createDataFrame([(1, "Section Lookup", "IPC", "7", ""), (2, "Case Law Search", "", "", "AIR 8"), (3, "Section Lookup", "IPC", "9", "")], "row_idx long, category string, correct_act string, correct_section string, correct_citation string")
    ranked = no_luck.createDataFrame([(1, 7, 1), (1, 3, 2), (2, 99, 1), (2, 8, 2), (2, 7, 4)], "row_idx long, doc_id long, rank int")
    got = m.precision_at_k(ranked, truth, acts, cases)
    assert shuffled(got) == []
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, 0.5), (2, 0.0, 0.5), (3, 0.0, 0.0)]


def test_lengths_give_the_stats(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "c")], "d long, t string")
    tokens = x.tokenised(docs, "d", "t")
    assert x.token_stats(tokens).collect() == x.bm25_stats(x.token_counts(tokens)).collect()
    nothing = x.tokenised(docs.limit(0), "d", "t")
    assert [tuple(r) for r in x.token_stats(nothing).collect()] == [(0, None)]
    asked = spark.createDataFrame([("q", "a c")], "q string, s string")
    monkeypatch.setattr(x, "bm25_stats", None)  # a pass over all tokens each time
    rank = lambda docs: [(r.d, r["rank"]) for r in sorted(x.bm25(docs, asked, doc="d", text="t", query="q", query_text="s").collect(), key=lambda r: r["rank"])]
    assert len(rank(docs)) == 2 and rank(docs.limit(0)) == []
