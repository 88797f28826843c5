"""Retrieval over documents, with the benchmark's items as queries, and over embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions import rules as r
from quillon.operators import lexical_index as li
from quillon.operators import retrieval as x
from quillon.operators import vector_index as vi
from quillon.plans.registry import query
from quillon.plans.rule_plans import TYPE_SQL
from quillon.sources.sinks import scratch, written

r6 = lambda c: F.round(c, 6)
_TOK = r"regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'section\s+(\d+[a-z]?)', 'section_\1', 'g'), 'sec\.\s+(\d+[a-z]?)', 'section_\1', 'g'), '[\p{L}\p{N}_]+')"
BM25_SQL = f"""tok AS (SELECT doc_id, {_TOK} AS t FROM documents), post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term, n), mean AS (SELECT avg(raw) AS mean FROM raw), w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN w USING (term), st GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20)"""
_kept = lambda ranked: x.checked(written(ranked, "ranked"))  # noqa: E731  # a ranking's few rows go to the tables that they are joined with
_bm25 = lambda t, k=20: x.bm25(t.documents, t.benchmark.select("item_id", F.col("text").alias("q")), doc="doc_id", text="text", query="item_id", query_text="q", k=k)
query("r01_bm25_postings", f"WITH tok AS (SELECT doc_id, {_TOK} AS t FROM documents) SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, CAST(len(t) AS INT) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2")(lambda t: x.postings(t.documents, "doc_id", "text"))
_IDF_SQL = BM25_SQL[: BM25_SQL.index(",\nq AS")]
query("r01_bm25_idf", f"WITH {_IDF_SQL} SELECT term, round(idf, 6) AS idf FROM w")(lambda t: x.idf(x.term_counts(t.documents, "text")).select("term", r6(F.col("idf")).alias("idf")))
query("r02_bm25_top20", f"WITH {BM25_SQL} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM top")(lambda t: _bm25(t))


@query("r02_indexed_top20", f"WITH {BM25_SQL.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE doc_id % 50 <> 7)')} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM top")
def _indexed(t):
    """The same from a maintained index: two inserts, of which the second also brings documents that are there, and a delete."""
    index = li.open_lexical(t.spark, f"{scratch(t.spark)}/terms-{uuid.uuid4().hex}", buckets=8)
    index = li.insert(index, t.documents.filter("doc_id % 3 < 2"))
    index = li.delete(li.insert(index, t.documents.filter("doc_id % 3 > 0")), t.documents.filter("doc_id % 50 = 7"))
    return li.search(index, t.benchmark.select("item_id", F.col("text").alias("q")), query="item_id", query_text="q").withColumnRenamed("doc", "doc_id")


# the stated queries: every vector whose id is divisible by 20
DENSE_SQL = """dq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), dp AS (SELECT query_id, vec_id, label, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))), 6) AS score FROM embeddings e, dq),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dp QUALIFY rank <= 20)"""
_dq = lambda t: t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
_dense = lambda t, k=20: x.dense(t.embeddings, _dq(t), key="vec_id", vector="embedding", query="query_id", query_vector="q", k=k)
query("r03_dense_top20", f"WITH {DENSE_SQL} SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM dense")(lambda t: _dense(t))


@query("r03_index_top20")
def _index_top20(t):
    """The same by an inverted file: recall@20 of 0.9 or more against r03_dense_top20."""
    index = vi.build_index(t.embeddings, f"{scratch(t.spark)}/vectors-{uuid.uuid4().hex}")
    return vi.search(index, _dq(t)).withColumnsRenamed({"query": "query_id", "key": "vec_id"})


query("r04_distance_similarity", f"WITH {DENSE_SQL} SELECT query_id, vec_id, round(1 / (1 + (2 - 2 * score)), 6) AS similarity FROM dense")(lambda t: _dense(t).select("query_id", "vec_id", r6(1 / (1 + (2 - 2 * F.col("score")))).alias("similarity")))
query("r05_post_filter", f"WITH {BM25_SQL} SELECT item_id, doc_id, CAST(rank AS INT) AS rank FROM top JOIN documents USING (doc_id) WHERE lang = 'en'")(lambda t: _kept(_bm25(t)).join(t.documents.select("doc_id", "lang"), "doc_id").filter("lang = 'en'").select("item_id", "doc_id", "rank"))
# the second ranking that is fused: documents' vectors have the documents' ids, item i asks with vector 20 * i
FUSED_SQL = f"{BM25_SQL}, {DENSE_SQL}, by_vector AS (SELECT query_id // 20 AS item_id, vec_id AS doc_id, score, rank FROM dense WHERE query_id // 20 IN (SELECT item_id FROM benchmark) AND vec_id IN (SELECT doc_id FROM documents)), fu AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank FROM top UNION ALL SELECT item_id, doc_id, rank FROM by_vector) GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fu QUALIFY rank <= 20)"


def _by_vector(t):
    asked = _dq(t).join(x.checked(t.benchmark.select((F.col("item_id") * 20).alias("query_id")).distinct()), "query_id", "left_semi")
    top = x.dense(t.embeddings, asked, key="vec_id", vector="embedding", query="query_id", query_vector="q", k=20)
    own = top.select((F.col("query_id") / 20).cast("long").alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    return own.join(t.documents.select("doc_id").distinct(), "doc_id", "left_semi").select("item_id", "doc_id", "score", "rank")


def fused(t):
    return x.fuse([_bm25(t), _by_vector(t)], "item_id", "doc_id")


query("r06_rrf", f"WITH {FUSED_SQL} SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM fused")(lambda t: fused(t))


@query("r07_rerank", f"""WITH {FUSED_SQL}, c AS (SELECT item_id, doc_id, round(coalesce(v.score, 0) + 0.35 * len(list_intersect(string_split(lower(b.text), ' '), string_split(lower(d.text), ' '))) / len(list_distinct(string_split(lower(b.text), ' '))), 6) AS final FROM fused JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) LEFT JOIN by_vector v USING (item_id, doc_id))
SELECT item_id, doc_id, final, CAST(row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS INT) AS place, round(1 / (1 + exp(-final)), 6) AS confidence FROM c QUALIFY place <= 5""")
def _rerank(t):
    """The scorer's column is the vectors' closeness, 0 where it wasn't ranked."""
    near = written(_by_vector(t), "near")
    ranked = x.fuse([_bm25(t), near], "item_id", "doc_id").join(near.select("item_id", "doc_id", F.col("score").alias("scorer")), ["item_id", "doc_id"], "left")
    c = _kept(ranked).join(t.documents.select("doc_id", "text"), "doc_id").join(x.checked(t.benchmark.select("item_id", F.col("text").alias("q"))), "item_id")
    words = F.split(F.lower("q"), " ")
    return x.rerank(c, query="item_id", doc="doc_id", score=F.coalesce("scorer", F.lit(0.0)), overlap=F.size(F.array_intersect(words, F.split(F.lower("text"), " "))) / F.size(F.array_distinct(words)), k=5).select("item_id", "doc_id", "final", "place", "confidence")


query("r08_no_rerank", f"WITH {FUSED_SQL} SELECT item_id, doc_id, CAST(rank AS INT) AS rank, CAST(0.5 AS DOUBLE) AS confidence, 'LOW' AS level FROM fused WHERE rank <= 5")(lambda t: fused(t).filter("rank <= 5").select("item_id", "doc_id", "rank", F.lit(0.5).alias("confidence"), r.level(F.lit(0.5)).alias("level")))
query("r09_filtered_dense", f"WITH {DENSE_SQL} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM dp WHERE label = 1) WHERE k <= 5")(lambda t: x.dense(t.embeddings.filter("label = 1"), _dq(t), key="vec_id", vector="embedding", query="query_id", query_vector="q", k=5).select("query_id", "vec_id", "score"))


@query("r10_filter_relaxation", f"WITH {BM25_SQL}, f AS (SELECT item_id, doc_id, rank FROM top JOIN documents USING (doc_id) WHERE lang = 'fr'), a AS (SELECT item_id, doc_id, rank FROM top WHERE item_id NOT IN (SELECT item_id FROM f)) SELECT item_id, doc_id, CAST(rank AS INT) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM a)")
def _relaxed(t):
    path = f"{scratch(t.spark)}/top-{uuid.uuid4().hex}"  # the ranking is read three times: it is made once
    _bm25(t).select("item_id", "doc_id", "rank").write.parquet(path)
    top = t.spark.read.parquet(path)
    kept = top.join(t.documents.filter("lang = 'fr'").select("doc_id"), "doc_id", "left_semi")
    return kept.select("item_id", "doc_id", "rank").unionAll(top.join(kept.select("item_id"), "item_id", "left_anti"))


query("r11_stats", f"WITH {BM25_SQL} SELECT count(*) AS documents, (SELECT count(*) FROM w) AS terms, (SELECT round(avgdl, 6) FROM st) AS mean_length FROM documents")(lambda t: t.documents.agg(F.count("*").alias("documents")).crossJoin(x.idf(x.term_counts(t.documents, "text")).agg(F.count("*").alias("terms"))).crossJoin(x.bm25_stats(x.term_counts(t.documents, "text")).select(r6(F.col("avgdl")).alias("mean_length"))))


def _amended(t, wanted):
    """Rows of (act_name, section_number, n): the amendments of the sections in ``wanted``; no others are grouped."""
    sections = ["act_name", "section_number"]
    return t.amendments.join(wanted.select(*sections), sections, "left_semi").groupBy(*sections).agg(F.count("*").alias("n"))


@query("r13_retrieve", f"""WITH {FUSED_SQL}, kept AS (SELECT item_id, doc_id, rank, score, CASE doc_id % 4 WHEN 0 THEN 'Indian Penal Code 1860' WHEN 1 THEN 'Bharatiya Nyaya Sanhita 2023' WHEN 2 THEN 'Code of Criminal Procedure 1973' ELSE 'Negotiable Instruments Act 1881' END AS act_name, CAST(300 + doc_id % 37 AS STRING) AS section_number FROM fused WHERE rank <= 5)
SELECT item_id, doc_id, CAST(rank AS INT) AS rank, CASE WHEN score * 30 >= 0.75 THEN 'HIGH' WHEN score * 30 >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS level, coalesce(n, 0) AS n_amendments FROM kept LEFT JOIN (SELECT act_name, section_number, count(*) AS n FROM amendments GROUP BY 1, 2) a USING (act_name, section_number)""")
def _retrieve(t):
    """An item's five best acts, with how often each was amended."""
    act = F.element_at(F.array(*map(F.lit, ["Indian Penal Code 1860", "Bharatiya Nyaya Sanhita 2023", "Code of Criminal Procedure 1973", "Negotiable Instruments Act 1881"])), (F.col("doc_id") % 4 + 1).cast("int"))
    kept = _kept(fused(t).filter("rank <= 5").withColumn("act_name", act).withColumn("section_number", (300 + F.col("doc_id") % 37).cast("string")))
    return kept.join(_amended(t, kept), ["act_name", "section_number"], "left").select("item_id", "doc_id", "rank", r.level(F.col("score") * 30).alias("level"), F.coalesce("n", F.lit(0)).alias("n_amendments"))


query("r15_footer", "SELECT row_idx, system, CASE WHEN contains(answer, 'Sources:') OR act1 IS NULL THEN answer ELSE answer || ' Sources: ' || concat_ws('; ', act1 || ' ' || section1, act2 || ' ' || section2) END AS answer FROM responses")(lambda t: t.responses.select("row_idx", "system", F.when(F.col("answer").contains("Sources:") | F.col("act1").isNull(), F.col("answer")).otherwise(F.concat("answer", F.lit(" Sources: "), F.concat_ws("; ", F.concat("act1", F.lit(" "), "section1"), F.concat("act2", F.lit(" "), "section2")))).alias("answer")))
_RULE = "=" * 80


@query("r16_context", f"""WITH {FUSED_SQL}, k AS (SELECT item_id, rank, doc_id, score, act_name, section_number, section_title, coalesce(nullif(full_text, ''), 'No text available') AS full_text, is_replaced, coalesce(n, 0) AS n FROM fused JOIN bare_acts b ON b.id = doc_id LEFT JOIN (SELECT act_name, section_number, count(*) AS n FROM amendments GROUP BY 1, 2) a USING (act_name, section_number) WHERE rank <= 5)
SELECT item_id, 'RETRIEVAL SUMMARY:' || chr(10) || 'Query Type: ' || any_value({TYPE_SQL.replace('query_text', 'text')}) || chr(10) || 'Confidence Level: ' || max(CASE WHEN score * 30 >= 0.75 THEN 'HIGH' WHEN score * 30 >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END) FILTER (rank = 1) || chr(10) || 'BNS/BNSS Transition Notes: ' || CASE WHEN bool_or(is_replaced) THEN 'Yes' ELSE 'No' END || chr(10) || chr(10)
  || '{_RULE}' || chr(10) || 'BARE ACTS / STATUTORY PROVISIONS:' || chr(10) || '{_RULE}' || chr(10)
  || string_agg(chr(10) || '[ACT ' || CAST(rank AS STRING) || ']' || chr(10) || 'Act: ' || act_name || chr(10) || 'Section: ' || section_number || chr(10) || 'Title: ' || section_title || chr(10) || 'Confidence: ' || printf('%.3f', score * 30) || chr(10) || CASE WHEN is_replaced THEN 'TRANSITION: the law was replaced' || chr(10) ELSE '' END || chr(10) || 'Text:' || chr(10) || full_text || CASE WHEN n > 0 THEN chr(10) || chr(10) || 'This section has ' || CAST(n AS STRING) || ' amendment(s)' ELSE '' END, chr(10) ORDER BY rank)
  || chr(10) || chr(10) || '{_RULE}' || chr(10) || 'RETRIEVAL STATISTICS:' || chr(10) || 'Bare Acts: ' || CAST(count(*) AS STRING) || chr(10) || 'Amendments: ' || CAST(CAST(sum(n) AS BIGINT) AS STRING) || chr(10) || '{_RULE}' AS context FROM k JOIN benchmark USING (item_id) GROUP BY 1""")
def _context(t):
    """The whole texts of an item's five best acts, with what is known of each, as one text."""
    top, acts = _kept(fused(t).filter("rank <= 5")), t.bare_acts.withColumnRenamed("id", "doc_id")
    n = _amended(t, x.checked(top.join(acts.select("doc_id", "act_name", "section_number"), "doc_id")))
    k = top.join(acts, "doc_id").join(n, ["act_name", "section_number"], "left").join(x.checked(t.benchmark.select("item_id", F.col("text").alias("asked"))), "item_id").withColumn("n", F.coalesce("n", F.lit(0)))
    lit = F.lit
    act = F.concat(lit("\n[ACT "), F.col("rank").cast("string"), lit("]\nAct: "), "act_name", lit("\nSection: "), "section_number", lit("\nTitle: "), "section_title", lit("\nConfidence: "), F.format_string("%.3f", F.col("score") * 30), lit("\n"), F.when(F.col("is_replaced"), "TRANSITION: the law was replaced\n").otherwise(""), lit("\nText:\n"), F.coalesce(F.nullif("full_text", lit("")), lit("No text available")), F.when(F.col("n") > 0, F.concat(lit("\n\nThis section has "), F.col("n").cast("string"), lit(" amendment(s)"))).otherwise(""))
    by = k.groupBy("item_id").agg(F.first(r.query_type(F.col("asked"))).alias("kind"), F.max(F.when(F.col("rank") == 1, r.level(F.col("score") * 30))).alias("level"), F.bool_or("is_replaced").alias("notes"), F.array_sort(F.collect_list(F.struct("rank", act.alias("a")))).alias("acts"), F.count("*").alias("c"), F.sum("n").alias("n"))  # five at most
    head = F.concat(lit("RETRIEVAL SUMMARY:\nQuery Type: "), "kind", lit("\nConfidence Level: "), "level", lit("\nBNS/BNSS Transition Notes: "), F.when(F.col("notes"), "Yes").otherwise("No"), lit(f"\n\n{_RULE}\nBARE ACTS / STATUTORY PROVISIONS:\n{_RULE}\n"))
    return by.select("item_id", F.concat(head, F.array_join(F.transform("acts", lambda a: a["a"]), "\n"), lit(f"\n\n{_RULE}\nRETRIEVAL STATISTICS:\nBare Acts: "), F.col("c").cast("string"), lit("\nAmendments: "), F.col("n").cast("string"), lit(f"\n{_RULE}")).alias("context"))



query("r17_warnings", "SELECT row_idx, system, concat_ws('; ', CASE WHEN lower(confidence) = 'low' THEN 'low confidence' END, CASE WHEN transition_note <> '' THEN 'law replaced' END, CASE WHEN contains(answer, 'overruled') THEN 'overruled case' END) AS warnings FROM responses")(lambda t: t.responses.select("row_idx", "system", F.concat_ws("; ", F.when(F.lower("confidence") == "low", "low confidence"), F.when(F.col("transition_note") != "", "law replaced"), F.when(F.col("answer").contains("overruled"), "overruled case")).alias("warnings")))
query("r18_simple_baseline", f"WITH {DENSE_SQL}, u AS (SELECT query_id, vec_id, 2 - 2 * score AS d FROM dp), t3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM u QUALIFY k <= 3) SELECT query_id, round(avg(d), 6) AS mean_distance, CASE WHEN round(avg(1 - d / 2), 6) >= 0.8 THEN 'high' WHEN round(avg(1 - d / 2), 6) >= 0.65 THEN 'medium' ELSE 'low' END AS label FROM t3 GROUP BY 1")(lambda t: _dense(t, 3).withColumn("d", 2 - 2 * F.col("score")).groupBy("query_id").agg(r6(F.avg("d")).alias("mean_distance"), r6(F.avg(1 - F.col("d") / 2)).alias("s")).select("query_id", "mean_distance", F.when(F.col("s") >= 0.8, "high").when(F.col("s") >= 0.65, "medium").otherwise("low").alias("label")))
# similarity joins: the stated queries against all vectors
query("j18_similarity_top_k", f"WITH {DENSE_SQL} SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM dense WHERE rank <= 3")(lambda t: _dense(t, 3).select("query_id", "vec_id", "rank"))


@query("j19_threshold_fallback", f"WITH {DENSE_SQL}, t3 AS (SELECT query_id, vec_id, rank, 2 - 2 * score < 0.7 AS pass FROM dense WHERE rank <= 3) SELECT query_id, vec_id FROM (SELECT *, bool_or(pass) OVER (PARTITION BY query_id) AS any_pass FROM t3) WHERE CASE WHEN any_pass THEN pass ELSE rank <= 2 END")
def _fallback(t):
    top = _dense(t, 3).withColumn("pass", 2 - 2 * F.col("score") < 0.7)
    passed = top.groupBy("query_id").agg(F.bool_or("pass").alias("any_pass"))
    return top.join(passed, "query_id").filter(F.when(F.col("any_pass"), F.col("pass")).otherwise(F.col("rank") <= 2)).select("query_id", "vec_id")


query("j20_nearest", f"WITH {DENSE_SQL} SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM dp WHERE label = 2 AND vec_id <> query_id) WHERE k = 1")(lambda t: x.dense(t.embeddings.filter("label = 2"), _dq(t), key="vec_id", vector="embedding", query="query_id", query_vector="q", k=2).filter("vec_id <> query_id").groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("vec_id")))
query("p25_duplicate_detector", f"WITH {DENSE_SQL} SELECT query_id, 2 - 2 * max(score) < 0.1 AS duplicate FROM dp WHERE vec_id <> query_id GROUP BY 1")(lambda t: _dense(t, 2).filter("vec_id <> query_id").groupBy("query_id").agg((2 - 2 * F.max("score") < 0.1).alias("duplicate")))


@query("r12_collection_preference", "SELECT lang, CASE WHEN n_ml > 0 THEN 'documents_ml' ELSE 'documents' END AS collection FROM (SELECT lang, count(*) FILTER (doc_id % 2 = 1 AND lang <> 'en') AS n_ml FROM documents GROUP BY 1)")
def _preference(t):
    """The multilingual twin of a collection where it has rows, else the collection itself."""
    twin = t.documents.filter("doc_id % 2 = 1 AND lang <> 'en'").groupBy("lang").agg(F.count("*").alias("n"))
    return t.documents.select("lang").distinct().join(twin, "lang", "left").select("lang", F.when(F.col("n") > 0, "documents_ml").otherwise("documents").alias("collection"))

