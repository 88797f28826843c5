"""Queries of the rules, gates and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import rules as r
from quillon.plans.registry import query


def any_sql(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def like_sql(c, patterns):
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in patterns) + ")"


_Q = "lower(query_text)"
TYPE_SQL = f"CASE WHEN {like_sql(_Q, r.SECTION_PATTERNS)} THEN 'section_lookup' WHEN {like_sql(_Q, r.CITATION_PATTERNS)} THEN 'citation_lookup' " + " ".join(f"WHEN {any_sql(_Q, w)} THEN '{k}'" for k, w in r.KEYWORDS.items()) + " ELSE 'legal_question' END"
ACT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(upper(coalesce(query_text, '')), '{p}') THEN '{a}'" for p, a in r.ACT_PATTERNS) + " END"
query("p01_query_type", f"SELECT query_id, {TYPE_SQL} AS kind FROM queries")(lambda t: t.queries.select("query_id", r.query_type(F.col("query_text")).alias("kind")))
query("p02_act_filter", f"SELECT query_id, {ACT_SQL} AS act FROM queries")(lambda t: t.queries.select("query_id", r.act_filter(F.col("query_text")).alias("act")))


@query("p03_adaptive_top_k", f"""WITH k AS (SELECT query_id, {TYPE_SQL} AS kind, {any_sql("lower(coalesce(query_text, ''))", r.COMPLEX)} AS hard FROM queries)
SELECT query_id, CASE WHEN kind = 'citation_lookup' THEN 2 WHEN hard THEN 6 WHEN kind IN ('legal_question', 'amendment_query', 'case_search') THEN 5 ELSE 3 END AS k_acts, CASE WHEN kind = 'citation_lookup' THEN 3 WHEN hard OR kind IN ('legal_question', 'amendment_query', 'case_search') THEN 8 ELSE 5 END AS k_cases FROM k""")
def _top_k(t):
    acts, cases = r.top_ks(F.col("query_text"), r.query_type(F.col("query_text")))
    return t.queries.select("query_id", acts.alias("k_acts"), cases.alias("k_cases"))


_S = "CASE WHEN d <= 1.0 THEN d ELSE 1 - d / 2 END"
_LEVEL = lambda s: f"CASE WHEN {s} >= 0.75 THEN 'HIGH' WHEN {s} >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END"
# Distances of retrieved items, two collections a query.
_ITEMS = "WITH items AS (SELECT l_orderkey AS query_id, CASE WHEN l_linenumber % 2 = 0 THEN 'acts' ELSE 'cases' END AS collection, l_linenumber AS rank, CAST(l_partkey % 200 AS DOUBLE) / 100 AS d FROM lineitem)"
_items = lambda t: t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linenumber") % 2 == 0, "acts").otherwise("cases").alias("collection"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 200 / 100).alias("d"))
query("p04_confidence_level", f"{_ITEMS} SELECT query_id, rank, {_LEVEL(_S)} AS level FROM items")(lambda t: _items(t).select("query_id", "rank", r.level(r.as_score(F.col("d"))).alias("level")))


def _gated(t):
    return _items(t).withColumn("score", r.as_score(F.col("d"))).withColumn("level", r.level(F.col("score")))


query("p05_confidence_gate", f"{_ITEMS} SELECT query_id, collection, count(*) FILTER ({_LEVEL(_S)} <> 'LOW') AS kept, count(*) FILTER ({_LEVEL(_S)} <> 'LOW') = 0 AS uncertain FROM items GROUP BY ALL")(lambda t: _gated(t).groupBy("query_id", "collection").agg(F.count_if(F.col("level") != "LOW").alias("kept"), (F.count_if(F.col("level") != "LOW") == 0).alias("uncertain")))
query("p06_query_abstain", f"{_ITEMS} SELECT query_id, count(*) FILTER (collection = 'acts') > 0 AND count(*) FILTER (collection = 'cases') > 0 AND count(*) FILTER ({_LEVEL(_S)} <> 'LOW') = 0 AS abstain FROM items GROUP BY query_id")(lambda t: _gated(t).groupBy("query_id").agg(((F.count_if(F.col("collection") == "acts") > 0) & (F.count_if(F.col("collection") == "cases") > 0) & (F.count_if(F.col("level") != "LOW") == 0)).alias("abstain")))
query("p07_overall_confidence", f"{_ITEMS}, k AS (SELECT query_id, round(avg({_S}) FILTER ({_LEVEL(_S)} <> 'LOW'), 6) AS score FROM items GROUP BY query_id) SELECT query_id, score, CASE WHEN score IS NULL THEN 'NONE' WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM k")(lambda t: _gated(t).groupBy("query_id").agg(F.round(F.avg(F.when(F.col("level") != "LOW", F.col("score"))), 6).alias("score")).withColumn("label", F.when(F.col("score").isNull(), "NONE").otherwise(r.level(F.col("score")))))
query("p08_distance_label", f"{_ITEMS} SELECT query_id, rank, CASE WHEN s >= 0.80 THEN 'high' WHEN s >= 0.65 THEN 'medium' ELSE 'low' END AS label FROM (SELECT *, greatest(0.0, least(1.0, 1 - d / 2)) AS s FROM items)")(lambda t: _items(t).withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / 2))).select("query_id", "rank", F.when(F.col("s") >= 0.80, "high").when(F.col("s") >= 0.65, "medium").otherwise("low").alias("label")))
query("p09_regime_rewrite", "SELECT row_idx, system, CASE WHEN lower(confidence) = 'low' THEN 'I cannot provide a reliable answer.' ELSE answer END AS answer, CASE WHEN lower(confidence) = 'low' THEN NULL ELSE act1 END AS act1 FROM responses")(lambda t: t.responses.select("row_idx", "system", F.when(F.lower("confidence") == "low", "I cannot provide a reliable answer.").otherwise(F.col("answer")).alias("answer"), F.when(F.lower("confidence") != "low", F.col("act1")).alias("act1")))
_N = "(CASE WHEN act1 IS NULL THEN 0 ELSE 1 END + CASE WHEN act2 IS NULL THEN 0 ELSE 1 END)"
_n = lambda: F.col("act1").isNotNull().cast("int") + F.col("act2").isNotNull().cast("int")
query("p10_citation_confidence", f"SELECT row_idx, system, CASE WHEN {_N} >= 2 THEN 'high' WHEN {_N} = 1 THEN 'medium' ELSE 'low' END AS label FROM responses")(lambda t: t.responses.select("row_idx", "system", F.when(_n() >= 2, "high").when(_n() == 1, "medium").otherwise("low").alias("label")))
ABSTAIN_SQL = f"(trigger_uncertainty OR (lower(confidence) = 'low' OR {any_sql('lower(answer)', r.ABSTENTION)}) AND {_N} = 0)"
query("p11_abstention", f"SELECT row_idx, system, {ABSTAIN_SQL} AS abstained FROM responses")(lambda t: t.responses.select("row_idx", "system", r.abstains(F.col("answer"), F.col("confidence"), F.col("trigger_uncertainty"), _n()).alias("abstained")))
query("p12_abstention_markers", f"SELECT row_idx, system, trigger_uncertainty OR {any_sql('lower(answer)', r.ABSTENTION_SHORT)} AS abstained FROM responses")(lambda t: t.responses.select("row_idx", "system", (F.col("trigger_uncertainty") | r.has_any(F.lower("answer"), r.ABSTENTION_SHORT)).alias("abstained")))
query("p13_abstention_words", "SELECT row_idx, system, contains(lower(answer), 'abstain') OR contains(lower(answer), 'cannot answer') AS abstained FROM responses")(lambda t: t.responses.select("row_idx", "system", r.has_any(F.lower("answer"), ["abstain", "cannot answer"]).alias("abstained")))
query("p14_api_error", f"SELECT row_idx, system, {any_sql('lower(answer)', r.API_ERRORS)} AS failed FROM responses")(lambda t: t.responses.select("row_idx", "system", r.has_any(F.lower("answer"), r.API_ERRORS).alias("failed")))
query("p15_history", "SELECT query_id, query_type, timestamp FROM queries WHERE query_type = 'click' AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-20 00:00:00' ORDER BY timestamp DESC, query_id LIMIT 100")(lambda t: t.queries.filter((F.col("query_type") == "click") & (F.col("timestamp") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("timestamp") < F.lit("2024-01-20").cast("timestamp"))).orderBy(F.desc("timestamp"), "query_id").limit(100).select("query_id", "query_type", "timestamp"))
_AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"
_as_of = lambda: F.lit("2024-01-20 12:00:00").cast("timestamp")
query("p16_time_range", f"SELECT query_type, count(*) AS n FROM queries WHERE timestamp >= {_AS_OF} - INTERVAL 7 DAY GROUP BY 1")(lambda t: t.queries.filter(F.col("timestamp") >= _as_of() - F.expr("INTERVAL 7 DAYS")).groupBy("query_type").agg(F.count("*").alias("n")))
query("p17_same_day", f"SELECT count(*) AS n FROM queries WHERE CAST(timestamp AS DATE) = CAST({_AS_OF} AS DATE)")(lambda t: t.queries.filter((F.col("timestamp") >= F.date_trunc("day", _as_of())) & (F.col("timestamp") < F.date_trunc("day", _as_of()) + F.expr("INTERVAL 1 DAY"))).agg(F.count("*").alias("n")))
query("p18_dummy_scan", f"SELECT id, {any_sql('lower(full_text)', r.DUMMY)} AS dummy FROM bare_acts")(lambda t: t.bare_acts.select("id", r.has_any(F.lower("full_text"), r.DUMMY).alias("dummy")))
query("p19_completeness", "SELECT 'bare_acts' AS collection, count(*) FILTER (section_title IS NULL OR section_title = '') AS no_title, count(*) FILTER (full_text IS NULL OR full_text = '') AS no_text FROM bare_acts UNION ALL SELECT 'case_law', count(*) FILTER (citation IS NULL OR citation = ''), count(*) FILTER (chunk_text IS NULL OR chunk_text = '') FROM case_law")(lambda t: t.bare_acts.agg(F.count_if(F.coalesce("section_title", F.lit("")) == "").alias("no_title"), F.count_if(F.coalesce("full_text", F.lit("")) == "").alias("no_text")).withColumn("collection", F.lit("bare_acts")).unionByName(t.case_law.agg(F.count_if(F.coalesce("citation", F.lit("")) == "").alias("no_title"), F.count_if(F.coalesce("chunk_text", F.lit("")) == "").alias("no_text")).withColumn("collection", F.lit("case_law"))))
query("p20_min_size", "SELECT 'bare_acts' AS collection, count(*) AS n, count(*) >= 15 AS enough FROM bare_acts UNION ALL SELECT 'case_law', count(*), count(*) >= 100 FROM case_law UNION ALL SELECT 'amendments', count(*), count(*) >= 10 FROM amendments")(lambda t: t.bare_acts.agg(F.count("*").alias("n")).select(F.lit("bare_acts").alias("collection"), "n", (F.col("n") >= 15).alias("enough")).unionAll(t.case_law.agg(F.count("*").alias("n")).select(F.lit("case_law"), "n", F.col("n") >= 100)).unionAll(t.amendments.agg(F.count("*").alias("n")).select(F.lit("amendments"), "n", F.col("n") >= 10)))
query("p21_required_metrics", "SELECT count(*) AS n_rows, count(car) AS car, count(hr) AS hr, count(acs) AS acs, count(car) = count(*) AND count(hr) = count(*) AS complete FROM scores")(lambda t: t.scores.agg(F.count("*").alias("n_rows"), F.count("car").alias("car"), F.count("hr").alias("hr"), F.count("acs").alias("acs"), ((F.count("car") == F.count("*")) & (F.count("hr") == F.count("*"))).alias("complete")))
query("p22_rating_range", "SELECT feedback_id, rating FROM feedback WHERE rating BETWEEN 1 AND 5")(lambda t: t.feedback.filter(F.col("rating").between(1, 5)).select("feedback_id", "rating"))


@query("p23_suggestions", """WITH s AS (SELECT 100.0 * count(*) FILTER (confidence = 'LOW') / count(*) AS low, avg(response_time_ms) AS ms, count(*) FILTER (sources_count = 0) AS zero FROM responses_log), f AS (SELECT avg(rating) AS rating FROM feedback)
SELECT 'low confidence' AS area FROM s WHERE low > 20 UNION ALL SELECT 'slow' FROM s WHERE ms > 5000 UNION ALL SELECT 'no sources' FROM s WHERE zero > 10 UNION ALL SELECT 'low rating' FROM f WHERE rating < 3.5""")
def _suggestions(t):
    one = t.responses_log.agg((100 * F.count_if(F.col("confidence") == "LOW") / F.count("*")).alias("low"), F.avg("response_time_ms").alias("ms"), F.count_if(F.col("sources_count") == 0).alias("zero")).crossJoin(t.feedback.agg(F.avg("rating").alias("rating")))
    rules = F.array(F.when(F.col("low") > 20, "low confidence"), F.when(F.col("ms") > 5000, "slow"), F.when(F.col("zero") > 10, "no sources"), F.when(F.col("rating") < 3.5, "low rating"))
    return one.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("area"))


@query("p24_rule_transition", """WITH m AS (SELECT DISTINCT act_name, section_number FROM bare_acts WHERE is_replaced)
SELECT row_idx, m.section_number IS NOT NULL AS replaced FROM (SELECT row_idx, CASE correct_act WHEN 'IPC' THEN 'Indian Penal Code 1860' WHEN 'CrPC' THEN 'Code of Criminal Procedure 1973' END AS act, correct_section FROM ground_truth) g LEFT JOIN m ON g.act = m.act_name AND g.correct_section = m.section_number""")
def _rule_transition(t):
    g = t.ground_truth.select("row_idx", F.when(F.col("correct_act") == "IPC", "Indian Penal Code 1860").when(F.col("correct_act") == "CrPC", "Code of Criminal Procedure 1973").alias("act_name"), F.col("correct_section").alias("section_number"))
    m = t.bare_acts.filter("is_replaced").select("act_name", "section_number").distinct().withColumn("there", F.lit(True))
    return g.join(m, ["act_name", "section_number"], "left").select("row_idx", F.coalesce("there", F.lit(False)).alias("replaced"))
