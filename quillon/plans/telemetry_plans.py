"""Usage telemetry: joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as x
from quillon.operators import parsing
from quillon.operators.relational import first_of, numbered, topk, upsert
from quillon.operators.transitions import transitions
from quillon.plans.registry import query
from quillon.plans.stats_plans import examples_of, examples_sql

r6 = lambda c: F.round(c, 6)
# ---- aggregates
query("a01_summary", "SELECT count(*) AS total, round(avg(r.response_time_ms), 6) AS mean_ms, count(DISTINCT q.session_id) AS sessions FROM queries q LEFT JOIN responses_log r ON q.query_id = r.query_id")(lambda t: t.queries.join(t.responses_log.select("query_id", "response_time_ms"), "query_id", "left").agg(F.count("*").alias("total"), r6(F.avg("response_time_ms")).alias("mean_ms"), F.countDistinct("session_id").alias("sessions")))
query("a02_by_confidence", "SELECT confidence, query_type, count(*) AS n FROM responses_log GROUP BY ALL")(lambda t: t.responses_log.groupBy("confidence", "query_type").agg(F.count("*").alias("n")))
query("a03_share", "SELECT query_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM queries), 2) AS share FROM queries GROUP BY query_type")(lambda t: t.queries.groupBy("query_type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 2)))
query("a04_rating", "SELECT round(avg(rating), 6) AS mean_rating, count(*) AS n FROM feedback")(lambda t: t.feedback.agg(r6(F.avg("rating")).alias("mean_rating"), F.count("*").alias("n")))
query("a05_common_queries", "WITH j AS (SELECT q.query_id, q.query_text, q.timestamp, r.response_time_ms FROM queries q LEFT JOIN responses_log r ON q.query_id = r.query_id) SELECT lower(query_text) AS key, count(*) AS frequency, round(avg(response_time_ms), 6) AS mean_ms, max(timestamp) AS last_asked, max_by(query_text, query_id) AS query_text FROM j GROUP BY lower(query_text) HAVING count(*) > 1")(lambda t: t.queries.join(t.responses_log.select("query_id", "response_time_ms"), "query_id", "left").groupBy(F.lower("query_text").alias("key")).agg(F.count("*").alias("frequency"), r6(F.avg("response_time_ms")).alias("mean_ms"), F.max("timestamp").alias("last_asked"), F.max_by("query_text", "query_id").alias("query_text")).filter("frequency > 1"))
query("a06_sources_bands", "SELECT CASE WHEN sources_count = 0 THEN '0' WHEN sources_count <= 2 THEN '1-2' WHEN sources_count <= 5 THEN '3-5' ELSE '6+' END AS band, count(*) AS n, round(avg(CASE confidence WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 ELSE 1.0 END), 6) AS mean_confidence FROM responses_log GROUP BY 1")(lambda t: t.responses_log.groupBy(F.when(F.col("sources_count") == 0, "0").when(F.col("sources_count") <= 2, "1-2").when(F.col("sources_count") <= 5, "3-5").otherwise("6+").alias("band")).agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("confidence") == "HIGH", 3.0).when(F.col("confidence") == "MEDIUM", 2.0).otherwise(1.0))).alias("mean_confidence")))
query("a07_mean_sources", "SELECT confidence, round(avg(bare_acts_retrieved), 6) AS acts, round(avg(case_laws_retrieved), 6) AS cases, round(avg(amendments_retrieved), 6) AS amendments FROM responses_log GROUP BY 1")(lambda t: t.responses_log.groupBy("confidence").agg(*[r6(F.avg(c)).alias(n) for c, n in (("bare_acts_retrieved", "acts"), ("case_laws_retrieved", "cases"), ("amendments_retrieved", "amendments"))]))
query("a08_percent_helpful", "SELECT round(100.0 * sum(CASE WHEN helpful THEN 1 ELSE 0 END) / count(*), 6) AS helpful, round(100.0 * sum(CASE WHEN accurate THEN 1 ELSE 0 END) / count(*), 6) AS accurate FROM feedback")(lambda t: t.feedback.agg(r6(100 * F.avg(F.col("helpful").cast("int"))).alias("helpful"), r6(100 * F.avg(F.col("accurate").cast("int"))).alias("accurate")))
query("a09_rating_histogram", "SELECT rating, count(*) AS n FROM feedback GROUP BY rating ORDER BY rating")(lambda t: t.feedback.groupBy("rating").agg(F.count("*").alias("n")).orderBy("rating"))
query("a10_low_share", "SELECT round(100.0 * count(*) FILTER (confidence = 'LOW') / count(*), 6) AS low FROM responses_log")(lambda t: t.responses_log.agg(r6(100 * F.count_if(F.col("confidence") == "LOW") / F.count("*")).alias("low")))
query("a11_sections_asked", r"SELECT section, count(*) AS n FROM (SELECT unnest(regexp_extract_all(query_text, '(?i)section\s+(\d+[A-Z]?)', 1)) AS section FROM queries) GROUP BY 1 ORDER BY n DESC, section LIMIT 10")(lambda t: t.queries.select(F.explode(F.regexp_extract_all("query_text", F.lit(r"(?i)section\s+(\d+[A-Z]?)"), F.lit(1))).alias("section")).groupBy("section").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(10))
query("a12_acts_asked", r"SELECT upper(act) AS act, count(*) AS n FROM (SELECT unnest(regexp_extract_all(query_text, '(?i)(IPC|CrPC|BNS|BNSS|IT Act)', 1)) AS act FROM queries) GROUP BY 1 ORDER BY n DESC, act LIMIT 10")(lambda t: t.queries.select(F.explode(F.regexp_extract_all("query_text", F.lit("(?i)(IPC|CrPC|BNS|BNSS|IT Act)"), F.lit(1))).alias("act")).groupBy(F.upper("act").alias("act")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "act").limit(10))
query("a13_mean_words", r"SELECT round(avg(len(list_filter(regexp_split_to_array(query_text, '\s+'), lambda w: w <> ''))), 6) AS mean_words FROM queries")(lambda t: t.queries.agg(r6(F.avg(F.size(F.filter(F.split("query_text", r"\s+"), lambda w: w != "")))).alias("mean_words")))
query("a14_peak_hours", "SELECT CAST(hour(timestamp) AS INT) AS hour, count(*) AS n FROM queries GROUP BY 1 ORDER BY n DESC, hour LIMIT 5")(lambda t: t.queries.groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(5))
query("a15_category_means", "SELECT system, category, round(avg(car), 6) AS car, round(avg(hr), 6) AS hr, round(avg(acs), 6) AS acs FROM scores GROUP BY ALL")(lambda t: t.scores.groupBy("system", "category").agg(*[r6(F.avg(c)).alias(c) for c in ("car", "hr", "acs")]))
query("a16_failures_by_category", "SELECT category, count(*) AS fails, round(avg(car), 6) AS car, round(avg(acs), 6) AS acs FROM scores WHERE correct = 0 GROUP BY 1 ORDER BY fails DESC, category")(lambda t: t.scores.filter("correct = 0").groupBy("category").agg(F.count("*").alias("fails"), r6(F.avg("car")).alias("car"), r6(F.avg("acs")).alias("acs")).orderBy(F.desc("fails"), "category"))
query("a17_failure_patterns", "SELECT category, system, difficulty, count(*) AS fails, round(avg(car), 6) AS car FROM scores WHERE correct = 0 GROUP BY 1, 2, 3 ORDER BY fails DESC, car, category, system, difficulty LIMIT 20")(lambda t: t.scores.filter("correct = 0").groupBy("category", "system", "difficulty").agg(F.count("*").alias("fails"), r6(F.avg("car")).alias("car")).orderBy(F.desc("fails"), "car", "category", "system", "difficulty").limit(20))
query("a18_series", "SELECT system, round(avg(car), 6) AS mean, round(stddev_samp(car), 6) AS std, round(quantile_cont(car, 0.5), 6) AS median FROM scores GROUP BY 1")(lambda t: t.scores.groupBy("system").agg(r6(F.avg("car")).alias("mean"), r6(F.stddev_samp("car")).alias("std"), r6(F.percentile("car", 0.5)).alias("median")))
query("a19_category_std", "SELECT category, round(avg(car), 6) AS mean, round(stddev_pop(car), 6) AS std, count(*) AS n FROM scores GROUP BY 1")(lambda t: t.scores.groupBy("category").agg(r6(F.avg("car")).alias("mean"), r6(F.stddev_pop("car")).alias("std"), F.count("*").alias("n")))
query("a20_domain_table", "SELECT coalesce(category, 'Overall') AS domain, count(*) AS n, round(avg(car) * 100, 2) AS car FROM scores WHERE system = 'full' GROUP BY ROLLUP (category)")(lambda t: t.scores.filter("system = 'full'").rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("car") * 100, 2).alias("car")).select(F.coalesce("category", F.lit("Overall")).alias("domain"), "n", "car"))
query("a21_weighted_mean", "WITH s AS (SELECT category, avg(car) AS m, count(*) AS n FROM scores GROUP BY 1) SELECT round(sum(m * n) / sum(n), 6) AS mean FROM s")(lambda t: t.scores.groupBy("category").agg(F.avg("car").alias("m"), F.count("*").alias("n")).agg(r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean")))
query("a22_legal_areas", "SELECT legal_area, count(*) AS n FROM overruling_map GROUP BY 1 ORDER BY n DESC, legal_area")(lambda t: t.overruling_map.groupBy("legal_area").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "legal_area"))
query("a23_system_log", "SELECT system, count(*) AS n, round(avg(seconds), 6) AS mean_s, count(*) FILTER (answer = '') AS errors, round(avg(CASE WHEN act1 IS NULL THEN 0 ELSE 1 END + CASE WHEN act2 IS NULL THEN 0 ELSE 1 END), 6) AS mean_citations FROM responses GROUP BY 1")(lambda t: t.responses.groupBy("system").agg(F.count("*").alias("n"), r6(F.avg("seconds")).alias("mean_s"), F.count_if(F.col("answer") == "").alias("errors"), r6(F.avg(F.col("act1").isNotNull().cast("int") + F.col("act2").isNotNull().cast("int"))).alias("mean_citations")))
query("a24_value_counts", "SELECT category, difficulty_level, count(*) AS n FROM ground_truth GROUP BY ALL")(lambda t: t.ground_truth.groupBy("category", "difficulty_level").agg(F.count("*").alias("n")))
query("a25_fields_seen", "SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")(lambda t: t.events.select(F.explode(F.json_object_keys("props")).alias("field")).distinct())
query("a26_last_runs", "SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 30")(lambda t: topk(t.events, ["event_type"], [F.desc("ts"), "event_id"], 30).select("event_type", "event_id", "ts"))
query("a27_risk_counts", "SELECT risk, coalesce(clause_type, 'Other') AS clause_type, count(*) AS n, count(*) FILTER (risk = 'high') AS high FROM risks GROUP BY 1, 2")(lambda t: t.risks.groupBy("risk", F.coalesce("clause_type", F.lit("Other")).alias("clause_type")).agg(F.count("*").alias("n"), F.count_if(F.col("risk") == "high").alias("high")))
query("a28_citations_by_act", "SELECT act_name, array_to_string(list_sort(list(DISTINCT section_number)), ',') AS sections FROM bare_acts GROUP BY 1")(lambda t: t.bare_acts.groupBy("act_name").agg(F.array_join(F.array_sort(F.collect_set("section_number")), ",").alias("sections")))
query("a29_ingest_stats", "SELECT count(*) AS scraped, count(DISTINCT md5(text)) AS stored, count(*) - count(DISTINCT md5(text)) AS duplicates, count(*) FILTER (length(text) < 100) AS errors FROM documents")(lambda t: t.documents.agg(F.count("*").alias("scraped"), F.countDistinct(F.md5("text")).alias("stored"), (F.count("*") - F.countDistinct(F.md5("text"))).alias("duplicates"), F.count_if(F.length("text") < 100).alias("errors")))
query("a30_attrition", "SELECT system, count(*) AS total, count(*) FILTER (answer <> '' AND NOT trigger_uncertainty) AS answered, count(*) FILTER (trigger_uncertainty) AS abstained, count(*) FILTER (answer = '') AS errors FROM responses GROUP BY 1")(lambda t: t.responses.groupBy("system").agg(F.count("*").alias("total"), F.count_if((F.col("answer") != "") & ~F.col("trigger_uncertainty")).alias("answered"), F.count_if("trigger_uncertainty").alias("abstained"), F.count_if(F.col("answer") == "").alias("errors")))
# ---- joins
query("j01_left_join", "SELECT q.query_id, q.query_type, r.response_id, r.confidence FROM queries q LEFT JOIN responses_log r ON q.query_id = r.query_id")(lambda t: t.queries.select("query_id", "query_type").join(t.responses_log.select("query_id", "response_id", "confidence"), "query_id", "left"))
query("j02_low_confidence", "SELECT q.query_id, q.query_text, r.response_id FROM queries q JOIN responses_log r ON q.query_id = r.query_id WHERE r.confidence = 'LOW'")(lambda t: t.queries.select("query_id", "query_text").join(t.responses_log.filter("confidence = 'LOW'").select("query_id", "response_id"), "query_id"))
query("j03_feedback_joined", "SELECT f.feedback_id, f.rating, r.confidence, q.query_type FROM feedback f JOIN responses_log r ON f.response_id = r.response_id JOIN queries q ON r.query_id = q.query_id")(lambda t: t.feedback.select("feedback_id", "rating", "response_id").join(t.responses_log.select("response_id", "query_id", "confidence"), "response_id").join(t.queries.select("query_id", "query_type"), "query_id").select("feedback_id", "rating", "confidence", "query_type"))
query("j04_aligned_systems", "SELECT a.query_id, a.car AS car_full, b.car AS car_simple, c.car AS car_none FROM scores a JOIN scores b ON a.query_id = b.query_id AND b.system = 'simple' JOIN scores c ON a.query_id = c.query_id AND c.system = 'none' WHERE a.system = 'full'")(lambda t: t.scores.groupBy("query_id").pivot("system", ["full", "simple", "none"]).agg(F.max("car")).select("query_id", F.col("full").alias("car_full"), F.col("simple").alias("car_simple"), F.col("none").alias("car_none")).dropna())
query("j05_left_merge", "SELECT r.row_idx, r.system, g.category, g.correct_act FROM responses r LEFT JOIN ground_truth g ON r.query_id = g.query_id")(lambda t: t.responses.select("row_idx", "system", "query_id").join(t.ground_truth.select("query_id", "category", "correct_act"), "query_id", "left").drop("query_id"))
query("j06_positional", "SELECT r.row_idx, r.system, r.query_id = g.query_id AS aligned FROM responses r JOIN ground_truth g ON r.row_idx = g.row_idx")(lambda t: t.responses.select("row_idx", "system", F.col("query_id").alias("a")).join(t.ground_truth.select("row_idx", F.col("query_id").alias("b")), "row_idx").select("row_idx", "system", F.when(F.col("a") == F.col("b"), True).otherwise(F.raise_error(F.lit("query ids differ"))).alias("aligned")))
query("j07_first_match", "SELECT r.row_idx, r.system, g.row_idx AS matched FROM responses r LEFT JOIN (SELECT query_text, min(row_idx) AS row_idx FROM ground_truth GROUP BY 1) g ON r.query = g.query_text")(lambda t: t.responses.select("row_idx", "system", F.col("query").alias("query_text")).join(first_of(t.ground_truth, ["query_text"], ["row_idx"]).select("query_text", F.col("row_idx").alias("matched")), "query_text", "left").drop("query_text"))
query("j08_overruling", "SELECT c.case_id, c.citation, o.overruled_by_citation FROM case_law c LEFT JOIN (SELECT overruled_citation, min_by(overruled_by_citation, id) AS overruled_by_citation FROM overruling_map GROUP BY 1) o ON c.citation = o.overruled_citation")(lambda t: t.case_law.select("case_id", "citation").join(first_of(t.overruling_map, ["overruled_citation"], ["id"]).select(F.col("overruled_citation").alias("citation"), "overruled_by_citation"), "citation", "left"))
query("j09_amendments", "SELECT b.id, array_to_string(a.years, ',') AS years FROM bare_acts b LEFT JOIN (SELECT act_name, section_number, list_sort(list(amendment_year)) AS years FROM amendments GROUP BY ALL) a ON b.act_name = a.act_name AND b.section_number = a.section_number")(lambda t: t.bare_acts.select("id", "act_name", "section_number").join(t.amendments.groupBy("act_name", "section_number").agg(F.array_join(F.array_sort(F.collect_list("amendment_year")), ",").alias("years")), ["act_name", "section_number"], "left").select("id", "years"))
_CITED = "SELECT row_idx, system, CASE act1 WHEN 'Indian Penal Code' THEN 'Indian Penal Code 1860' WHEN 'BNS' THEN 'Bharatiya Nyaya Sanhita 2023' WHEN 'CrPC' THEN 'Code of Criminal Procedure 1973' ELSE 'Negotiable Instruments Act 1881' END AS act_name, replace(section1, 'Section ', '') AS section_number FROM responses WHERE type1 = 'bare_act'"
_cited = lambda t: t.responses.filter("type1 = 'bare_act'").select("row_idx", "system", F.when(F.col("act1") == "Indian Penal Code", "Indian Penal Code 1860").when(F.col("act1") == "BNS", "Bharatiya Nyaya Sanhita 2023").when(F.col("act1") == "CrPC", "Code of Criminal Procedure 1973").otherwise("Negotiable Instruments Act 1881").alias("act_name"), F.replace("section1", F.lit("Section "), F.lit("")).alias("section_number"))
_ON = ["act_name", "section_number"]
query("j10_cited_and_there", f"SELECT * FROM ({_CITED}) c WHERE EXISTS (SELECT 1 FROM bare_acts b WHERE b.act_name = c.act_name AND b.section_number = c.section_number)")(lambda t: _cited(t).join(t.bare_acts.select(*_ON), _ON, "left_semi").select("row_idx", "system", *_ON))
query("j11_anti_missing_citation", f"SELECT * FROM ({_CITED}) c WHERE NOT EXISTS (SELECT 1 FROM bare_acts b WHERE b.act_name = c.act_name AND b.section_number = c.section_number)")(lambda t: _cited(t).join(t.bare_acts.select(*_ON), _ON, "left_anti").select("row_idx", "system", *_ON))
query("j12_holdout", "SELECT row_idx FROM ground_truth WHERE row_idx NOT IN (SELECT doc_id FROM labels)")(lambda t: t.ground_truth.select("row_idx").join(t.labels.select(F.col("doc_id").alias("row_idx")), "row_idx", "left_anti"))
query("j13_evaluated", "SELECT row_idx, category FROM ground_truth WHERE lower(trim(query_text)) IN (SELECT lower(trim(query)) FROM responses WHERE confidence = 'high')")(lambda t: t.ground_truth.withColumn("k", F.lower(F.trim("query_text"))).join(t.responses.filter("confidence = 'high'").select(F.lower(F.trim("query")).alias("k")), "k", "left_semi").select("row_idx", "category"))
_MAP = "SELECT act_name, section_number, min(CAST(section_number AS INT) + 1000) AS new_section, min(CASE WHEN CAST(section_number AS INT) % 9 = 0 THEN 'removed' ELSE 'replaced' END) AS change FROM bare_acts WHERE is_replaced GROUP BY ALL"
_map = lambda t: t.bare_acts.filter("is_replaced").groupBy("act_name", "section_number").agg(F.min(F.col("section_number").cast("int") + 1000).alias("new_section"), F.min(F.when(F.col("section_number").cast("int") % 9 == 0, "removed").otherwise("replaced")).alias("change"))
#: A model's word on each section, and the table of replaced sections.
_PREDICTED = """SELECT DISTINCT act_name, section_number, CAST(section_number AS INT) % 4 = 1 AS is_superseded, CASE WHEN CAST(section_number AS INT) % 8 = 1 THEN '' ELSE 'New Section ' || CAST(CAST(section_number AS INT) + 50 AS STRING) END AS replacement FROM bare_acts"""
_REPLACED = """SELECT CASE WHEN act_name = 'Indian Penal Code 1860' THEN 'IPC' ELSE 'CrPC' END AS old, section_number AS section, min(CASE WHEN CAST(section_number AS INT) % 9 = 0 AND act_name = 'Indian Penal Code 1860' THEN 'removed' ELSE CAST(CAST(section_number AS INT) + 1000 AS STRING) END) AS new, min('as ' || act_name) AS changes
        FROM bare_acts WHERE act_name IN ('Indian Penal Code 1860', 'Code of Criminal Procedure 1973') AND CAST(section_number AS INT) % 3 <> 1 GROUP BY 1, 2"""
_made = lambda t, sql: t.spark.sql(sql.replace("FROM bare_acts", "FROM {bare_acts}"), bare_acts=t.bare_acts)
query(
    "j14_mapping",
    f"""WITH predicted AS ({_PREDICTED}), replaced AS ({_REPLACED}), j AS (SELECT b.id, b.act_name, b.section_number, CASE b.act_name WHEN 'Indian Penal Code 1860' THEN 'IPC' WHEN 'Code of Criminal Procedure 1973' THEN 'CrPC' END AS old, p.is_superseded, p.replacement FROM bare_acts b LEFT JOIN predicted p USING (act_name, section_number)),
k AS (SELECT j.*, r.new, r.changes, coalesce(is_superseded, false) AND j.old IS NOT NULL AS learned, CASE j.old WHEN 'IPC' THEN 'BNS' ELSE 'BNSS' END AS newer FROM j LEFT JOIN replaced r ON j.old = r.old AND j.section_number = r.section),
n AS (SELECT *, old || ' Section ' || section_number AS original, CASE WHEN replacement <> '' THEN replacement WHEN old = 'IPC' THEN 'Removed in BNS' ELSE 'BNSS equivalent' END AS by_ FROM k WHERE old IS NOT NULL)
SELECT id, act_name, section_number, CASE WHEN learned OR new IS NOT NULL THEN original END AS original, CASE WHEN learned THEN by_ WHEN new = 'removed' THEN 'Removed in ' || newer ELSE newer || ' Section ' || new END AS replaced_by, CASE WHEN learned THEN 'learned transition classifier' ELSE changes END AS changes,
CASE WHEN learned THEN '⚠️ Note: ' || original || ' has been superseded. Suggested replacement: ' || by_ || '.' WHEN new = 'removed' THEN '⚠️ Note: ' || original || ' has been removed in Bharatiya Nyaya Sanhita 2023.' ELSE '⚠️ Note: ' || original || ' has been replaced by ' || newer || ' Section ' || new || '. Changes: ' || changes END AS note, CASE WHEN learned THEN 'learned' WHEN new IS NOT NULL THEN 'rule_map' END AS source FROM n
UNION ALL SELECT id, act_name, section_number, NULL, NULL, NULL, NULL, NULL FROM k WHERE old IS NULL""",
)(lambda t: transitions(t.bare_acts.select("id", "act_name", "section_number"), _made(t, _PREDICTED), _made(t, _REPLACED)))
query("j15_mentioned_sections", f"""WITH e AS (SELECT DISTINCT row_idx, system, unnest(regexp_extract_all(answer, '(?i)sec(?:tion)?\\s+(\\d+)', 1)) AS section_number FROM responses)
SELECT e.row_idx, e.system, array_to_string(list_sort(list(m.act_name || ' ' || e.section_number || ' ' || m.change)), '; ') AS notes FROM e JOIN ({_MAP}) m ON e.section_number = m.section_number GROUP BY 1, 2""")(lambda t: t.responses.select("row_idx", "system", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"(?i)sec(?:tion)?\s+(\d+)"), F.lit(1)))).alias("section_number")).join(_map(t), "section_number").groupBy("row_idx", "system").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "act_name", "section_number", "change"))), "; ").alias("notes")))
query("j16_key_order", "SELECT o.pos, g.query_id, g.category FROM (SELECT doc_id, row_number() OVER (ORDER BY quality, doc_id DESC) - 1 AS pos FROM labels) o LEFT JOIN ground_truth g ON o.doc_id = g.row_idx")(lambda t: numbered(t.labels.select("quality", "doc_id"), ["quality", F.desc("doc_id")]).select("pos", F.col("doc_id").alias("row_idx")).join(t.ground_truth.select("row_idx", "query_id", "category"), "row_idx", "left").drop("row_idx"))
query("j17_matched_keys", "SELECT a.query, count(*) AS pairs, round(avg(a.seconds - b.seconds), 6) AS diff FROM responses a JOIN responses b ON a.row_idx = b.row_idx AND a.query = b.query AND a.system = 'full' AND b.system = 'none' GROUP BY 1")(lambda t: t.responses.filter("system = 'full'").select("row_idx", "query", F.col("seconds").alias("a")).join(t.responses.filter("system = 'none'").select("row_idx", "query", F.col("seconds").alias("b")), ["row_idx", "query"]).groupBy("query").agg(F.count("*").alias("pairs"), r6(F.avg(F.col("a") - F.col("b"))).alias("diff")))
query("j21_clause_index", "SELECT r.doc_id, r.clause_number, d.lang FROM risks r JOIN documents d ON r.doc_id = d.doc_id WHERE r.risk = 'high' AND r.clause_number >= 1")(lambda t: t.risks.filter("risk = 'high' AND clause_number >= 1").select("doc_id", "clause_number").join(t.documents.select("doc_id", "lang"), "doc_id"))
query("j22_valid_citations", f"SELECT c.row_idx, c.system, b.section_number IS NOT NULL AS valid FROM ({_CITED}) c LEFT JOIN (SELECT DISTINCT act_name, section_number FROM bare_acts) b ON c.act_name = b.act_name AND c.section_number = b.section_number")(lambda t: _cited(t).join(t.bare_acts.select(*_ON).distinct().withColumn("valid", F.lit(True)), _ON, "left").select("row_idx", "system", F.coalesce("valid", F.lit(False)).alias("valid")))
query("j23_reuse_or_run", "SELECT g.row_idx, r.answer, r.row_idx IS NULL AS to_run FROM ground_truth g LEFT JOIN responses r ON g.query_id = r.query_id AND r.system = 'full' AND r.answer <> ''")(lambda t: t.ground_truth.select("row_idx", "query_id").join(t.responses.filter("system = 'full' AND answer <> ''").select("query_id", "answer"), "query_id", "left").select("row_idx", "answer", F.col("answer").isNull().alias("to_run")))
query("j24_classification_merge", "SELECT d.doc_id, coalesce(r.clause_type, 'Other') AS clause_type FROM documents d LEFT JOIN (SELECT doc_id, min_by(clause_type, clause_number) AS clause_type FROM risks WHERE clause_type IS NOT NULL GROUP BY 1) r ON d.doc_id = r.doc_id + 1")(lambda t: t.documents.select("doc_id").join(first_of(t.risks.filter("clause_type IS NOT NULL"), ["doc_id"], ["clause_number"]).select((F.col("doc_id") + 1).alias("doc_id"), "clause_type"), "doc_id", "left").select("doc_id", F.coalesce("clause_type", F.lit("Other")).alias("clause_type")))
# ---- sort, top-k, windows, sampling
query("w01_latest", "SELECT query_id, timestamp FROM queries ORDER BY timestamp DESC, query_id LIMIT 50")(lambda t: t.queries.select("query_id", "timestamp").orderBy(F.desc("timestamp"), "query_id").limit(50))
query("w02_most_common", "SELECT query_text, count(*) AS n, min(query_id) AS first_seen FROM queries GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")(lambda t: t.queries.groupBy("query_text").agg(F.count("*").alias("n"), F.min("query_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(10))
query("w03_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 20")(lambda t: topk(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 20))
query("w04_best_worst", examples_sql("acs"))(lambda t: examples_of(t, F.col("acs")))
query("w05_first_n", "WITH f AS (SELECT row_idx, min(CASE system WHEN 'full' THEN 0 WHEN 'simple' THEN 1 ELSE 2 END) AS class FROM scores WHERE correct = 0 GROUP BY 1) SELECT class, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY row_idx) AS k FROM f) WHERE k <= 3")(lambda t: topk(t.scores.filter("correct = 0").groupBy("row_idx").agg(F.min(F.when(F.col("system") == "full", 0).when(F.col("system") == "simple", 1).otherwise(2)).alias("class")), ["class"], ["row_idx"], 3).select("class", "row_idx"))
query("w06_first_occurrence", "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)")(lambda t: t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")))
query("w07_occurrence_cap", "SELECT id, act_name, section_number FROM (SELECT *, row_number() OVER (PARTITION BY act_name, section_number ORDER BY id) AS k FROM bare_acts) WHERE k <= 2")(lambda t: topk(t.bare_acts.select("id", "act_name", "section_number"), ["act_name", "section_number"], ["id"], 2))
query("w08_priority", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 3 END AS priority FROM orders ORDER BY priority, o_orderkey")(lambda t: t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED"), 2).otherwise(3).alias("priority")).orderBy("priority", "o_orderkey"))
query("w09_stratified", "SELECT category, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42' || query_id), row_idx) AS k FROM ground_truth) WHERE k <= 7")(lambda t: topk(t.ground_truth.withColumn("h", F.md5(F.concat(F.lit("42"), "query_id"))), ["category"], ["h", "row_idx"], 7).select("category", "row_idx"))


@query("w10_balanced", """WITH r AS (SELECT category, row_idx, md5('7' || query_id) AS h, row_number() OVER (PARTITION BY category ORDER BY md5('7' || query_id), row_idx) AS k FROM ground_truth)
SELECT category, row_idx FROM r WHERE k <= 12 UNION ALL (SELECT category, row_idx FROM r WHERE k > 12 ORDER BY h, row_idx LIMIT 3)""")
def _balanced(t):
    g = t.ground_truth.select("category", "row_idx", F.md5(F.concat(F.lit("7"), "query_id")).alias("h"))
    per = topk(g, ["category"], ["h", "row_idx"], 12)
    return per.select("category", "row_idx").unionAll(g.join(per.select("row_idx"), "row_idx", "left_anti").orderBy("h", "row_idx").limit(3).select("category", "row_idx"))


def _split(t):
    """Ranks inside a label are places in one order less the label's first place, so that a label isn't sorted in one task."""
    n = numbered(t.labels.select("doc_id", "quality", F.md5(F.col("doc_id").cast("string")).alias("h")), ["quality", "h"])
    sizes = n.groupBy("quality").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return n.join(F.broadcast(sizes), "quality").select("doc_id", F.when(F.col("pos") - F.col("first") + 1 <= F.floor(0.8 * F.col("n")), "train").otherwise("test").alias("split"))


query("w12_split", "SELECT doc_id, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS STRING))) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)")(lambda t: _split(t))
query("w13_numeric_order", r"SELECT query_id, CAST(regexp_extract(query_id, '(\d+)', 1) AS INT) AS n FROM ground_truth ORDER BY n")(lambda t: t.ground_truth.select("query_id", F.regexp_extract("query_id", r"(\d+)", 1).cast("int").alias("n")).orderBy("n"))
query("w14_trims", "SELECT row_idx, category FROM ground_truth WHERE row_idx < (SELECT least((SELECT count(*) FROM labels), (SELECT count(*) FROM ground_truth)))")(lambda t: t.ground_truth.crossJoin(t.labels.agg(F.count("*").alias("n"))).crossJoin(t.ground_truth.agg(F.count("*").alias("m"))).filter(F.col("row_idx") < F.least("n", "m")).select("row_idx", "category"))
query("w15_citation_ranking", "WITH c AS (SELECT row_idx, system, 1 AS pos, upper(act1 || '|' || section1) AS pair, CASE WHEN type1 = 'bare_act' THEN 100 ELSE 60 END AS score FROM responses WHERE act1 IS NOT NULL UNION ALL SELECT row_idx, system, 2, upper(act2 || '|' || section2), 80 FROM responses WHERE act2 IS NOT NULL) SELECT row_idx, system, array_to_string(list(pair ORDER BY score DESC, pos), ';') AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY row_idx, system, pair ORDER BY score DESC, pos) AS k FROM c) WHERE k = 1 GROUP BY 1, 2")(lambda t: first_of(t.responses.select("row_idx", "system", F.inline(F.array(F.struct(F.lit(1).alias("pos"), F.upper(F.concat_ws("|", "act1", "section1")).alias("pair"), F.when(F.col("type1") == "bare_act", 100).otherwise(60).alias("score"), F.col("act1").isNotNull().alias("there")), F.struct(F.lit(2).alias("pos"), F.upper(F.concat_ws("|", "act2", "section2")).alias("pair"), F.lit(80).alias("score"), F.col("act2").isNotNull().alias("there"))))).filter("there"), ["row_idx", "system", "pair"], [F.desc("score"), "pos"]).groupBy("row_idx", "system").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "pair"))), lambda s: s["pair"]), ";").alias("ranked")))
query("w16_over_fetch", "WITH a AS (SELECT court, case_id, year, row_number() OVER (PARTITION BY court ORDER BY n_chars DESC, case_id) AS k FROM case_law), b AS (SELECT court, case_id, row_number() OVER (PARTITION BY court ORDER BY k) AS k FROM a WHERE k <= 10 AND year BETWEEN 1960 AND 1999) SELECT court, case_id, CAST(k AS INT) AS k FROM b WHERE k <= 5")(lambda t: topk(topk(t.case_law.select("court", "case_id", "year", "n_chars"), ["court"], [F.desc("n_chars"), "case_id"], 10).filter(F.col("year").between(1960, 1999)), ["court"], [F.desc("n_chars"), "case_id"], 5, rank="k").select("court", "case_id", "k"))
query("w17_random_system")(lambda t: t.ground_truth.select("query_id", F.element_at(F.array(F.lit("full"), F.lit("simple"), F.lit("none")), (F.pmod(F.xxhash64(F.lit(42), "row_idx"), F.lit(3)) + 1).cast("int")).alias("system")))
query("w18_latest_result", "SELECT path, rows, modified FROM (SELECT event_type AS path, count(*) AS rows, max(ts) AS modified FROM events GROUP BY 1) ORDER BY rows DESC, modified DESC LIMIT 1")(lambda t: t.events.groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("rows"), F.max("ts").alias("modified")).orderBy(F.desc("rows"), F.desc("modified")).limit(1))
query("w19_rank_label", "SELECT system, ['best', 'middle', 'worst'][least(row_number() OVER (ORDER BY avg(car) DESC, system), 3)] AS label FROM scores GROUP BY system")(lambda t: t.scores.groupBy("system").agg(F.avg("car").alias("car")).select("system", F.element_at(F.array(F.lit("best"), F.lit("middle"), F.lit("worst")), F.least(F.row_number().over(Window.orderBy(F.desc("car"), "system")), F.lit(3))).alias("label")))
query("w20_custom_order", "SELECT system, CASE system WHEN 'full' THEN 0 WHEN 'simple' THEN 1 ELSE 2 END AS position, count(*) AS n FROM scores GROUP BY 1 ORDER BY position")(lambda t: t.scores.groupBy("system").agg(F.count("*").alias("n")).withColumn("position", F.when(F.col("system") == "full", 0).when(F.col("system") == "simple", 1).otherwise(2)).orderBy("position"))
# ---- set operations
query("u01_concat", "SELECT query_id, category, NULL AS domain FROM ground_truth WHERE row_idx % 2 = 0 UNION ALL SELECT query_id, category, domain FROM ground_truth WHERE row_idx % 2 = 1")(lambda t: t.ground_truth.filter("row_idx % 2 = 0").select("query_id", "category").unionByName(t.ground_truth.filter("row_idx % 2 = 1").select("query_id", "category", "domain"), allowMissingColumns=True))
query("u02_merged_collections", "SELECT 'acts' AS collection, id, n_chars AS distance FROM bare_acts UNION ALL SELECT 'cases', case_id, n_chars + 1 FROM case_law ORDER BY distance, collection, id LIMIT 30")(lambda t: t.bare_acts.select(F.lit("acts").alias("collection"), "id", F.col("n_chars").alias("distance")).unionAll(t.case_law.select(F.lit("cases"), "case_id", F.col("n_chars") + 1)).orderBy("distance", "collection", "id").limit(30))
query("u03_overlap_ratio", "SELECT row_idx, round(len(list_intersect(q, s)) / greatest(len(list_distinct(q)), 1), 6) AS ratio FROM (SELECT row_idx, string_split(lower(query_text), ' ') AS q, string_split(summary, ' ') AS s FROM ground_truth)")(lambda t: t.ground_truth.withColumn("q", F.split(F.lower("query_text"), " ")).select("row_idx", r6(F.size(F.array_intersect("q", F.split("summary", " "))) / F.greatest(F.size(F.array_distinct("q")), F.lit(1))).alias("ratio")))
query("u04_difference_overlap", "SELECT row_idx, CAST(len(list_distinct(list_filter(s, lambda w: NOT list_contains(['the', 'of', 'or', 'for'], w)))) AS INT) AS n, CAST(len(list_distinct(list_filter(s, lambda w: NOT list_contains(['the', 'of', 'or', 'for'], w) AND list_contains(['theft', 'fine', 'case'], w)))) AS INT) AS shared FROM (SELECT row_idx, string_split(summary, ' ') AS s FROM ground_truth)")(lambda t: t.ground_truth.withColumn("s", F.array_except(F.split("summary", " "), F.array(*map(F.lit, ["the", "of", "or", "for"])))).select("row_idx", F.size("s").alias("n"), F.size(F.array_intersect("s", F.array(*map(F.lit, ["theft", "fine", "case"])))).alias("shared")))
query("u05_key_intersection", "SELECT query FROM responses WHERE system = 'full' AND answer <> '' INTERSECT SELECT query FROM responses WHERE system = 'none' AND answer <> ''")(lambda t: t.responses.filter("system = 'full' AND answer <> ''").select("query").intersect(t.responses.filter("system = 'none' AND answer <> ''").select("query")))
query("u06_distinct_strings", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")(lambda t: t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")))
query("u07_missing_columns", "SELECT unnest(['car', 'hr', 'acs', 'olr']) AS col EXCEPT SELECT column_name FROM (DESCRIBE SELECT * FROM scores)")(lambda t: t.spark.range(1).select(F.explode(F.array_except(F.array(*map(F.lit, ["car", "hr", "acs", "olr"])), F.array(*map(F.lit, t.scores.columns)))).alias("col")))
query("u08_row_dedup", "SELECT min(query_id) AS query_id, lower(query_text) AS key FROM queries GROUP BY 2")(lambda t: first_of(t.queries.select("query_id", F.lower("query_text").alias("key")), ["key"], ["query_id"]))
query("u09_generator", "WITH p AS (SELECT DISTINCT act_name, section_number FROM bare_acts) SELECT replace(replace(k.template, '{a}', act_name), '{s}', section_number) AS text, label FROM p, (SELECT 'Section {s} of {a}' AS template, 1 AS label UNION ALL SELECT 'What is {a} {s}?', 1 UNION ALL SELECT 'weather in {s}', 0) k")(lambda t: t.bare_acts.select("act_name", "section_number").distinct().select("act_name", "section_number", F.inline(F.array(*[F.struct(F.lit(a).alias("template"), F.lit(b).alias("label")) for a, b in (("Section {s} of {a}", 1), ("What is {a} {s}?", 1), ("weather in {s}", 0))]))).select(F.replace(F.replace("template", F.lit("{a}"), F.col("act_name")), F.lit("{s}"), F.col("section_number")).alias("text"), "label"))
# ---- sources and sinks
query("s02_point_get", "SELECT id, section_title FROM bare_acts WHERE act_name = 'Indian Penal Code 1860' AND section_number = '302'")(lambda t: t.bare_acts.filter("act_name = 'Indian Penal Code 1860' AND section_number = '302'").select("id", "section_title"))
query("s03_paged_scan", "SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) AS BIGINT) AS page FROM bare_acts")(lambda t: numbered(t.bare_acts.select("id"), ["id"]).select("id", F.floor(F.col("pos") / 100).alias("page")))
query("s04_full_scan", "SELECT * FROM documents")(lambda t: t.documents)
query("s05_collection_counts", "SELECT coalesce(collection, 'total') AS collection, count(*) AS n FROM (SELECT 'bare_acts' AS collection FROM bare_acts UNION ALL SELECT 'case_law' FROM case_law UNION ALL SELECT 'amendments' FROM amendments UNION ALL SELECT 'overruling_map' FROM overruling_map) GROUP BY ROLLUP (collection)")(lambda t: t.bare_acts.select(F.lit("bare_acts").alias("collection")).unionAll(t.case_law.select(F.lit("case_law"))).unionAll(t.amendments.select(F.lit("amendments"))).unionAll(t.overruling_map.select(F.lit("overruling_map"))).rollup("collection").agg(F.count("*").alias("n")).select(F.coalesce("collection", F.lit("total")).alias("collection"), "n"))
query("s06_counts_by_act", "SELECT act_name, count(*) AS n FROM bare_acts GROUP BY 1")(lambda t: t.bare_acts.groupBy("act_name").agg(F.count("*").alias("n")))
query("s08_upsert", "SELECT id, act_name, section_number FROM bare_acts WHERE id % 10 <> 0 UNION ALL SELECT id, 'Amended Act', section_number FROM bare_acts WHERE id % 10 = 0 UNION ALL SELECT id + 1000000000, 'New Act', section_number FROM bare_acts WHERE id % 20 = 0")(lambda t: upsert(t.bare_acts.select("id", "act_name", "section_number"), t.bare_acts.filter("id % 10 = 0").select("id", F.lit("Amended Act").alias("act_name"), "section_number").unionAll(t.bare_acts.filter("id % 20 = 0").select(F.col("id") + 1000000000, F.lit("New Act"), "section_number")), ["id"]))
query("s09_reload", "SELECT id, section_number FROM bare_acts WHERE act_name <> 'Bharatiya Nyaya Sanhita 2023' UNION ALL SELECT id, 'new ' || section_number FROM bare_acts WHERE act_name = 'Bharatiya Nyaya Sanhita 2023' AND id % 2 = 1")(lambda t: t.bare_acts.filter("act_name <> 'Bharatiya Nyaya Sanhita 2023'").select("id", "section_number").unionAll(t.bare_acts.filter("act_name = 'Bharatiya Nyaya Sanhita 2023' AND id % 2 = 1").select("id", F.concat(F.lit("new "), "section_number"))))
# questions with context and answer, out of conversations: the first user and assistant texts and the system's; long ones are cut into windows of 500 words that start every 450
_QA = "SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'user'), '') AS q, coalesce(min_by(text, turn) FILTER (role = 'system'), '') AS c, coalesce(min_by(text, turn) FILTER (role = 'assistant'), '') AS a FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1"
query("s18_qa_reader", rf"""WITH f AS (SELECT conv_id, 'Question: ' || q || chr(10) || chr(10) || 'Context: ' || c || chr(10) || chr(10) || 'Answer: ' || a AS t FROM ({_QA})), w AS (SELECT conv_id, t, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS w FROM f)
SELECT conv_id, CASE WHEN floor(len(w) / 0.75) > 500 THEN CAST(s / 450 AS INT) ELSE 0 END AS chunk, CASE WHEN floor(len(w) / 0.75) > 500 THEN array_to_string(w[s + 1 : s + 500], ' ') ELSE t END AS combined FROM (SELECT conv_id, t, w, unnest(range(0, CASE WHEN floor(len(w) / 0.75) > 500 THEN len(w) ELSE 1 END, 450)) AS s FROM w)""")(lambda t: _qa(t))
query("s19_instruction_reader", "SELECT conv_id, turn, text AS instruction, response FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE role = 'user' AND next_role = 'assistant' AND text <> '' AND response <> ''")(lambda t: t.conversations.withColumn("response", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("next_role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'user' AND next_role = 'assistant' AND text <> '' AND response <> ''").select("conv_id", "turn", F.col("text").alias("instruction"), "response"))
query("s20_judgments", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 500 ORDER BY doc_id LIMIT 3000")(lambda t: t.documents.filter(F.length("text") >= 500).select("doc_id", "n_chars").orderBy("doc_id").limit(3000))


def _plain(c):
    """SQL of the text of HTML, cleaned."""
    c = f"regexp_replace({c}, '{parsing.HIDDEN}', ' ', 'g')"
    for entity, character in x.ENTITIES.items():
        c = f"replace({c}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return rf"""trim(regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,;:()\-''"/\[\]]', '', 'g'))"""


# pages stand for what a browser would fetch
query("s21_page_documents", rf"""WITH b AS (SELECT page_id, url, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS a FROM pages), r AS (SELECT page_id, url, coalesce(nullif({_plain("regexp_extract(a, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), 'Unknown Case') AS title, {_plain("a")} AS content FROM b)
SELECT page_id, url, substr(sha256(title || substr(content, 1, 500)), 1, 16) AS id, title, content, array_to_string(list_sort(list_filter([{", ".join(f"'{p}'" for p in x.ACTS_16)}], lambda n: contains(lower(content), lower(n)))), '|') AS acts,
array_to_string(list_sort(list_distinct(flatten([regexp_extract_all(content, '(?i)Section\s+(\d+[A-Z]*)', 1), regexp_extract_all(content, '(?i)Sec\.\s+(\d+[A-Z]*)', 1), regexp_extract_all(content, '(?i)S\.\s+(\d+[A-Z]*)', 1)]))), '|') AS sections FROM r WHERE content <> ''""")(lambda t: parsing.page_documents(t.pages, "page_id", "url", "html"))
query("s23_density", "SELECT page_id, length(html) / 2 >= 50 AS dense FROM pages")(lambda t: t.pages.select("page_id", (F.length("html") / 2 >= 50).alias("dense")))
query("s24_format_router", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'unsupported' END AS route FROM pages")(lambda t: t.pages.withColumn("ext", F.element_at(F.array(*map(F.lit, ["pdf", "docx", "doc", "txt"])), (F.col("page_id") % 4 + 1).cast("int"))).select("page_id", F.when(F.col("ext").isin("pdf", "docx"), F.col("ext")).otherwise("unsupported").alias("route")))
query("s25_path_selection", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 1")(lambda t: t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1))
query("s29_critical_pairs", "SELECT DISTINCT act_name, section_number, false AS current FROM bare_acts WHERE is_replaced UNION ALL SELECT DISTINCT 'new ' || act_name, section_number, true FROM bare_acts WHERE is_replaced")(lambda t: t.bare_acts.filter("is_replaced").select("act_name", "section_number").distinct().select(F.inline(F.array(F.struct("act_name", "section_number", F.lit(False).alias("current")), F.struct(F.concat(F.lit("new "), "act_name").alias("act_name"), "section_number", F.lit(True).alias("current"))))))


def _qa(t):
    said = lambda role: F.coalesce(F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    each = t.conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(said("user").alias("q"), said("system").alias("c"), said("assistant").alias("a"))
    full = each.select("conv_id", F.concat(F.lit("Question: "), "q", F.lit("\n\nContext: "), "c", F.lit("\n\nAnswer: "), "a").alias("t"))
    return full.select("conv_id", F.posexplode(F.when(x.token_estimate(F.col("t")) > 500, x.chunks(F.col("t"), 500, 50)).otherwise(F.array("t"))).alias("chunk", "combined"))
