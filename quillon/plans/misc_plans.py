"""Parsing, sources and sinks, and the streaming counterparts of scheduled jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import parsing as p
from quillon.operators.relational import first_of, topk, upsert
from quillon.operators.sampling import pick_unique
from quillon.plans.registry import query
from quillon.sources import files, seeds, workbooks
from quillon.sources.sinks import scratch
from quillon.streaming import jobs, once

_HEAD = p.HEADING
_L = f"l AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM clauses)), m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM l)"
query("t10_section_lines", f"WITH {_L} SELECT doc_id, CAST(pos AS INT) AS pos, line, CAST(part AS INT) AS part FROM m")(lambda t: p.lines(t.clauses, "doc_id", "text"))
_C = f"{_L}, k AS (SELECT doc_id, part, min(pos) AS pos, min_by(line, pos) AS heading, trim(coalesce(string_agg(CASE WHEN first_ THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS content FROM (SELECT *, pos = min(pos) OVER (PARTITION BY doc_id, part) AS first_ FROM m WHERE part > 0) GROUP BY 1, 2), g AS (SELECT * FROM k WHERE content <> '')"
query("t33_clauses", f"WITH {_C} SELECT doc_id, CAST(part AS INT) AS clause, heading, content FROM g UNION ALL SELECT doc_id, 1, 'Document', trim(text) FROM clauses WHERE doc_id NOT IN (SELECT doc_id FROM g)")(lambda t: p.clauses(t.clauses, "doc_id", "text"))
query("t35_clause_filter", f"WITH {_C} SELECT doc_id, CAST(part AS INT) AS clause FROM g WHERE contains(lower(content), 'due') OR contains(lower(heading), 'confidential')")(lambda t: p.clauses(t.clauses, "doc_id", "text").filter((F.col("heading") != "Document") & (F.contains(F.lower("content"), F.lit("due")) | F.contains(F.lower("heading"), F.lit("confidential")))).select("doc_id", "clause"))
query("t34_auto_numbers")(lambda t: t.clauses.select("doc_id", F.filter(F.split("text", "\n"), lambda x: x.rlike(p.HEADING)).alias("headings")).mapInPandas(p.auto_numbers("doc_id"), "doc_id long, numbers string"))
query("t21_sentence_packing")(lambda t: t.documents.select("doc_id", F.posexplode(p.pack_sentences(F.col("text"), 120)).alias("piece", "text")))
query("t13_fallback_split")(lambda t: t.clauses.withColumn("a", F.split("text", r"\n(?=Section \d+)")).withColumn("b", F.split("text", r"\n(?=\d+\.)")).select("doc_id", F.posexplode(F.when(F.size("a") >= 10, F.col("a")).otherwise(F.col("b"))).alias("part", "body")).filter(F.length("body") >= 30))
_ALIAS_SQL = "lower(trim(section_title))"
for _p, _r in text.HEADING_TERMS:
    _ALIAS_SQL = f"regexp_replace({_ALIAS_SQL}, '(?i){_p}', '{_r}', 'g')"
query("t15_heading_alias", f"""WITH a AS (SELECT id, lower(trim(section_title)) AS low, trim(regexp_replace({_ALIAS_SQL}, '\\s+', ' ', 'g'), ' .;-:') AS a FROM bare_acts), b AS (SELECT id, low, regexp_replace(regexp_replace(regexp_replace(a, 'के लिए\\s+के लिए', 'के लिए', 'g'), 'का\\s+का( |$)', 'का\\1', 'g'), 'और\\s+और', 'और', 'g') AS a FROM a)
SELECT id, CASE WHEN lower(a) = low THEN '' ELSE a END AS alias FROM b""")(lambda t: t.bare_acts.select("id", text.heading_alias(F.col("section_title")).alias("alias")))
query("t17_heading_update", "SELECT id, CASE WHEN id % 3 = 0 THEN 'changed ' || section_title ELSE section_title END AS section_title FROM bare_acts")(lambda t: upsert(t.bare_acts.select("id", "section_title"), t.bare_acts.filter("id % 3 = 0").select("id", F.concat(F.lit("changed "), "section_title").alias("section_title")), ["id"]))
_T41 = "trim(query_text)"
for _p, _r in text.QUERY_WORDS.items():
    _T41 = f"replace({_T41}, '{_p}', '{_r}')"
query("t41_query_templates", f"WITH q AS (SELECT row_idx, {_T41} AS q FROM asked) SELECT row_idx, CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN regexp_replace(q, '{p}', '{r}')" for p, r in text.QUERY_TEMPLATES) + f" ELSE regexp_replace(q, '\\?$', '') || '{text.QUERY_SUFFIX}' END AS hindi FROM q")(lambda t: t.asked.select("row_idx", text.hindi_query(F.col("query_text")).alias("hindi")))
query("t43_list_parse", "SELECT row_idx, system, CASE WHEN act1 IS NULL THEN '' ELSE act1 || '|' || section1 END AS items FROM responses")(lambda t: t.responses.withColumn("raw", F.when(F.col("act1").isNull(), "nan").otherwise(F.concat(F.lit("['"), "act1", F.lit("', '"), "section1", F.lit("']")))).select("row_idx", "system", F.array_join(F.coalesce(F.from_json("raw", "array<string>"), F.from_json(F.translate("raw", "'", '"'), "array<string>"), F.array().cast("array<string>")), "|").alias("items")))
query("t45_map_rows", "SELECT row_idx, system, metric, v FROM (SELECT row_idx, system, 'car' AS metric, car AS v FROM scores UNION ALL SELECT row_idx, system, 'hr', hr FROM scores)")(lambda t: t.scores.select("row_idx", "system", F.explode(F.create_map(F.lit("car"), "car", F.lit("hr"), "hr")).alias("metric", "v")))


@query("w11_round_robin")
def _round_robin(t):
    """40 rows, one of each category in turn: rank inside the category, then rank order, so that no sequential pick is needed."""
    g = topk(t.ground_truth.select("category", "row_idx", "query_text"), ["query_text"], ["row_idx"], 1)
    return topk(g, ["category"], ["row_idx"], 40, rank="turn").orderBy("turn", "category").limit(40).select("turn", "category", "row_idx")


@query("w11_unique_pick")
def _unique_pick(t):
    """40 rows, categories in turn, sections that aren't used yet first; a section's reference is its act and number."""
    reference = F.when(F.col("correct_section") != "", F.concat_ws(" ", "correct_act", "correct_section")).otherwise(F.col("correct_act"))
    return pick_unique(t.ground_truth.withColumn("reference", reference), key="row_idx", category="category", reference="reference", order=["row_idx"])


@query("s23_decoded", "SELECT doc_id, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, text, len(text) < 50 AS thin FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z .]+', ' ', 'g'), '^ +| +$', '', 'g') AS text FROM documents WHERE doc_id % 50 = 0) WHERE text <> ''")
def _decoded(t):
    """Documents written as DOCX bytes and decoded again, with the rule on density."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z .]+", " "), "^ +| +$", "")
    some = t.documents.filter("doc_id % 50 = 0").select(F.concat(F.lit("x/"), "doc_id", F.lit(".docx")).alias("path"), F.concat(F.lit("Doc "), "doc_id").alias("title"), plain.alias("text")).filter("text <> ''")
    made = files.decoded(files.as_docx(some))
    return made.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "title", "text", F.col("problem").isNotNull().alias("thin"))


# ---- sources and sinks: what is written is read again
def _written(df, write):
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    write(df, path)
    return path


query("s01_collections", "SELECT 'bare_acts' AS collection, count(*) AS n FROM bare_acts UNION ALL SELECT 'case_law', count(*) FROM case_law")(lambda t: t.spark.read.parquet(_written(t.bare_acts.select(F.lit("bare_acts").alias("collection")).unionAll(t.case_law.select(F.lit("case_law"))).withColumn("one", F.lit(1)), lambda d, q: d.write.partitionBy("collection").parquet(q))).groupBy("collection").agg(F.count("*").alias("n")))
query("s07_insert", "SELECT id, act_name FROM bare_acts UNION ALL SELECT id + 1000000000, act_name FROM bare_acts WHERE id % 50 = 0")(lambda t: t.spark.read.parquet(_written(t.bare_acts.select("id", "act_name"), lambda d, q: (d.write.parquet(q), d.filter("id % 50 = 0").select((F.col("id") + 1000000000).alias("id"), "act_name").write.mode("append").parquet(q)))))
query("s10_reset", "SELECT id FROM bare_acts WHERE id % 2 = 1")(lambda t: t.spark.read.parquet(_written(t.bare_acts.select("id"), lambda d, q: (d.filter("id % 2 = 0").write.parquet(q), d.filter("id % 2 = 1").write.mode("overwrite").parquet(q)))))
# at most a thousand ids an exported row, so that a section may have any number
query("s11_export_import", "SELECT id, act_name, section_number FROM bare_acts")(lambda t: t.spark.read.schema("ids array<long>, acts array<string>, sections array<string>, count long").json(_written(t.bare_acts.groupBy("act_name", "section_number", F.floor(F.col("id") / 1000)).agg(F.collect_list("id").alias("ids"), F.count("*").alias("count")).select("ids", F.transform("ids", lambda i: F.col("act_name")).alias("acts"), F.transform("ids", lambda i: F.col("section_number")).alias("sections"), "count"), lambda d, q: d.write.json(q))).filter(F.when(F.size("ids") == F.col("count"), True).otherwise(F.raise_error(F.lit("count differs")))).select(F.inline(F.arrays_zip("ids", "acts", "sections"))).toDF("id", "act_name", "section_number"))
# the other collection's vectors are of a unit length
query("s12_reindex", "SELECT vec_id, label, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")(lambda t: t.spark.read.parquet(_written(t.embeddings.select("vec_id", "label", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("norm")).join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("vec_id", "label", F.round("norm", 4).alias("norm"), F.transform("embedding", lambda v: v / F.col("norm")).alias("unit")), lambda d, q: d.write.mode("overwrite").parquet(q))).select("vec_id", "label", "norm"))


@query("s13_workbook", "SELECT system, category, round(avg(car), 6) AS car, count(*) AS n FROM scores GROUP BY 1, 2")
def _workbook(t):
    """The means by category as a workbook for reviewers, with a sheet of instructions, read back."""
    means = t.scores.groupBy("system", "category").agg(F.round(F.avg("car"), 6).alias("car"), F.count("*").alias("n"))  # some twenty rows
    path = f"{scratch(t.spark)}/report-{uuid.uuid4().hex}.xlsx"
    workbooks.write_workbook({"INSTRUCTIONS": t.spark.range(1).select(F.lit("Check each mean; leave the other columns as they are.").alias("INSTRUCTIONS")), "Category Means": means}, path)
    return workbooks.read_sheet(t.spark, path, "Category Means", "system string, category string, car double, n long")


query("s14_csv", "SELECT row_idx, system, car, hr FROM scores")(lambda t: t.spark.read.schema("row_idx long, system string, car double, hr double").csv(_written(t.scores.select("row_idx", "system", "car", "hr"), lambda d, q: d.write.csv(q, header=True)), header=True))
query("s15_json_checkpoint", "SELECT row_idx, system, answer FROM responses")(lambda t: t.spark.read.schema("row_idx long, system string, answer string").json(_written(t.responses.select("row_idx", "system", "answer"), lambda d, q: d.write.json(q))))
query("s16_unanswered_log", "SELECT query_id, query_text FROM queries WHERE query_text = '' OR query_type = 'error'")(lambda t: t.spark.read.schema("query_id long, query_text string").json(_written(t.queries.filter("query_text = ''").select("query_id", "query_text"), lambda d, q: (d.write.json(q), t.queries.filter("query_text <> '' AND query_type = 'error'").select("query_id", "query_text").write.mode("append").json(q)))))
# a file of an act: a head with its names, then sections; here two for each
_S17 = lambda: F.format_string("ACT_NAME: %s no. %d\nSHORT_NAME: A%d\n\n[SECTION %s] %s\n  first line\n\n of %s  \n[SECTION %sA] Second part\nbody\x1e", "act_name", "id", "id", "section_number", "section_title", "lang", "section_number")
query("s17_act_file", r"""WITH b AS (SELECT act_name || ' no. ' || CAST(id AS STRING) AS act_name, 'A' || CAST(id AS STRING) AS short_name, section_number AS n, trim(section_title) AS title, lang FROM bare_acts)
SELECT act_name, short_name, short_name || '_' || n AS id, n AS section_number, title AS section_title, 'Section ' || n || ' ' || title || '. first line of ' || lang AS full_text FROM b
UNION ALL SELECT act_name, short_name, short_name || '_' || n || 'A', n || 'A', 'Second part', 'Section ' || n || 'A Second part. body' FROM b""")(lambda t: p.act_sections(t.spark.read.text(_written(t.bare_acts.select(_S17().alias("value")), lambda d, q: d.write.text(q)), lineSep="\x1e"), "value"))
query("s26_tables", "SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM queries GROUP BY 1")(lambda t: t.spark.read.parquet(_written(t.queries.withColumn("day", F.to_date("timestamp")), lambda d, q: d.write.partitionBy("day").parquet(q))).groupBy("day").agg(F.count("*").alias("n")))
query("s27_log_insert", "SELECT query_id, confidence FROM responses_log")(lambda t: t.spark.read.parquet(_written(t.responses_log.select("query_id", "confidence"), lambda d, q: d.write.mode("append").parquet(q))))
query("s28_seed_tables", "SELECT * FROM (VALUES " + ", ".join(f"('amendments', '{a}', '{b}', '{c}', {d})" for a, b, c, d in seeds.AMENDMENTS) + ", " + ", ".join(f"('overruling_map', '{a}', '{b}', '{c}', {d})" for a, b, c, d in seeds.OVERRULINGS) + ") v(collection, id, name, reference, year)")(lambda t: seeds.tables(t.spark))
# ---- streaming
query("g01_available_now", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(lambda t: jobs.run_once(t, lambda s: s.select("event_type", "event_id")).groupBy("event_type").agg(F.count("*").alias("n")))
query("g03_look_back", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'")(lambda t: jobs.run_once(t, lambda s: s.filter((F.col("ts") >= F.lit("2024-01-13 12:00:00").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20 12:00:00").cast("timestamp"))).select("event_id")))
query("g05_skip_duplicates", "SELECT DISTINCT user_id, event_type, value FROM events")(lambda t: jobs.run_once(t, lambda s: s.withWatermark("ts", "90 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "value"]).select("user_id", "event_type", "value")))
query("g06_append_log", "SELECT event_id, value FROM events WHERE event_type = 'error'")(lambda t: jobs.run_once(t, lambda s: s.filter("event_type = 'error'").select("event_id", "value")))
_G7 = "SELECT date_trunc('{0}', ts) AS {0}, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
query("g04_last_run", "SELECT count(*) AS taken, max(ts) AS newest FROM events")(lambda t: jobs.last_run(t))
query("g07_hourly", _G7.format("hour"))(lambda t: jobs.windows(t, "1 hour", "hour"))
query("g07_daily", _G7.format("day"))(lambda t: jobs.windows(t, "1 day", "day"))
query("g07_weekly", _G7.format("week"))(lambda t: jobs.windows(t, "7 days", "week", "4 days"))  # weeks start on Mondays
query("g07_sessions", """WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS first FROM events), k AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")(lambda t: jobs.sessions(t))
query("g08_resume", "SELECT event_id FROM events")(lambda t: jobs.resumed(t))


@query("g08_done_ids", "SELECT event_id, value * 2 AS doubled FROM events")
def _done_ids(t):
    """Each event is worked on once: a second run, with other state but the same done ids, finds nothing to do."""
    root = f"{scratch(t.spark)}/once-{uuid.uuid4().hex}"
    for _ in range(2):
        once.each_once(jobs._stream(t), root, "event_id", lambda df: df.select("event_id", (F.col("value") * 2).alias("doubled"))).awaitTermination()
    return once.results(t.spark, root)


@query("g05_near_copies")
def _near_copies(t):
    """Documents that aren't near copies of one kept before them; a document's time is a minute for each id."""
    docs = t.spark.readStream.schema(t.documents.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/documents.parque[t]")
    timed = docs.withColumn("at", F.timestamp_seconds(F.col("doc_id") * 60))
    root = f"{scratch(t.spark)}/near-{uuid.uuid4().hex}"
    once.skip_near_copies(timed, root, key="doc_id", text="text", time="at").awaitTermination()
    return once.results(t.spark, root).select("doc_id")
