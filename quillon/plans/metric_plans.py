"""Queries of the reliability metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import rules as r
from quillon.operators import metrics as m
from quillon.operators.relational import topk
from quillon.plans.registry import query
from quillon.plans.retrieval_plans import FUSED_SQL, fused
from quillon.plans.rule_plans import ABSTAIN_SQL, any_sql
from quillon.plans.text_plans import citation_sql

r6 = lambda c: F.round(c, 6)


def _act_sql(c):
    k = f"upper(trim({c}))"
    return f"CASE WHEN {k} = '' THEN NULL " + " ".join(f"WHEN {k} = '{a}' THEN '{b}'" for a, b in m.ACT_NAMES.items()) + " " + " ".join(f"WHEN starts_with({k}, '{a}') OR starts_with('{a}', {k}) THEN '{b}'" for a, b in m.ACT_NAMES.items()) + " END"


def _tok(c):
    return rf"trim(regexp_replace(trim(regexp_replace(trim({c}), '(?i)^section\s*', '')), '(?i)^sec\.?\s*', ''))"


_VARIANTS = "CASE act " + " ".join(f"WHEN '{k}' THEN {any_sql('text', v)}" for k, v in m.ACT_VARIANTS.items()) + " ELSE contains(text, act) END"
_MATCH = """(p <> '' AND norm <> '' AND (contains(p, norm) OR contains(norm, p) OR (len(regexp_extract_all(norm, '(\\d+[A-Z]?)', 1)) > 0 AND len(list_filter(regexp_extract_all(norm, '(\\d+[A-Z]?)', 1), lambda n: NOT contains(p, n))) = 0
 AND (len(list_filter(string_split(norm, ' '), lambda w: length(w) > 4 AND w NOT IN ('""" + "', '".join(m.MATCH_STOPWORDS) + """'))) = 0 OR len(list_filter(string_split(norm, ' '), lambda w: length(w) > 4 AND w NOT IN ('""" + "', '".join(m.MATCH_STOPWORDS) + """') AND contains(p, w))) > 0))))"""
J = f"""j0 AS (SELECT r.*, g.category, upper(trim(g.correct_act)) AS act, trim(g.correct_section) AS section, trim(g.correct_citation) AS cit, g.summary, g.amendment_applies, g.transition_applies, g.overruling_applies,
  upper(concat_ws(' ', r.act1 || ' ' || r.section1, r.act2 || ' ' || r.section2)) AS text FROM responses r JOIN ground_truth g ON r.row_idx = g.row_idx),
j AS (SELECT *, CASE WHEN cit = '' AND act <> '' AND section <> '' THEN act || ' Section ' || section ELSE cit END AS expected FROM j0)"""
CAR = f"""{J}, n AS (SELECT *, {citation_sql('expected')} AS norm, {citation_sql("act1 || ' ' || section1")} AS p1, {citation_sql('section1')} AS p2, {citation_sql("act2 || ' ' || section2")} AS p3, {citation_sql('section2')} AS p4 FROM j),
car AS (SELECT *, act = '' OR (text <> '' AND {_VARIANTS}) AS act_ok, section = '' OR (text <> '' AND (coalesce(upper(trim(section1)) = upper(section), false) OR coalesce(upper(trim(section2)) = upper(section), false)
  OR contains(text, 'SECTION ' || upper(section)) OR contains(text, 'SEC ' || upper(section)) OR contains(text, 'S. ' || upper(section)) OR contains(text, '§ ' || upper(section)) OR contains(text, 'SEC. ' || upper(section)) OR contains(text, ' ' || upper(section) || ' '))) AS section_ok,
  ({_MATCH.replace('p,', 'p1,').replace('(p ', '(p1 ').replace(', p)', ', p1)')}) OR ({_MATCH.replace('p,', 'p2,').replace('(p ', '(p2 ').replace(', p)', ', p2)')}) OR ({_MATCH.replace('p,', 'p3,').replace('(p ', '(p3 ').replace(', p)', ', p3)')}) OR ({_MATCH.replace('p,', 'p4,').replace('(p ', '(p4 ').replace(', p)', ', p4)')}) AS match,
  contains(lower(answer), lower(act)) AS said, section = '' OR list_contains(regexp_extract_all(lower(answer), '(?:section|sec|s\\.)\\s*(\\d+(?:\\.\\d+)?)', 1), section) AS number FROM n),
s AS (SELECT *, CASE WHEN act = '' OR match OR (act_ok AND section_ok) THEN 1.0 WHEN act_ok THEN 0.5 ELSE 0.0 END AS retrieved, CASE WHEN act = '' OR (said AND number) THEN 1.0 WHEN said THEN 0.5 ELSE 0.0 END AS generated FROM car)"""
_j = lambda t: m.joined(t.responses, t.ground_truth)
_car = lambda t: m.accuracy(_j(t))
query("m00_act_resolver", f"SELECT row_idx, system, {_act_sql('act1')} AS name FROM responses")(lambda t: t.responses.select("row_idx", "system", m.act_name(F.col("act1")).alias("name")))
query("m01_citation_accuracy", f"WITH {CAR} SELECT system, coalesce(category, 'overall') AS category, CAST(round(avg(retrieved) * 100, 6) AS DOUBLE) AS retrieved, CAST(round(avg(generated) * 100, 6) AS DOUBLE) AS generated, CAST(round((avg(retrieved) + avg(generated)) * 50, 6) AS DOUBLE) AS car FROM s GROUP BY system, ROLLUP (category)")(lambda t: _car(t).groupingSets([["system", "category"], ["system"]], "system", "category").agg(r6(F.avg("retrieved") * 100).alias("retrieved"), r6(F.avg("generated") * 100).alias("generated"), r6((F.avg("retrieved") + F.avg("generated")) * 50).alias("car")).withColumn("category", F.coalesce("category", F.lit("overall"))))
query("m01_citation_scores", f"WITH {CAR} SELECT row_idx, system, CAST(retrieved AS DOUBLE) AS retrieved, CAST(generated AS DOUBLE) AS generated FROM s")(lambda t: _car(t).select("row_idx", "system", "retrieved", "generated"))
query("m01a_candidates", "SELECT row_idx, system, array_to_string(list_filter(c, lambda v, i: v IS NOT NULL AND list_position(c, v) = i), '|') AS candidates FROM (SELECT row_idx, system, [act1 || ' ' || section1, section1, act2 || ' ' || section2, section2] AS c FROM responses)")(lambda t: t.responses.select("row_idx", "system", F.array_join(m.candidates(m.citations()), "|").alias("candidates")))
query("m01b_citation_match", f"WITH {CAR} SELECT row_idx, system, match FROM s")(lambda t: _j(t).withColumn("norm", m.x.citation(F.col("expected"))).select("row_idx", "system", F.exists(F.transform(m.candidates(F.col("cites")), m.x.citation), lambda p: m.citation_match(p, F.col("norm"))).alias("match")))
query("m01c_act_mentioned", f"WITH {CAR} SELECT row_idx, system, act_ok FROM s")(lambda t: _j(t).select("row_idx", "system", m.act_mentioned(F.col("act"), F.col("text")).alias("act_ok")))
query("m01d_section_mentioned", f"WITH {CAR} SELECT row_idx, system, section_ok FROM s")(lambda t: _j(t).select("row_idx", "system", m.section_mentioned(F.col("section"), F.col("cites"), F.col("text")).alias("section_ok")))
HR = f"""{J}, c0 AS (SELECT row_idx, system, act, section AS s, expected AS e, type1 AS type, act1 AS a, section1 AS sec FROM j WHERE act1 IS NOT NULL UNION ALL SELECT row_idx, system, act, section, expected, 'bare_act', act2, section2 FROM j WHERE act2 IS NOT NULL),
c AS (SELECT *, CASE WHEN type = 'bare_act' THEN {_tok('sec')} ELSE sec END AS sn, coalesce({_act_sql('a')}, a) AS an, ({_tok('sec')} = s AND coalesce({_act_sql('a')} = {_act_sql('act')}, false)) OR sec = e AS ok FROM c0),
per AS (SELECT row_idx, system, count(*) AS claims, count(*) FILTER (NOT ok AND type = 'bare_act' AND NOT EXISTS (SELECT 1 FROM bare_acts b WHERE b.act_name = an AND b.section_number = sn)) AS sections, count(*) FILTER (NOT ok AND type = 'case_law' AND NOT EXISTS (SELECT 1 FROM case_law k WHERE k.citation = sn)) AS cases FROM c GROUP BY 1, 2),
inl AS (SELECT row_idx, system, CAST(len(list_filter(regexp_extract_all(lower(answer), '(?:section|sec|s\\.)\\s*(\\d+(?:\\.\\d+)?)', 1), lambda v: NOT coalesce(contains(lower(section1), v), false) AND NOT coalesce(contains(lower(section2), v), false))) AS INT) AS inline FROM j),
hr AS (SELECT row_idx, system, inline, coalesce(claims, 0) AS claims, coalesce(sections, 0) AS sections, coalesce(cases, 0) AS cases, coalesce(claims, 0) + inline AS total, (coalesce(sections, 0) + coalesce(cases, 0) + inline) / greatest(coalesce(claims, 0) + inline, 1) AS rate FROM inl LEFT JOIN per USING (row_idx, system))"""
_hr = lambda t: m.hallucinations(_j(t), t.bare_acts, t.case_law)
query("m02_hallucination_rows", f"WITH {HR} SELECT row_idx, system, claims, sections, cases, inline, round(rate, 6) AS rate FROM hr")(lambda t: _hr(t).select("row_idx", "system", "claims", "sections", "cases", "inline", r6(F.col("rate")).alias("rate")))
query("m02_hallucination_rate", f"WITH {HR} SELECT system, round(100.0 * sum(sections + cases + inline) / greatest(sum(total), 1), 6) AS micro, round(100 * avg(rate), 6) AS macro FROM hr GROUP BY 1")(lambda t: _hr(t).groupBy("system").agg(r6(100 * F.sum(F.col("sections") + F.col("cases") + F.col("inline")) / F.greatest(F.sum("total"), F.lit(1))).alias("micro"), r6(100 * F.avg("rate")).alias("macro")))
query("m02a_string_claims", r"""SELECT row_idx, system, CASE WHEN regexp_matches(c, '(?i)\b(AIR|SCC|SCR)\b') THEN 'case_law' WHEN regexp_matches(c, '(?i)(section|sec\.?|s\.?)\s*[0-9]+[A-Z]?') THEN 'bare_act' END AS type FROM (SELECT row_idx, system, act1 || ' ' || section1 AS c FROM responses)""")(lambda t: t.responses.withColumn("c", F.concat("act1", F.lit(" "), "section1")).select("row_idx", "system", F.when(F.col("c").rlike(r"(?i)\b(AIR|SCC|SCR)\b"), "case_law").when(F.col("c").rlike(r"(?i)(section|sec\.?|s\.?)\s*[0-9]+[A-Z]?"), "bare_act").alias("type")))
_FULL = "(answer || ' ' || concat_ws(' ', act1, act2))"
OLR = f"{J}, o AS (SELECT *, " + ", ".join(f"regexp_matches({_FULL}, '{old}') AS {n}_cited, regexp_matches({_FULL}, '{old}') AND NOT (regexp_matches({_FULL}, '{new}')" + (" OR transition_note <> ''" if n == "ipc" else "") + f") AS {n}_outdated" for n, (old, new) in m.REPLACED.items()) + " FROM j)"
_OUT = "count(*) FILTER (ipc_outdated) + count(*) FILTER (crpc_outdated) + count(*) FILTER (evidence_outdated)"
_CIT = _OUT.replace("outdated", "cited")
_olr = lambda t: m.outdated(_j(t))
_sum = lambda what: sum((F.count_if(f"{n}_{what}") for n in m.REPLACED), F.lit(0))
_rate = lambda a, b: r6(F.coalesce(F.try_divide(100 * a, b), F.lit(0.0)))
_any_old = lambda: F.col("ipc_outdated") | F.col("crpc_outdated") | F.col("evidence_outdated")
query("m03_outdated_rate", f"WITH {OLR} SELECT system, " + ", ".join(f"round(coalesce(100.0 * count(*) FILTER ({n}_outdated) / nullif(count(*) FILTER ({n}_cited), 0), 0), 6) AS {n}" for n in m.REPLACED) + f", round(coalesce(100.0 * ({_OUT}) / nullif({_CIT}, 0), 0), 6) AS overall, round(100.0 * count(*) FILTER (ipc_outdated OR crpc_outdated OR evidence_outdated) / count(*), 6) AS responses FROM o GROUP BY 1")(lambda t: _olr(t).groupBy("system").agg(*[_rate(F.count_if(f"{n}_outdated"), F.count_if(f"{n}_cited")).alias(n) for n in m.REPLACED], _rate(_sum("outdated"), _sum("cited")).alias("overall"), r6(100 * F.count_if(_any_old()) / F.count("*")).alias("responses")))
query("m03a_outdated_transition", f"WITH {OLR} SELECT system, count(*) AS n, round(100.0 * count(*) FILTER (ipc_outdated OR crpc_outdated OR evidence_outdated) / count(*), 6) AS rate FROM o WHERE category ILIKE '%transition%' GROUP BY 1")(lambda t: _olr(t).filter(F.col("category").ilike("%transition%")).groupBy("system").agg(F.count("*").alias("n"), r6(100 * F.count_if(_any_old()) / F.count("*")).alias("rate")))
AP = f"""{CAR}, ab AS (SELECT *, {ABSTAIN_SQL} AS abstained, EXISTS (SELECT 1 FROM bare_acts b WHERE b.act_name = {_act_sql('act')} AND b.section_number = section) AS available, act = '' OR (act_ok AND section_ok) AS right_ FROM s),
q4 AS (SELECT system, count(*) FILTER (abstained AND NOT available) AS tp, count(*) FILTER (abstained AND available) AS fp, count(*) FILTER (NOT abstained AND NOT right_) AS fn, count(*) FILTER (NOT abstained AND right_) AS tn, count(*) AS n FROM ab GROUP BY 1)"""


@query("m04_abstention", f"WITH {AP} SELECT system, tp, fp, fn, tn, round(tp / greatest(tp + fp, 1), 6) AS precision_, round(tp / greatest(tp + fn, 1), 6) AS recall_, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 0.001), 6) AS f1 FROM q4")
def _abstention(t):
    j = _j(t).withColumn("act_name", m.act_name(F.col("act")))
    known = t.bare_acts.select("act_name", F.col("section_number").alias("section")).distinct().withColumn("available", F.lit(True))
    j = j.join(known, ["act_name", "section"], "left").withColumn("available", F.coalesce("available", F.lit(False)))
    right = (F.col("act") == "") | (m.act_mentioned(F.col("act"), F.col("text")) & m.section_mentioned(F.col("section"), F.col("cites"), F.col("text")))
    j = j.select("system", r.abstains(F.col("answer"), F.col("confidence"), F.col("trigger_uncertainty"), F.size("cites")).alias("a"), "available", right.alias("ok"))
    n = j.groupBy("system").agg(F.count_if(F.col("a") & ~F.col("available")).alias("tp"), F.count_if(F.col("a") & F.col("available")).alias("fp"), F.count_if(~F.col("a") & ~F.col("ok")).alias("fn"), F.count_if(~F.col("a") & F.col("ok")).alias("tn"))
    p, q = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return n.select("system", "tp", "fp", "fn", "tn", r6(p).alias("precision_"), r6(q).alias("recall_"), r6(2 * p * q / F.greatest(p + q, F.lit(0.001))).alias("f1"))


_STOP = "['" + "', '".join(m.RUBRIC_STOPWORDS) + "']"
ACS = rf"""{J}, t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(summary), '\s+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w))) AS ref FROM j),
acs AS (SELECT row_idx, system, category, round((CASE WHEN answer = '' THEN 0.5 WHEN len(list_intersect(ref, regexp_split_to_array(lower(answer), '\s+'))) / greatest(len(ref), 1) >= 0.35 THEN 1.0 WHEN len(list_intersect(ref, regexp_split_to_array(lower(answer), '\s+'))) / greatest(len(ref), 1) >= 0.15 THEN 0.5 ELSE 0.0 END
 + CASE WHEN contains(lower(act1), lower(act)) OR contains(lower(act2), lower(act)) THEN 1 ELSE 0 END + CASE WHEN trim(section1) = section OR trim(section2) = section THEN 1 ELSE 0 END
 + CASE WHEN lower(amendment_applies) <> 'yes' OR {any_sql('lower(answer)', m.NOTE_WORDS['amendment'])} THEN 1 ELSE 0 END + CASE WHEN lower(transition_applies) <> 'yes' OR transition_note <> '' OR {any_sql('lower(answer)', m.NOTE_WORDS['transition'])} THEN 1 ELSE 0 END + CASE WHEN lower(overruling_applies) <> 'yes' OR {any_sql('lower(answer)', m.NOTE_WORDS['overruling'])} THEN 1 ELSE 0 END) / 6.0 * 100, 2) AS acs FROM t)"""
query("m05_rubric_rows", f"WITH {ACS} SELECT row_idx, system, CAST(acs AS DOUBLE) AS acs FROM acs")(lambda t: m.rubric(_j(t)).select("row_idx", "system", "acs"))
query("m05_rubric", f"WITH {ACS} SELECT system, category, round(avg(acs), 4) AS acs FROM acs GROUP BY 1, 2")(lambda t: m.rubric(_j(t)).groupBy("system", "category").agg(F.round(F.avg("acs"), 4).alias("acs")))


# a reference's vector has the row's number, an answer's one that depends on its system; the rows beyond the vectors fall back on the rubric
_COS = "list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))"


@query("m06_semantic", f"""WITH {ACS} SELECT acs.row_idx, acs.system, CAST(CASE WHEN trim(r.answer) = '' THEN 0 WHEN b.vec_id IS NULL OR c.vec_id IS NULL THEN acs ELSE round(greatest(0, least(100, ({_COS} + 1) / 2 * 100)), 2) END AS DOUBLE) AS acs
FROM acs JOIN responses r USING (row_idx, system) LEFT JOIN embeddings b ON b.vec_id = acs.row_idx LEFT JOIN embeddings c ON c.vec_id = acs.row_idx + length(acs.system)""")
def _semantic(t):
    j = m.rubric(_j(t)).select("row_idx", "system", "answer", "acs", (F.col("row_idx") + F.length("system")).alias("of_answer"))
    j = j.join(t.embeddings.select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("b")), "row_idx", "left").join(t.embeddings.select(F.col("vec_id").alias("of_answer"), F.col("embedding").alias("c")), "of_answer", "left")
    return j.select("row_idx", "system", m.semantic(F.col("b"), F.col("c"), F.col("answer"), F.col("acs")).alias("acs"))


_M7 = f"""{FUSED_SQL}, m7 AS (SELECT g.row_idx, rank, coalesce(CASE WHEN lower(replace(g.category, ' ', '_')) IN ('case_law_search', 'overruled_detection') THEN c.citation = g.correct_citation
 ELSE b.section_number = g.correct_section AND b.act_name = coalesce({_act_sql('g.correct_act')}, lower(g.correct_act)) END, false) AS hit
 FROM ground_truth g LEFT JOIN (SELECT item_id, doc_id, rank FROM fused WHERE rank <= 3) f ON f.item_id = g.row_idx LEFT JOIN bare_acts b ON b.id = f.doc_id LEFT JOIN case_law c ON c.case_id = f.doc_id WHERE g.row_idx IN (SELECT item_id FROM benchmark)),
p7 AS (SELECT row_idx, round(count(*) FILTER (hit AND rank <= 1), 6) AS p_at_1, round(count(*) FILTER (hit AND rank <= 3) / greatest(least(3, count(rank)), 1), 6) AS p_at_3 FROM m7 GROUP BY 1)"""


def _precision(t):
    """Of the fused rankings for the benchmark's items; item i asks the ground truth's question i."""
    asked = t.ground_truth.join(t.benchmark.select(F.col("item_id").alias("row_idx")), "row_idx", "left_semi")
    return m.precision_at_k(fused(t).withColumnRenamed("item_id", "row_idx"), asked, t.bare_acts, t.case_law)


query("m07_precision_at_k", f"WITH {_M7} SELECT row_idx, CAST(p_at_1 AS DOUBLE) AS p_at_1, CAST(p_at_3 AS DOUBLE) AS p_at_3 FROM p7")(_precision)
query("m07_precision", f"WITH {_M7} SELECT round(avg(p_at_1) * 100, 4) AS p_at_1, round(avg(p_at_3) * 100, 4) AS p_at_3 FROM p7")(lambda t: _precision(t).agg(*[F.round(F.avg(c) * 100, 4).alias(c) for c in ("p_at_1", "p_at_3")]))
_target = lambda: F.when(F.col("confidence") == "high", 0.90).when(F.col("confidence") == "medium", 0.725).otherwise(0.50)
query("m08_calibration", "WITH l AS (SELECT system, confidence, count(*) AS n, abs(avg(correct) - CASE confidence WHEN 'high' THEN 0.90 WHEN 'medium' THEN 0.725 ELSE 0.50 END) AS e FROM scores GROUP BY 1, 2) SELECT system, round(sum(n * e) / sum(n), 6) AS error, sum(n * e) / sum(n) < 0.15 AS good FROM l GROUP BY 1")(lambda t: t.scores.groupBy("system", "confidence").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy")).withColumn("e", F.abs(F.col("accuracy") - _target())).groupBy("system").agg(r6(F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("error"), (F.sum(F.col("n") * F.col("e")) / F.sum("n") < 0.15).alias("good")))


@query("m09_all_metrics", f"WITH {CAR}, {HR[len(J) + 2:]}, {OLR[len(J) + 2:]}, {ACS[len(J) + 2:]} SELECT system, 'car' AS metric, CAST(round((avg(retrieved) + avg(generated)) * 50, 4) AS DOUBLE) AS value FROM s GROUP BY 1 UNION ALL SELECT system, 'hr', round(100 * avg(rate), 4) FROM hr GROUP BY 1 UNION ALL SELECT system, 'olr', round(100.0 * count(*) FILTER (ipc_outdated OR crpc_outdated OR evidence_outdated) / count(*), 4) FROM o GROUP BY 1 UNION ALL SELECT system, 'acs', round(avg(acs), 4) FROM acs GROUP BY 1")
def _all_metrics(t):
    j = _j(t)
    row = lambda df, name, value: df.groupBy("system").agg(F.round(value, 4).alias("value")).select("system", F.lit(name).alias("metric"), "value")
    one = m.rubric(m.outdated(m.accuracy(j)))
    wide = one.groupBy("system").agg(F.round((F.avg("retrieved") + F.avg("generated")) * 50, 4).alias("car"), F.round(100 * F.count_if(_any_old()) / F.count("*"), 4).alias("olr"), F.round(F.avg("acs"), 4).alias("acs"))
    return wide.select("system", F.expr("stack(3, 'car', car, 'olr', olr, 'acs', acs) AS (metric, value)")).unionByName(row(m.hallucinations(j, t.bare_acts, t.case_law), "hr", 100 * F.avg("rate")))


@query("m10_per_query", f"WITH {CAR}, {HR[len(J) + 2:]}, {ACS[len(J) + 2:]} SELECT s.row_idx, s.system, CAST((retrieved + generated) / 2 AS DOUBLE) AS car, round(rate, 6) AS hr, CAST(round(acs.acs / 100, 6) AS DOUBLE) AS acs, {ABSTAIN_SQL} AS abstained FROM s JOIN hr USING (row_idx, system) JOIN acs USING (row_idx, system)")
def _per_query(t):
    j = _j(t)
    one = m.rubric(m.accuracy(j)).select("row_idx", "system", ((F.col("retrieved") + F.col("generated")) / 2).alias("car"), r6(F.col("acs") / 100).alias("acs"), r.abstains(F.col("answer"), F.col("confidence"), F.col("trigger_uncertainty"), F.size("cites")).alias("abstained"))
    return one.join(m.hallucinations(j, t.bare_acts, t.case_law).select("row_idx", "system", r6(F.col("rate")).alias("hr")), ["row_idx", "system"])


query("m11_comparison", "WITH b AS (SELECT system, avg(car) AS v FROM scores GROUP BY 1) SELECT a.system, round(CASE WHEN f.v > 0 THEN (a.v - f.v) / f.v * 100 ELSE 0 END, 6) AS improvement FROM b a, b f WHERE f.system = 'none' AND a.system <> 'none'")(lambda t: (lambda b: b.filter("system <> 'none'").crossJoin(b.filter("system = 'none'").select(F.col("v").alias("base"))).select("system", r6(F.when(F.col("base") > 0, (F.col("v") - F.col("base")) / F.col("base") * 100).otherwise(0)).alias("improvement")))(t.scores.groupBy("system").agg(F.avg("car").alias("v"))))
query("m12_system_table", "SELECT category, round(avg(car) FILTER (system = 'full'), 6) AS full_, round(avg(car) FILTER (system = 'simple'), 6) AS simple_, round(coalesce(avg(car) FILTER (system = 'none'), 0), 6) AS none_ FROM scores GROUP BY 1")(lambda t: t.scores.groupBy("category").pivot("system", ["full", "simple", "none"]).agg(F.avg("car")).select("category", r6(F.col("full")).alias("full_"), r6(F.col("simple")).alias("simple_"), r6(F.coalesce("none", F.lit(0.0))).alias("none_")))
query("m13_masked_car", f"WITH {CAR} SELECT system, CAST(round(avg(CASE WHEN act <> '' THEN retrieved END) * 100, 6) AS DOUBLE) AS car FROM s GROUP BY 1")(lambda t: _car(t).groupBy("system").agg(r6(F.avg(F.when(F.col("act") != "", F.col("retrieved"))) * 100).alias("car")))
query("m14_legacy_citations", r"SELECT doc_id, regexp_extract(text, '(?i)section\s+(\d+[A-Z]?)\s+(?:of\s+(?:the\s+)?)?([A-Za-z ]+?)(?:[.,;]|\s\d|$)', 1) AS section, regexp_extract(text, '(?i)(?:IPC|CrPC|BNSS|BNS)', 0) AS act FROM legal")(lambda t: t.legal.select("doc_id", F.regexp_extract("text", r"(?i)section\s+(\d+[A-Z]?)\s+(?:of\s+(?:the\s+)?)?([A-Za-z ]+?)(?:[.,;]|\s\d|$)", 1).alias("section"), F.regexp_extract("text", "(?i)(?:IPC|CrPC|BNSS|BNS)", 0).alias("act")))
query("m15_failure_proxy", "SELECT doc_id, CAST(CASE WHEN length(text) >= 450 THEN 1.0 WHEN length(text) >= 180 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS proxy FROM documents")(lambda t: t.documents.select("doc_id", F.when(F.length("text") >= 450, 1.0).when(F.length("text") >= 180, 0.5).otherwise(0.0).alias("proxy")))
