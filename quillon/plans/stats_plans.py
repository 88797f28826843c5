"""Queries of the statistics, ablations and error analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import stats as s
from quillon.operators.relational import topk
from quillon.operators.sampling import examples
from quillon.plans.registry import query
from quillon.sources.sinks import scratch

r6 = lambda c: F.round(c, 6)
WIDE = "w AS (SELECT row_idx, max(car) FILTER (system = 'full') AS a, max(car) FILTER (system = 'simple') AS b, max(hr) FILTER (system = 'full') AS ha, max(hr) FILTER (system = 'simple') AS hb FROM scores GROUP BY 1)"
_wide = lambda t: t.scores.groupBy("row_idx").agg(*[F.max(F.when(F.col("system") == n, F.col(c))).alias(k) for k, c, n in (("a", "car", "full"), ("b", "car", "simple"), ("ha", "hr", "full"), ("hb", "hr", "simple"))])
_T = "avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))"
query("e01_paired_t", f"WITH {WIDE} SELECT count(*) AS n, round(avg(a - b), 6) AS diff, round({_T}, 6) AS t FROM w")(lambda t: s.paired(_wide(t), F.col("a"), F.col("b")).select("n", r6("diff").alias("diff"), r6("t").alias("t")))


@query("e01_paired_p")
def _p(t):
    row = s.paired(_wide(t), F.col("a"), F.col("b")).first()  # one row
    return t.spark.range(1).select(F.lit(round(s.two_sided_p(row.t, row.n - 1), 9)).alias("p"))


_LCG = "CAST(floor((((id * 7919 + 13) % 2147483648) * 1103515245 + 12345) % 2147483648 * n / 2147483648) AS BIGINT)"
query("e02_bootstrap", f"""WITH v AS (SELECT row_idx, car FROM scores WHERE system = 'full'), c AS (SELECT count(*) AS n FROM v), d AS (SELECT id // n AS b, {_LCG.replace('* n /', '* CAST(n AS DOUBLE) /')} AS i FROM (SELECT unnest(range(10000 * (SELECT n FROM c))) AS id), c),
m AS (SELECT b, avg(car) AS mean FROM d JOIN v ON d.i = v.row_idx GROUP BY 1) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")(lambda t: s.bootstrap(t.scores.filter("system = 'full'"), "row_idx", "car"))
query("e03_effect_sizes", f"WITH {WIDE} SELECT round((avg(a) - avg(b)) / sqrt((var_pop(a) + var_pop(b)) / 2), 6) AS d_pop, round((avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2), 6) AS d_samp, round(avg(a - b) / stddev_samp(a - b), 6) AS dz FROM w")(lambda t: s.paired(_wide(t), F.col("a"), F.col("b")).select(*[r6(c).alias(c) for c in ("d_pop", "d_samp", "dz")]))
query("e04_effect_labels", "SELECT system, category, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM (SELECT system, category, round((avg(car) - 0.5) / stddev_samp(car), 6) AS d FROM scores GROUP BY 1, 2)")(lambda t: t.scores.groupBy("system", "category").agg(r6((F.avg("car") - 0.5) / F.stddev_samp("car")).alias("d")).select("system", "category", s.effect_label(F.col("d")).alias("label")))
query("e05_bonferroni", f"WITH {WIDE} SELECT 0.05 / 8 AS alpha, abs(round({_T}, 6)) > 2.73 AS significant FROM w")(lambda t: s.paired(_wide(t), F.col("a"), F.col("b")).select(F.lit(0.05 / 8).alias("alpha"), (F.abs(r6("t")) > 2.73).alias("significant")))


@query("e06_kappa", """WITH p AS (SELECT a.score AS x, b.score AS y FROM ratings a JOIN ratings b ON a.query_id = b.query_id AND a.evaluator = 'a' AND b.evaluator = 'b'), n AS (SELECT count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS po FROM p),
e AS (SELECT sum(cx * cy) / ((SELECT n FROM n) * (SELECT n FROM n)) AS pe FROM (SELECT x, count(*) AS cx FROM p GROUP BY 1) q JOIN (SELECT y, count(*) AS cy FROM p GROUP BY 1) z ON q.x = z.y) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM n, e""")
def _kappa(t):
    p = t.ratings.filter("evaluator = 'a'").select("query_id", F.col("score").alias("x")).join(t.ratings.filter("evaluator = 'b'").select("query_id", F.col("score").alias("y")), "query_id")
    return s.kappa(p, "x", "y")


query("e07_threshold_sensitivity", "SELECT t.threshold, s.system, count(*) FILTER (acs >= t.threshold) AS kept, round(avg(car) FILTER (acs >= t.threshold), 6) AS car FROM scores s, (SELECT unnest([30, 40, 50, 60, 70, 80, 90]) AS threshold) t GROUP BY 1, 2")(lambda t: t.scores.select("system", "acs", "car", F.explode(F.array(*map(F.lit, [30, 40, 50, 60, 70, 80, 90]))).alias("threshold")).groupBy("threshold", "system").agg(F.count_if(F.col("acs") >= F.col("threshold")).alias("kept"), r6(F.avg(F.when(F.col("acs") >= F.col("threshold"), F.col("car")))).alias("car")))
query("e08_objective", "WITH o AS (SELECT category, difficulty, round(0.45 * avg(car) + 0.45 * (1 - avg(hr)) + 0.10 * (1 - avg(abstained)), 4) AS objective FROM scores GROUP BY 1, 2) SELECT category, difficulty, objective FROM o ORDER BY objective DESC, category, difficulty LIMIT 1")(lambda t: t.scores.groupBy("category", "difficulty").agg(F.round(0.45 * F.avg("car") + 0.45 * (1 - F.avg("hr")) + 0.10 * (1 - F.avg("abstained")), 4).alias("objective")).orderBy(F.desc("objective"), "category", "difficulty").limit(1))
_CLASS = "CASE WHEN answer = '' THEN 'generation_failure' WHEN act1 IS NULL THEN 'no_citation' WHEN trigger_uncertainty THEN 'over_abstention' WHEN type1 = 'case_law' AND contains(answer, 'overruled') THEN 'overruled' WHEN transition_note <> '' THEN 'transition' ELSE 'other' END"
_class = lambda: F.when(F.col("answer") == "", "generation_failure").when(F.col("act1").isNull(), "no_citation").when(F.col("trigger_uncertainty"), "over_abstention").when((F.col("type1") == "case_law") & F.col("answer").contains("overruled"), "overruled").when(F.col("transition_note") != "", "transition").otherwise("other")
query("e09_error_classes", f"SELECT row_idx, system, {_CLASS} AS class FROM responses")(lambda t: t.responses.select("row_idx", "system", _class().alias("class")))
_CLASSES = ["generation_failure", "no_citation", "over_abstention", "overruled", "transition", "other"]
query("e10_failure_distribution", f"WITH f AS (SELECT {_CLASS} AS class FROM responses WHERE lower(confidence) = 'low' OR length(answer) < 50) SELECT k.class, count(f.class) AS n FROM (SELECT unnest({_CLASSES}) AS class) k LEFT JOIN f ON f.class = k.class GROUP BY 1")(lambda t: t.spark.range(1).select(F.explode(F.array(*map(F.lit, _CLASSES))).alias("class")).join(t.responses.filter((F.lower("confidence") == "low") | (F.length("answer") < 50)).groupBy(_class().alias("class")).agg(F.count("*").alias("k")), "class", "left").select("class", F.coalesce("k", F.lit(0)).alias("n")))
query("e11_confusion", "SELECT confidence, count(*) FILTER (correct = 1) AS right_, count(*) FILTER (correct = 0) AS wrong FROM scores GROUP BY 1")(lambda t: t.scores.groupBy("confidence").pivot("correct", [1, 0]).agg(F.count(F.lit(1))).na.fill(0).select("confidence", F.col("1").alias("right_"), F.col("0").alias("wrong")))
query("e12_difficulty", "SELECT round(corr(CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, correct), 6) AS r, round(avg(correct) FILTER (difficulty = 'easy'), 6) AS easy, round(avg(correct) FILTER (difficulty = 'hard'), 6) AS hard FROM scores")(lambda t: t.scores.agg(r6(F.corr(F.when(F.col("difficulty") == "easy", 1).when(F.col("difficulty") == "medium", 2).otherwise(3), F.col("correct"))).alias("r"), r6(F.avg(F.when(F.col("difficulty") == "easy", F.col("correct")))).alias("easy"), r6(F.avg(F.when(F.col("difficulty") == "hard", F.col("correct")))).alias("hard")))
query("e13_transition_dive", "SELECT r.system, count(*) AS applicable, count(*) FILTER (contains(answer, 'BNS')) AS detected, round(1.0 * count(*) FILTER (contains(answer, 'BNS')) / count(*), 6) AS rate FROM responses r JOIN ground_truth g ON r.row_idx = g.row_idx WHERE g.transition_applies = 'yes' GROUP BY 1")(lambda t: t.responses.join(t.ground_truth.filter("transition_applies = 'yes'").select("row_idx"), "row_idx", "left_semi").groupBy("system").agg(F.count("*").alias("applicable"), F.count_if(F.contains("answer", F.lit("BNS"))).alias("detected"), r6(F.count_if(F.contains("answer", F.lit("BNS"))) / F.count("*")).alias("rate")))
_SC = "correct + 0.5 * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END"
_sc = lambda: F.col("correct") + 0.5 * F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.5).otherwise(0.0)


def examples_sql(score: str) -> str:
    kind = "CASE WHEN lower(confidence) = 'high' AND correct = 0 THEN 'overconfident_error' WHEN lower(confidence) = 'low' AND correct = 1 THEN 'underconfident_success' END"
    return f"""WITH r AS (SELECT system, row_idx, {score} AS score, {kind} AS kind FROM scores), k AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY score DESC, row_idx) AS b, row_number() OVER (PARTITION BY system ORDER BY score, row_idx DESC) AS w, row_number() OVER (PARTITION BY system, kind IS NULL ORDER BY score DESC, row_idx) AS o FROM r)
SELECT system, row_idx, 'best' AS side, CAST(b AS INT) AS place FROM k WHERE b <= 5 UNION ALL SELECT system, row_idx, 'worst', CAST(w AS INT) FROM k WHERE w <= 5 UNION ALL SELECT system, row_idx, kind, CAST(o AS INT) FROM k WHERE kind IS NOT NULL AND o <= 10"""


examples_of = lambda t, score: examples(t.scores, "system", "row_idx", score, F.col("confidence"), F.col("correct") == 1)
query("e14_examples", examples_sql(_SC))(lambda t: examples_of(t, _sc()))


query("e15_regimes", "SELECT count(*) AS differ, printf('%.1f%%', 100.0 * count(*) FILTER (contains(lower(b.answer), 'could not')) / count(*)) AS abstained FROM responses a JOIN responses b ON a.row_idx = b.row_idx AND a.system = 'full' AND b.system = 'none' WHERE a.answer <> b.answer")(lambda t: t.responses.filter("system = 'full'").select("row_idx", F.col("answer").alias("x")).join(t.responses.filter("system = 'none'").select("row_idx", F.col("answer").alias("y")), "row_idx").filter("x <> y").agg(F.count("*").alias("differ"), F.format_string("%.1f%%", (100.0 * F.count_if(F.contains(F.lower("y"), F.lit("could not"))) / F.count("*")).cast("double")).alias("abstained")))
query("e16_transition_ablation", r"SELECT system, round(avg(CASE WHEN regexp_matches(answer, '\bIPC\b') THEN 1.0 ELSE 0.0 END), 6) AS old_, round(avg(CASE WHEN regexp_matches(answer, '\bBNS\b') THEN 1.0 ELSE 0.0 END), 6) AS new_, round(avg(greatest(CASE WHEN regexp_matches(answer, '\bIPC\b') THEN 1.0 ELSE 0.0 END, CASE WHEN transition_note <> '' THEN 1.0 ELSE 0.0 END)), 6) AS combined FROM responses GROUP BY 1")(lambda t: (lambda o, n, k: t.responses.groupBy("system").agg(r6(F.avg(o)).alias("old_"), r6(F.avg(n)).alias("new_"), r6(F.avg(F.greatest(o, k))).alias("combined")))(F.col("answer").rlike(r"\bIPC\b").cast("double"), F.col("answer").rlike(r"\bBNS\b").cast("double"), (F.col("transition_note") != "").cast("double")))
query("e17_ablation_test", f"WITH {WIDE} SELECT round((avg(ha) - avg(hb)) / greatest(avg(hb), 0.001) * 100, 6) AS improvement, round(avg(ha - hb) / (stddev_samp(ha - hb) / sqrt(count(*))), 6) AS t FROM w")(lambda t: _wide(t).agg(r6((F.avg("ha") - F.avg("hb")) / F.greatest(F.avg("hb"), F.lit(0.001)) * 100).alias("improvement"), r6(F.avg(F.col("ha") - F.col("hb")) / (F.stddev_samp(F.col("ha") - F.col("hb")) / F.sqrt(F.count("*")))).alias("t")))
@query("e18_component_intervals")
def _component_intervals(t):
    """Each system's mean of each metric, in per cent, with the ends of its 95 % bootstrap interval."""
    long = t.scores.select("system", F.expr("stack(2, 'CAR', car * 100, 'HR', hr * 100) AS (metric, v)"))
    return s.bootstrap_by(long, ["system", "metric"], "v").withColumnsRenamed({"low": "ci95_lower", "high": "ci95_upper"})


@query("e20_category_intervals")
def _category_intervals(t):
    """The full system's mean by category, and how far the ends of its 95 % bootstrap interval lie from it."""
    by = s.bootstrap_by(t.scores.filter("system = 'full'"), ["category"], "car")
    return by.select("category", "n", "mean", (F.col("mean") - F.col("low")).alias("err_lower"), (F.col("high") - F.col("mean")).alias("err_upper"))


query("e18_component_table", "SELECT system, metric, round(avg(v), 6) AS mean, round(1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS half FROM (SELECT system, 'car' AS metric, car AS v FROM scores UNION ALL SELECT system, 'hr', hr FROM scores) GROUP BY 1, 2")(lambda t: t.scores.select("system", F.expr("stack(2, 'car', car, 'hr', hr) AS (metric, v)")).groupBy("system", "metric").agg(r6(F.avg("v")).alias("mean"), r6(1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("half")))


@query("e19_audited_failures", "WITH f AS (SELECT row_idx, 0 AS class FROM scores WHERE correct = 0 AND hr > 0.9 UNION ALL SELECT row_idx, 1 FROM scores WHERE car = 0 UNION ALL SELECT row_idx, 2 FROM scores WHERE abstained = 1), u AS (SELECT row_idx, min(class) AS class FROM f GROUP BY 1) SELECT class, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY row_idx) AS k FROM u) WHERE k <= 3")
def _audited(t):
    kinds = F.array_compact(F.array(F.when((F.col("correct") == 0) & (F.col("hr") > 0.9), 0), F.when(F.col("car") == 0, 1), F.when(F.col("abstained") == 1, 2)))
    return topk(t.scores.select("row_idx", F.explode(kinds).alias("class")).groupBy("row_idx").agg(F.min("class").alias("class")), ["class"], ["row_idx"], 3).select("class", "row_idx")


query("e20_figure_data", "SELECT category, confidence, round(avg(car), 6) AS mean, count(*) AS n, round(1.96 * stddev_samp(car) / sqrt(count(*)), 6) AS half FROM scores GROUP BY 1, 2")(lambda t: t.scores.groupBy("category", "confidence").agg(r6(F.avg("car")).alias("mean"), F.count("*").alias("n"), r6(1.96 * F.stddev_samp("car") / F.sqrt(F.count("*"))).alias("half")))
query("e21_provenance", "SELECT count(*) AS n_rows, count(car) AS car, count(hr) AS hr, count(act1) AS act1 FROM scores JOIN responses USING (row_idx, system)")(lambda t: t.scores.join(t.responses, ["row_idx", "system"]).agg(F.count("*").alias("n_rows"), F.count("car").alias("car"), F.count("hr").alias("hr"), F.count("act1").alias("act1")))
query("e22_split_sizes", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM labels GROUP BY 1")(lambda t: t.labels.groupBy(F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("positives"), F.count_if(F.col("quality") == 0).alias("negatives")))
_PRED = "SELECT quality AS y, CASE WHEN toxic = 0 AND doc_id % 7 <> 0 THEN 1 ELSE 0 END AS p FROM labels"
query("e23_classifier_metrics", f"""WITH c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM ({_PRED}))
SELECT tp, fp, fn, tn, round(1.0 * (tp + tn) / greatest(tp + tn + fp + fn, 1), 6) AS accuracy, round(1.0 * tp / greatest(tp + fp, 1), 6) AS precision_, round(1.0 * tp / greatest(tp + fn, 1), 6) AS recall_, round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1,
round((1.0 * tp / greatest(tp + fp, 1) + 1.0 * tn / greatest(tn + fn, 1)) / 2, 6) AS macro_precision, round((1.0 * tp / greatest(tp + fn, 1) + 1.0 * tn / greatest(tn + fp, 1)) / 2, 6) AS macro_recall, round((2.0 * tp / greatest(2 * tp + fp + fn, 1) + 2.0 * tn / greatest(2 * tn + fp + fn, 1)) / 2, 6) AS macro_f1 FROM c""")(lambda t: s.classified(t.labels, F.col("quality"), F.when((F.col("toxic") == 0) & (F.col("doc_id") % 7 != 0), 1).otherwise(0)))


@query("e23_classifier_fit")
def _fit(t):
    rows = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), (F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")) / F.greatest(F.length("text"), F.lit(1)) * 10).alias("symbols"), (F.length(F.regexp_replace("text", "[^A-Z!]", "")) / F.greatest(F.length("text"), F.lit(1)) * 10).alias("capitals"))
    path = f"{scratch(t.spark)}/features-{uuid.uuid4().hex}"
    rows.write.parquet(path)  # each step of the fit reads these few columns only
    rows = t.spark.read.schema(rows.schema).parquet(path)
    w = s.logistic(rows.filter("doc_id % 5 <> 0"), ["symbols", "capitals"], "y")
    return rows.filter("doc_id % 5 = 0").select("doc_id", "y", F.round(1 / (1 + F.exp(-(F.col("symbols") * w[0] + F.col("capitals") * w[1] + w[2]))), 6).alias("p"))


query("e24_transition_experiment", "SELECT system, round(avg(CASE WHEN transition_note = '' THEN 1.0 ELSE 0.0 END), 6) AS without_note, count(*) FILTER (transition_note = '' AND g.transition_applies = 'yes') AS errors FROM responses r JOIN ground_truth g USING (row_idx) GROUP BY 1")(lambda t: t.responses.select("row_idx", "system", "transition_note").join(t.ground_truth.select("row_idx", "transition_applies"), "row_idx").groupBy("system").agg(r6(F.avg((F.col("transition_note") == "").cast("double"))).alias("without_note"), F.count_if((F.col("transition_note") == "") & (F.col("transition_applies") == "yes")).alias("errors")))
query("e25_phase_delta", "SELECT metric, round(max(v) FILTER (system = 'full') - max(v) FILTER (system = 'none'), 6) AS delta FROM (SELECT system, 'car' AS metric, avg(car) AS v FROM scores GROUP BY 1 UNION ALL SELECT system, 'hr', avg(hr) FROM scores GROUP BY 1) GROUP BY 1")(lambda t: t.scores.groupBy().pivot("system", ["full", "none"]).agg(F.avg("car").alias("car"), F.avg("hr").alias("hr")).select(F.expr("stack(2, 'car', full_car - none_car, 'hr', full_hr - none_hr) AS (metric, d)")).select("metric", r6("d").alias("delta")))
