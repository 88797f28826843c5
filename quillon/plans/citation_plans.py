"""Citations in answers and of what was retrieved."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import citations as c
from quillon.plans.registry import query

_strip = lambda x: f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def _found(pattern: str, way: int, number: int, act: int) -> str:
    """Matches of a pattern in cited_answers with their places, in DuckDB."""
    p = f"'(?i){pattern}'"
    return f"""SELECT row_idx, {way} AS way, CAST(list_sum(list_transform(piece[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS start, hit[i] AS full_text, number[i] AS number, act[i] AS act
FROM (SELECT *, unnest(generate_series(1, len(hit))) AS i FROM (SELECT row_idx, regexp_extract_all(answer, {p}) AS hit, regexp_extract_all(answer, {p}, {number}) AS number, regexp_extract_all(answer, {p}, {act}) AS act, string_split_regex(answer, {p}) AS piece FROM cited_answers))"""


FOUND_SQL = f"""found AS ({_found(c.SECTION_OF_ACT, 1, 1, 2)} UNION ALL {_found(c.ACT_SECTION, 2, 2, 1)}),
cited AS (SELECT row_idx, way, start, start + len(full_text) AS stop, full_text, 'Section ' || number AS section, {_strip("act")} AS act FROM found QUALIFY row_number() OVER (PARTITION BY row_idx, section, act ORDER BY start, way) = 1),
known AS (SELECT DISTINCT 'Section ' || section_number AS section, act_name AS act FROM bare_acts),
report AS (SELECT cited.*, known.act IS NOT NULL AS is_valid FROM cited LEFT JOIN known USING (section, act))"""
_known = lambda t: t.bare_acts.select(F.concat(F.lit("Section "), "section_number").alias("section"), F.col("act_name").alias("act"))


@query(
    "r19_masking",
    f"""WITH RECURSIVE {FOUND_SQL},
bad AS (SELECT row_idx, start, stop, row_number() OVER (PARTITION BY row_idx ORDER BY start DESC, way DESC) AS k FROM report WHERE NOT is_valid),
fold AS (SELECT row_idx, 0 AS k, answer FROM cited_answers UNION ALL SELECT fold.row_idx, fold.k + 1, substr(answer, 1, start) || '{c.REMOVED}' || substr(answer, stop + 1) FROM fold JOIN bad ON bad.row_idx = fold.row_idx AND bad.k = fold.k + 1),
n AS (SELECT row_idx, count(*) AS n_citations, count(*) FILTER (is_valid) AS n_valid, count(*) FILTER (NOT is_valid) AS n_invalid FROM report GROUP BY 1)
SELECT row_idx, answer, coalesce(n_citations, 0) AS n_citations, coalesce(n_valid, 0) AS n_valid, coalesce(n_invalid, 0) AS n_invalid FROM (SELECT row_idx, arg_max(struct_pack(a := answer), k).a AS answer FROM fold GROUP BY 1) LEFT JOIN n USING (row_idx)""",
)
def _masking(t):
    """Answers whose citations of unknown sections are replaced, with the numbers of their citations."""
    return c.mask_citations(t.cited_answers, _known(t), ["row_idx"], "answer")


query("r19_report", f"WITH {FOUND_SQL} SELECT row_idx, section, act, full_text, start AS place, is_valid FROM report")(lambda t: c.citation_report(t.cited_answers, _known(t), ["row_idx"], "answer").select("row_idx", "section", "act", "full_text", F.col("start").cast("long").alias("place"), "is_valid"))


@query("r19_nested")
def _nested(t):
    """The same inside JSON answers, at any depth; what isn't looked at stays."""
    risk = F.struct(F.struct(F.col("answer").alias("reason"), F.array(F.col("answer"), F.lit("plain")).alias("notes")).alias("risk"), F.lit(3).alias("level"))
    made = F.to_json(F.struct(F.array(risk).alias("risks"), F.col("answer").alias("overview"), F.col("answer").alias("question")))
    return c.mask_json(t.cited_answers.select("row_idx", made.alias("response")), _known(t), ["row_idx"], "response")


def _label(x: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN '{label}' WHEN '{n} {year}' THEN '{label}'" for n, year, label in c.ACT_LABELS)
    return f"(CASE upper({_strip(x)}) {cases} ELSE {_strip(x)} END)"


def _section(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({_strip(x)}, '(?i)^section\\s*', ''), '[^0-9A-Za-z()\\-]+', '', 'g')"
    return f"(CASE WHEN {bare} = '' THEN '' ELSE 'Section ' || {bare} END)"


LAST = r"list_last(string_split_regex(successor, '\s+'))"
_hints = " ".join(f"WHEN {' OR '.join(f"contains(u, '{n}')" for n in names)} THEN '{label}'" for label, names in c.ACT_HINTS)


@query(
    "r14_structured_citations",
    rf"""WITH q AS (SELECT *, CASE {_hints} ELSE '' END AS act, CASE WHEN regexp_extract(u, '(?:SECTION|SEC\.?|S\.?|धारा)\s*(\d+[A-Z]?)', 1) <> '' THEN regexp_extract(u, '(?:SECTION|SEC\.?|S\.?|धारा)\s*(\d+[A-Z]?)', 1) ELSE regexp_extract(u, '(?:IPC|CRPC|BNS|BNSS)\s*(\d+[A-Z]?)', 1) END AS sec,
  regexp_extract_all(u, '\d+[A-Z]?') AS numbers, regexp_matches(u, '(\b(SECTION|SEC\.?|S\.?)|धारा)\s*\d+') AS lookup FROM (SELECT row_idx, upper(coalesce(query, '')) AS u FROM lookups)),
a AS (SELECT *, upper({_label("act")}) AS label, upper({_section("sec")}) AS wanted FROM q),
r AS (SELECT f.row_idx, f.pos, f.type, {_strip("f.name")} AS name, {_strip("f.reference")} AS reference, {_strip("f.replaced_by")} AS successor, a.*, {_strip("replace(upper(coalesce(f.reference, '')), 'SECTION', '')")} AS number FROM found_sources f JOIN a USING (row_idx)),
s AS (SELECT *, label <> '' AND upper({_label("name")}) = label AS same_act, wanted <> '' AND upper({_section("number")}) = wanted AS same_section FROM r),
e AS (SELECT row_idx, 0 AS kind, 0 AS pos, 0 AS sub, 'query_hint' AS type, {_label("act")} AS act_or_case, {_section("sec")} AS section_or_citation, 1000 AS score FROM a WHERE act <> '' AND sec <> ''
  UNION ALL SELECT row_idx, 1, pos, 0, type, {_label("name")}, {_section("reference")}, CASE WHEN list_contains(numbers, number) THEN 100 ELSE 0 END + CASE WHEN same_act THEN 60 ELSE 0 END + CASE WHEN same_section THEN 80 ELSE 0 END + CASE WHEN lookup AND same_act AND same_section THEN 400 ELSE 0 END FROM s WHERE type = 'bare_act' AND name <> '' AND reference <> ''
  UNION ALL SELECT row_idx, 1, pos, 1, 'bare_act_transition', CASE WHEN starts_with(upper(successor), 'BNSS') THEN 'BNSS' ELSE 'BNS' END, {_section(LAST)}, 10 FROM s WHERE type = 'bare_act' AND (starts_with(upper(successor), 'BNS SECTION') OR starts_with(upper(successor), 'BNSS SECTION'))
  UNION ALL SELECT row_idx, 2, pos, 0, type, name, reference, 0 FROM s WHERE type = 'case_law' AND name <> '' AND reference <> ''),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY row_idx, upper(act_or_case), upper(section_or_citation) ORDER BY score DESC, kind, pos, sub) = 1)
SELECT row_idx, CAST(row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, kind, pos, sub) AS INT) AS place, type, act_or_case, section_or_citation, CAST(score AS INT) AS score FROM d""",
)
def _structured(t):
    return c.structured_citations(t.found_sources, t.lookups)
