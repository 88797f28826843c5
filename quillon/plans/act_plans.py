"""From fetched pages to sections of acts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import acts as a
from quillon.plans.registry import query
from quillon.plans.text_plans import _HINTS, _short

_strip = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_norm = lambda c: rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_ACT_HINTS = _HINTS.replace("FROM bare_acts", "FROM act_texts")
_short_of = lambda c: F.when(F.col(c) % 4 == 0, "IPC").when(F.col(c) % 4 == 1, "BNS").when(F.col(c) % 4 == 2, "BNSS").otherwise("ICA")

query(
    "t07_target_page",
    f"""{_ACT_HINTS}, n AS (SELECT *, {_norm("substr(full_text, 1, 6000)")} AS t FROM d)
SELECT id, length(t) >= 200 AND len(list_filter(hints, lambda w: contains(t, w))) >= CASE WHEN short IN ('BNS', 'BNSS', 'BSA') THEN 3 ELSE 2 END
AND NOT ((contains(' ' || t || ' ', ' vs ') AND contains(t, 'high court') OR contains(t, 'petitioner') OR contains(t, 'respondent')) AND NOT (contains(t, 'union of india act') OR contains(t, 'published in gazette') OR contains(t, 'act ') OR contains(t, 'code of ') OR contains(t, 'part i'))) AS valid FROM n""",
)(lambda t: t.act_texts.select("id", a.target_page(F.col("full_text"), F.col("act_name"), _short()).alias("valid")))

query(
    "t08_rank_candidates",
    f"""{_HINTS.replace("SELECT id, act_name, section_title, full_text", "SELECT doc_id AS id, pos, url, label, act_name").replace(" id % 4", " doc_id % 4").replace("FROM bare_acts", "FROM act_links WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, url ORDER BY pos) = 1")},
n AS (SELECT *, {_norm("label")} AS norm FROM d), s AS (SELECT id, pos, url, CASE WHEN norm = '' THEN -999 ELSE CAST(len(list_filter(hints, lambda w: contains(norm, w))) * 10 - CASE WHEN contains(' ' || norm || ' ', ' vs ') OR contains(' ' || norm || ' ', ' high court ') OR contains(' ' || norm || ' ', ' supreme court ') THEN 30 ELSE 0 END
+ CASE WHEN contains(' ' || norm || ' ', ' act ') OR contains(' ' || norm || ' ', ' code ') OR contains(' ' || norm || ' ', ' constitution ') THEN 8 ELSE 0 END
+ CASE WHEN (short = 'BNS' AND contains(norm, 'nyaya') AND NOT contains(norm, 'nagarik')) OR (short = 'BNSS' AND contains(norm, 'nagarik') AND contains(norm, 'suraksha')) THEN 25 ELSE 0 END AS INT) END AS score FROM n)
SELECT id AS doc_id, url, CAST(score AS INT) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INT) AS place FROM s QUALIFY place <= 8""",
)(lambda t: a.rank_candidates(t.act_links.withColumn("short", _short_of("doc_id")), "doc_id", "act_name", "short", "pos", "url", "label").select("doc_id", "url", "score", "place"))

_NUMBER = lambda c: rf"coalesce(nullif(regexp_extract(regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '(?i)^(section|sec\.?|article|art\.?)\s+', ''), '(?i)^([0-9]+[A-Z]?(?:\([0-9A-Za-z]+\))?(?:-[0-9A-Za-z]+)?)', 1), ''), nullif(regexp_replace({c}, '[^0-9A-Za-z()\-]+', '', 'g'), ''), 'unknown')"
_first = lambda c, patterns, g: "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '(?i){p}', {g}), '')" for p in patterns) + ", '')"
query(
    "t09_parse_section",
    rf"""WITH n AS (SELECT id, full_text AS t, {_first("substr(full_text, 1, 200)", a.ONE_SECTION, 1)} AS num FROM act_texts)
SELECT id, {_NUMBER("num")} AS number, regexp_replace(CASE WHEN regexp_extract(substr(t, 1, 300), '(?i){a.ONE_TITLE}', 0) <> '' THEN {_strip(f"regexp_extract(substr(t, 1, 300), '(?i){a.ONE_TITLE}', 1)")} ELSE {_strip("substr(t, 1, 100)")} END, '\s+', ' ', 'g') AS title,
nullif({_strip(_first("t", a.PUNISHMENT_OF_ONE, 0))}, '') AS punishment FROM n""",
)(lambda t: t.act_texts.select("id", *[c.alias(n) for n, c in a.one_section(F.col("full_text")).items()]))


def _spans(name: str, of: str, pattern: str, groups: int) -> str:
    """Rows (id, t, i, start, stop, g1, …) of a pattern's matches in ``of`` (id, t), in DuckDB."""
    every = ", ".join(f"regexp_extract_all(t, '{pattern}', {g}) AS g{g}" for g in range(groups + 1))
    each = ", ".join(f"g{g}[i] AS g{g}" for g in range(1, groups + 1))
    start = "CAST(list_sum(list_transform(piece[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(g0[1:i-1], lambda x: len(x))), 0) AS BIGINT)"
    return f"{name} AS (SELECT id, t, i, len(g0) AS n, {start} AS start, {start} + len(g0[i]) AS stop, {each} FROM (SELECT *, unnest(generate_series(1, len(g0))) AS i FROM (SELECT id, t, {every}, string_split_regex(t, '{pattern}') AS piece FROM {of})))"


_SPLIT = rf"""c AS (SELECT id, regexp_replace(regexp_replace(full_text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g') AS t FROM act_texts),
{_spans("named", "c", "(?im)" + a.NAMED_HEADING, 2)}, {_spans("bare", "c", "(?im)" + a.BARE_HEADING, 2)},
best AS (SELECT *, count(*) FILTER (way = 1) OVER (PARTITION BY id) AS n1, count(*) FILTER (way = 2) OVER (PARTITION BY id) AS n2 FROM (SELECT *, 1 AS way FROM named UNION ALL SELECT *, 2 FROM bare)),
used AS (SELECT *, lead(start, 1, len(t)) OVER (PARTITION BY id ORDER BY i) AS until FROM best WHERE CASE WHEN n2 > n1 THEN way = 2 ELSE way = 1 END AND greatest(n1, n2) >= 3),
split AS (SELECT id, CAST(i - 1 AS INT) AS idx, {_NUMBER("g1")} AS number, {_strip("g2")} AS heading, {_strip("substr(t, stop + 1, until - stop)")} AS body FROM used),
sections AS (SELECT id, idx, number, heading, CASE WHEN heading = '' THEN body ELSE {_strip("heading || chr(10) || body")} END AS section_text FROM split)"""
query("t10_split_act", f"WITH {_SPLIT} SELECT id, idx, number, heading, section_text FROM sections")(lambda t: a.split_act(t.act_texts, "id", "full_text"))

_by = lambda *c: f"OVER (PARTITION BY {', '.join(('id', *c))} ORDER BY idx)"
query(
    "t11_section_cleanup",
    rf"""WITH {_SPLIT}, s1 AS (SELECT * FROM sections WHERE number <> '' AND len(section_text) >= 30 QUALIFY row_number() {_by("number")} <= 2),
s2 AS (SELECT id, idx, number, CASE WHEN len(section_text) > 3000 THEN substr(section_text, 1, 3000) || '...' ELSE section_text END AS section_text FROM s1),
s3 AS (SELECT *, {_strip("string_split(section_text, chr(10))[1]")} AS line FROM s2),
s4 AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN line = '' THEN 'Section ' || number ELSE substr(line, 1, 200) END, '^\d+[\.:\-–—\s]+', ''), '\s+', ' ', 'g') AS title FROM s3),
s5 AS (SELECT *, lower({_strip(r"regexp_replace(substr(section_text, 1, 220), '\s+', ' ', 'g')")}) AS begin_ FROM s4 WHERE NOT (len(section_text) < 120 AND regexp_matches({_strip("title")}, '(?i)^(part|chapter|schedule)\b'))),
s6 AS (SELECT * FROM s5 QUALIFY row_number() {_by("number", "begin_")} = 1), s7 AS (SELECT s6.*, expected, row_number() {_by()} AS k FROM s6 JOIN act_texts USING (id))
SELECT id, idx, number, title, section_text, nullif({_strip(_first("substr(section_text, 1, 1000)", a.PUNISHMENT_OF_SECTION, 0))}, '') AS punishment FROM s7 WHERE k <= ceil(expected * 1.2)""",
)(lambda t: a.clean_sections(a.split_act(t.act_texts, "id", "full_text"), t.act_texts, "id"))

query(
    "t12_numbered_split",
    rf"""WITH c AS (SELECT id, regexp_replace(replace(full_text, chr(10) || chr(10) || chr(10), chr(10) || chr(10)), ' +', ' ', 'g') AS t FROM act_texts), {_spans("m", "c", a.NUMBERED, 1)},
u AS (SELECT id, CAST(i - 1 AS INT) AS pos, g1 AS number, {_strip("substr(t, stop + 1, lead(start, 1, len(t)) OVER (PARTITION BY id ORDER BY i) - stop)")} AS body FROM m WHERE 2 * n + 1 > 20),
l AS (SELECT *, {_strip("string_split(body, chr(10))[1]")} AS line FROM u WHERE len(body) >= 50)
SELECT *, nullif({_strip(_first("substr(body, 1, 1000)", a.PUNISHMENT_OF_SECTION, 0))}, '') AS punishment FROM (SELECT id, pos, number, CASE WHEN len(line) > 150 THEN substr(line, 1, 147) || '...' ELSE line END AS title, CASE WHEN len(body) > 3000 THEN substr(body, 1, 3000) || '...' ELSE body END AS body FROM l)""",
)(lambda t: a.numbered_sections(t.act_texts, "id", "full_text"))
