"""Queries of the text functions over the legal corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as x
from quillon.plans.registry import query

def _alt(patterns):
    """SQL of the first non-empty match."""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 0), '')" for p in patterns) + ", '')"


def _per_doc(name, columns, sql):
    query(name, f"SELECT doc_id, {sql}" + ("" if " FROM legal" in sql else " FROM legal"))(lambda t: t.legal.select("doc_id", *[c.alias(n) for n, c in columns().items()]))


query("t01_section_number", r"""WITH v AS (SELECT row_idx, system, regexp_replace(trim(regexp_replace(coalesce(section1, ''), '\s+', ' ', 'g')), '(?i)^(section|sec\.?|article|art\.?)\s+', '') AS v FROM responses)
SELECT row_idx, system, coalesce(nullif(regexp_extract(v, '(?i)^([0-9]+[A-Z]?(?:\([0-9A-Za-z]+\))?(?:-[0-9A-Za-z]+)?)', 1), ''), nullif(regexp_replace(v, '[^0-9A-Za-z()\-]+', '', 'g'), ''), 'unknown') AS section_number FROM v""")(lambda t: t.responses.select("row_idx", "system", x.section_number(F.coalesce("section1", F.lit(""))).alias("section_number")))
query("t02_section_token", r"""SELECT row_idx, system, trim(regexp_replace(trim(regexp_replace(trim(section1), '(?i)^section\s*', '')), '(?i)^sec\.?\s*', '')) AS token FROM responses""")(lambda t: t.responses.select("row_idx", "system", x.section_token(F.col("section1")).alias("token")))
query("t03_whole_number", r"""SELECT row_idx, CASE WHEN regexp_matches(s, '^\d+\.0$') THEN regexp_replace(s, '\.0$', '') ELSE s END AS section FROM (SELECT row_idx, correct_section || CASE WHEN row_idx % 2 = 0 THEN '.0' ELSE '' END AS s FROM ground_truth)""")(lambda t: t.ground_truth.select("row_idx", x.whole_number(F.concat("correct_section", F.when(F.col("row_idx") % 2 == 0, ".0").otherwise(""))).alias("section")))
_per_doc("t04_match_normalise", lambda: {"norm": x.for_match(F.col("text"))}, r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm")
_SHORT = "CASE id % 4 WHEN 0 THEN 'IPC' WHEN 1 THEN 'BNS' WHEN 2 THEN 'BNSS' ELSE 'ICA' END"
_HINTS = f"""WITH b AS (SELECT id, act_name, section_title, full_text, {_SHORT} AS short, trim(regexp_replace(regexp_replace(lower(act_name), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS base FROM bare_acts),
h AS (SELECT *, list_concat(list_concat(list_filter(string_split(base, ' '), lambda w: length(w) >= 3 AND w NOT IN ('the', 'of', 'and', 'act', 'code', 'india', 'indian', 'from', 'law', 'rules', 'rule', 'section', 'sanhita', 'adhiniyam')), regexp_extract_all(base, '\\b(18\\d{{2}}|19\\d{{2}}|20\\d{{2}})\\b', 1)), CASE short WHEN 'BNS' THEN ['nyaya'] WHEN 'BNSS' THEN ['nagarik', 'suraksha'] WHEN 'ICA' THEN ['contract'] ELSE [] END) AS all_hints FROM b),
d AS (SELECT *, list_filter(all_hints, lambda w, i: list_position(all_hints, w) = i) AS hints FROM h)"""
_short = lambda: F.when(F.col("id") % 4 == 0, "IPC").when(F.col("id") % 4 == 1, "BNS").when(F.col("id") % 4 == 2, "BNSS").otherwise("ICA")
query("t05_act_hints", _HINTS + " SELECT id, array_to_string(hints, ' ') AS hints FROM d")(lambda t: t.bare_acts.select("id", F.array_join(x.act_hints(F.col("act_name"), _short()), " ").alias("hints")))
query("t06_search_score", _HINTS + r""", n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(act_name || ' ' || section_title || CASE WHEN id % 5 = 0 THEN ' vs State' ELSE '' END), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM d)
SELECT id, CAST(len(list_filter(hints, lambda w: contains(norm, w))) * 10 - CASE WHEN contains(' ' || norm || ' ', ' vs ') OR contains(' ' || norm || ' ', ' high court ') OR contains(' ' || norm || ' ', ' supreme court ') THEN 30 ELSE 0 END
+ CASE WHEN contains(' ' || norm || ' ', ' act ') OR contains(' ' || norm || ' ', ' code ') OR contains(' ' || norm || ' ', ' constitution ') THEN 8 ELSE 0 END
+ CASE WHEN (short = 'BNS' AND contains(norm, 'nyaya') AND NOT contains(norm, 'nagarik')) OR (short = 'BNSS' AND contains(norm, 'nagarik') AND contains(norm, 'suraksha')) THEN 25 ELSE 0 END AS INT) AS score FROM n""")(lambda t: t.bare_acts.select("id", x.search_score(F.concat("act_name", F.lit(" "), "section_title", F.when(F.col("id") % 5 == 0, " vs State").otherwise("")), F.col("act_name"), _short()).alias("score")))
_per_doc("t14_punishment", lambda: {"punishment": x.punishment(F.col("text"))}, r"coalesce(nullif(regexp_extract(substr(text, 1, 1000), '(?i)shall be punished with [^.]+', 0), ''), nullif(regexp_extract(substr(text, 1, 1000), '(?i)punishable with [^.]+', 0), ''), nullif(regexp_extract(substr(text, 1, 1000), '(?i)shall be liable to [^.]+', 0), ''), '') AS punishment")
_per_doc("t16_embedding_text", lambda: {"embedding_text": F.concat_ws(" ", F.nullif("source", F.lit("src0")), F.nullif("lang", F.lit("")), F.col("text"))}, "concat_ws(' ', nullif(source, 'src0'), nullif(lang, ''), text) AS embedding_text")
query("t18_word_chunks", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM legal)
SELECT doc_id, CAST(s / 500 AS INT) AS chunk, array_to_string(w[s + 1 : s + 600], ' ') AS chunk_text FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 500)) AS s FROM w)""")(lambda t: t.legal.select("doc_id", F.posexplode(x.chunks(F.col("text"), 600, 100)).alias("chunk", "chunk_text")))
query("t19_token_chunks", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM legal)
SELECT doc_id, CAST(s / 450 AS INT) AS chunk, array_to_string(w[s + 1 : s + 500], ' ') AS chunk_text FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 450)) AS s FROM w)""")(lambda t: t.legal.select("doc_id", F.posexplode(x.chunks(F.col("text"), 500, 50)).alias("chunk", "chunk_text")))
_per_doc("t20_token_estimate", lambda: {"n_tokens": x.token_estimate(F.col("text"))}, r"CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 0.75) AS BIGINT) AS n_tokens")
_per_doc("t22_clean_scraped", lambda: {"clean": x.clean_scraped(F.col("text"))}, r"""trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,;:()\-''"/\[\]]', '', 'g')) AS clean""")
_per_doc("t23_clean_document", lambda: {"clean": x.clean_document(F.col("text"))}, r"trim(replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '(?i)Page \d+ of \d+', '', 'g'), chr(13) || chr(10), chr(10))) AS clean")
_per_doc("t24_acts_as_written", lambda: {"acts": F.array_join(x.acts_as_written(F.col("text")), "|")}, "array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(text, '(?i)({p})', 1)" for p in x.ACTS_19) + "]))), '|') AS acts")
_per_doc("t25_acts_present", lambda: {"acts": F.array_join(x.acts_present(F.col("text")), "|")}, "array_to_string(list_sort(list_filter([" + ", ".join(f"'{p}'" for p in x.ACTS_16) + "], lambda n: contains(lower(text), lower(n)))), '|') AS acts")
_per_doc("t26_acts_sorted", lambda: {"acts": F.array_join(x.acts_present(F.col("text"), x.ACTS_11), "|")}, "array_to_string(list_sort(list_filter([" + ", ".join(f"'{p}'" for p in x.ACTS_11) + "], lambda n: contains(lower(text), lower(n)))), '|') AS acts")
_per_doc("t27_sections", lambda: {"sections": F.array_join(x.sections_all(F.col("text")), "|")}, r"array_to_string(list_sort(list_distinct(flatten([regexp_extract_all(text, '(?i)Section\s+(\d+[A-Z]*)', 1), regexp_extract_all(text, '(?i)Sec\.\s+(\d+[A-Z]*)', 1), regexp_extract_all(text, '(?i)S\.\s+(\d+[A-Z]*)', 1)]))), '|') AS sections")
_per_doc("t28_sections_short", lambda: {"sections": F.array_join(x.sections_short(F.col("text")), "|")}, r"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[Ss]ection|[Ss]ec\.|[Ss]\.\s+(\d+[A-Z]?)', 1), lambda s: s <> ''))), '|') AS sections")
_per_doc("t29_citation_loose", lambda: {"citation": x.first_match(F.col("text"), x.CITATIONS_LOOSE, "(?i)")}, _alt(["(?i)" + p for p in x.CITATIONS_LOOSE]) + " AS citation")
_per_doc("t29_citation_strict", lambda: {"citation": x.first_match(F.col("text"), x.CITATIONS_STRICT)}, _alt(x.CITATIONS_STRICT) + " AS citation")
_per_doc("t30_year", lambda: {"year": x.year(F.col("text"))}, r"regexp_extract(text, '\b(19[5-9]\d|20[0-2]\d)\b', 1) AS year")
_per_doc("t31_court", lambda: {"court": x.court(F.col("text"))}, "CASE WHEN contains(lower(text), 'supreme court') THEN 'Supreme Court of India' " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in x.COURTS.items()) + " ELSE 'Unknown Court' END AS court")
_per_doc("t32_hash_ids", lambda: {"id10": F.substring(F.md5("text"), 1, 10), "id12": F.substring(F.md5("text"), 1, 12), "id16": F.substring(F.sha2("text", 256), 1, 16)}, "substr(md5(text), 1, 10) AS id10, substr(md5(text), 1, 12) AS id12, substr(sha256(text), 1, 16) AS id16")
_per_doc("t36_bm25_tokens", lambda: {"n": F.size(x.bm25_tokens(F.col("text"))), "tokens": F.md5(F.array_join(x.bm25_tokens(F.col("text")), " "))}, r"CAST(len(k) AS INT) AS n, md5(array_to_string(k, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), 'section\s+(\d+[a-z]?)', 'section_\1', 'g'), 'sec\.\s+(\d+[a-z]?)', 'section_\1', 'g'), '[\p{L}\p{N}_]+') AS k FROM legal)")
query("t36_bm25_tokens_of_queries", r"""SELECT query_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(lower(query_text), 'section\s+(\d+[a-z]?)', 'section_\1', 'g'), 'sec\.\s+(\d+[a-z]?)', 'section_\1', 'g'), '[\p{L}\p{N}_]+'), ' ') AS tokens FROM queries""")(lambda t: t.queries.select("query_id", F.array_join(x.bm25_tokens(F.col("query_text")), " ").alias("tokens")))
query("t37_search_text", "SELECT id, concat_ws(' ', full_text, act_name, section_number, section_title, source, lang) AS search_text FROM bare_acts")(lambda t: t.bare_acts.select("id", F.concat_ws(" ", "full_text", "act_name", "section_number", "section_title", "source", "lang").alias("search_text")))
query("t38_query_pattern", r"""SELECT query_id, substr(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce(query_text, ''))), '\b(18|19|20)\d{2}\b', '<YEAR>', 'g'), '\b\d+[a-z]?\b', '<NUM>', 'g'), '\s+', ' ', 'g'), 1, 140) AS pattern FROM queries""")(lambda t: t.queries.select("query_id", x.query_pattern(F.col("query_text")).alias("pattern")))


def citation_sql(c: str) -> str:
    """The citation normaliser in DuckDB's SQL."""
    s = f"trim(coalesce({c}, ''))"
    for p, to in x.EXPANSIONS:
        s = f"regexp_replace({s}, '{p}', '{to}', 'g')"
    s = rf"regexp_replace({s}, '(?i)\bR\.\s*(\d)', 'Rule \1', 'g')"
    for p, to in x.ACT_EXPANSIONS:
        s = rf"regexp_replace({s}, '(?i)\b{p}\b', '{to}', 'g')"
    s = rf"regexp_replace({s}, '(?i)^(.*?\bACT\b(?:\s+\d{{4}})?)\s+(\d+[A-Z]?)$', '\1 Section \2')"
    s = rf"translate(regexp_replace({s}, '\b(19|20)\d{{2}}\b', '', 'g'), ':-', '  ')"
    s = rf"regexp_replace({s}, '(?i)\bSECTION\s*([0-9]+[A-Z]?(?:\([0-9A-Za-z]+\))?)', 'SECTION \1', 'g')"
    s = rf"regexp_replace({s}, '(?i)\bARTICLE\s*([0-9]+[A-Z]?)\b', 'ARTICLE \1', 'g')"
    return rf"upper(trim(regexp_replace({s}, '\s+', ' ', 'g')))"


query("t39_citation_normalise", f"SELECT row_idx, system, {citation_sql("act1 || ' ' || section1")} AS citation, {citation_sql('answer')} AS answer FROM responses")(lambda t: t.responses.select("row_idx", "system", x.citation(F.concat("act1", F.lit(" "), "section1")).alias("citation"), x.citation(F.col("answer")).alias("answer")))
_per_doc("t40_snippet", lambda: {"snippet": x.snippet(F.col("text"), 120)}, r"CASE WHEN length(s) > 120 THEN substr(s, 1, 120) || '...' ELSE s END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM legal)")
query("t42_slug", "SELECT DISTINCT act_name, regexp_replace(regexp_replace(lower(act_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM bare_acts")(lambda t: t.bare_acts.select("act_name", x.slug(F.col("act_name")).alias("slug")).distinct())
@query("t44_ground_truth_labels", r"""WITH m AS (SELECT query_id, query_text, regexp_extract(query_text, '(?i)Section\s+(\d+[A-Z]?(?:\([a-z]\))?)\s+(?:of\s+(?:the\s+)?)?(.+?(?:Act|IPC|BNS|CrPC|BNSS))', 1) AS s1, regexp_extract(query_text, '(?i)Section\s+(\d+[A-Z]?(?:\([a-z]\))?)\s+(?:of\s+(?:the\s+)?)?(.+?(?:Act|IPC|BNS|CrPC|BNSS))', 2) AS a1,
regexp_extract(query_text, '(?i)(IPC|BNS|CrPC|BNSS|NI Act)\s+(?:Section\s+)?(\d+[A-Z]?)', 1) AS a2, regexp_extract(query_text, '(?i)(IPC|BNS|CrPC|BNSS|NI Act)\s+(?:Section\s+)?(\d+[A-Z]?)', 2) AS s2 FROM queries)
SELECT query_id, CASE WHEN s1 <> '' THEN s1 WHEN s2 <> '' THEN s2 ELSE '' END AS section, CASE WHEN s1 <> '' THEN CASE WHEN contains(lower(a1), 'negotiable') THEN 'NI ACT' WHEN contains(lower(a1), 'evidence') THEN 'EVIDENCE ACT' WHEN contains(lower(a1), 'companies') THEN 'COMPANIES ACT' WHEN contains(lower(a1), 'information technology') OR contains(a1, 'IT Act') THEN 'IT ACT'
WHEN contains(lower(a1), 'arbitration') THEN 'ARBITRATION ACT' WHEN contains(lower(a1), 'ipc') OR contains(lower(a1), 'indian penal') THEN 'IPC' WHEN contains(lower(a1), 'bns') OR contains(lower(a1), 'bharatiya nyaya') THEN 'BNS' WHEN contains(lower(a1), 'crpc') OR contains(lower(a1), 'criminal procedure') THEN 'CRPC' ELSE upper(trim(a1)) END ELSE upper(a2) END AS act FROM m""")
def _labels(t):
    q, p1, p2 = F.col("query_text"), r"(?i)Section\s+(\d+[A-Z]?(?:\([a-z]\))?)\s+(?:of\s+(?:the\s+)?)?(.+?(?:Act|IPC|BNS|CrPC|BNSS))", r"(?i)(IPC|BNS|CrPC|BNSS|NI Act)\s+(?:Section\s+)?(\d+[A-Z]?)"
    s1, a1, a2, s2 = (F.regexp_extract(q, p, i) for p, i in ((p1, 1), (p1, 2), (p2, 1), (p2, 2)))
    return t.queries.select("query_id", F.when(s1 != "", s1).otherwise(s2).alias("section"), F.when(s1 != "", x.act_label(F.trim(a1))).otherwise(F.upper(a2)).alias("act"))
