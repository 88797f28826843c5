"""The input tables, and reference-shaped tables that are made from them.

Each adapter is one SELECT in the dialect that Spark and DuckDB share, so that
an operator and its oracle see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_K = "CAST(replace(replace(props, '{\"k\": ', ''), '}', '') AS INT)"

_ACT = "CASE doc_id % 4 WHEN 0 THEN 'Indian Penal Code 1860' WHEN 1 THEN 'Bharatiya Nyaya Sanhita 2023' WHEN 2 THEN 'Bharatiya Nagarik Suraksha Sanhita 2023' ELSE 'Indian Contract Act 1872' END"
_LINES = lambda *parts: " || chr(10) || ".join(parts)

ADAPTERS: dict[str, str] = {
    # telemetry
    "queries": """SELECT event_id AS query_id, event_type AS query_type, ts AS timestamp, user_id AS session_id,
        CASE event_id % 10 WHEN 0 THEN 'What is Section ' || CAST(300 + event_id % 40 AS STRING) || ' of IPC?' WHEN 1 THEN 'what is the punishment for theft'
        WHEN 2 THEN 'What is the Punishment for theft' WHEN 3 THEN 'Has Section 66A of the IT Act been amended in 2015?' WHEN 4 THEN 'Explain BNSS Section 35 and CrPC Section 41'
        WHEN 5 THEN 'Cases decided on bail' WHEN 6 THEN 'AIR 1978 SC 597' WHEN 7 THEN 'Compare the old and new evidence law' WHEN 8 THEN '' ELSE 'Is consideration needed for contract ' || CAST(event_id % 7 AS STRING) || '?' END AS query_text
        FROM events""",
    "responses_log": f"""SELECT event_id * 2 AS response_id, CASE WHEN event_id % 7 = 0 THEN -1 - event_id ELSE event_id END AS query_id, event_type AS query_type, value * 25 AS response_time_ms,
        CASE WHEN value < 15 THEN 'LOW' WHEN value < 50 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, {_K} % 8 AS sources_count, {_K} % 4 AS bare_acts_retrieved,
        {_K} % 3 AS case_laws_retrieved, {_K} % 2 AS amendments_retrieved, event_id % 9 = 0 AS trigger_uncertainty, ts AS timestamp FROM events
        UNION ALL SELECT event_id * 2 + 1, event_id, event_type, value * 30, 'MEDIUM', 3, 1, 1, 1, false, ts FROM events WHERE event_id % 5 = 0""",
    "feedback": """SELECT doc_id AS feedback_id, doc_id AS query_id, doc_id * 2 AS response_id, CAST(1 + (doc_id * 7 + quality) % 5 AS INT) AS rating, quality = 1 AS helpful, toxic = 0 AS accurate FROM labels""",
    # corpus
    "legal": """SELECT doc_id, lang, source, n_chars, CASE doc_id % 12
        WHEN 0 THEN 'Under Section ' || CAST(300 + doc_id % 200 AS STRING) || ' of the Indian Penal Code the accused shall be punished with imprisonment for seven years. Supreme Court, 1998. AIR 1978 SC ' || CAST(doc_id % 900 AS STRING) || '.'
        WHEN 1 THEN 'The Delhi High Court held, in (2014) 9 SCC ' || CAST(doc_id % 800 AS STRING) || ', that S. 34 and Sec. 120B of IPC apply.'
        WHEN 2 THEN 'Code of Criminal Procedure, section 41A(1); CrPC s. 438. Page 3 of 12  Bail   was granted.'
        WHEN 3 THEN 'Bharatiya Nyaya Sanhita Section 103 replaces Section 302 IPC from 2024.'
        WHEN 4 THEN 'The Negotiable Instruments Act, Sec. 138, and the Companies Act; 2009 (4) SCC 12. Bombay.'
        WHEN 5 THEN 'Whoever commits theft shall be liable to fine which may extend to Rs. 5000. Constitution of India, Article 21.'
        WHEN 6 THEN 'BNSS Section 35 (formerly CrPC Section 41) was amended in 2023. JT 2001 (3) SC 45'
        WHEN 7 THEN 'The Indian Evidence Act is now the Bharatiya Sakshya Adhiniyam; Evidence Act section 65B.'
        WHEN 8 THEN 'Hindu Marriage Act 1955 S. 13 divorce. Madras High Court 1962.'
        WHEN 9 THEN 'No statute is named here; the parties compare their old and new terms.'
        WHEN 10 THEN 'POCSO and the Information Technology Act, Section 66A, were cited. PAGE 1 OF 10'
        ELSE 'section 420.0 420 420A x' END || ' ' || coalesce(text, '') AS text FROM documents""",
    "bare_acts": """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'Indian Penal Code 1860' WHEN 1 THEN 'Bharatiya Nyaya Sanhita 2023' WHEN 2 THEN 'Code of Criminal Procedure 1973' ELSE 'Negotiable Instruments Act 1881' END AS act_name,
        CAST(CASE WHEN doc_id % 37 = 8 THEN 908 ELSE 300 + doc_id % 37 END AS STRING) AS section_number, source, lang, n_chars, CASE doc_id % 23 WHEN 1 THEN 'Punishment for theft' WHEN 2 THEN 'Dishonestly inducing delivery of property' WHEN 3 THEN 'Definition of electronic evidence'
        WHEN 4 THEN 'Anticipatory bail and arrest without trial' WHEN 5 THEN 'Criminal breach of trust by public servant' WHEN 6 THEN 'Agreement in restraint of marriage' WHEN 7 THEN 'Culpable homicide; dowry death. ' WHEN 8 THEN 'Insolvency  of  company director' ELSE 'Offence ' || CAST(doc_id % 11 AS STRING) END AS section_title, text AS full_text, doc_id % 3 = 0 AS is_replaced FROM documents""",
    "case_law": """SELECT doc_id AS case_id, 'AIR ' || CAST(1950 + doc_id % 70 AS STRING) || ' SC ' || CAST(doc_id % 50 AS STRING) AS citation, 1950 + doc_id % 70 AS year, source AS court, lang, n_chars, text AS chunk_text FROM documents""",
    "amendments": """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Indian Penal Code 1860' WHEN 1 THEN 'Bharatiya Nyaya Sanhita 2023' WHEN 2 THEN 'Code of Criminal Procedure 1973' ELSE 'Companies Act 2013' END AS act_name,
        CAST(CASE WHEN event_id % 10 = 3 THEN 300 + event_id % 41 ELSE 1000 + event_id END AS STRING) AS section_number, 1990 + event_id % 34 AS amendment_year, event_type AS importance FROM events""",
    "overruling_map": """SELECT event_id AS id, CASE WHEN event_id % 6 = 1 THEN 'AIR ' || CAST(1950 + event_id % 70 AS STRING) || ' SC ' || CAST(event_id % 50 AS STRING) ELSE 'SCR ' || CAST(event_id AS STRING) END AS overruled_citation, '(2018) 5 SCC ' || CAST(event_id AS STRING) AS overruled_by_citation,
        2000 + event_id % 24 AS year_overruled, event_type AS legal_area FROM events""",
    # evaluation
    "ground_truth": """SELECT doc_id AS row_idx, 'Q' || CAST(doc_id AS STRING) AS query_id, lang AS domain,
        CASE doc_id % 5 WHEN 0 THEN 'Section Lookup' WHEN 1 THEN 'Case Law Search' WHEN 2 THEN 'BNS Transition' WHEN 3 THEN 'Amendment Query' ELSE 'Multi-hop' END AS category,
        'Question ' || CAST(doc_id % 400 AS STRING) || ' on Section ' || CAST(300 + doc_id % 20 AS STRING) AS query_text,
        CASE doc_id % 6 WHEN 0 THEN 'IPC' WHEN 1 THEN 'BNS' WHEN 2 THEN 'CrPC' WHEN 3 THEN 'NI Act' WHEN 4 THEN '' ELSE 'Companies Act' END AS correct_act,
        CASE WHEN doc_id % 6 = 4 THEN '' ELSE CAST(300 + doc_id % 20 AS STRING) END AS correct_section,
        CASE WHEN doc_id % 9 = 5 THEN 'AIR 1978 SC ' || CAST(doc_id % 30 AS STRING) ELSE '' END AS correct_citation,
        'the offence of theft carries imprisonment for three years or fine or both case ' || CAST(doc_id % 13 AS STRING) AS summary,
        CASE WHEN doc_id % 4 = 1 THEN 'yes' ELSE 'no' END AS amendment_applies, CASE WHEN doc_id % 3 = 1 THEN 'yes' ELSE 'no' END AS transition_applies,
        CASE WHEN doc_id % 7 = 2 THEN 'yes' ELSE '' END AS overruling_applies, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty_level FROM documents""",
    "responses": """SELECT s.system, d.doc_id AS row_idx, 'Q' || CAST(d.doc_id AS STRING) AS query_id, 'Question ' || CAST(d.doc_id % 400 AS STRING) || ' on Section ' || CAST(300 + d.doc_id % 20 AS STRING) AS query,
        CASE (d.doc_id + s.n) % 7 WHEN 0 THEN 'Under Section ' || CAST(300 + d.doc_id % 20 AS STRING) || ' IPC the offence of theft carries imprisonment for three years or fine.'
        WHEN 1 THEN 'Section ' || CAST(301 + d.doc_id % 20 AS STRING) || ' of the CrPC was replaced by BNSS in July 2024 and amended in 2019.'
        WHEN 2 THEN 'I could not find a reliable source; please consult primary sources.' WHEN 3 THEN 'BNS, formerly IPC, sec ' || CAST(300 + d.doc_id % 20 AS STRING) || '. The earlier case was overruled.'
        WHEN 4 THEN 'The Evidence Act applies.' WHEN 5 THEN '' ELSE 'NI Act section ' || CAST(300 + d.doc_id % 20 AS STRING) || ': imprisonment or fine or both.' END AS answer,
        CASE (d.doc_id * 3 + s.n) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'HIGH' END AS confidence,
        CASE WHEN (d.doc_id + s.n) % 5 = 4 THEN NULL WHEN (d.doc_id + s.n) % 3 = 0 THEN 'case_law' ELSE 'bare_act' END AS type1,
        CASE (d.doc_id + s.n) % 5 WHEN 0 THEN 'Indian Penal Code' WHEN 1 THEN 'BNS' WHEN 2 THEN 'CrPC' WHEN 3 THEN 'NI Act' ELSE NULL END AS act1,
        CASE WHEN (d.doc_id + s.n) % 5 = 4 THEN NULL WHEN (d.doc_id + s.n) % 3 = 0 THEN 'AIR 1978 SC ' || CAST(d.doc_id % 30 AS STRING) ELSE 'Section ' || CAST(300 + (d.doc_id + s.n) % 20 AS STRING) END AS section1,
        CASE WHEN (d.doc_id + s.n) % 4 = 1 THEN CASE d.doc_id % 10 WHEN 1 THEN 'POCSO Act' WHEN 2 THEN 'Hindu Marriage Act' WHEN 3 THEN 'SRA' WHEN 4 THEN 'TPA' WHEN 5 THEN 'PWDVA 2005' WHEN 6 THEN 'Arbitration and Conciliation' WHEN 7 THEN 'Consumer Protection Act' WHEN 8 THEN 'Land Act' WHEN 9 THEN 'BSA' ELSE 'Companies Act' END ELSE NULL END AS act2, CASE WHEN (d.doc_id + s.n) % 4 = 1 THEN CAST(300 + d.doc_id % 20 AS STRING) ELSE NULL END AS section2,
        CASE WHEN (d.doc_id + s.n) % 8 = 3 THEN 'IPC was replaced' ELSE '' END AS transition_note, (d.doc_id + s.n) % 11 = 0 AS trigger_uncertainty, CAST((d.doc_id + s.n) % 40 AS DOUBLE) / 10 AS seconds
        FROM documents d CROSS JOIN (SELECT 'full' AS system, 0 AS n UNION ALL SELECT 'simple', 1 UNION ALL SELECT 'none', 2) s""",
    "scores": """SELECT d.doc_id AS row_idx, 'Q' || CAST(d.doc_id AS STRING) AS query_id, s.system, CASE d.doc_id % 4 WHEN 0 THEN 'criminal' WHEN 1 THEN 'civil' WHEN 2 THEN 'corporate' ELSE 'family' END AS category,
        CASE d.doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, CAST((d.doc_id * 7 + s.n * 3) % 11 AS DOUBLE) / 10 AS car, CAST((d.doc_id * 5 + s.n * 13) % 17 AS DOUBLE) / 16 AS hr, (d.doc_id + s.n * 29) % 101 AS acs,
        CASE WHEN (d.doc_id + s.n) % 6 = 0 THEN 1 ELSE 0 END AS abstained, CASE (d.doc_id + s.n * 2) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, (d.doc_id * 3 + s.n) % 2 AS correct
        FROM documents d CROSS JOIN (SELECT 'full' AS system, 0 AS n UNION ALL SELECT 'simple', 1 UNION ALL SELECT 'none', 2) s""",
    "asked": """SELECT doc_id AS row_idx, CASE doc_id % 19 WHEN 0 THEN 'What does Section ' || CAST(doc_id % 500 AS STRING) || ' say?' WHEN 1 THEN 'Explain Section ' || CAST(doc_id % 500 AS STRING) || ' of the Indian Penal Code' WHEN 2 THEN 'What is Section ' || CAST(doc_id % 500 AS STRING) || '?'
        WHEN 3 THEN 'Show me Section ' || CAST(doc_id % 500 AS STRING) WHEN 4 THEN 'Section 9: What does Section 9 cover?' WHEN 5 THEN 'What is the punishment for theft?' WHEN 6 THEN 'What is the sentence for fraud?' WHEN 7 THEN 'How many years imprisonment for forgery?'
        WHEN 8 THEN 'How long can you be jailed for perjury?' WHEN 9 THEN 'Has AIR 1950 SC 27 been overruled?' WHEN 10 THEN 'What happened to the Negotiable Instruments Act?' WHEN 11 THEN 'What changed in the Code of Criminal Procedure?' WHEN 12 THEN 'Are there new provisions for bail?'
        WHEN 13 THEN 'What are the legal requirements for a will?' WHEN 14 THEN 'What are the ingredients of cheating?' WHEN 15 THEN '  Is consent needed?  ' WHEN 16 THEN '' WHEN 17 THEN 'What is Section 5 of the Indian Penal Code?' ELSE 'bail in ' || lang END AS query_text FROM documents""",
    "cited_answers": """SELECT doc_id AS row_idx, CASE doc_id % 12 WHEN 0 THEN 'Under Section ' || CAST(300 + doc_id % 60 AS STRING) || ' of Indian Penal Code 1860 theft is punished; not so Section 300 of Indian Penal Code 1860.'
        WHEN 1 THEN 'Negotiable Instruments Act 1881, Section ' || CAST(300 + doc_id % 45 AS STRING) || '. Negotiable Instruments Act 1881 Section 138 is about cheques' WHEN 2 THEN 'see Section 5 of Indian Penal Code 1860, Section 302 of Evidence Act 1872.'
        WHEN 3 THEN 'section 420A of negotiable instruments act 1881; SECTION 301 OF INDIAN PENAL CODE 1860' WHEN 4 THEN 'Section 999 of Companies Act 2013, Section 999 of Companies Act 2013, and once more Section 999 of Companies Act 2013.' WHEN 5 THEN '' WHEN 6 THEN NULL
        WHEN 7 THEN 'Nothing is cited but Section 302 of the Code.' WHEN 8 THEN 'Section 303 of' || chr(10) || 'Indian Penal Code 1860' || chr(10) || 'Indian Penal Code 1860, Section 304A' WHEN 9 THEN 'é Section 12b of Land Act 1894, Section 308 of Indian Penal Code 1860. Stamp Act 1899, Section 3; end'
        ELSE 'By Section ' || CAST(doc_id % 400 AS STRING) || ' of Indian Penal Code 1860 and Section ' || CAST(doc_id % 350 AS STRING) || ' of Negotiable Instruments Act 1881 it is void.' END || ' ' || substr(coalesce(text, ''), 1, 80) AS answer FROM documents""",
    "lookups": """SELECT doc_id AS row_idx, CASE doc_id % 14 WHEN 0 THEN 'What is Section ' || CAST(300 + doc_id % 37 AS STRING) || ' of IPC?' WHEN 1 THEN 'ipc ' || CAST(300 + doc_id % 37 AS STRING) || 'a punishment' WHEN 2 THEN 'धारा ' || CAST(300 + doc_id % 37 AS STRING) || ' भारतीय दंड संहिता'
        WHEN 3 THEN 'Negotiable Instruments Act and 138' WHEN 4 THEN 'sec. 35 of the Bharatiya Nagarik Suraksha Sanhita' WHEN 5 THEN 'BNS 103 or IPC 302' WHEN 6 THEN 'bail in 1998' WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN 'Is s. 13 of the Hindu Marriage Act in force'
        WHEN 10 THEN 'Arbitration Act, section ' || CAST(doc_id % 90 AS STRING) WHEN 11 THEN 'Does limitation act bar it' WHEN 12 THEN 'Code of Criminal Procedure ' || CAST(300 + doc_id % 37 AS STRING) ELSE 'domestic violence act S 12' END AS query FROM documents""",
    "found_sources": """SELECT d.doc_id AS row_idx, s.n AS pos, CASE WHEN s.n >= 4 THEN 'case_law' ELSE 'bare_act' END AS type,
        CASE WHEN s.n >= 4 THEN CASE (d.doc_id + s.n) % 5 WHEN 0 THEN '' ELSE ' State v. Person ' || CAST((d.doc_id + s.n) % 6 AS STRING) END ELSE CASE (d.doc_id + s.n) % 6 WHEN 0 THEN 'Indian Penal Code 1860' WHEN 1 THEN 'code of criminal procedure' WHEN 2 THEN 'Negotiable Instruments Act 1881' WHEN 3 THEN ' Hindu Marriage Act ' WHEN 4 THEN 'Companies Act 2013' ELSE 'Arbitration and Conciliation Act 1996' END END AS name,
        CASE WHEN s.n >= 4 THEN CASE (d.doc_id + s.n) % 7 WHEN 0 THEN NULL ELSE 'AIR 1978 SC ' || CAST(d.doc_id % 9 AS STRING) END ELSE CASE (d.doc_id * 3 + s.n) % 8 WHEN 0 THEN '' WHEN 1 THEN 'section ' || CAST(300 + d.doc_id % 37 AS STRING) WHEN 2 THEN CAST(300 + d.doc_id % 37 AS STRING) || 'A' WHEN 3 THEN '13' WHEN 4 THEN '138.' ELSE CAST(300 + d.doc_id % 37 AS STRING) END END AS reference,
        CASE WHEN s.n < 4 AND (d.doc_id + s.n) % 9 = 2 THEN 'BNS Section ' || CAST(100 + d.doc_id % 50 AS STRING) WHEN s.n < 4 AND (d.doc_id + s.n) % 9 = 5 THEN 'bnss section ' || CAST(30 + d.doc_id % 9 AS STRING) WHEN (d.doc_id + s.n) % 9 = 7 THEN 'repealed' ELSE NULL END AS replaced_by
        FROM documents d CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) s""",
    "ratings": """SELECT doc_id AS query_id, e.evaluator, CAST((doc_id * 7 + e.n * doc_id % 3) % 5 AS INT) AS score FROM labels CROSS JOIN (SELECT 'a' AS evaluator, 1 AS n UNION ALL SELECT 'b', 2 UNION ALL SELECT 'c', 4) e""",
    "clauses": """SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'ARTICLE 1 TERMS' || chr(10) || 'The parties agree.' || chr(10) || '1.1 Scope' || chr(10) || 'Works described here.' || chr(10) || '2. Payment' || chr(10) || 'Fees are due.' || chr(10)
        WHEN 1 THEN '1. Definitions' || chr(10) || '2. Term' || chr(10) || 'One year.' || chr(10) || 'CONFIDENTIALITY' || chr(10) || 'Keep secrets.' || chr(10) WHEN 2 THEN 'Section 4 Liability' || chr(10) || 'Limited.' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents""",
    "act_texts": f"""SELECT doc_id AS id, {_ACT} AS act_name, source AS section_title, CAST(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 40 END AS INT) AS expected, CASE doc_id % 7
        WHEN 0 THEN {_ACT} || ': the petitioner vs State, High Court. ' || coalesce(text, '')
        WHEN 1 THEN {_LINES(_ACT + " || ' An Act of Parliament'", "'Section 1. Short title'", "substr(text, 1, 90)", "'  section 2 - Definitions'", "substr(text, 60, 400)", "'Section 2: Definitions'", "substr(text, 60, 400)", "'Section 2. Third'", "substr(text, 10, 300)", "'Sec. 3A) Chapter heads'", "'Chapter words, few but enough.'", "'Article 4'", "''", "substr(text, 1, 4000)", "'SECTION 5(2). 12: Numbers go'", "substr(text, 5, 200)")}
        WHEN 2 THEN {_LINES("'Preamble'", "'1. Alpha'", "substr(text, 1, 120)", "'2) Beta'", "substr(text, 20, 200)", "'3(1) - Gamma  of   spaces'", "substr(text, 1, 3500)", "'4. Part of nothing'", "'5. Part of nothing more than this'")}
        WHEN 3 THEN {_LINES("coalesce(source, '')", *(f"'{i}. ' || substr(text, {7 * i}, {30 * i})" for i in range(1, 13)))}
        WHEN 4 THEN {_LINES("'Section 1 Only'", "substr(text, 1, 200)", "'Section 2 Two'", "substr(text, 1, 200)")}
        WHEN 5 THEN 'Sec. ' || CAST(doc_id % 500 AS STRING) || 'B. Title of this' || chr(10) || ' one. Whoever does it shall be punished with fine and more. ' || substr(coalesce(text, ''), 1, 500)
        ELSE CASE doc_id % 2 WHEN 0 THEN '17. ' ELSE 'see 12A - ' END || coalesce(text, '') END AS full_text FROM documents""",
    "act_links": f"""SELECT d.doc_id, {_ACT} AS act_name, s.n AS pos, CASE WHEN (d.doc_id + s.n) % 13 = 4 THEN NULL ELSE 'https://example.org/doc/' || CAST((d.doc_id * 7 + s.n * s.n) % 23 AS STRING) END AS url,
        CASE (d.doc_id + s.n) % 8 WHEN 0 THEN ' The Indian Penal Code, 1860 ' WHEN 1 THEN 'Bharatiya Nyaya Sanhita, 2023' WHEN 2 THEN 'Section 302 in The Indian Penal Code' WHEN 3 THEN 'State vs Nobody on Penal Code' WHEN 4 THEN NULL WHEN 5 THEN 'Bharatiya Nagarik Suraksha Sanhita' WHEN 6 THEN 'The Indian Contract Act, 1872' ELSE d.source END AS label
        FROM documents d CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) s""",
    "risks": """SELECT doc_id, CAST(doc_id % 9 AS INT) AS clause_number, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS clause_type FROM documents""",
}


class Tables:
    """Input tables and adapters by name, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in ADAPTERS:
                sql = ADAPTERS[name]
                used = {t: getattr(self, t) for t in TABLES if re.search(rf"\bFROM {t}\b", sql)}
                for t in used:
                    sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
                self._made[name] = self.spark.sql(sql.replace('{"k": ', '{{"k": ').replace("'}'", "'}}'"), **used)
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def with_adapters(sql: str) -> str:
    """``sql`` after definitions of the adapters that it uses, for DuckDB."""
    used = [n for n in ADAPTERS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    made = ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in used)
    sql = sql.strip()
    if re.match(r"(?i)with\s+recursive\s", sql):
        return f"WITH RECURSIVE {made}, {re.sub(r'(?i)^with\s+recursive\s', '', sql)}"
    return f"WITH {made}, {sql[5:]}" if re.match(r"(?i)with\s", sql) else f"WITH {made}\n{sql}"
