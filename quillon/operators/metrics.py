"""Reliability metrics: row scores of responses joined with ground truth, then aggregates.

A response's citations are an array of structs (type, act, section); all systems
are scored in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as x
from quillon.operators.retrieval import checked, cosine
from quillon.sources.sinks import written

# Act names, their variants and word lists, in their order.
ACT_NAMES = {
    "IPC": "Indian Penal Code 1860", "INDIAN PENAL CODE": "Indian Penal Code 1860", "INDIAN PENAL CODE 1860": "Indian Penal Code 1860",
    "BNS": "Bharatiya Nyaya Sanhita 2023", "BHARATIYA NYAYA SANHITA": "Bharatiya Nyaya Sanhita 2023", "BHARATIYA NYAYA SANHITA 2023": "Bharatiya Nyaya Sanhita 2023",
    "CRPC": "Code of Criminal Procedure 1973", "CR.P.C": "Code of Criminal Procedure 1973", "CODE OF CRIMINAL PROCEDURE": "Code of Criminal Procedure 1973", "CODE OF CRIMINAL PROCEDURE 1973": "Code of Criminal Procedure 1973",
    "BNSS": "Bharatiya Nagarik Suraksha Sanhita 2023", "BHARATIYA NAGARIK SURAKSHA SANHITA": "Bharatiya Nagarik Suraksha Sanhita 2023", "BHARATIYA NAGARIK SURAKSHA SANHITA 2023": "Bharatiya Nagarik Suraksha Sanhita 2023",
    "NI ACT": "Negotiable Instruments Act 1881", "NEGOTIABLE INSTRUMENTS ACT": "Negotiable Instruments Act 1881", "NEGOTIABLE INSTRUMENTS ACT 1881": "Negotiable Instruments Act 1881",
    "IEA": "Indian Evidence Act 1872", "INDIAN EVIDENCE ACT": "Indian Evidence Act 1872", "INDIAN EVIDENCE ACT 1872": "Indian Evidence Act 1872", "EVIDENCE ACT": "Indian Evidence Act 1872",
    "BSA": "Bharatiya Sakshya Adhiniyam 2023", "BHARATIYA SAKSHYA ADHINIYAM": "Bharatiya Sakshya Adhiniyam 2023", "BHARATIYA SAKSHYA ADHINIYAM 2023": "Bharatiya Sakshya Adhiniyam 2023",
    "CPC": "Code of Civil Procedure 1908", "CODE OF CIVIL PROCEDURE": "Code of Civil Procedure 1908", "CODE OF CIVIL PROCEDURE 1908": "Code of Civil Procedure 1908",
    "COMPANIES ACT": "Companies Act 2013", "COMPANIES ACT 2013": "Companies Act 2013", "CONSUMER PROTECTION ACT": "Consumer Protection Act 2019", "CONSUMER PROTECTION ACT 2019": "Consumer Protection Act 2019",
    "HINDU MARRIAGE ACT": "Hindu Marriage Act 1955", "HINDU MARRIAGE ACT 1955": "Hindu Marriage Act 1955", "HMA": "Hindu Marriage Act 1955",
    "ARBITRATION AND CONCILIATION ACT": "Arbitration and Conciliation Act 1996", "ARBITRATION AND CONCILIATION ACT 1996": "Arbitration and Conciliation Act 1996", "ACA": "Arbitration and Conciliation Act 1996",
    "TRANSFER OF PROPERTY ACT": "Transfer of Property Act 1882", "TRANSFER OF PROPERTY ACT 1882": "Transfer of Property Act 1882", "TPA": "Transfer of Property Act 1882",
    "LIMITATION ACT": "Limitation Act 1963", "LIMITATION ACT 1963": "Limitation Act 1963", "LA": "Limitation Act 1963",
    "PWDVA": "Protection of Women from Domestic Violence Act 2005", "PROTECTION OF WOMEN FROM DOMESTIC VIOLENCE ACT": "Protection of Women from Domestic Violence Act 2005", "PROTECTION OF WOMEN FROM DOMESTIC VIOLENCE ACT 2005": "Protection of Women from Domestic Violence Act 2005",
    "POCSO": "Protection of Children from Sexual Offences Act 2012", "PROTECTION OF CHILDREN FROM SEXUAL OFFENCES ACT": "Protection of Children from Sexual Offences Act 2012", "PROTECTION OF CHILDREN FROM SEXUAL OFFENCES ACT 2012": "Protection of Children from Sexual Offences Act 2012",
    "SRA": "Specific Relief Act 1963", "SPECIFIC RELIEF ACT": "Specific Relief Act 1963", "SPECIFIC RELIEF ACT 1963": "Specific Relief Act 1963",
}
ACT_VARIANTS = {
    "IPC": ["IPC", "INDIAN PENAL CODE", "PENAL CODE"], "BNS": ["BNS", "BHARATIYA NYAYA SANHITA", "NYAYA SANHITA"], "CRPC": ["CRPC", "CR.P.C", "CODE OF CRIMINAL PROCEDURE", "CRIMINAL PROCEDURE CODE"],
    "BNSS": ["BNSS", "BHARATIYA NAGARIK SURAKSHA SANHITA"], "NI ACT": ["NI ACT", "NEGOTIABLE INSTRUMENTS ACT", "N.I. ACT"], "NIA": ["NIA", "NI ACT", "NEGOTIABLE INSTRUMENTS ACT", "N.I. ACT"],
    "COMPANIES ACT": ["COMPANIES ACT"], "EVIDENCE ACT": ["EVIDENCE ACT", "INDIAN EVIDENCE ACT"], "HMA": ["HMA", "HINDU MARRIAGE ACT"], "POCSO": ["POCSO", "PROTECTION OF CHILDREN FROM SEXUAL OFFENCES"],
    "PWDVA": ["PWDVA", "DOMESTIC VIOLENCE ACT", "PROTECTION OF WOMEN FROM DOMESTIC VIOLENCE"], "SRA": ["SRA", "SPECIFIC RELIEF ACT"], "TPA": ["TPA", "TRANSFER OF PROPERTY ACT"], "LA": ["LA", "LIMITATION ACT"],
    "ACA": ["ACA", "ARBITRATION AND CONCILIATION ACT", "ARBITRATION ACT"], "CPC": ["CPC", "CODE OF CIVIL PROCEDURE"],
}
REPLACED = {"ipc": (r"(?i)\b(IPC|Indian Penal Code)\b", r"(?i)\b(BNS|Bharatiya Nyaya Sanhita)\b"), "crpc": (r"(?i)\b(CrPC|Code of Criminal Procedure)\b", r"(?i)\b(BNSS|Bharatiya Nagarik Suraksha Sanhita)\b"), "evidence": (r"(?i)\b(IEA|Evidence Act)\b", r"(?i)\b(BSA|Bharatiya Sakshya Adhiniyam)\b")}
MATCH_STOPWORDS = ["SECTION", "ARTICLE", "ORDER", "RULE", "CODE", "ACT", "PROCEDURE", "CHILDREN", "FROM", "SEXUAL", "OFFENCES", "OF", "THE", "AND", "FOR", "UNDER"]
RUBRIC_STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "of", "to", "and", "or", "for", "with", "on", "at", "from", "by", "that", "this", "which", "shall", "may", "any", "such", "said", "under", "section", "act"]
NOTE_WORDS = {"amendment": ["amended", "amendment", "modified", "substituted", "inserted", "changed", "2013", "2015", "2018", "2019", "2023"], "transition": ["bns", "bnss", "bsa", "bharatiya nyaya", "bharatiya nagarik", "bharatiya sakshya", "replaced", "transition", "new law", "july 2024", "2024"], "overruling": ["overruled", "overruling", "no longer good law", "per incuriam", "not good law", "subsequently overruled", "reversed"]}
INLINE = r"(?:section|sec|s\.)\s*(\d+(?:\.\d+)?)"


def any_of(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def act_name(c: Column) -> Column:
    """The full name of an act: an exact key's, else that of the first key of which one is a prefix of the other, else null."""
    key = F.upper(F.trim(c))
    pairs = list(ACT_NAMES.items())
    exact = reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), pairs[1:], F.when(key == pairs[0][0], pairs[0][1]))
    prefix = reduce(lambda acc, kv: acc.when(key.startswith(kv[0]) | F.lit(kv[0]).startswith(key), kv[1]), pairs[1:], F.when(key.startswith(pairs[0][0]) | F.lit(pairs[0][0]).startswith(key), pairs[0][1]))
    return F.when(key != "", F.coalesce(exact, prefix))


def citations(type1: str = "type1", act1: str = "act1", section1: str = "section1", act2: str = "act2", section2: str = "section2") -> Column:
    one = F.struct(F.col(type1).alias("type"), F.col(act1).alias("act"), F.col(section1).alias("section"))
    two = F.struct(F.lit("bare_act").alias("type"), F.col(act2).alias("act"), F.col(section2).alias("section"))
    return F.filter(F.array(one, two), lambda c: c["act"].isNotNull())


def cited_text(cites: Column) -> Column:
    return F.upper(F.array_join(F.transform(cites, lambda c: F.concat(c["act"], F.lit(" "), c["section"])), " "))


def candidates(cites: Column) -> Column:
    """Distinct strings that may match the expected citation: act with section, and section alone."""
    return F.array_distinct(F.flatten(F.transform(cites, lambda c: F.array(F.concat(c["act"], F.lit(" "), c["section"]), c["section"]))))


def citation_match(predicted: Column, expected: Column) -> Column:
    """Both normalised: equal or one inside the other, or all numbers of the expected and one of its key words occur."""
    numbers = F.regexp_extract_all(expected, F.lit(r"(\d+[A-Z]?)"), F.lit(1))
    words = F.filter(F.split(expected, " "), lambda w: (F.length(w) > 4) & ~w.isin(MATCH_STOPWORDS))
    partial = (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.contains(predicted, n)) & ((F.size(words) == 0) | F.exists(words, lambda w: F.contains(predicted, w)))
    return (predicted != "") & (expected != "") & (F.contains(predicted, expected) | F.contains(expected, predicted) | partial)


def act_mentioned(act: Column, text: Column) -> Column:
    """Whether a variant of an (upper-case) act's name is in the citations' text."""
    out = None
    for key, variants in ACT_VARIANTS.items():
        out = F.when(act == key, any_of(text, variants)) if out is None else out.when(act == key, any_of(text, variants))
    return (act == "") | ((text != "") & out.otherwise(F.contains(text, act)))


def section_mentioned(section: Column, cites: Column, text: Column) -> Column:
    s = F.upper(section)
    forms = reduce(lambda a, b: a | b, [F.contains(text, F.concat(F.lit(p), s, F.lit(q))) for p, q in (("SECTION ", ""), ("SEC ", ""), ("S. ", ""), ("§ ", ""), ("SEC. ", ""), (" ", " "))])
    return (s == "") | ((F.size(cites) > 0) & (F.exists(cites, lambda c: F.upper(F.trim(c["section"])) == s) | forms))


def joined(responses: DataFrame, truth: DataFrame) -> DataFrame:
    """Responses with their ground truth, by row; a row whose query ids differ is an error."""
    t = truth.select("row_idx", F.col("query_id").alias("truth_id"), "category", F.upper(F.trim("correct_act")).alias("act"), F.trim("correct_section").alias("section"), F.trim("correct_citation").alias("expected"), "summary", "amendment_applies", "transition_applies", "overruling_applies")
    out = responses.join(t, "row_idx").withColumn("cites", citations())
    out = out.withColumn("expected", F.when((F.col("expected") == "") & (F.col("act") != "") & (F.col("section") != ""), F.concat("act", F.lit(" Section "), "section")).otherwise(F.col("expected")))
    guard = F.when(F.col("truth_id") == F.col("query_id"), F.lit(True)).otherwise(F.raise_error(F.lit("query ids differ")))
    return out.withColumn("text", cited_text(F.col("cites"))).filter(guard)


def accuracy(j: DataFrame) -> DataFrame:
    """Adds ``retrieved`` and ``generated``, the citation scores 0, .5 or 1."""
    norm = x.citation(F.col("expected"))
    match = F.exists(F.transform(candidates(F.col("cites")), x.citation), lambda p: citation_match(p, F.col("norm")))
    act, section = act_mentioned(F.col("act"), F.col("text")), section_mentioned(F.col("section"), F.col("cites"), F.col("text"))
    low = F.lower("answer")
    said = F.contains(low, F.lower("act"))
    number = (F.col("section") == "") | F.exists(F.regexp_extract_all(low, F.lit(INLINE), F.lit(1)), lambda s: s == F.col("section"))
    step = lambda full, half: F.when(F.col("act") == "", 1.0).when(full, 1.0).when(half, 0.5).otherwise(0.0)
    return j.withColumn("norm", norm).withColumn("retrieved", step(match | (act & section), act)).withColumn("generated", step(said & number, said))


def outdated(j: DataFrame) -> DataFrame:
    """Adds for each replaced law whether it is cited, and whether without its successor."""
    text = F.concat_ws(" ", "answer", F.array_join(F.transform("cites", lambda c: c["act"]), " "))
    for name, (old, new) in REPLACED.items():
        cited = text.rlike(old)
        noted = text.rlike(new) | ((F.col("transition_note") != "") if name == "ipc" else F.lit(False))
        j = j.withColumn(f"{name}_cited", cited).withColumn(f"{name}_outdated", cited & ~noted)
    return j


def rubric(j: DataFrame) -> DataFrame:
    """Adds ``acs``, the mean of six parts, in per cent."""
    low = F.lower("answer")
    ref = F.array_except(F.array_distinct(x.tokens(F.lower("summary"))), F.array(*map(F.lit, RUBRIC_STOPWORDS)))
    overlap = F.size(F.array_intersect(ref, x.tokens(low))) / F.greatest(F.size(ref), F.lit(1))
    direct = F.when(low == "", 0.5).when(overlap >= 0.35, 1.0).when(overlap >= 0.15, 0.5).otherwise(0.0)
    act = F.exists("cites", lambda c: F.contains(F.lower(c["act"]), F.lower("act"))).cast("double")
    section = F.exists("cites", lambda c: F.trim(c["section"]) == F.col("section")).cast("double")
    note = lambda flag, words, extra: F.when(F.lower(flag) == "yes", (extra | any_of(low, words)).cast("double")).otherwise(1.0)
    parts = direct + act + section + note(F.col("amendment_applies"), NOTE_WORDS["amendment"], F.lit(False)) + note(F.col("transition_applies"), NOTE_WORDS["transition"], F.col("transition_note") != "") + note(F.col("overruling_applies"), NOTE_WORDS["overruling"], F.lit(False))
    return j.withColumn("acs", F.round(parts / 6 * 100, 2))


def claims(j: DataFrame) -> DataFrame:
    """One row a citation that isn't the expected one: row_idx, system, type, act_name, section (a bare number for statutes)."""
    c = j.select("row_idx", "system", "act", "section", "expected", F.explode("cites").alias("c"))
    number = x.section_token(F.col("c.section"))
    expected = ((number == F.col("section")) & F.coalesce(act_name(F.col("c.act")) == act_name(F.col("act")), F.lit(False))) | (F.col("c.section") == F.col("expected"))
    return c.select("row_idx", "system", F.col("c.type").alias("type"), F.coalesce(act_name(F.col("c.act")), F.col("c.act")).alias("act_name"), F.when(F.col("c.type") == "bare_act", number).otherwise(F.col("c.section")).alias("section"), expected.alias("expected"))


def hallucinations(j: DataFrame, sections: DataFrame, cases: DataFrame) -> DataFrame:
    """Per response: claims, hallucinated sections and cases, unsupported inline mentions, and the rate."""
    c = claims(j)
    known = sections.select("act_name", F.col("section_number").alias("section")).distinct().withColumn("known_section", F.lit(True))
    cited = cases.select(F.col("citation").alias("section")).distinct().withColumn("known_case", F.lit(True))
    probed = c.join(known, ["act_name", "section"], "left").join(cited, "section", "left")
    bad = lambda kind, known_: F.count_if(~F.col("expected") & (F.col("type") == kind) & F.col(known_).isNull())
    per = probed.groupBy("row_idx", "system").agg(F.count("*").alias("claims"), bad("bare_act", "known_section").alias("sections"), bad("case_law", "known_case").alias("cases"))
    inline = F.size(F.filter(F.regexp_extract_all(F.lower("answer"), F.lit(INLINE), F.lit(1)), lambda s: ~F.exists("cites", lambda k: F.contains(F.lower(k["section"]), s))))
    out = j.select("row_idx", "system", inline.alias("inline")).join(per, ["row_idx", "system"], "left").fillna(0, ["claims", "sections", "cases"])
    total = F.col("claims") + F.col("inline")
    return out.withColumn("total", total).withColumn("rate", (F.col("sections") + F.col("cases") + F.col("inline")) / F.greatest(total, F.lit(1)))


def semantic(reference: Column, answer_vector: Column, answer: Column, fallback: Column) -> Column:
    """Closeness of an answer's vector to its reference's in per cent: 0 for an empty answer, the fallback where a vector is missing."""
    close = (cosine(reference, answer_vector) + 1) / 2 * 100
    missing = reference.isNull() | answer_vector.isNull()
    return F.when(F.trim(answer) == "", 0.0).when(missing, fallback).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), close)), 2))


#: The categories that are asked of the cases.
CASE_CATEGORIES = ["case_law_search", "overruled_detection"]


def precision_at_k(ranked: DataFrame, truth: DataFrame, acts: DataFrame, cases: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Rows of (row_idx, p_at_k for each k): of what ``ranked`` (row_idx, doc_id, rank) found, the share that its metadata make relevant.

    A question of the cases wants the expected citation, any other the act's
    full name and its section. A question without results has 0. What was found
    goes to the acts and cases, so that no others are shuffled.
    """
    found = written(ranked.filter(F.col("rank") <= max(ks)).select("row_idx", "doc_id", "rank"), "found")
    wanted = checked(found.select("doc_id"))
    acts = acts.select(F.col("id").alias("doc_id"), "act_name", "section_number").join(wanted, "doc_id", "left_semi")
    cases = cases.select(F.col("case_id").alias("doc_id"), "citation").join(wanted, "doc_id", "left_semi")
    found = found.join(acts, "doc_id", "left").join(cases, "doc_id", "left")
    case = F.lower(F.replace("category", F.lit(" "), F.lit("_"))).isin(CASE_CATEGORIES)
    act = (F.col("section_number") == F.col("correct_section")) & (F.col("act_name") == F.coalesce(act_name(F.col("correct_act")), F.lower("correct_act")))
    hit = F.coalesce(F.when(case, F.col("citation") == F.col("correct_citation")).otherwise(act), F.lit(False))
    j = truth.select("row_idx", "category", "correct_act", "correct_section", "correct_citation").join(found, "row_idx", "left").withColumn("hit", hit)
    share = lambda k: F.count_if(F.col("hit") & (F.col("rank") <= k)) / F.greatest(F.least(F.lit(k), F.count("rank")), F.lit(1))
    return j.groupBy("row_idx").agg(*[F.round(share(k), 6).alias(f"p_at_{k}") for k in ks])
