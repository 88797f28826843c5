"""Routing, gates and labels as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, keywords and thresholds that results depend on, in their order.
SECTION_PATTERNS = [r"section\s+\d+[a-z]?", r"sec\.\s+\d+", r"s\.\s+\d+", "what is section", "explain section", "define section"]
CITATION_PATTERNS = [r"air\s+\d{4}\s+sc\s+\d+", r"\(\d{4}\)\s+\d+\s+scc\s+\d+", r"\d{4}\s+\(\d+\)\s+scc\s+\d+"]
KEYWORDS = {"punishment_query": ["punishment", "penalty", "sentence", "imprisonment", "fine"], "amendment_query": ["amended", "amendment", "changed", "modified", "updated"], "case_search": ["case", "judgment", "precedent", "ruling", "held", "decided"]}
COMPLEX = ["equivalent", "replaced", "transition", "compare", "difference", "changed", "mapping", "old", "new", "superseded"]
ACT_PATTERNS = [
    (r"\bCPC\b|CODE OF CIVIL PROCEDURE", "Code of Civil Procedure 1908"), (r"\bCRPC\b|CODE OF CRIMINAL PROCEDURE|CR\.P\.C", "Code of Criminal Procedure 1973"), (r"\bIPC\b|INDIAN PENAL CODE", "Indian Penal Code 1860"),
    (r"\bBNS\b|BHARATIYA NYAYA SANHITA", "Bharatiya Nyaya Sanhita 2023"), (r"\bBNSS\b|BHARATIYA NAGARIK SURAKSHA SANHITA", "Bharatiya Nagarik Suraksha Sanhita 2023"), (r"\bBSA\b|BHARATIYA SAKSHYA ADHINIYAM", "Bharatiya Sakshya Adhiniyam 2023"),
    (r"\bPOCSO\b|PROTECTION OF CHILDREN FROM SEXUAL OFFENCES", "Protection of Children from Sexual Offences Act 2012"), (r"\bNIA\b|\bNI ACT\b|NEGOTIABLE INSTRUMENTS ACT", "Negotiable Instruments Act 1881"), ("SPECIFIC RELIEF ACT", "Specific Relief Act 1963"), ("LIMITATION ACT", "Limitation Act 1963"),
    ("TRANSFER OF PROPERTY ACT", "Transfer of Property Act 1882"), ("ARBITRATION( AND| &) CONCILIATION ACT|ARBITRATION ACT", "Arbitration and Conciliation Act 1996"), (r"HINDU MARRIAGE ACT|\bHMA\b", "Hindu Marriage Act 1955"), ("DOMESTIC VIOLENCE ACT|PROTECTION OF WOMEN FROM DOMESTIC VIOLENCE", "Protection of Women from Domestic Violence Act 2005"),
]
ABSTENTION = ["cannot provide a reliable answer", "insufficient information", "not found in my current database", "unable to conclusively assess", "cannot answer this query", "i could not find", "not available in my database", "please consult primary sources", "outside my current knowledge", "i do not have sufficient", "no relevant information found", "database does not contain", "cannot find a reliable", "please verify with primary", "unable to find"]
ABSTENTION_SHORT = ["cannot provide a reliable answer", "insufficient information", "i could not find", "unable to find"]
API_ERRORS = ["rate limit", "api error", "timeout", "could not find"]
DUMMY = ["lorem ipsum", "dummy", "test data", "sample", "placeholder", "xxx", "todo", "example.com", "foo", "bar"]
HIGH, MEDIUM = 0.75, 0.60


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def query_type(c: Column) -> Column:
    q = F.lower(c)
    out = F.when(matches_any(q, SECTION_PATTERNS), "section_lookup").when(matches_any(q, CITATION_PATTERNS), "citation_lookup")
    for name, words in KEYWORDS.items():
        out = out.when(has_any(q, words), name)
    return out.otherwise("legal_question")


def act_filter(c: Column) -> Column:
    """The first act whose pattern occurs, else null."""
    q = F.upper(F.coalesce(c, F.lit("")))
    return reduce(lambda acc, r: acc.when(q.rlike(r[0]), r[1]), ACT_PATTERNS[1:], F.when(q.rlike(ACT_PATTERNS[0][0]), ACT_PATTERNS[0][1]))


def top_ks(text: Column, kind: Column) -> tuple[Column, Column]:
    """How many sections and cases to retrieve."""
    wide = kind.isin("legal_question", "amendment_query", "case_search")
    hard = has_any(F.lower(F.coalesce(text, F.lit(""))), COMPLEX)
    pick = lambda cited, most, more, few: F.when(kind == "citation_lookup", cited).when(hard, F.greatest(F.when(wide, more).otherwise(few), F.lit(most))).otherwise(F.when(wide, more).otherwise(few))
    return pick(2, 6, 5, 3), pick(3, 8, 8, 5)


def as_score(d: Column) -> Column:
    """A score as it is, a distance above 1 as 1 - d / 2."""
    return F.when(d <= 1.0, d).otherwise(1 - d / 2)


def level(score: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def abstains(answer: Column, confidence: Column, flag: Column, n_citations: Column) -> Column:
    """An explicit flag, or low confidence or a phrase without citations."""
    return F.coalesce(flag, F.lit(False)) | ((F.lower(confidence) == "low") | has_any(F.lower(answer), ABSTENTION)) & (n_citations == 0)
