"""Text functions: Column to Column, built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, patterns and word lists that results depend on, in their order.
ACTS_19 = ["Indian Penal Code", "IPC", r"I\.P\.C\.", "Code of Criminal Procedure", "CrPC", r"Cr\.P\.C\.", "Indian Contract Act", "Companies Act", "Arbitration and Conciliation Act", "Income Tax Act", "Negotiable Instruments Act", "Evidence Act", "Transfer of Property Act", "Consumer Protection Act", "SARFAESI Act", "Bharatiya Nyaya Sanhita", "BNS", "Bharatiya Nagarik Suraksha Sanhita", "BNSS"]
ACTS_16 = ["Indian Penal Code", "Bharatiya Nyaya Sanhita", "Code of Criminal Procedure", "Bharatiya Nagarik Suraksha Sanhita", "Indian Evidence Act", "Bharatiya Sakshya Adhiniyam", "Indian Contract Act", "Negotiable Instruments Act", "Companies Act", "Information Technology Act", "Arbitration and Conciliation Act", "Constitution of India", "Hindu Marriage Act", "Protection of Women from Domestic Violence Act", "Protection of Children from Sexual Offences Act", "POCSO"]
ACTS_11 = ["Indian Penal Code", "IPC", "Code of Criminal Procedure", "CrPC", "Bharatiya Nyaya Sanhita", "BNS", "Bharatiya Nagarik Suraksha Sanhita", "BNSS", "Evidence Act", "Indian Evidence Act", "Constitution of India"]
CITATIONS_LOOSE = [r"AIR\s+\d{4}\s+SC\s+\d+", r"\(\d{4}\)\s+\d+\s+SCC\s+\d+", r"\d{4}\s+\(\d+\)\s+SCC\s+\d+", r"\d{4}\s+AIR\s+\d+", r"\(\d{4}\)\s+\d+\s+SCR\s+\d+"]
CITATIONS_STRICT = [r"AIR\s+\d{4}\s+SC\s+\d+", r"\(\d{4}\)\s+\d+\s+SCC\s+\d+", r"\d{4}\s+\(\d+\)\s+SCC\s+\d+", r"AIR\s+\d{4}\s+(?:Bom|Del|Mad|Cal|All|Kar|Ker|Guj|Raj|P&H)\s+\d+", r"JT\s+\d{4}\s+\(\d+\)\s+SC\s+\d+"]
COURTS = {"bombay": "Bombay High Court", "delhi": "Delhi High Court", "madras": "Madras High Court", "calcutta": "Calcutta High Court", "allahabad": "Allahabad High Court", "karnataka": "Karnataka High Court", "kerala": "Kerala High Court", "gujarat": "Gujarat High Court", "rajasthan": "Rajasthan High Court", "punjab": "Punjab and Haryana High Court"}
HINT_STOPWORDS = ["the", "of", "and", "act", "code", "india", "indian", "from", "law", "rules", "rule", "section", "sanhita", "adhiniyam"]
HINTS = {"BNS": ["nyaya"], "BNSS": ["nagarik", "suraksha"], "BSA": ["sakshya"], "POCSO": ["children", "sexual", "offences"], "ICA": ["contract"], "SRA": ["specific", "relief"], "IBC": ["insolvency", "bankruptcy"], "COI": ["constitution"]}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
PUNISHMENT = [r"shall be punished with [^.]+", r"punishable with [^.]+", r"shall be liable to [^.]+"]

HEADING_TERMS = [
    (r"\bpunishment\b", "दंड"), (r"\bpenalty\b", "दंड"), (r"\bfor\b", "के लिए"), (r"\bof\b", "का"), (r"\band\b", "और"), (r"\bwith\b", "सहित"), (r"\bwithout\b", "बिना"),
    (r"\bto\b", "को"), (r"\bin\b", "में"), (r"\bon\b", "पर"), (r"\bby\b", "द्वारा"), (r"\bfrom\b", "से"), (r"\bunder\b", "के तहत"), (r"\bagainst\b", "के विरुद्ध"),
    (r"\bdefinition\b", "परिभाषा"), (r"\binterpretation\b", "व्याख्या"), (r"\bgeneral explanation\b", "सामान्य स्पष्टीकरण"), (r"\belectronic\b", "इलेक्ट्रॉनिक"),
    (r"\bproperty\b", "संपत्ति"), (r"\bperson\b", "व्यक्ति"), (r"\bwoman\b", "महिला"), (r"\bchild\b", "बालक"), (r"\bdeath\b", "मृत्यु"),
    (r"\bdishonestly\b", "बेईमानी से"), (r"\bfraudulently\b", "कपटपूर्वक"), (r"\bdelivery\b", "सुपुर्दगी"), (r"\binducing\b", "प्रेरित करना"), (r"\bintent\b", "आशय"),
    (r"\bintention\b", "आशय"), (r"\bcriminal\b", "आपराधिक"), (r"\boffence\b", "अपराध"), (r"\boffences\b", "अपराध"), (r"\bact\b", "अधिनियम"), (r"\bsection\b", "धारा"),
    (r"\bmurder\b", "हत्या"), (r"\bculpable homicide\b", "गैर इरादतन हत्या"), (r"\btheft\b", "चोरी"), (r"\brobbery\b", "लूट"), (r"\bdacoity\b", "डकैती"),
    (r"\bcheating\b", "धोखाधड़ी"), (r"\bcriminal breach of trust\b", "आपराधिक न्यासभंग"), (r"\bforgery\b", "जालसाजी"), (r"\bextortion\b", "उगाही"),
    (r"\bkidnapping\b", "अपहरण"), (r"\babduction\b", "अपहरण"), (r"\brape\b", "बलात्कार"), (r"\bsexual harassment\b", "यौन उत्पीड़न"), (r"\bassault\b", "आक्रमण"),
    (r"\bhurt\b", "चोट"), (r"\bgrievous hurt\b", "गंभीर चोट"), (r"\bwrongful restraint\b", "अवैध निरोध"), (r"\bwrongful confinement\b", "अवैध निरुद्धि"),
    (r"\bdefamation\b", "मानहानि"), (r"\bsedition\b", "देशद्रोह"), (r"\badultery\b", "व्यभिचार"), (r"\bdowry death\b", "दहेज मृत्यु"), (r"\bdowry\b", "दहेज"),
    (r"\bpublic servant\b", "लोक सेवक"), (r"\babetment\b", "उकसावा"), (r"\battempt\b", "प्रयास"), (r"\bconspiracy\b", "षड्यंत्र"), (r"\bcommon intention\b", "समान आशय"),
    (r"\bcommon object\b", "सामान्य उद्देश्य"), (r"\bevidence\b", "साक्ष्य"), (r"\belectronic evidence\b", "इलेक्ट्रॉनिक साक्ष्य"), (r"\bconfession\b", "स्वीकारोक्ति"),
    (r"\bstatement\b", "बयान"), (r"\bbail\b", "जमानत"), (r"\banticipatory bail\b", "अग्रिम जमानत"), (r"\barrest\b", "गिरफ्तारी"), (r"\binvestigation\b", "जांच"),
    (r"\btrial\b", "विचारण"), (r"\bprocedure\b", "प्रक्रिया"), (r"\bcognizable\b", "संज्ञेय"), (r"\bnon-cognizable\b", "असंज्ञेय"), (r"\bcompoundable\b", "समझौतायोग्य"),
    (r"\bnon-compoundable\b", "असमझौतायोग्य"), (r"\bcontract\b", "अनुबंध"), (r"\bagreement\b", "समझौता"), (r"\bconsideration\b", "प्रतिफल"), (r"\bvoid\b", "शून्य"),
    (r"\bspecific relief\b", "विशिष्ट अनुतोष"), (r"\barbitration\b", "मध्यस्थता"), (r"\bconciliation\b", "सुलह"), (r"\bcompany\b", "कंपनी"), (r"\bdirector\b", "निदेशक"),
    (r"\binsolvency\b", "दिवालियापन"), (r"\bbankruptcy\b", "दिवालियापन"), (r"\bconsumer\b", "उपभोक्ता"), (r"\bmarriage\b", "विवाह"),
    (r"\bdomestic violence\b", "घरेलू हिंसा"), (r"\bchild\b", "बालक"), (r"\bchildren\b", "बालक"),
]
QUERY_WORDS = {"Indian Penal Code": "भारतीय दंड संहिता", "Code of Criminal Procedure": "दंड प्रक्रिया संहिता", "Negotiable Instruments Act": "परक्राम्य लिखत अधिनियम", "What does ": ""}
QUERY_TEMPLATES = [
    (r"^What does (Section .+?) say\?$", r"\1 में क्या कहा गया है?"), (r"^Explain (Section .+?)$", r"\1 की व्याख्या करें।"), (r"^What is (Section .+?)\?$", r"\1 क्या है?"), (r"^Show me (Section .+?)$", r"मुझे \1 दिखाइए।"),
    (r"^What does (Section .+?) cover\?$", r"\1 में क्या प्रावधान है?"), (r"^What is the punishment for (.+)\?$", r"\1 के लिए सजा क्या है?"), (r"^What is the sentence for (.+)\?$", r"\1 के लिए दंड क्या है?"),
    (r"^How many years imprisonment for (.+)\?$", r"\1 के लिए कितने वर्ष की सजा है?"), (r"^How long can you be jailed for (.+)\?$", r"\1 के लिए कितनी अवधि की जेल हो सकती है?"), (r"^Has (.+) been overruled\?$", r"क्या \1 को निरस्त किया जा चुका है?"),
    (r"^What happened to (.+)\?$", r"\1 के साथ क्या हुआ?"), (r"^What changed in (.+)\?$", r"\1 में क्या बदलाव हुआ है?"), (r"^Are there new provisions for (.+)\?$", r"क्या \1 के लिए नए प्रावधान हैं?"),
    (r"^What are the legal requirements for (.+)\?$", r"\1 के लिए कानूनी आवश्यकताएँ क्या हैं?"), (r"^What are the ingredients of (.+)\?$", r"\1 के आवश्यक तत्व क्या हैं?"),
]
QUERY_SUFFIX = " के बारे में कानूनी स्थिति क्या है?"


def heading_alias(c: Column) -> Column:
    """A heading with its known terms in Hindi, one term after the other; empty if nothing changed."""
    low = F.lower(F.trim(c))
    out = reduce(lambda h, t: F.regexp_replace(h, "(?i)" + t[0], t[1]), HEADING_TERMS, low)
    out = F.trim(F.regexp_replace(out, r"\s+", " "), F.lit(" .;-:"))
    for pattern, once in ((r"के लिए\s+के लिए", "के लिए"), (r"का\s+का( |$)", "का$1"), (r"और\s+और", "और")):
        out = F.regexp_replace(out, pattern, once)
    return F.when(F.lower(out) == low, "").otherwise(out)


def hindi_query(c: Column) -> Column:
    """A query with its acts' names replaced, in the first template that it matches, else with the suffix."""
    q = reduce(lambda h, t: F.replace(h, F.lit(t[0]), F.lit(t[1])), QUERY_WORDS.items(), F.trim(c))
    made = F.concat(F.regexp_replace(q, r"\?$", ""), F.lit(QUERY_SUFFIX))
    for pattern, to in reversed(QUERY_TEMPLATES):
        made = F.when(q.rlike(pattern), F.regexp_replace(q, pattern, to.replace("\\1", "$1"))).otherwise(made)
    return made


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def section_number(c: Column) -> Column:
    """123, 123A, 123(1), 123-A out of a label; else its word characters; ``unknown`` without any."""
    v = F.regexp_replace(squeeze(c), r"(?i)^(section|sec\.?|article|art\.?)\s+", "")
    number = F.regexp_extract(v, r"(?i)^([0-9]+[A-Z]?(?:\([0-9A-Za-z]+\))?(?:-[0-9A-Za-z]+)?)", 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(F.regexp_replace(v, r"[^0-9A-Za-z()\-]+", ""), F.lit("")), F.lit("unknown"))


def section_token(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), r"(?i)^section\s*", "")), r"(?i)^sec\.?\s*", ""))


def whole_number(c: Column) -> Column:
    """420 for 420.0."""
    return F.when(c.rlike(r"^\d+\.0$"), F.regexp_replace(c, r"\.0$", "")).otherwise(c)


def for_match(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """White-space-separated words; an empty text has none."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def act_hints(name: Column, short: Column) -> Column:
    base = for_match(name)
    words = F.filter(F.split(base, " "), lambda t: (F.length(t) >= 3) & ~t.isin(HINT_STOPWORDS))
    years = F.regexp_extract_all(base, F.lit(r"\b((?:18|19|20)\d{2})\b"), F.lit(1))
    special = reduce(lambda acc, kv: F.when(short == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(acc), HINTS.items(), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, years, special))


def search_score(text: Column, name: Column, short: Column) -> Column:
    norm = for_match(text)
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    has = lambda *ws: reduce(lambda a, b: a | b, [padded.contains(f" {w} ") for w in ws])
    hits = F.size(F.filter(act_hints(name, short), lambda t: norm.contains(t)))
    bonus = ((short == "BNS") & norm.contains("nyaya") & ~norm.contains("nagarik")) | ((short == "BNSS") & norm.contains("nagarik") & norm.contains("suraksha")) | ((short == "BSA") & norm.contains("sakshya"))
    return F.when(norm == "", -999).otherwise(hits * 10 - F.when(has("vs", "high court", "supreme court"), 30).otherwise(0) + F.when(has("act", "code", "constitution"), 8).otherwise(0) + F.when(bonus, 25).otherwise(0))


def first_match(c: Column, patterns: list[str], flags: str = "") -> Column:
    """The first pattern's first match; empty without any."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, flags + p, 0), F.lit("")) for p in patterns], F.lit(""))


def year(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(19[5-9]\d|20[0-2]\d)\b", 1)


def court(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(low.contains("supreme court"), "Supreme Court of India")
    for word, name in COURTS.items():
        out = out.when(low.contains(word), name)
    return out.otherwise("Unknown Court")


def acts_as_written(c: Column) -> Column:
    """Distinct surface forms of 19 patterns, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(f"(?i)({p})"), F.lit(1)) for p in ACTS_19]))))


def acts_present(c: Column, names: list[str] = ACTS_16) -> Column:
    low = F.lower(c)
    return F.array_sort(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(low, F.lower(n))))


def sections_all(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(?i)Section\s+(\d+[A-Z]*)", r"(?i)Sec\.\s+(\d+[A-Z]*)", r"(?i)S\.\s+(\d+[A-Z]*)")])))


def sections_short(c: Column) -> Column:
    """Numbers of ``S. n`` forms only: the alternation's other branches capture nothing."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"[Ss]ection|[Ss]ec\.|[Ss]\.\s+(\d+[A-Z]?)"), F.lit(1)), lambda s: s != "")))


def clean_scraped(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"[^\p{L}\p{N}_\s.,;:()\-'\"/\[\]]", ""))


def unescape(c: Column) -> Column:
    """The characters that HTML's five own entities and the hard space stand for."""
    for entity, character in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(character))
    return c


def clean_document(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), " {2,}", " ")
    return F.trim(F.replace(F.regexp_replace(c, r"(?i)Page \d+ of \d+", ""), F.lit("\r\n"), F.lit("\n")))


def bm25_tokens(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"section\s+(\d+[a-z]?)", "section_$1")
    c = F.regexp_replace(c, r"sec\.\s+(\d+[a-z]?)", "section_$1")
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def query_pattern(c: Column) -> Column:
    c = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(F.regexp_replace(c, r"\b(?:18|19|20)\d{2}\b", "<YEAR>"), r"\b\d+[a-z]?\b", "<NUM>")
    return F.substring(F.regexp_replace(c, r"\s+", " "), 1, 140)


def token_estimate(c: Column) -> Column:
    return F.floor(F.size(tokens(c)) / 0.75).cast("long")


def chunks(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that start every size - overlap words."""
    words = tokens(c)
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snippet(c: Column, n: int) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def punishment(c: Column) -> Column:
    return first_match(F.substring(c, 1, 1000), PUNISHMENT, "(?i)")


# Abbreviations and act names of the citation normaliser, in the order of replacement.
EXPANSIONS = [(r"(?i)\bS\.\s*", "Section "), (r"(?i)\bSec\b\.?\s*", "Section "), (r"(?i)\bArt\b\.?\s*", "Article "), (r"(?i)\bOrd\b\.?\s*", "Order ")]
ACT_EXPANSIONS = [("CPC", "Code of Civil Procedure"), ("CrPC", "Code of Criminal Procedure"), (r"Cr\.P\.C", "Code of Criminal Procedure"), ("NI Act", "Negotiable Instruments Act"), ("HMA", "Hindu Marriage Act"), ("IPC", "Indian Penal Code"), ("BNS", "Bharatiya Nyaya Sanhita"), ("BNSS", "Bharatiya Nagarik Suraksha Sanhita"), ("BSA", "Bharatiya Sakshya Adhiniyam"), ("IEA", "Indian Evidence Act"), ("NIA", "Negotiable Instruments Act"), ("POCSO", "Protection of Children from Sexual Offences Act")]


def citation(c: Column) -> Column:
    """A citation in upper case with its abbreviations written out and years left out."""
    c = F.trim(F.coalesce(c, F.lit("")))
    for p, to in EXPANSIONS:
        c = F.regexp_replace(c, p, to)
    c = F.regexp_replace(c, r"(?i)\bR\.\s*(\d)", "Rule $1")
    for p, to in ACT_EXPANSIONS:
        c = F.regexp_replace(c, rf"(?i)\b{p}\b", to)
    c = F.regexp_replace(c, r"(?i)^(.*?\bACT\b(?:\s+\d{4})?)\s+(\d+[A-Z]?)$", "$1 Section $2")
    c = F.regexp_replace(c, r"\b(?:19|20)\d{2}\b", "")
    c = F.translate(c, ":-", "  ")
    c = F.regexp_replace(c, r"(?i)\bSECTION\s*([0-9]+[A-Z]?(?:\([0-9A-Za-z]+\))?)", "SECTION $1")
    c = F.regexp_replace(c, r"(?i)\bARTICLE\s*([0-9]+[A-Z]?)\b", "ARTICLE $1")
    return F.upper(squeeze(c))


def act_label(c: Column) -> Column:
    low = F.lower(c)
    rules = [(low.contains("negotiable"), "NI ACT"), (low.contains("evidence"), "EVIDENCE ACT"), (low.contains("companies"), "COMPANIES ACT"), (low.contains("information technology") | c.contains("IT Act"), "IT ACT"), (low.contains("arbitration"), "ARBITRATION ACT"), (low.contains("ipc") | low.contains("indian penal"), "IPC"), (low.contains("bns") | low.contains("bharatiya nyaya"), "BNS"), (low.contains("crpc") | low.contains("criminal procedure"), "CRPC")]
    return reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0])).otherwise(F.upper(c))
