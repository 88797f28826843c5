"""Citations in answers: spans with their places, validity against a table of sections, masking, and citations of what was retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.relational import first_of

# Two ways to cite a section, the text that takes the place of one that isn't known, and the parts of an answer that are looked at.
SECTION_OF_ACT = r"Section\s+(\d+[A-Za-z]?)\s+of\s+([^.,;\n]+(?:Act|Code)\s+\d{4})"
ACT_SECTION = r"([^.,;\n]+(?:Act|Code)\s+\d{4}),?\s+Section\s+(\d+[A-Za-z]?)"
REMOVED = "[citation removed - not verified]"
FIELDS = ("risks", "suggested_revisions", "overview")
#: What a match of ACT_SECTION has at its end; without it the longer pattern, whose work grows with a line's square, isn't tried.
ACT_SECTION_END = r"(?:Act|Code)\s+\d{4},?\s+Section\s+\d"
#: Case and all white space and digits count as Python's do.
_FLAGS = "(?iU)"
#: A JSON string and, if it is a key, the colon after it, in text without blanks beside its signs.
_LITERAL = r'"(?:[^"\\]|\\.)*+"(:?)'


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once: it is the variable of an outer lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """The matches of ``pattern``: structs of start, end (code points, from 0), full_text and the groups g1, g2, ….

    The pieces between the matches have as many code points as the places need.
    The text is searched twice; groups are taken from the matches, so that a
    pattern may look at no text beside its match but for the begin and end of a line.
    """
    kind = "struct<start:int,end:int,full_text:string" + "".join(f",g{i}:string" for i in range(1, groups + 1)) + ">"
    none = F.lit(None).cast(kind)
    start = F.struct(F.lit(0).alias("at"), F.array(none).alias("out"))

    def step(s: Column, m: Column) -> Column:
        at = s["at"] + F.length(m["before"])
        end = at + F.length(m["g0"])
        one = F.struct(at.alias("start"), end.alias("end"), m["g0"].alias("full_text"), *[F.regexp_extract(m["g0"], pattern, i).alias(f"g{i}") for i in range(1, groups + 1)])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    def placed(found: Column) -> Column:
        parts = F.arrays_zip(found.alias("g0"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("before"))
        return F.when(F.size(found) > 0, F.filter(F.aggregate(parts, start, step, lambda s: s["out"]), lambda x: x.isNotNull())).when(found.isNotNull(), F.array().cast(f"array<{kind}>"))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spliced(text: Column, changes: Column) -> Column:
    """``text`` with each of ``changes`` (start, end, new), from the last to the first, in place of what then stands there."""
    return F.aggregate(F.reverse(changes), text, lambda s, c: F.concat(F.substring(s, F.lit(1), c["start"]), c["new"], F.substring(s, c["end"] + 1, F.length(s))))


def citations_in(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows of (keys, start, end, section, act, full_text): each section of an act where a text first cites it."""
    one = F.transform(spans(F.col(text), _FLAGS + SECTION_OF_ACT, 2), lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("way"), m["end"].alias("end"), m["g1"].alias("number"), m["g2"].alias("act"), m["full_text"].alias("full_text")))
    two = F.transform(spans(F.when(F.col(text).rlike(_FLAGS + ACT_SECTION_END), F.col(text)).otherwise(F.when(F.col(text).isNotNull(), "")), _FLAGS + ACT_SECTION, 2), lambda m: F.struct(m["start"].alias("start"), F.lit(2).alias("way"), m["end"].alias("end"), m["g2"].alias("number"), m["g1"].alias("act"), m["full_text"].alias("full_text")))
    each = texts.select(*keys, F.inline(F.concat(one, two))).withColumn("section", F.concat(F.lit("Section "), "number")).withColumn("act", F.regexp_replace("act", r"(?U)^\s+|\s+$", ""))
    return first_of(each, [*keys, "section", "act"], ["start", "way"]).select(*keys, "start", "way", "end", "section", "act", "full_text")


def citation_report(texts: DataFrame, valid: DataFrame, keys: list[str], text: str) -> DataFrame:
    """citations_in() with is_valid: whether ``valid`` (section, act) has the pair, as it is written."""
    known = valid.select("section", "act").distinct().withColumn("is_valid", F.lit(True))
    return citations_in(texts, keys, text).join(known, ["section", "act"], "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))


def mask_citations(texts: DataFrame, valid: DataFrame, keys: list[str], text: str, replacement: str = REMOVED) -> DataFrame:
    """``texts`` with unknown citations replaced and the numbers n_citations, n_valid, n_invalid.

    ``keys`` tell rows apart. Citations are told apart by section and act; only
    the first place of one is replaced. A null text has none and stays null.
    """
    report = citation_report(texts, valid, keys, text)
    invalid = F.array_sort(F.collect_list(F.when(~F.col("is_valid"), F.struct("start", "way", "end", F.lit(replacement).alias("new")))))
    counts = report.groupBy(*keys).agg(F.count("*").alias("n_citations"), F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid"), invalid.alias("_changes"))
    masked = F.when(F.size("_changes") > 0, spliced(F.col(text), F.col("_changes"))).otherwise(F.col(text))
    out = texts.join(counts, keys, "left").withColumn(text, masked).drop("_changes")
    return out.na.fill(0, ["n_citations", "n_valid", "n_invalid"])


def mask_json(answers: DataFrame, valid: DataFrame, keys: list[str], column: str, fields: tuple[str, ...] = FIELDS, replacement: str = REMOVED) -> DataFrame:
    """Answers as JSON objects: the strings anywhere inside ``fields`` masked as texts of their own, with the answer's numbers.

    The object is taken apart as VARIANT; strings of a field, at any depth, are found by
    their places in its text, masked, and put back. Keys, other fields and other
    kinds of values stay; the object's fields come in VARIANT's order. A text that
    isn't a JSON object is left as it is, with zeros.
    """
    whole = answers.select(*keys, F.col(column).alias("_json"), F.try_parse_json(column).alias("_v"))
    objects = whole.filter(F.schema_of_variant("_v").startswith("OBJECT"))
    field = objects.lateralJoin(answers.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keys, F.col("pos").alias("_pos"), F.col("key").alias("_field"), F.to_json("value").alias("_text"))
    inside = field.filter(F.col("_field").isin(*fields))
    literal = inside.select(*keys, "_pos", F.posexplode(F.filter(spans(F.col("_text"), _LITERAL, 1), lambda m: m["g1"] == "")).alias("_n", "_m")).select(*keys, "_pos", "_n", F.col("_m.start").alias("_start"), F.col("_m.end").alias("_end"), F.from_json(F.concat(F.lit("["), F.col("_m.full_text"), F.lit("]")), "array<string>")[0].alias("_value"))
    masked = mask_citations(literal, valid, [*keys, "_pos", "_n"], "_value", replacement)
    again = F.to_json(F.array("_value"))
    change = F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"), F.substring(again, F.lit(2), F.length(again) - 2).alias("new"))
    numbers = ["n_citations", "n_valid", "n_invalid"]
    changed = masked.groupBy(*keys, "_pos").agg(*[F.sum(n).alias(n) for n in numbers], F.array_sort(F.collect_list(F.when(F.col("n_invalid") > 0, change))).alias("_changes"))
    name = F.to_json(F.array("_field"))
    part = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.when(F.size("_changes") > 0, spliced(F.col("_text"), F.col("_changes"))).otherwise(F.col("_text")))
    parts = field.join(changed, [*keys, "_pos"], "left").groupBy(*keys).agg(*[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in numbers], F.array_sort(F.collect_list(F.struct("_pos", part.alias("part")))).alias("_parts"))
    rebuilt = F.concat(F.lit("{"), F.array_join(F.transform("_parts", lambda p: p["part"]), ","), F.lit("}"))
    return answers.join(parts, keys, "left").withColumn(column, F.when(F.col("n_citations") > 0, rebuilt).otherwise(F.col(column))).drop("_parts").na.fill(0, numbers)


# What a question calls an act, in the order in which they are looked for; short names of acts as they are written in full.
ACT_HINTS: list[tuple[str, list[str]]] = [
    ("IPC", ["IPC", "आईपीसी", "INDIAN PENAL CODE", "भारतीय दंड संहिता"]),
    ("CRPC", ["CRPC", "सीआरपीसी", "CODE OF CRIMINAL PROCEDURE", "दंड प्रक्रिया संहिता"]),
    ("CPC", ["CPC", "CODE OF CIVIL PROCEDURE"]),
    ("IT ACT", ["IT ACT", "आईटी अधिनियम", "INFORMATION TECHNOLOGY ACT"]),
    ("BNSS", ["BNSS", "बीएनएसएस", "BHARATIYA NAGARIK SURAKSHA SANHITA"]),
    ("BNS", ["BNS", "बीएनएस", "BHARATIYA NYAYA SANHITA"]),
    ("BSA", ["BSA", "BHARATIYA SAKSHYA ADHINIYAM"]),
    ("POCSO", ["POCSO", "PROTECTION OF CHILDREN FROM SEXUAL OFFENCES"]),
    ("NIA", ["NI ACT", "NEGOTIABLE INSTRUMENTS ACT", "NIA"]),
    ("HMA", ["HMA", "HINDU MARRIAGE ACT"]),
    ("SRA", ["SPECIFIC RELIEF ACT"]),
    ("LA", ["LIMITATION ACT"]),
    ("TPA", ["TRANSFER OF PROPERTY ACT"]),
    ("ACA", ["ARBITRATION ACT", "ARBITRATION AND CONCILIATION ACT"]),
    ("PWDVA", ["DOMESTIC VIOLENCE ACT", "PROTECTION OF WOMEN FROM DOMESTIC VIOLENCE"]),
]
ACT_LABELS: list[tuple[str, str, str]] = [
    ("BHARATIYA NYAYA SANHITA", "2023", "BNS"),
    ("BHARATIYA NAGARIK SURAKSHA SANHITA", "2023", "BNSS"),
    ("BHARATIYA SAKSHYA ADHINIYAM", "2023", "BSA"),
    ("INDIAN PENAL CODE", "1860", "IPC"),
    ("CODE OF CIVIL PROCEDURE", "1908", "CPC"),
    ("CODE OF CRIMINAL PROCEDURE", "1973", "CRPC"),
    ("INDIAN EVIDENCE ACT", "1872", "IEA"),
    ("NEGOTIABLE INSTRUMENTS ACT", "1881", "NIA"),
    ("SPECIFIC RELIEF ACT", "1963", "SRA"),
    ("LIMITATION ACT", "1963", "LA"),
    ("TRANSFER OF PROPERTY ACT", "1882", "TPA"),
    ("ARBITRATION AND CONCILIATION ACT", "1996", "ACA"),
    ("HINDU MARRIAGE ACT", "1955", "HMA"),
    ("PROTECTION OF WOMEN FROM DOMESTIC VIOLENCE ACT", "2005", "PWDVA"),
    ("PROTECTION OF CHILDREN FROM SEXUAL OFFENCES ACT", "2012", "POCSO"),
]
HINT_SCORE, IN_QUERY, SAME_ACT, SAME_SECTION, SAME_PAIR, TRANSITION = 1000, 100, 60, 80, 400, 10


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def act_label(c: Column) -> Column:
    """An act's short name; others as they are, without white space at the ends."""
    short = F.create_map(*[F.lit(x) for name, year, label in ACT_LABELS for n in (name, f"{name} {year}") for x in (n, label)])
    name = _stripped(c)
    return F.coalesce(F.try_element_at(short, F.upper(name)), name)


def section_label(c: Column) -> Column:
    """``Section`` and the letters, digits, brackets and dashes of what follows the word; '' if there are none."""
    bare = F.regexp_replace(_stripped(F.regexp_replace(_stripped(c), r"(?iU)^section\s*", "")), r"[^0-9A-Za-z()\-]+", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("Section "), bare))


def query_hints(query: Column) -> tuple[Column, Column, Column, Column]:
    """Of a question: the act that it names, its section, all numbers in it, and whether it asks for a section; '' where there is none."""
    q = F.upper(F.coalesce(query, F.lit("")))
    act = F.lit("")
    for label, names in reversed(ACT_HINTS):
        act = F.when(F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(q, n)), label).otherwise(act)
    named, after = (F.regexp_extract(q, p, 1) for p in (r"(?U)(?:SECTION|SEC\.?|S\.?|धारा)\s*(\d+[A-Z]?)", r"(?U)(?:IPC|CRPC|BNS|BNSS)\s*(\d+[A-Z]?)"))
    numbers = F.array_distinct(F.regexp_extract_all(q, F.lit(r"(?U)(?<!\d)(\d+[A-Z]?)(?!\d)"), F.lit(1)))
    return act, F.when(named != "", named).otherwise(after), numbers, q.rlike(r"(?U)\b(SECTION|SEC\.?|S\.?|धारा)\s*\d+")


def structured_citations(sources: DataFrame, queries: DataFrame, key: str = "row_idx", query: str = "query") -> DataFrame:
    """Rows of (key, place, type, act_or_case, section_or_citation, score): what an answer cites, the closest to its question first.

    ``sources`` are (key, pos, type, name, reference, replaced_by): bare acts,
    then case laws, in the order in which they were found; a bare act with a
    successor gives a second citation. A question that names an act and a section
    is cited itself. Citations without name or reference are left out, repeated
    ones but for the first as well.
    """
    act, section, numbers, lookup = query_hints(F.col(query))
    asked = queries.select(key, act.alias("_act"), section.alias("_section"), numbers.alias("_numbers"), lookup.alias("_lookup"))
    asked = asked.withColumn("_label", F.upper(act_label(F.col("_act")))).withColumn("_wanted", F.upper(section_label(F.col("_section"))))
    hint = asked.filter("_act <> '' AND _section <> ''").select(key, F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_pos"), F.lit(0).alias("_sub"), F.lit("query_hint").alias("type"), act_label(F.col("_act")).alias("act_or_case"), section_label(F.col("_section")).alias("section_or_citation"), F.lit(HINT_SCORE).alias("score"))
    rows = sources.withColumn("name", _stripped(F.col("name"))).withColumn("reference", _stripped(F.col("reference"))).join(asked, key)
    number = _stripped(F.replace(F.upper("reference"), F.lit("SECTION"), F.lit("")))
    same_act = (F.col("_label") != "") & (F.upper(act_label(F.col("name"))) == F.col("_label"))
    same_section = (F.col("_wanted") != "") & (F.upper(section_label(number)) == F.col("_wanted"))
    points = lambda when, n: F.when(when, n).otherwise(0)
    score = points(F.array_contains("_numbers", number), IN_QUERY) + points(same_act, SAME_ACT) + points(same_section, SAME_SECTION) + points(F.col("_lookup") & same_act & same_section, SAME_PAIR)
    statute = F.col("type") == "bare_act"
    own = F.struct(F.lit(0).alias("_sub"), F.col("type"), F.when(statute, act_label(F.col("name"))).otherwise(F.col("name")).alias("act_or_case"), F.when(statute, section_label(F.col("reference"))).otherwise(F.col("reference")).alias("section_or_citation"), F.when(statute, score).otherwise(0).alias("score"))
    to = F.upper(_stripped(F.col("replaced_by")))
    successor = F.when(statute & to.startswith("BNS SECTION"), "BNS").when(statute & to.startswith("BNSS SECTION"), "BNSS")
    last = F.element_at(F.split(_stripped(F.col("replaced_by")), r"(?U)\s+"), -1)
    new = F.struct(F.lit(1).alias("_sub"), F.lit("bare_act_transition").alias("type"), successor.alias("act_or_case"), section_label(last).alias("section_or_citation"), F.lit(TRANSITION).alias("score"))
    wanted = F.filter(F.array(F.when((F.col("name") != "") & (F.col("reference") != ""), own), F.when(successor.isNotNull(), new)), lambda x: x.isNotNull())
    each = rows.select(key, F.when(statute, 1).otherwise(2).alias("_kind"), F.col("pos").cast("long").alias("_pos"), F.inline(wanted)).unionByName(hint)
    each = each.withColumn("_a", F.upper(_stripped(F.col("act_or_case")))).withColumn("_s", F.upper(_stripped(F.col("section_or_citation"))))
    order = [F.desc("score"), "_kind", "_pos", "_sub"]
    once = first_of(each, [key, "_a", "_s"], order).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return once.select(key, "place", "type", "act_or_case", "section_or_citation", "score")
