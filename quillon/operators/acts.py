"""Acts as fetched: which page is the act, and its text cut into sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as fn
from quillon.operators.citations import once, spans
from quillon.operators.relational import first_of, topk

# Acts whose pages must show more of their names' words, marks of judgments and of statutes, headings of sections, ways to name one section, and limits of lengths.
CLOSELY_NAMED = ["BNS", "BNSS", "BSA"]
JUDGMENT, STATUTE = ["petitioner", "respondent"], ["union of india act", "published in gazette", "act ", "code of ", "part i"]
NAMED_HEADING = r"^\s*(?:section|sec\.?|article|art\.?)\s+([0-9]+[A-Z]?(?:\([0-9A-Za-z]+\))?)\s*[\.\-:–—\)]?\s*(.*)$"
BARE_HEADING = r"^\s*([0-9]+[A-Z]?(?:\([0-9A-Za-z]+\))?)\s*[\.\-:–—\)]\s+(.*)$"
ONE_SECTION = [r"(?:Section|Sec\.?|Article|Art\.?)\s+(\d+[A-Z]?)", r"^(\d+[A-Z]?)\.", r"(\d+[A-Z]?)\s*[-–—]\s*"]
ONE_TITLE = r"(?:Section|Sec\.?|Article)\s+\d+[A-Z]?[\.:\s–—]+([^.]+)"
PUNISHMENT_OF_ONE = [r"(?:punishable|punishment|imprison|sentence|fine)[^.]{0,200}\.", r"shall be punished[^.]{0,200}\.", r"imprisonment[^.]{0,200}\."]
PUNISHMENT_OF_SECTION = [r"(?:shall be punished|punishable|imprisonment|rigorous imprisonment|fine)[^.]{0,300}\.", r"penalty[^.]{0,200}\."]
NUMBERED = r"\n\s*(\d+)\.\s+"
HEADINGS, SHORT, LONG, NAVIGATION, TWICE, MARGIN = 3, 30, 3000, 120, 2, 1.2
PARTS, NUMBERED_SHORT, TITLE = 20, 50, 150


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def target_page(text: Column, name: Column, short: Column) -> Column:
    """Whether a page is the act's: two words of its name or more, three for closely named acts, and no judgment without signs of a statute. Looks at 6000 characters."""
    hints = fn.act_hints(name, short)

    def judged(sample: Column) -> Column:
        hits = F.size(F.filter(hints, lambda t: F.contains(sample, t)))
        any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(sample, F.lit(w)) for w in words])
        judgment = F.contains(F.concat(F.lit(" "), sample, F.lit(" ")), F.lit(" vs ")) & F.contains(sample, F.lit("high court")) | any_of(JUDGMENT)
        return F.coalesce((F.length(sample) >= 200) & (hits >= F.when(short.isin(CLOSELY_NAMED), 3).otherwise(2)) & ~(judgment & ~any_of(STATUTE)), F.lit(False))

    # the sample is a variable of an outer lambda: it is made once, not again for each hint and mark
    return F.element_at(F.transform(F.array(fn.for_match(F.substring(text, 1, 6000))), judged), 1)


def rank_candidates(found: DataFrame, act: str, name: str, short: str, pos: str, url: str, label: str, k: int = 8) -> DataFrame:
    """Of search results (act, name, short, pos, url, label) each act's best ``k`` addresses by their labels' score; an address counts where it comes first."""
    once = first_of(found.filter(F.col(url).isNotNull()), [act, url], [pos])
    scored = once.withColumn("score", fn.search_score(strip(F.coalesce(F.col(label), F.lit(""))), F.col(name), F.col(short)))
    return topk(scored, [act], [F.desc("score"), pos], k, rank="place")


def _punishment(section: str) -> Column:
    """The first words on a penalty in a section's first 1000 characters; null without any."""
    return F.nullif(strip(fn.first_match(F.substring(section, 1, 1000), PUNISHMENT_OF_SECTION, "(?iU)")), F.lit(""))


def one_section(text: Column) -> dict[str, Column]:
    """Of a text that is one section: number ('' if it names none), title and punishment (null if it names none)."""
    head = F.substring(text, 1, 200)
    number = F.coalesce(*[F.nullif(F.regexp_extract(head, "(?iU)" + p, 1), F.lit("")) for p in ONE_SECTION], F.lit(""))
    title = F.regexp_extract(F.substring(text, 1, 300), "(?iU)" + ONE_TITLE, 1)
    named = F.regexp_extract(F.substring(text, 1, 300), "(?iU)" + ONE_TITLE, 0) != ""
    title = F.regexp_replace(F.when(named, strip(title)).otherwise(strip(F.substring(text, 1, 100))), r"(?U)\s+", " ")
    return {"number": fn.section_number(number), "title": title, "punishment": F.nullif(strip(fn.first_match(text, PUNISHMENT_OF_ONE, "(?iU)")), F.lit(""))}


def _until_next(text: Column, matches: Column, m: Column, i: Column) -> Column:
    """The text between the i-th match and the next one, or its end."""
    stop = F.coalesce(F.get(matches, i + 1)["start"], F.length(text))
    return F.substring(text, m["end"] + 1, stop - m["end"])


def split_act(acts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of (key, idx, number, heading, section_text): the act's text between its headings.

    Of two kinds of headings the one with more of them counts, the named one if
    both have as many; an act with fewer than HEADINGS has no sections.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"(?U)\n\s*\n", "\n\n"), " +", " ")

    def sections(t: Column) -> Column:
        named, bare = (spans(t, "(?imdU)" + p, 2) for p in (NAMED_HEADING, BARE_HEADING))
        best = once(F.struct(named.alias("n"), bare.alias("b")), lambda w: F.when(F.size(w["b"]) > F.size(w["n"]), w["b"]).otherwise(w["n"]))
        return once(best, lambda ms: F.when(F.size(ms) >= HEADINGS, F.transform(ms, lambda m, i: F.struct(m["g1"].alias("g1"), m["g2"].alias("g2"), _until_next(t, ms, m, i).alias("body")))))

    # exploded as it is made: a filter on a column of matches would be pushed below and work them out again
    each = acts.select(key, F.posexplode(once(clean, sections)).alias("idx", "m"))
    heading, body = strip(F.col("m.g2")), strip(F.col("m.body"))
    return each.select(key, "idx", fn.section_number(F.col("m.g1")).alias("number"), heading.alias("heading"), F.when(heading == "", body).otherwise(strip(F.concat(heading, F.lit("\n"), body))).alias("section_text"))


def clean_sections(sections: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows of (key, idx, number, title, section_text, punishment) of what is worth keeping of split_act().

    In this order: texts of SHORT characters at least; a number's first TWICE;
    texts cut at LONG; no short part of a table of contents; no text that begins
    as one before it with the same number; the first MARGIN times as many as ``expected`` (key, expected).
    """
    by = lambda *c: Window.partitionBy(key, *c).orderBy("idx")
    s = sections.filter((F.col("number") != "") & (F.length("section_text") >= SHORT)).withColumn("_k", F.row_number().over(by("number"))).filter(F.col("_k") <= TWICE)
    s = s.withColumn("section_text", F.when(F.length("section_text") > LONG, F.concat(F.substring("section_text", 1, LONG), F.lit("..."))).otherwise(F.col("section_text")))
    line = strip(F.substring_index("section_text", "\n", 1))
    title = F.when(line == "", F.concat(F.lit("Section "), "number")).otherwise(F.substring(line, 1, 200))
    s = s.withColumn("title", F.regexp_replace(F.regexp_replace(title, r"(?U)^\d+[\.:\-–—\s]+", ""), r"(?U)\s+", " "))
    s = s.filter(~((F.length("section_text") < NAVIGATION) & F.rlike(strip(F.col("title")), F.lit(r"(?i)^(part|chapter|schedule)\b"))))
    s = s.withColumn("_s", F.lower(strip(F.regexp_replace(F.substring("section_text", 1, 220), r"(?U)\s+", " ")))).withColumn("_k", F.row_number().over(by("number", "_s"))).filter("_k = 1")
    s = s.join(expected.select(key, F.col("expected").alias("_e")), key).withColumn("_k", F.row_number().over(by())).filter(F.col("_k") <= F.greatest(F.ceil(F.coalesce("_e", F.lit(500)) * MARGIN), F.lit(1)))
    return s.select(key, "idx", "number", "title", "section_text", _punishment("section_text").alias("punishment"))


def numbered_sections(acts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of (key, pos, number, title, body, punishment) of acts whose sections begin a line with a number and a point.

    An act that splits into PARTS pieces or fewer is in another format and gives
    none; sections under NUMBERED_SHORT characters are left out; titles over
    TITLE are cut three earlier, bodies at LONG, with dots.
    """
    clean = F.regexp_replace(F.replace(F.col(text), F.lit("\n\n\n"), F.lit("\n\n")), " +", " ")

    def pieces(t: Column) -> Column:
        return once(spans(t, "(?U)" + NUMBERED, 1), lambda ms: F.when(2 * F.size(ms) + 1 > PARTS, F.transform(ms, lambda m, i: F.struct(m["g1"].alias("g1"), _until_next(t, ms, m, i).alias("body")))))

    each = acts.select(key, F.posexplode(once(clean, pieces)).alias("pos", "m"))
    each = each.select(key, "pos", F.col("m.g1").alias("number"), strip(F.col("m.body")).alias("_b")).filter(F.length("_b") >= NUMBERED_SHORT)
    line = strip(F.substring_index("_b", "\n", 1))
    cut = lambda c, at, most: F.when(F.length(c) > most, F.concat(F.substring(c, 1, at), F.lit("..."))).otherwise(c)
    out = each.select(key, "pos", "number", cut(line, TITLE - 3, TITLE).alias("title"), cut(F.col("_b"), LONG, LONG).alias("body"))
    return out.withColumn("punishment", _punishment("body"))
