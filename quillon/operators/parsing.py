"""Splitting texts into sections and clauses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as fn

#: What of a page isn't text.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]+>"
HEADING = r"(?i)^(section|article)\s+\d+|^\d+(\.\d+)*\.?\s+[A-Z]|^[A-Z][A-Z ]{5,60}$"


def lines(df: DataFrame, key: str, text: str, heading: str = HEADING) -> DataFrame:
    """Rows of (key, pos, line, part): part counts the headings up to a line; 0 stands before the first.

    Parts are numbered inside the row, each repeated for its lines, so that nothing is shuffled and the time is in proportion to the lines.
    """
    split = df.select(key, F.split(text, "\n").alias("l"))
    at = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(heading), i)), lambda i: i.isNotNull())
    marks = split.select(key, "l", F.concat(F.array(F.lit(0)), at).alias("h"))
    parts = F.flatten(F.transform("h", lambda i, k: F.array_repeat(k, F.coalesce(F.get("h", k + 1), F.size("l")) - i)))
    return marks.select(key, F.posexplode(F.arrays_zip("l", parts.alias("p"))).alias("pos", "z")).select(key, "pos", F.col("z.l").alias("line"), F.col("z.p").alias("part"))


def clauses(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of (key, clause, heading, content): clauses without content are left out; a text without clauses is one."""
    split = df.select(key, text, F.split(text, "\n").alias("l"))
    marks = split.select(key, text, "l", F.filter(F.transform("l", lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull()).alias("h"))
    at = marks.select(key, text, "l", "h", F.transform("h", lambda i, k: F.struct((k + 1).alias("clause"), F.get("l", i).alias("heading"), F.trim(F.array_join(F.slice("l", i + 2, F.greatest(F.coalesce(F.get("h", k + 1), F.size("l")) - i - 1, F.lit(0))), "\n")).alias("content"))).alias("c"))
    full = at.select(key, text, F.filter("c", lambda c: c["content"] != "").alias("c"))
    whole = F.array(F.struct(F.lit(1).alias("clause"), F.lit("Document").alias("heading"), F.trim(F.col(text)).alias("content")))
    return full.select(key, F.inline(F.when(F.size("c") > 0, F.col("c")).otherwise(whole)))


def act_sections(files: DataFrame, text: str) -> DataFrame:
    """The sections of act files, one text a row: ACT_NAME and SHORT_NAME lines, then ``[SECTION n] title`` blocks; a file without names is an error."""
    name = lambda what: F.trim(F.regexp_extract(text, rf"(?m)^{what}:[ \t]*(.+)$", 1))
    own = files.filter(F.col(text).rlike(r"\S")).select(text, name("ACT_NAME").alias("act_name"), name("SHORT_NAME").alias("short_name"))
    own = own.filter(F.when((F.col("act_name") != "") & (F.col("short_name") != ""), True).otherwise(F.raise_error(F.lit("ACT_NAME or SHORT_NAME is missing"))))
    blocks = own.select("act_name", "short_name", F.explode(F.split(text, r"(?:^|\n)(?=\[SECTION\s+[0-9A-Za-z]+\])")).alias("b")).filter(F.startswith("b", F.lit("[SECTION")))
    number, title = F.regexp_extract("b", r"^\[SECTION\s+([0-9A-Za-z]+)\]", 1), F.trim(F.regexp_extract("b", r"^\[SECTION\s+[0-9A-Za-z]+\]\s*([^\n]+)", 1))
    lines = F.filter(F.transform(F.split(F.regexp_replace("b", r"^[^\n]*\n?", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return blocks.select("act_name", "short_name", F.concat("short_name", F.lit("_"), number).alias("id"), number.alias("section_number"), title.alias("section_title"), F.trim(F.concat(F.lit("Section "), number, F.lit(" "), title, F.lit(". "), F.array_join(lines, " "))).alias("full_text"))


def page_documents(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """The documents of fetched pages: title, text, the acts and sections that the text names, and an id made of title and the text's start.

    The text is that of the page's article without scripts, comments and marks; a page without one is no document.
    """
    plain = lambda c: fn.clean_scraped(fn.unescape(F.regexp_replace(c, HIDDEN, " ")))
    body = pages.select(key, url, F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1).alias("a"))
    read = body.select(key, url, plain(F.regexp_extract("a", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h"), plain(F.col("a")).alias("content")).filter("content <> ''")
    titled = read.select(key, url, F.coalesce(F.nullif("h", F.lit("")), F.lit("Unknown Case")).alias("title"), "content")
    return titled.select(key, url, F.substring(F.sha2(F.concat("title", F.substring("content", 1, 500)), 256), 1, 16).alias("id"), "title", "content", F.array_join(fn.acts_present(F.col("content")), "|").alias("acts"), F.array_join(fn.sections_all(F.col("content")), "|").alias("sections"))


def pack_sentences(c: Column, limit: int) -> Column:
    """Sentences packed greedily into pieces of fewer than ``limit`` words (a longer sentence is a piece)."""
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    step = lambda a, s: F.when((a["n"] > 0) & (a["n"] + words(s) >= limit), F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), s.alias("open"), words(s).alias("n"))).otherwise(F.struct(a["done"].alias("done"), F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(" "), s)).alias("open"), (a["n"] + words(s)).alias("n")))
    return F.aggregate(sentences, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def auto_numbers(key: str):
    """A function for mapInPandas over (key, headings): numbers for headings without one are the document's highest so far, plus one.

    It is nested, so that it travels to the workers by value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for b in batches:
            out = []
            for headings in b["headings"]:
                top, numbers = 0, []
                for h in headings:
                    m = re.match(r"(?i)(?:section|article)?\s*(\d+)", h)
                    top = max(top, int(m[1])) if m else top + 1
                    numbers.append(m[1] if m else str(top))
                out.append(",".join(numbers))
            yield b[[key]].assign(numbers=out)

    return run
