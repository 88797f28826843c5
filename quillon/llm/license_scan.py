"""License scan with DataFrame expressions only.

A paragraph (a stretch between blank lines) is looked at around the words of a
vocabulary, in pieces of at most PIECE words that overlap by more than the longest
template. A piece is classified by one logistic regression for each family, on
the presence of word unigrams and bigrams, so that it may name several licences.
They are trained on the driver, on notices made by rule from the templates
below, against sentences of no family, so that they don't depend on the corpus;
what no regression claims is the unknown class. A temperature and a threshold are
calibrated on notices made with other frames. A prediction counts if the piece
also holds enough of a template of its family. The weights and templates are
small, fixed tables.

The weights belong to n-grams with a word of the vocabulary, so that words far
from all of these needn't be scored.
"""

from __future__ import annotations

import json
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.chat_format import bound
from quillon.llm.common import ascii_lower, table

#: Names, identifiers and notices of each family; a confirmed piece holds most of the word pairs of one of them.
TEMPLATES = {
    "apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache 2.0", "licensed under the apache license", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "mit": ["mit license", "mit licence", "license mit", "license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause", "bsd style license", "redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "isc": ["isc license", "license identifier isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "boost": ["boost software license", "bsl 1.0"],
    "zlib": ["zlib license", "license identifier zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"],
    "gpl": ["gnu general public license", "gnu gpl", "gpl version 2", "gpl version 3", "gpl 2.0 only", "gpl 2.0 or later", "gpl 3.0 only", "gpl 3.0 or later", "gplv2 license", "gplv3 license", "under gplv3", "the gplv3"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl license", "lgpl 2.1", "lgpl 3.0"],
    "agpl": ["gnu affero general public license", "gnu agpl", "agpl 3.0", "agplv3 license"],
    "mpl": ["mozilla public license", "mpl 2.0"],
    "epl": ["eclipse public license", "epl 1.0", "epl 2.0"],
    "cc-by": ["cc by 4.0", "cc by 3.0", "creative commons attribution 4.0 international license", "creative commons attribution license"],
    "cc-by-sa": ["cc by sa 4.0", "cc by sa 3.0", "creative commons attribution sharealike 4.0 international license", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc 4.0", "cc by nc 3.0", "creative commons attribution noncommercial 4.0 international license", "creative commons attribution non commercial"],
    "cc-by-nd": ["cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"],
    "public-domain": ["released into the public domain", "dedicated to the public domain", "in the public domain", "cc0 1.0", "public domain dedication", "license identifier unlicense", "this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved", "proprietary and confidential"],
}
UNKNOWN = "unknown"
FAMILIES = list(TEMPLATES)
#: Function words; alone, they aren't features.
PLAIN = "a an and any are as at be by for from in into is it may no not of on or that the this to under was were with without you can will all".split()
#: What parts words: characters other than letters, digits and those beyond ASCII, and full stops (STOP) that aren't before a digit.
PARTS, STOP = r"[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+", r"\.(?![0-9])"
BLANK = r"\n[ \t\r]*\n"
CONTAINED, PRECISION, TEXTS, SEED = 0.85, 0.99, 60, 5
#: Words between which a run ends, words around a run, words of a piece, and words from one piece to the next; templates are shorter than the overlap.
GAP, AROUND, PIECE, STEP = 8, 3, 64, 32


def words_of(text: str) -> list[str]:
    """Words of a paragraph in lower case, as the Column expression makes them."""
    return [w for w in re.split(PARTS, re.sub(STOP, " ", re.sub("[A-Z]", lambda m: m[0].lower(), text))) if w]


def pairs_of(words: list[str]) -> list[str]:
    return list(map(" ".join, zip(words, words[1:], strict=False)))


FRAMES = ["licensed under {}", "licensed under the {}", "released under the {}", "this work is licensed under the {}", "this software is distributed under the terms of the {}", "{}", "see the {} for details", "copyright 2020 {} by {w}", "code is available under the {}", "under {}", "published under the {} by the authors", "spdx license identifier {}", "this file is part of {w} and is under the {}"]
OTHER_FRAMES = ["this work is licensed under {}", "content is made available under the {}", "the project uses the {}", "you may copy it under the terms of {}", "{} applies to this package", "license {}", "the source of {w} is covered by the {}"]
NONE = ["licensed under the {w} license", "released under the {w} public license", "this work is the property of {w}", "see the license agreement for details", "a driver license is required", "the public works of {w}", "the general public may use the software", "version 3 of the {w} was released", "version 2.0 of the work is public", "copyright {w} 2020", "the apache helicopter", "students at mit and {w}", "all {w} reserved seats", "the rights of the public in {w}", "creative work of {w}", "redistribution of wealth", "permission to {w} was granted", "mozilla was founded", "the gnu is an animal", "general election in {w}", "domain of the function", "{w} by 4.0 percent", "under the terms of the {w} treaty", "table reserved for {w}", "international trade and attribution of {w}", "the eclipse of the sun", "a boost for the software industry", "the library of the public", "no commercial use of the {w} road", "files and copies of the software", "the terms and conditions of sale", "the license of the {w} bar expired", "documentation of the source is included"]


def _made(seed: int, frames: list[str]) -> list[tuple[list[str], list[int]]]:
    """Notices made by rule, of one family or two, and sentences of none, as words, with their classes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "st", "le", "o", "a"]) for _ in range(r.randint(1, 4)))
    known = sorted({w for t in TEMPLATES.values() for x in t for w in x.split()} - {*PLAIN})
    # a word of the vocabulary stands alone here, beside made ones
    pad = lambda: " ".join(f"{word()} {r.choice([word, word, word, lambda: r.choice(known)])()}" for _ in range(r.choice([0, 0, 0, 1, 2, 6, 20])))

    def named(c: int) -> str:
        t = r.choice(TEMPLATES[FAMILIES[c]])
        return t if len(t.split()) > 6 or FAMILIES[c] == "reserved" else r.choice(frames).replace("{w}", word()).replace("{}", t).replace("license license", "license")

    out = []
    for c in range(len(FAMILIES)):
        for i in range(TEXTS):
            s, y = named(c), [c]
            if i % 4 == 3:
                other = r.randrange(len(FAMILIES))
                s, y = f"{s} {r.choice(['or', 'and', 'dual', 'or at your option'])} {named(other)}", [c, other]
            out.append((f"{pad()} {s} {pad()}".split(), y))
    for _ in range(TEXTS * 12):
        s = r.choice([lambda: r.choice(NONE).replace("{w}", word()), lambda: " ".join(r.choice([word(), r.choice(PLAIN)]) for _ in range(r.randint(1, 30)))])()
        out.append((f"{pad()} {s} {pad()}".split(), []))
    r.shuffle(out)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@cache
def fitted() -> dict:
    """vocabulary, weights by n-gram, bias, temperature, threshold, and held_out: the share of notices with exactly the right families, and their number."""
    train, held = _made(SEED, FRAMES), _made(SEED + 1, OTHER_FRAMES)
    known = {w for t in TEMPLATES.values() for x in t for w in x.split()} - {*PLAIN}
    counts: dict[str, int] = {}
    for words, _ in train:
        for g in {*words, *pairs_of(words)}:
            if known & {*g.split()}:
                counts[g] = counts.get(g, 0) + 1
    grams = sorted(g for g, n in counts.items() if n >= 3)
    at = {g: i for i, g in enumerate(grams)}

    def matrix(rows):
        x, y = np.zeros((len(rows), len(grams))), np.zeros((len(rows), len(FAMILIES)))
        for i, (words, classes) in enumerate(rows):
            x[i, [at[g] for g in {*words, *pairs_of(words)} if g in at]] = 1
            y[i, classes] = 1
        return x, y

    x, y = matrix(train)
    w, b = np.zeros((len(grams), len(FAMILIES))), np.zeros(len(FAMILIES))
    for _ in range(600):
        e = (y - _sigmoid(x @ w + b)) / len(y)
        w += 4 * (x.T @ e)
        w = np.sign(w) * np.maximum(np.abs(w) - 4e-4, 0)  # L1: a sparse model
        b += 4 * e.sum(axis=0)
    x, y = matrix(held)
    z = x @ w + b
    loss = lambda t: -(y * np.log(_sigmoid(z / t) + 1e-12) + (1 - y) * np.log(1 - _sigmoid(z / t) + 1e-12)).mean()
    temperature = min(np.geomspace(0.2, 5, 40), key=loss)
    p = _sigmoid(z / temperature)
    threshold = next((float(t) for t in np.linspace(0.2, 0.99, 80) if (y[p >= t] == 1).mean() >= PRECISION), 0.99)
    some = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    return {"vocabulary": sorted({v for i in some for v in grams[i].split()} & known), "weights": {grams[i]: w[i].round(6).tolist() for i in some}, "bias": b.round(6).tolist(), "temperature": float(temperature), "threshold": round(threshold, 3), "held_out": (float(((p >= threshold) == (y == 1)).all(axis=1).mean()), len(y))}


def _weights(spark: SparkSession) -> DataFrame:
    """A row for each n-gram; the empty one, which each piece has once, weighs nothing."""
    rows = json.dumps([{"gram": g, "w": w} for g, w in {"": [0.0] * len(FAMILIES), **fitted()["weights"]}.items()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<gram:string,w:array<double>>>"))).select("gram", *[F.col("w")[i].alias(f"w{i}") for i in range(len(FAMILIES))])


def _confirmed(pairs: Column) -> Column:
    """The numbers of the families of which a template is among the pairs."""
    made = [[sorted({*pairs_of(t.split())}) for t in ts] for ts in TEMPLATES.values()]
    some = sorted({p for ts in made for t in ts for p in t})
    templates = F.from_json(F.lit(json.dumps(made)), "array<array<array<string>>>")
    held = lambda own: F.filter(F.transform(templates, lambda ts, i: F.when(F.exists(ts, lambda t: F.size(F.array_intersect(t, own)) >= CONTAINED * F.size(t)), i)), lambda i: i.isNotNull())
    return bound(F.filter(pairs, lambda x: x.isin(some)), lambda own: F.when(F.size(own) > 0, held(own)).otherwise(F.array().cast("array<int>")))


def _pieces(words: Column) -> Column:
    """The pieces of a paragraph's words that are near the vocabulary's: (at, words), in time in proportion to the words."""
    some = fitted()["vocabulary"]

    def runs(hits: Column) -> Column:
        starts = F.filter(F.transform(hits, lambda h, k: F.when((k == 0) | (h - F.get(hits, k - 1) > GAP), k)), lambda k: k.isNotNull())
        return bound(starts, lambda s: F.transform(s, lambda k, j: F.struct(F.greatest(F.get(hits, k) - AROUND, F.lit(1)).alias("a"), (F.get(hits, F.coalesce(F.get(s, j + 1), F.size(hits)) - 1) + AROUND).alias("b"))))

    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(some), i + 1)), lambda i: i.isNotNull())
    cut = lambda r: F.transform(F.sequence(r["a"], F.greatest(r["a"], r["b"] - STEP), F.lit(STEP)), lambda q: F.struct(q.alias("at"), F.slice(words, q, F.least(F.lit(PIECE), r["b"] - q + 1)).alias("words")))
    return F.flatten(F.transform(bound(hits, runs), cut))


def license_scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_licenses (confirmed families, each counted once a paragraph), n_unconfirmed, families (sorted, comma-joined), probability (the highest of confirmed ones, else 0).

    A null or empty text has no paragraphs. Rows with the same key and text give
    as many equal rows, each with its own text's counts; null keys stay. Texts
    are read whole, once, in time in proportion to their length. An empty table
    gives no rows; other columns aren't read.
    """
    spark, m = docs.sparkSession, fitted()
    split = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda p: F.array_remove(F.split(F.regexp_replace(ascii_lower(p), STOP, " "), PARTS), ""))
    each = docs.select(F.col(key).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"), split.alias("p"))
    weighed = ["", *m["weights"]]
    grams = lambda ws, pairs: F.array_distinct(F.filter(F.concat(F.array(F.lit("")), ws, pairs), lambda g: g.isin(weighed)))
    pairs = lambda ws: F.array_distinct(F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b)))
    shaped = lambda pos, x: bound(pairs(x["words"]), lambda two: F.struct(pos.alias("pos"), x["at"].alias("at"), _confirmed(two).alias("held"), grams(x["words"], two).alias("grams")))
    found = F.flatten(F.transform("p", lambda ws, i: F.transform(_pieces(ws), lambda x: shaped(i, x))))
    # one more for each row, so that rows without a licence stay
    base = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("held"), F.array(F.lit("")).alias("grams"))
    rows = each.select("k", "mark", F.concat(F.array(base), found).alias("pieces"))
    # outer, as Spark would else add filters on the arrays' sizes, for which it makes them once more
    rows = rows.select("k", "mark", F.inline_outer("pieces")).select("k", "mark", "pos", "at", "held", F.explode_outer("grams").alias("gram"))
    scored = rows.join(F.broadcast(_weights(spark)), "gram").groupBy("k", "mark", "pos", "at").agg(F.first("held").alias("held"), F.count_if(F.col("gram") == "").alias("rows"), *[F.sum(f"w{i}").alias(f"z{i}") for i in range(len(FAMILIES))])
    # equal rows have added up the same n-grams
    p = F.array(*[1 / (1 + F.exp(-(F.col(f"z{i}") / F.col("rows") + b) / m["temperature"])) for i, b in enumerate(m["bias"])])
    called = F.filter(F.transform(p, lambda x, i: F.struct(F.col("pos").alias("pos"), i.alias("f"), x.alias("p"), F.array_contains("held", i).alias("ok"))), lambda c: c["p"] >= m["threshold"])
    judged = scored.select("k", "mark", F.when(F.col("pos") == -1, F.col("rows")).alias("rows"), F.when(F.col("pos") >= 0, called).otherwise(F.array().cast("array<struct<pos:int,f:int,p:double,ok:boolean>>")).alias("called"))
    by = judged.groupBy("k", "mark").agg(F.max("rows").alias("rows"), F.flatten(F.collect_list("called")).alias("c"))
    ok = F.filter("c", lambda c: c["ok"])
    at = lambda cs: F.array_distinct(F.transform(cs, lambda c: F.struct(c["pos"], c["f"])))
    out = by.select("*", at(ok).alias("yes"), at(F.col("c")).alias("all"), F.coalesce(F.array_max(F.transform(ok, lambda c: c["p"])), F.lit(0.0)).alias("best"))
    names = F.array(*map(F.lit, FAMILIES))
    out = out.select("*", F.array_join(F.array_sort(F.array_distinct(F.transform("yes", lambda c: F.get(names, c["f"])))), ",").alias("named"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(F.col("k").alias(key), F.size("yes").cast("long").alias("n_licenses"), (F.size("all") - F.size("yes")).cast("long").alias("n_unconfirmed"), F.col("named").alias("families"), F.round("best", 6).alias("probability"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
