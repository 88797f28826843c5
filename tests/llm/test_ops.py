"""Each operator on odd rows, and against brute force."""

import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_format, decontaminate, license_scan, lm_scoring, near_dedup, packing, private_data, quality_resampling, quality_rules, token_counts
from tests.oracle import DATA, compare, duck

#: Columns whose names the operators use themselves.
EXTRA = "rid long, kept boolean, mark string, words string, n_chars long, lang string"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", LONG, "Éa b c d e f\ng", "Éa b c d e f\ng", "mail a@b.co or +1 (743) 555-3824 and 10.0.0.1 or 4111 1111 1111 1111"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, i, True, "m", "w", len(t or ""), "en") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "null id", 1, False, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def benchmark(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


OPERATORS = {
    "license": lambda d: license_scan.license_scan(d),
    "hits": lambda d: decontaminate.hits(d, benchmark(d.sparkSession)),
    "tokens": lambda d: token_counts.count_tokens(d),
    "lm": lambda d: lm_scoring.lm_scores(d),
    "lm in shards": lambda d: lm_scoring.lm_scores(d, most_mb=0),
    "private": lambda d: private_data.private_data(d),
    "near": lambda d: near_dedup.near_duplicates(d),
    "resample": lambda d: quality_resampling.resample(d, d.sparkSession.read.parquet(f"{DATA}/labels.parquet")),
    "rules": lambda d: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, empty, name):
    f = OPERATORS[name]
    assert f(empty).count() == 0
    got = f(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert len({tuple(v for k, v in r.asDict().items() if k != "rid") for r in got if r.doc_id == 5}) == 1  # equal rows, equal results


def test_stage_functions_keep_columns(odd, empty):
    for f in (quality_rules.keep_good, near_dedup.one_of_each, private_data.mask_private, lambda d: decontaminate.without_contaminated(d, benchmark(d.sparkSession))):
        assert f(odd).columns == odd.columns and f(empty).count() == 0
    assert near_dedup.one_of_each(odd).count() == odd.count() - 2  # 5, 5 and 6 are one text
    assert decontaminate.without_contaminated(odd, benchmark(odd.sparkSession)).count() == odd.count()
    masked = by_id(private_data.mask_private(odd))
    assert masked[7].text == "mail [EMAIL] or [PHONE] and [IP] or [CARD]" and masked[7].n_chars == len(masked[7].text) and masked[0].text is None


def brute_licenses(text):
    """The verdict on a text in plain Python: (n_licenses, n_unconfirmed, families, probability)."""
    m, known, yes, every, best = license_scan.fitted(), set(license_scan.fitted()["vocabulary"]), set(), set(), 0.0
    for pos, p in enumerate(re.split(license_scan.BLANK, text or "")):
        words = license_scan.words_of(p)
        runs = []
        for i in (i for i, w in enumerate(words) if w in known):
            if runs and i - runs[-1][1] <= license_scan.GAP:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        for a, b in runs:
            a, b = max(0, a - license_scan.AROUND), min(len(words), b + license_scan.AROUND + 1)
            for q in range(a, max(a, b - license_scan.STEP - 1) + 1, license_scan.STEP):
                piece = words[q : min(q + license_scan.PIECE, b)]
                pairs = {" ".join(x) for x in zip(piece, piece[1:])}
                for f, family in enumerate(license_scan.FAMILIES):
                    z = m["bias"][f] + sum(m["weights"][g][f] for g in {*piece, *pairs} if g in m["weights"])
                    prob = 1 / (1 + math.exp(-z / m["temperature"]))
                    if prob >= m["threshold"]:
                        every.add((pos, family))
                        if any(len({*zip(t.split(), t.split()[1:])} & {tuple(x.split()) for x in pairs}) >= license_scan.CONTAINED * len({*zip(t.split(), t.split()[1:])}) for t in license_scan.TEMPLATES[family]):
                            yes.add((pos, family))
                            best = max(best, prob)
    return len(yes), len(every - yes), ",".join(sorted({f for _, f in yes})), round(best, 6)


def test_license_scan(spark, docs, texts):
    said = {"mit": "Released under the MIT License", "apache-2.0": "Apache License, Version 2.0", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC 4.0", "reserved": "All rights reserved"}
    for i, r in by_id(license_scan.license_scan(docs)).items():
        assert r.families == ",".join(sorted(k for k, s in said.items() if s in texts[i]))
        assert tuple(r)[1:4] == brute_licenses(texts[i])[:3] and r.probability == pytest.approx(brute_licenses(texts[i])[3], abs=2e-6)
    m = license_scan.fitted()
    assert m["held_out"][0] > 0.97
    assert max(len(t.split()) for ts in license_scan.TEMPLATES.values() for t in ts) <= license_scan.PIECE - license_scan.STEP


def test_licenses_in_one_line(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    want = {"MIT license or Apache License 2.0": "apache-2.0,mit", "licensed under the mit license, or the gnu general public license version 2": "gpl,mit", "SPDX-License-Identifier: MIT": "mit", "GPL-2.0-only": "gpl", "BSD-2-Clause": "bsd", "GNU Affero General Public License": "agpl", "ISC License": "isc", "Boost Software License": "boost", "Eclipse Public License - v 2.0": "epl", "see the license agreement": "", "a driver license is required": "", "students at MIT": "", "the license of the bar": "", "Released\nunder the MIT\nLicense": "mit", LONG + " Released under the MIT License. " + LONG: "mit"}
    want |= {"software a b c d e f " * n + notice: "mit" for n in (1, 56, *range(60, 66), 400)}
    want |= {"software license x y z " * n + notice + " license copy" * 500: "mit" for n in (31, 32, 33)}
    got = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")))
    for i, (t, families) in enumerate(want.items()):
        assert got[i].families == families, t[-200:]
        assert tuple(got[i])[1:4] == brute_licenses(t)[:3]


def test_license_scan_is_linear(spark):
    began = time.time()
    line = "software license x y z a b c d e f g h i j k l " * 20_000
    r = license_scan.license_scan(spark.createDataFrame([(0, line), (1, line.replace(" ", "  ") + "\n" * 100_000)], "doc_id long, text string")).collect()
    assert len(r) == 2 and time.time() - began < 60


def test_chat_round_trip(spark):
    r = random.Random(5)
    bits = ["\\", "<|", "|>", "<|end|>", "<|turn|>", "a", "\n", "<", "\\<|text|>", "é", "𝄞", "$1", ""]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "sys<|"]), "".join(r.choice(bits) for _ in range(r.randint(0, 6))) or None) for c in range(40) for t in range(r.randint(1, 8))]
    rows += [(None, None, None, None), (50, 1, "user", "x"), (50, 1, "user", "x")]
    rows += [(60, t, "user" if t % 7 == 3 else "assistant", f"t{t}") for t in range(2000)]
    d = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("i", F.lit(2)).repartition(4))
    got = {x.conv_id: x for x in d.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("lost")).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    for c, ts in want.items():
        ts.sort()
        assert [tuple(x) for x in got[c].turns] == [x[1:] for x in ts]
        assert got[c].lost == "".join(x[2] for x in ts if x[1] == "assistant")
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op3_decontamination"])
def test_sql(spark, name):
    from quillon.llm.queries import ORACLES, QUERIES

    compare(QUERIES[name](spark, DATA), ORACLES[name], duck())


def test_decontamination_small(spark):
    items = [(1, " ".join(f"Q{i}" for i in range(20))), (2, "short item"), (3, None), (4, "!!"), (2, "short item"), (None, "lost")]
    text = [(1, "x " * 5 + " ".join(f"q{i}" for i in range(3, 17)) + " y"), (2, "a Short, ITEM! b"), (3, " ".join(f"q{i}" for i in range(12))), (4, None), (5, "lost")]
    d = spark.createDataFrame(text, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.hits(d, b))
    assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) for i in range(1, 6)] == [(20, 14, 1, True), (4, 2, 1, True), (12, 0, 0, False), (0, 0, 0, False), (1, 0, 0, False)]
    assert got[2].items_sha256 == hashlib.sha256(b"2").hexdigest() and got[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.hits(d, b.filter("false")).filter("n_hit > 0").count() == 0
    assert sorted(decontaminate.hits(d, b, most=5).collect()) == sorted(got.values())  # the way for tables too large to broadcast at once


def test_decontamination_is_linear(spark):
    item = " ".join(f"Q{i}" for i in range(13))
    d = spark.createDataFrame([(1, "x " * 200_000 + item + " y" * 200_000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "q1 q2")], "item_id long, text string")
    began = time.time()
    r = decontaminate.hits(d, b, most=5).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (400_013, 13, 2, False) and time.time() - began < 60


def test_keys_with_the_operators_names(spark):
    b = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    for key in ("mark", "score", "k"):
        d = spark.createDataFrame([(1, "a short item", 0), (2, "b " * 60, 0)], f"{key} long, text string, more long")
        assert [r[key] for r in decontaminate.without_contaminated(d, b, key=key).collect()] == [2]
        assert {r[key] for r in decontaminate.hits(d, b, key=key).collect()} == {1, 2}
        assert sorted(r[key] for r in near_dedup.one_of_each(d, key=key).collect()) == [1, 2]
        assert {r[key] for r in near_dedup.near_duplicates(d, key=key).collect()} == {1, 2}
        assert {r[0] for r in lm_scoring.lm_scores(d, key=key).collect()} == {1, 2}
        assert {r[0] for r in license_scan.license_scan(d, key=key).collect()} == {1, 2}


def test_native_plans(spark, docs):
    for df in (license_scan.license_scan(docs), decontaminate.hits(docs, benchmark(spark)), chat_format.format_chats(spark.read.parquet(f"{DATA}/conversations.parquet"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_token_counts(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    more = {-1: "it's I'M a\x1cb <|endoftext|>a <|ENDOFTEXT|> İİ ΣΑΣ ''s 日本語 👍🏽 \x85 É", -2: LONG}
    all_ = texts | more
    got = by_id(token_counts.count_tokens(docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(more.items()), "doc_id long, text string"))))
    for i, x in all_.items():
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(x.encode()), n > 2048)


def test_lm_scores(spark, docs, texts):
    toks = {i: [*x.encode().lower().split(), None] for i, x in texts.items()}
    c = Counter(w for i, x in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    n, v = sum(c.values()), len(c)
    runs = [by_id(lm_scoring.lm_scores(docs, **k)) for k in ({}, {"most_mb": 0.02}, {"frequent": 50}, {"most_words_mb": 0, "frequent": 50})]
    for i, x in toks.items():
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        for got in runs:
            r = got[i]
            assert r.base_score == pytest.approx(want) and (r.n_known, r.n_tokens, r.train_tokens) == (sum(c[w] > 0 for w in x), len(x), n)
            assert r.score < 0 and r.score_per_token == pytest.approx(r.score / len(x))
        assert runs[0][i].score == pytest.approx(runs[1][i].score)
        assert runs[2][i].score == pytest.approx(runs[3][i].score)
    held = [r for r in runs[0].values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("frequent", [1_000_000, 0])
def test_probabilities_sum_to_one(spark, frequent, monkeypatch):
    """Over all words and an unknown one, for each history; with rare histories' shares below 1."""
    monkeypatch.setattr(lm_scoring, "BITS", 400)  # so that nothing is there by chance
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    train = [" ".join(r.choices(vocabulary, [2.0**-i for i in range(12)], k=r.randint(1, 40))) for _ in range(60)]
    train[0] += " " + " ".join(vocabulary)
    ids = iter(i for i in range(10_000) if not lm_scoring.held_out(i))
    held = iter(i for i in range(10_000) if lm_scoring.held_out(i))
    rows = [(next(ids), x) for x in train]
    asked = {}
    for h in vocabulary:
        for w in [*vocabulary, "never", None]:
            i = next(held)
            asked[i] = (h, w)
            rows.append((i, h if w is None else f"{h} {w}"))
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent).collect()}
    m = brute_model([x.split() for x in train])
    weights = m["weights"](frequent)
    for i, (h, w) in asked.items():
        assert got[i] == pytest.approx(m["score"]([h, w] if w else [h], weights, frequent), abs=1e-9)
    for h in vocabulary:
        mass = sum(m["p"](h, w, weights, frequent) for w in [*vocabulary, None, "never"])
        assert mass == pytest.approx(1) if frequent else mass <= 1 + 1e-9


def brute_model(texts):
    """The model as its docstring says, from exact counts in plain Python."""
    one, two = Counter(), Counter()
    for x in texts:
        x = [*x, None]
        one.update(x)
        two.update(zip([None, *x], x))
    level = lambda c: c.bit_length()
    mid = lambda c: 1.5 * 2 ** (level(c) - 1) - 0.5 if c else 0.0
    norm = sum(map(mid, one.values())) + 0.5 * (len(one) + 1)
    sums = Counter()
    for (h, _), c in two.items():
        sums[h] += mid(c)

    def parts(h, w, frequent, less=0):
        c = two[h, w]
        if frequent:
            share = max(mid(c) - less, 0) / max(sums[h] - less, 1)
        else:
            share = max((2 ** (level(c) - 1) if c else 0) - less, 0) / max((2 ** level(one[h]) - 1 if one[h] else 0) - less, 1)
        return min(1, share), (max(mid(one[w]) - less, 0) + 0.5) / norm

    def weights(frequent):
        """By the history's level, the grid's weight that fits best; ratios are binned as the operator does."""
        n = np.zeros((lm_scoring.LEVELS + 1, lm_scoring._BINS))
        for x in texts:
            x = [*x, None]
            for h, w in zip([None, *x], x):
                a, b = parts(h, w, frequent, 1)
                k = int(np.clip((math.log2(a / b) - lm_scoring._LOWEST) * lm_scoring._FINE + 1, 1, lm_scoring._BINS - 1)) if a > 0 else 0
                n[level(one[h]), k] += 1
        ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(1, lm_scoring._BINS) - 0.5) / lm_scoring._FINE + lm_scoring._LOWEST)])
        return lm_scoring.GRID[(n @ np.log(1 - lm_scoring.GRID + np.outer(ratio, lm_scoring.GRID))).argmax(axis=1)]

    def p(h, w, weights, frequent):
        a, b = parts(h, w, frequent)
        k = weights[level(one[h])]
        return k * a + (1 - k) * b

    def score(x, weights, frequent):
        x = [*x, None]
        return sum(math.log10(p(h, w, weights, frequent)) for h, w in zip([None, *x], x))

    return {"p": p, "score": score, "weights": weights}


def test_log_frequency_filter():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 64, 5000, np.uint64))
    counts = r.integers(1, 1000, len(keys))
    f = lm_scoring.Filter(1, {0: lm_scoring.segment(keys, counts)})
    q = f.levels(keys)
    assert (q >= lm_scoring.quantised(counts)).all() and (q == lm_scoring.quantised(counts)).mean() > 0.97
    assert (f.levels(r.integers(0, 1 << 64, 5000, np.uint64)) > 0).mean() < 0.03


def brute_spans(t):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (16 <= len(d) <= 19 and private_data.luhn(d)) or k == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_private_data(docs, texts):
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("a1.@+- (2)05") for _ in range(r.randint(1, 45)))
        assert sorted(private_data.base_spans(t)) == brute_spans(t), t
    got = by_id(private_data.private_data(docs))
    for i, t in texts.items():
        base = brute_spans(t)
        assert [got[i][f"n_{k}"] for k in private_data.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        spelled = private_data.spell(base)
        assert got[i].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_spans == len([*filter(None, got[i].spans.split(","))])


def test_field_on_held_out_documents():
    made = private_data.made_documents(150, 99)
    found = private_data.find([t for t, _ in made], private_data.fitted())
    right = wrong = 0
    for (_, spans), (_, added) in zip(made, found):
        for k, a, b in added:
            ok = any(k == kk and a < d and c < b for (c, d), kk in spans.items())
            right, wrong = right + ok, wrong + (not ok)
    assert right > 60 and wrong <= 0.05 * right
    same = "call +1 (743) 555-3824 " + "x " * 3000 + "or 743-555-3824 now"  # a distant mention of an observed number
    assert [s[0] for s in private_data.find([same], private_data.fitted())[0][1]] == [3]


def test_private_data_is_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "+1 " * 100_000, "1 " * 200_000, "@" * 200_000):
        private_data.base_spans(t)


def test_field_is_linear():
    began = time.time()
    for t in ("a" * 1_000_000 + "1", "中" * 1_000_000 + "@b", "a1@" * 300_000, "x" * 500_000 + " 1 " + "y" * 500_000):
        private_data.find([t], private_data.fitted())
    assert time.time() - began < 10
    for t in ("".join(random.Random(i).choice("ab1@ \n.é") for _ in range(30)) for i in range(2000)):
        assert [m.span() for m in private_data._TOKEN.finditer(t)] == [m.span() for m in re.finditer(r"\S*[0-9@]\S*", t)]


def test_marginals_against_all_labellings():
    """Exact where the edges form a tree; close to it where they form a loop."""
    w = private_data.fitted()
    r = np.random.default_rng(3)
    n = private_data.NONE + 1
    for chain, skip, within in (([(0, 1), (1, 2), (2, 3)], [], 1e-3), ([(0, 1)], [(1, 2), (1, 3)], 1e-3), ([(0, 1), (1, 2), (2, 3)], [(0, 2)], 0.1)):
        for observed in ([-1] * 4, [3, -1, -1, -1]):
            x = (r.random((4, len(private_data.FEATURES))) < 0.15).astype(float)
            g = {"x": x, "observed": np.array(observed), "chain": np.array(chain, int).reshape(-1, 2), "skip": np.array(skip, int).reshape(-1, 2)}
            unary, total = x @ w["unary"], np.zeros((4, n))
            for labels in itertools.product(range(n), repeat=4):
                if all(o in (-1, k) for o, k in zip(observed, labels)):
                    e = sum(unary[i, k] for i, k in enumerate(labels)) + sum(w["chain"][labels[a], labels[b]] for a, b in chain) + sum(w["skip"][labels[a], labels[b]] for a, b in skip)
                    total[range(4), labels] += math.exp(e)
            assert np.abs(private_data.marginals(g, w) - total / total.sum(axis=1, keepdims=True)).max() < within


def check_pieces(rows, ids):
    by = defaultdict(list)
    seq = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, ps in by.items():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]] and sum(p.length for p in ps) == len(ids[d])
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(ids[d][p.start : p.start + p.length].astype("<u4").tobytes()) and p.doc_tokens == len(ids[d])
    for s, ps in seq.items():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]]
        assert sum(p.length for p in ps) == packing.WINDOW or s == max(seq)


def test_packing(spark, docs, texts, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path("byte_bpe_50k.json"))
    more = {-1: "a  b \n c\t\td   ", -2: "x<|endoftext|>y", -3: None, -4: "a\x1c b\x85  c\xa0", -5: LONG}
    d = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(more.items()), "doc_id long, text string")).repartition(5)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in (texts | more).items()}
    check_pieces(packing.pack(d).collect(), ids)
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd).filter("start = 0").count() == odd.count()
    e, r = packing.Encoder(), random.Random(4)
    for _ in range(5000):
        s = "".join(r.choice(["a", " ", "  ", "\n", "é", "'s", "12", ".", "\t", "\xa0", "the", "\x85", "中"]) for _ in range(r.randint(0, 12)))
        assert e(s) == e.whole(s), repr(s)


def brute_components(texts, threshold=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders, up = defaultdict(list), {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        n = Counter(j for x in s for j in holders[x])
        for j, k in n.items():
            if 100 * k >= threshold * (len(s) + len(sets[j]) - k) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
        for x in s:
            holders[x].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def near_texts():
    r = random.Random(9)
    base = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(300)) for _ in range(6)]
    out = {}
    for i in range(260):  # exact and near copies, of which many only just reach the threshold, and texts that share a passage
        w = base[i % 6].split()
        for _ in range(r.choice([0, 0, 1, 2, 4, 5, 6, 7, 8])):
            w[r.randrange(len(w))] = f"v{r.randint(0, 99999)}"
        out[i] = " ".join(w) if i % 13 else " ".join(w[:100]) + " " + " ".join(f"u{r.randint(0, 99999)}" for _ in range(120))
    return out | {1000: "", 1001: "a b", 1002: "A  b", 1003: "a b c d e", 1004: None}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, small, monkeypatch):
    if small:  # the ways for buckets and components that are large
        monkeypatch.setattr(near_dedup, "BUCKET", 5)
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 20)
        monkeypatch.setattr(near_dedup, "LEADERS", 2)
        monkeypatch.setattr(near_dedup, "MOST_BROADCAST", 0)
    t = near_texts()
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(4)))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute_components(t)


def test_threshold_is_a_parameter(spark):
    r = random.Random(4)
    w = [f"w{r.randint(0, 5000)}" for _ in range(300)]
    rows = [(0, " ".join(w)), (1, " ".join("new" if i % 50 == 20 else x for i, x in enumerate(w)))]  # 0.85 > J >= 0.8
    rows += [(2, " ".join(w[:215]))]  # J < 0.8 with both
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (t.split() for _, t in rows)]
    j = lambda a, b: len(s[a] & s[b]) / len(s[a] | s[b])
    assert 0.8 <= j(0, 1) < 0.85 and j(0, 2) < 0.8 and j(1, 2) < 0.8
    assert {r.doc_id for r in near_dedup.one_of_each(docs, threshold=85).collect()} == {0, 1, 2}
    assert {r.doc_id for r in near_dedup.one_of_each(docs, threshold=80).collect()} == {0, 2}
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(docs, threshold=79)


def test_one_of_each_with_any_keys(spark):
    r = random.Random(5)
    a, b, c, d = (" ".join(f"w{r.randint(0, 5000)}" for _ in range(300)) for _ in range(4))
    near = c.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, 0), (1, b, 1), (1, b, 2), (None, c, 3), (None, c, 4), (None, near, 5), (None, d, 6), (7, d, 7), (1, "", 8), (1, None, 9), (None, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").coalesce(1)
    got = sorted(x.row for x in near_dedup.one_of_each(docs).collect())
    assert got[:2] == [0, 1] and got[2] in (3, 4, 5) and got[3:] == [7, 8, 9, 10]


def test_bands_suit_the_threshold():
    for threshold in (80, 85, 90):
        r, missed = np.random.default_rng(threshold), 0
        for _ in range(200):
            k = -(-400 * 2 * threshold // (100 + threshold))
            x = r.integers(0, 1 << 64, 800 - k, np.uint64)
            a, b = (near_dedup.minima(s) for s in (x[:400], x[400 - k :]))
            p, q = (np.frombuffer(near_dedup.packed(m), np.uint64) for m in (a, b))
            near = float(near_dedup.estimates(p, q[None])[0])
            missed += near < near_dedup.least_estimate(threshold) or not (near_dedup.band_keys(a, threshold) == near_dedup.band_keys(b, threshold)).any()
        assert not missed


def test_estimates_are_corrected():
    r = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        e = []
        for _ in range(60):
            x = np.unique(r.integers(0, 1 << 64, 400, np.uint64))
            k = int(400 * 2 * share / (1 + share))
            y = np.unique(np.concatenate([x[:k], r.integers(0, 1 << 64, 400 - k, np.uint64)]))
            a, b = (np.frombuffer(near_dedup.packed(near_dedup.minima(s)), np.uint64) for s in (x, y))
            e.append(float(near_dedup.estimates(a, b[None])[0]))
        assert np.mean(e) == pytest.approx(share, abs=0.04)


def brute_resampling(texts, good):
    """log ratios and sample keys in plain Python whole numbers."""
    import xxhash

    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
        return [x % quality_resampling.BUCKETS for x in h] + [mix((a * 0xD1342543DE82EF95 + b) & mask) % quality_resampling.BUCKETS for a, b in itertools.pairwise(h)]

    each = {i: grams(t) for i, t in texts.items()}
    every, target = Counter(), Counter()
    for i, g in each.items():
        every.update(g)
        if i in good:
            target.update(g)
    p = lambda c, b: (c[b] + 1) / (sum(c.values()) + quality_resampling.BUCKETS)
    logs = {b: math.log(p(target, b)) - math.log(p(every, b)) for b in every}
    ratio = {i: math.fsum(logs[b] for b in g) for i, g in each.items()}
    noise = {i: -math.log(-math.log(((xxhash.xxh3_64_intdigest(str(i).encode(), quality_resampling.SEED) >> 11) + 0.5) / 2**53)) for i in texts}
    return {i: (len(each[i]), ratio[i], ratio[i] + noise[i]) for i in texts}


def test_resampling(spark, docs, texts):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality_resampling.resample(docs, labels).toPandas().sort_values("sample_key", ascending=False)
    merged = got.merge(labels.toPandas(), on="doc_id")
    assert merged[merged.quality == 1].log_ratio.mean() > merged[merged.quality == 0].log_ratio.mean()
    want = brute_resampling(texts, {r.doc_id for r in labels.filter("quality = 1 AND toxic = 0").collect()})
    for r in got.itertuples():
        n, ratio, key = want[r.doc_id]
        assert r.n_grams == n and r.log_ratio == pytest.approx(ratio, abs=1e-8) and r.sample_key == pytest.approx(key, abs=1e-8)
    best = sorted(want, key=lambda i: -want[i][2])[: math.ceil(quality_resampling.FRACTION * len(want))]
    assert set(got[got.kept].doc_id) == set(best)


def test_kth_largest(spark):
    x = np.array([3.5, -2.0, 0.0, -0.0, 1e300, -1e300, 3.5, 7.25])
    d = spark.createDataFrame([(int(v),) for v in quality_resampling.ordered(x)], "o long")
    for k in range(1, len(x) + 1):
        want = int(quality_resampling.ordered(np.sort(x)[::-1][k - 1 : k])[0]) % (1 << 64)
        assert quality_resampling.kth_largest(d, "o", k) == want
    assert quality_resampling.kth_largest(d, "o", 99) is None


def test_quality_rules(docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path(quality_rules.VOCABULARY))
    got = by_id(quality_rules.quality_rules(docs))
    for i, t in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", t)
        lines, seen, dups = t.split("\n"), set(), 0
        for x in lines:
            dups += x in seen and bool(re.search("[^\x20\x09-\x0d]", x))
            seen.add(x)
        n = Counter(zip(words, words[1:], words[2:]))
        at = {k for j, w in enumerate(zip(words, words[1:], words[2:])) if n[w] > 1 for k in (j, j + 1, j + 2)}
        failed = len(words) < 50 or 100 * len(at) > 50 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(at), failed)
        ids = [x for w in words for x in sp.encode(w)]
        assert r.n_tokens == len(ids) and not (r.base_failed and r.kept)
        if ids:
            c = Counter(ids)
            assert r.token_entropy == pytest.approx(-sum(v / len(ids) * math.log2(v / len(ids)) for v in c.values()))
            assert r.byte_share == pytest.approx(sum(3 <= x < 259 for x in ids) / len(ids)) and r.chars_per_token == pytest.approx(r.word_chars / len(ids))


def test_bands_bite_without_a_language(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.1/documents.parquet").drop("lang")
    labels = spark.read.parquet(f"{DATA}/../sf0.1/labels.parquet").filter("doc_id % 2 = 1")  # the bands are from the others
    some = docs.join(labels, "doc_id", "left_semi")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    for bands in (quality_rules.BANDS, quality_rules.fit_bands(docs, labels.filter("doc_id % 4 = 1"))):
        rows = [r for r in quality_rules.quality_rules(some, bands=bands).collect() if not r.base_failed and (bands is quality_rules.BANDS or r.doc_id % 4 == 3)]
        share = lambda q: np.mean([r.kept for r in rows if quality[r.doc_id] == q])  # noqa: E731, B023
        assert share(0) < 0.1 and share(1) > 0.98
        short = [r for r in rows if r.n_tokens < 256 and quality[r.doc_id] == 0]
        assert len(short) >= 5 and np.mean([r.kept for r in short]) <= 0.5  # no size is let off


def test_bands_are_fitted_by_script_and_language(spark):
    good = [(i, " ".join(f"слово{(i * 7 + j * j) % 397}" for j in range(60 + i)), "ru", 1) for i in range(200)]
    bad = [(1000 + i, "спам " * 30 + " ".join(f"реклама{j % 9}" for j in range(80)), "ru", 0) for i in range(20)]
    both = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, quality int")
    bands = quality_rules.fit_bands(both, both, lang="lang")
    assert bands["cyrillic"] == bands["ru"] != quality_rules.BANDS["cyrillic"] and bands["latin"] == quality_rules.BANDS["latin"]
    kept = by_id(quality_rules.quality_rules(both, bands=bands))
    assert sum(kept[i].kept for i, *_ in good) >= 196 and not any(kept[i].kept for i, *_ in bad)
    assert quality_rules.fit_bands(both.filter("false"), both) == quality_rules.fit_bands(both, both.filter("false")) == quality_rules.BANDS
    # a band of a language goes before its script's where the column is named
    none = {"ru": (50.0, 60.0, 0.0, (quality_rules.NOTHING,))}
    assert not any(r.kept for r in quality_rules.quality_rules(both, lang="lang", bands=bands | none).collect())


def test_folders_of_vocabularies(spark, tmp_path):
    """Another folder's vocabulary of the same name isn't taken for the one before."""
    from tokenizers import Tokenizer

    text = "Tokenisation of documents and considerable understanding"
    model = json.loads(Path(token_counts.vocabulary_path(token_counts.VOCABULARY)).read_text())
    model["model"]["merges"] = model["model"]["merges"][:500]
    (tmp_path / token_counts.VOCABULARY).write_text(json.dumps(model))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = [len(Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY, f)).encode(text, add_special_tokens=False).ids) for f in (None, str(tmp_path))]
    got = [token_counts.count_tokens(docs, folder=f).first().n_tokens for f in (None, str(tmp_path), None)]
    assert got == [*want, want[0]] and want[0] < want[1]



SYLLABLES = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "is", "or", "un")]


def test_rejection_bands(spark):
    r = random.Random(1)
    # six syllables alone have too little entropy now, so there are as many as plain text has
    good = " ".join("".join(r.choice(["the", "er", "on", "an", "re", "in", *SYLLABLES]) for _ in range(r.randint(1, 3))) for _ in range(200))
    poor = " ".join("".join(r.choice(["the", "er", "on", "an", "re", "in"]) for _ in range(r.randint(1, 3))) for _ in range(200))
    junk = " ".join(chr(r.randint(0x2800, 0x28FF)) * 3 for _ in range(80)) + " abc"
    rows = [(0, good, None), (1, junk, "en"), (2, poor, None)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bands=quality_rules.BANDS | {"en": quality_rules.BANDS["latin"]}))
    assert got[0].kept and not got[1].kept and not got[1].base_failed and not got[2].kept and not got[2].base_failed
    assert quality_rules.script("Привет мир") == "cyrillic" and quality_rules.script("123") == "other" and quality_rules.script("Éa") == "latin"


def test_window_of_many_items(spark):
    """A window that thousands of items have is one row; its items come in once for all documents that hit it."""
    line = " ".join(f"shared{i}" for i in range(20))
    items = [(f"i{k}", f"{line} own{k} " + " ".join(f"x{k}y{j}" for j in range(k % 15))) for k in range(4000)]
    bench = spark.createDataFrame([*items, items[0], (None, line), ("none", None), ("short", "only three words")], "item_id string, text string")
    found, listed = decontaminate.windows(bench)
    assert found.groupBy("w").count().filter("count > 1").isEmpty() and "array<string>" not in dict(listed.dtypes).values()
    assert listed.groupBy("items").count().agg(F.max("count")).first()[0] == 4000 and listed.count() < 4000 * 15
    docs = [(d, f"pre{d} {line} post") for d in range(6)] + [(7, "only three words"), (8, items[14][1]), (9, "nothing"), (9, None)]
    got = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    every = hashlib.sha256(",".join(sorted(k for k, _ in items)).encode()).hexdigest()
    assert len(got) == 10
    for r in got:
        if r.doc_id < 6 or r.doc_id == 8:
            assert (r.n_items, r.items_sha256) == (4000, every) and r.contaminated
        elif r.doc_id == 7:
            assert (r.n_items, r.n_hit, r.items_sha256) == (1, 3, hashlib.sha256(b"short").hexdigest())
        else:
            assert (r.n_items, r.n_hit, r.items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
