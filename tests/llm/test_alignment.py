"""op12: groups, links and counts against a plain working-out of the contract."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import tokenizer_alignment as ta
from tests.oracle import DATA

ODD = [None, "", " ", "  two  blanks ", "a\n\n b\t c", "▁ literal", "x▁y", "<|endoftext|> and <s> here", "naïve Éa 日本語 🙂‍🙂", "same words here", "same words here", "\x1c\x1d odd", "end ", " start", "é ́x", "word" * 300, "a" * 5000, " " * 3000, "!" * 700 + " ?", "тест 한국어 ‮rtl", "\x00 nul"]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(libraries, texts):
    """By byte offsets: (n_a, n_b, n_groups, n_links, n_best, count_sum, hash) of each text."""
    a, sp = libraries
    letters = ta.token_bytes_a({chr(c): i for i, c in enumerate([*range(33, 127), *range(161, 173), *range(174, 324)])})
    of = {chr(c): x for c, x in zip([*range(33, 127), *range(161, 173), *range(174, 324)], letters, strict=True)}
    rows, docs = [], Counter()
    for t in texts:
        if not t:
            rows.append(None)
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        ids_a, bytes_a = e.ids, [b"".join(of[c] for c in a.id_to_token(i)) for i in e.ids]
        ids_b = sp.encode(t)
        pieces = [sp.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            rows.append(None)
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for x in parts:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups = [([i for i, e in zip(ids_a, ends[0], strict=True) if lo < e <= hi], [i for i, e in zip(ids_b, ends[1], strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        links = Counter()
        for x, y in groups:
            for i, k in Counter(x).items():
                for j, m in Counter(y).items():
                    links[i, j] += k * m
        docs.update({*links})
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    highest = Counter()
    for (i, _), n in docs.items():
        highest[i] = max(highest[i], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], sum(r[3].values()), sum(k for p, k in r[3].items() if docs[p] == highest[p[0]]), sum(k * docs[p] for p, k in r[3].items()), r[4]) for r in rows]


def figures(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def worked_out(spark, libraries):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    both = docs.unionAll(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")).persist()
    rows = both.collect()
    want = plain(libraries, [r.text for r in rows])
    assert sum(w[0] == 0 for w in want) < len(ODD)
    return both, {r.doc_id: w for r, w in zip(rows, want, strict=True)}


@pytest.mark.parametrize("most", [ta.MOST_PAIRS, 0])
def test_alignment_against_offsets(worked_out, most):
    docs, want = worked_out
    assert figures(ta.align(docs, most=most)) == want


def test_transducer_states():
    t = ta.Transducer([b"", b"ab", b"c", b"abc"], [b"", b"a", b"bc", b"abc", b"x"])
    assert t([1, 2], [1, 2]) == [([1, 2], [1, 2])]
    assert t([3], [3]) == [([3], [3])] and t([1, 2, 3], [3, 1, 2]) == [([1, 2], [3]), ([3], [1, 2])]
    assert t([1], [4]) is None and t([1], [1]) is None and t([], [1]) is None and t([], []) == []
    assert t.step(0, 1) % 2 == 0 and t.residuals[t.step(0, 1)] == b"ab"  # A leads
    assert t.step(t.step(0, 2), 3) == -1


def test_alignment_of_odd_rows(spark):
    rows = [(1, "same text", "x"), (1, "same text", "y"), (None, "same text", "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string").withColumn("row", F.lit(1)).withColumn("n_a", F.lit("clash"))
    out = ta.align(docs).orderBy("n_a").collect()
    assert len(out) == 4 and [r.n_a for r in out] == [0, 2, 2, 2] and {r.count_sum for r in out[1:]} == {6}
    assert ta.align(docs.filter("false")).count() == 0
