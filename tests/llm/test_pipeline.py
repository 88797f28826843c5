"""The pipeline, stage by stage, against brute force."""

import re

from quillon.llm import private_data, quality_rules
from quillon.llm.common import written
from tests.llm.test_ops import brute_components, brute_spans, check_pieces
from tests.oracle import DATA


def test_stages(spark):
    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quillon.llm.token_counts import vocabulary_path

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, out = docs.columns, []
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, DATA), name)
        out.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    start = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    judged = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    a, b, c, d = ({r.doc_id: r for r in rows} for rows in out[:4])
    assert set(a) == {i for i, k in judged.items() if k} and all(a[i] == start[i] for i in a)
    want = brute_components({i: r.text for i, r in a.items()}, 80)
    assert set(b) == {i for i, x in want.items() if x[2]} and all(b[i] == a[i] for i in b)
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    grams = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [words(r.text)] if w for i in range(max(1, len(w) - 12))}
    clean = set()
    for i, r in b.items():
        w = words(r.text)
        hit = {p for n in {len(g) for g in grams} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in grams for p in range(s, s + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert set(c) == clean and all(c[i] == b[i] for i in c)
    assert set(d) == set(c)
    for i, r in d.items():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not any(private_data.find([c[i].text], private_data.fitted())[0]):
            assert r == c[i]
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    check_pieces(out[4], {i: np.array([*t.encode(r.text, add_special_tokens=False).ids, 1]) for i, r in d.items()})


def test_empty_and_null_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.filter("false").unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema))
    for frame in (docs.filter("false"), odd):
        for name, f in corpus_pipeline.STAGES:
            frame = written(f(spark, frame, DATA), name)
            if name == "packing":
                assert frame.count() == 0


def test_tables_are_deleted(spark):
    """run() leaves the table of its rows; an operator's go when the block around it ends."""
    import corpus_pipeline
    from quillon.llm import common
    from quillon.llm.decontaminate import op3_decontamination

    root = common.Path(common.shared_dir(spark).removeprefix("file:")) / "quillon"
    there = lambda: {p.name for p in root.iterdir()} if root.exists() else set()
    before = there()
    n = corpus_pipeline.run(spark, DATA).count()
    left = there() - before
    assert n > 0 and len(left) == 1 and min(left).startswith("packing-")
    with common.released(spark) as keep:
        df = op3_decontamination(spark, DATA)
        kept = written(df, "result")
        keep.append(kept)
        assert len(there() - before - left) > 1
    assert {p.split("-")[0] for p in there() - before - left} == {"result"} and kept.count() == 200
    common.drop(kept)
    assert there() == before | left
