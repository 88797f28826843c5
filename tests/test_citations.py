"""Masking and structured citations by hand: places, order, overlaps, nesting, scores."""

import json

from quillon.operators import citations as c

VALID = [("Section 302", "Indian Penal Code 1860"), ("Section 73", "Indian Contract Act 1872")]
GONE = "[citation removed - not verified]"


def masked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = c.mask_citations(df, spark.createDataFrame(VALID, "section string, act string"), ["i"], "t").collect()
    return [(r.t, r.n_citations, r.n_valid, r.n_invalid) for r in sorted(out)]


def test_masking(spark):
    got = masked(spark, [
        "Section 302 of Indian Penal Code 1860 and no more.",
        "Section 999 of Indian Penal Code 1860 and no more.",
        "Indian Contract Act 1872, Section 73",
        "Indian Contract Act 1872 Section 74; é Section 5 of Land Act 1894",
        "SECTION 302 OF INDIAN PENAL CODE 1860",  # another spelling isn't in the table
        "Section 9 of Land Act 1894. Section 9 of Land Act 1894.",  # one citation, replaced where it first stands
        None,
        "",
        "Section 9 of the Land Act, 1894",
    ])
    assert got == [
        ("Section 302 of Indian Penal Code 1860 and no more.", 1, 1, 0),
        (f"{GONE} and no more.", 1, 0, 1),
        ("Indian Contract Act 1872, Section 73", 1, 1, 0),
        (f"{GONE}; é {GONE}", 2, 0, 2),
        (GONE, 1, 0, 1),
        (f"{GONE}. Section 9 of Land Act 1894.", 1, 0, 1),
        (None, 0, 0, 0),
        ("", 0, 0, 0),
        ("Section 9 of the Land Act, 1894", 0, 0, 0),
    ]


def test_overlapping_spans_from_the_right(spark):
    """Both ways read the middle; the later span is replaced first, and the earlier one's end counts in what then stands there."""
    t = "see Section 5 of Land Act 1894, Section 6 of Sea Act 1900"
    rows = sorted(c.citations_in(spark.createDataFrame([(1, t)], "i int, t string"), ["i"], "t").collect(), key=lambda r: (r.start, r.way))
    assert [(r.start, r.end, r.section, r.act) for r in rows] == [(0, 41, "Section 6", "see Section 5 of Land Act 1894"), (4, 30, "Section 5", "Land Act 1894"), (32, 57, "Section 6", "Sea Act 1900")]
    want = t
    for r in reversed(rows):
        want = want[: r.start] + GONE + want[r.end :]
    assert masked(spark, [t]) == [(want, 3, 0, 3)]


def test_masking_in_json(spark):
    bad, good = "Section 1 of Land Act 1894", "Section 302 of Indian Penal Code 1860"
    answer = {
        "risks": [{"why": f'a "quoted" {bad}\n', "deep": [[{"x": [good, bad, 5, None, True]}]], bad: "a key stays"}, bad],
        "overview": f"é {bad}; \\ {good}",
        "suggested_revisions": {"n": 1.5},
        "other": bad,
    }
    rows = [(1, json.dumps(answer)), (2, json.dumps({"other": bad})), (3, "no json " + bad), (4, None), (5, json.dumps([bad])), (6, "{}")]
    df = spark.createDataFrame(rows, "i int, response string")
    out = {r.i: r for r in c.mask_json(df, spark.createDataFrame(VALID, "section string, act string"), ["i"], "response").collect()}
    got = json.loads(out[1].response)
    assert got == {
        "risks": [{"why": f'a "quoted" {GONE}\n', "deep": [[{"x": [good, GONE, 5, None, True]}]], bad: "a key stays"}, GONE],
        "overview": f"é {GONE}; \\ {good}",
        "suggested_revisions": {"n": 1.5},
        "other": bad,
    }
    assert (out[1].n_citations, out[1].n_valid, out[1].n_invalid) == (6, 2, 4)
    for i in (2, 3, 4, 5, 6):
        assert out[i].response == dict(rows)[i] and out[i].n_citations == 0


def places(spark, query, sources):
    q = spark.createDataFrame([(1, query)], "row_idx int, query string")
    s = spark.createDataFrame([(1, i, *x) for i, x in enumerate(sources)], "row_idx int, pos int, type string, name string, reference string, replaced_by string")
    return [(r.type, r.act_or_case, r.section_or_citation, r.score) for r in sorted(c.structured_citations(s, q).collect(), key=lambda r: r.place)]


def test_structured_citations(spark):
    sources = [
        ("case_law", "State v. X", "AIR 1978 SC 597", None),
        ("bare_act", "Companies Act 2013", "420", None),
        ("bare_act", "indian penal code", "Section 302", "BNS Section 103"),
        ("bare_act", "Indian Penal Code 1860", "420", "BNSS section 9"),
        ("bare_act", "", "1", None),
        ("case_law", "State v. X", "", None),
    ]
    assert places(spark, "What is Section 420 of the IPC?", sources) == [
        ("query_hint", "IPC", "Section 420", 1000),
        # the pair itself scores 100 + 60 + 80 + 400 and goes as a repeat of the question's own
        ("bare_act", "Companies Act 2013", "Section 420", 180),
        ("bare_act", "IPC", "Section 302", 60),
        ("bare_act_transition", "BNS", "Section 103", 10),
        ("bare_act_transition", "BNSS", "Section 9", 10),
        ("case_law", "State v. X", "AIR 1978 SC 597", 0),
    ]
    # no section asked for: only the act counts; digits beside letters are told apart
    assert places(spark, "IPC on 12A3 and 302", sources)[0] == ("bare_act", "IPC", "Section 302", 160)
    assert places(spark, None, sources)[0][3] == 10
    # without the word "section" the pair isn't boosted by 400, though both match
    assert ("bare_act", "CRPC", "Section 41(1)", 60) in places(spark, "crpc 41", [("bare_act", "Code of Criminal Procedure 1973", "41(1)", None)])
    assert places(spark, "धारा 420 आईपीसी", [("bare_act", "Indian Penal Code", "420", None)]) == [("query_hint", "IPC", "Section 420", 1000)]


def test_hints(spark):
    qs = ["s. 5 bns", "BNSS 35", "the NIA", "sec 12b domestic violence act", "no hint", "IPC", "section 9"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    act, section, _, lookup = c.query_hints(df["q"])
    assert [tuple(r) for r in df.select(act, section, lookup).collect()] == [("BNS", "5", True), ("BNSS", "35", False), ("NIA", "", False), ("PWDVA", "12B", True), ("", "", False), ("IPC", "", False), ("", "9", True)]


def test_texts_are_searched_once(spark):
    from quillon.operators import citations as c

    texts = spark.createDataFrame([(1, "By Stamp Act 1899, Section 3; and\nSection 5 of Land Act 1894"), (2, None), (3, "")], "id long, t string")
    got = c.citations_in(texts, ["id"], "t")
    assert sorted((r.section, r.act, r.start) for r in got.collect()) == [("Section 3", "By Stamp Act 1899", 0), ("Section 5", "Land Act 1894", 34)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
