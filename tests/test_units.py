import hashlib
import math
import os
import random
import re
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import rules, text
from quillon.operators import metrics, parsing, retrieval, stats
from quillon.operators.relational import topk, upsert
from quillon.sources import workbooks

TRUTH = "row_idx long, query_id string, category string, correct_act string, correct_section string, correct_citation string, summary string, amendment_applies string, transition_applies string, overruling_applies string"
RESPONSE = "system string, row_idx long, query_id string, answer string, confidence string, type1 string, act1 string, section1 string, act2 string, section2 string, transition_note string, trigger_uncertainty boolean"
STORE = "act_name string, section_number string"


def scored(spark, act, section, gt_act, gt_section, answer="x", store=(), query_id="Q1", truth_id="Q1"):
    r = spark.createDataFrame([("s", 0, query_id, answer, "high", "bare_act", act, section, None, None, "", False)], RESPONSE)
    t = spark.createDataFrame([(0, truth_id, "c", gt_act, gt_section, "", "theft", "no", "no", "")], TRUTH)
    j = metrics.joined(r, t)
    return j, metrics.hallucinations(j, spark.createDataFrame(list(store), STORE), spark.createDataFrame([], "citation string"))


def test_fake_section_is_flagged(spark):
    _, h = scored(spark, "Indian Penal Code", "9999", "IPC", "302", "Under Section 9999 of IPC the punishment is death")
    assert h.first().rate > 0


def test_section_label_is_stripped(spark):
    _, h = scored(spark, "IPC", "Section 304A", "IPC", "999", store=[("Indian Penal Code 1860", "304A")])
    assert h.first().rate == 0


def test_expected_citation_is_never_hallucinated(spark):
    _, h = scored(spark, "Indian Penal Code", "Section 420", "IPC", "420")
    assert h.first().sections == 0


def test_swapped_query_id_is_an_error(spark):
    j, _ = scored(spark, "IPC", "302", "IPC", "302", query_id="Q2")
    with pytest.raises(Exception, match="query ids differ"):
        j.collect()


def test_rubric_prefers_the_right_short_answer(spark):
    good, _ = scored(spark, "IPC", "302", "IPC", "302", "theft")
    bad, _ = scored(spark, "Companies Act", "1", "IPC", "302", "word " * 200)
    assert metrics.rubric(good).first().acs > metrics.rubric(bad).first().acs


@pytest.mark.parametrize(("answer", "confidence", "n", "want"), [("I cannot provide a reliable answer.", "high", 0, True), ("Section 302 IPC applies. Death penalty.", "high", 1, False), ("no idea", "low", 0, True), ("no idea", "low", 1, False)])
def test_abstention(spark, answer, confidence, n, want):
    assert spark.range(1).select(rules.abstains(F.lit(answer), F.lit(confidence), F.lit(False), F.lit(n))).first()[0] is want


@pytest.mark.parametrize(("query", "want"), [("What is Section 420?", "section_lookup"), ("AIR 1978 SC 597", "citation_lookup"), ("punishment for theft", "punishment_query"), ("was it amended", "amendment_query"), ("bail", "legal_question")])
def test_query_type(spark, query, want):
    assert spark.range(1).select(rules.query_type(F.lit(query))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [(" Section  420 ", "420"), ("sec. 304A", "304A"), ("Art. 21", "21"), ("123(1)", "123(1)"), ("", "unknown"), ("§", "unknown")])
def test_section_number(spark, raw, want):
    assert spark.range(1).select(text.section_number(F.lit(raw))).first()[0] == want


def test_chunks_cover_the_text(spark):
    words = [f"w{i}" for i in range(1234)]
    got = spark.range(1).select(text.chunks(F.lit(" ".join(words)), 500, 50)).first()[0]
    assert [c.split()[0] for c in got] == [f"w{i}" for i in range(0, 1234, 450)] and got[-1].split()[-1] == "w1233"


@settings(max_examples=5, deadline=None)
@given(st.randoms(use_true_random=False))
def test_fusion_ignores_row_order(spark, r):
    a, b = [(1, d, i + 1) for i, d in enumerate(range(10))], [(1, d, i + 1) for i, d in enumerate(range(9, -1, -1))]
    make = lambda rows: spark.createDataFrame(r.sample(rows, len(rows)), "q long, d long, rank int")
    got = retrieval.fuse([make(a), make(b)], "q", "d")
    assert sorted(got.collect()) == sorted(retrieval.fuse([make(b), make(a)], "q", "d").collect())


def test_bm25_matches_the_formula(spark):
    docs = ["the cat sat", "the dog sat sat", "a bird", "section 420 of law", "bird song"]
    got = retrieval.bm25(spark.createDataFrame(list(enumerate(docs)), "d long, t string"), spark.createDataFrame([(0, "bird sat sat")], "q long, x string"), doc="d", text="t", query="q", query_text="x").collect()
    tok = [["section_420", "of", "law"] if "420" in x else x.split() for x in docs]
    n, avg = len(tok), sum(map(len, tok)) / len(tok)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w in {w for x in tok for w in x} for k in [sum(w in x for x in tok)]}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    want = {i: sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in ["bird", "sat", "sat"] if w in x) for i, x in enumerate(tok)}
    assert {r.d: r.score for r in got} == {i: pytest.approx(v, abs=1e-5) for i, v in want.items() if v}


def test_t_probability():
    assert stats.two_sided_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.two_sided_p(0.0, 5) == 1.0


def test_sentence_packing(spark):
    r = random.Random(1)
    s = " ".join(" ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 12))) + "." for _ in range(50))
    got = spark.range(1).select(parsing.pack_sentences(F.lit(s), 30)).first()[0]
    assert " ".join(got) == s and all(len(x.split()) < 30 for x in got)


def test_upsert_and_topk(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert topk(old.unionAll(new), ["k"], ["v"], 1).count() == 3


def test_act_names_as_literals(spark):
    """Against the names themselves, not the engine's table; the first key of which one is a prefix of the other wins."""
    want = {"IPC": "Indian Penal Code 1860", "indian penal code 186": "Indian Penal Code 1860", "Cr.P.C": "Code of Criminal Procedure 1973", "BNS": "Bharatiya Nyaya Sanhita 2023", "BNSS": "Bharatiya Nagarik Suraksha Sanhita 2023", "IEA": "Indian Evidence Act 1872", "BSA": "Bharatiya Sakshya Adhiniyam 2023", "Consumer Protection Act": "Consumer Protection Act 2019", "HMA": "Hindu Marriage Act 1955", "ACA": "Arbitration and Conciliation Act 1996", "TPA": "Transfer of Property Act 1882", "PWDVA 2005": "Protection of Women from Domestic Violence Act 2005", "POCSO Act": "Protection of Children from Sexual Offences Act 2012", "SRA": "Specific Relief Act 1963", "LA": "Limitation Act 1963", "LAND ACT": "Limitation Act 1963", "BNS Act": "Bharatiya Nyaya Sanhita 2023", "CPC": "Code of Civil Procedure 1908", "NI Act": "Negotiable Instruments Act 1881", "Motor Vehicles Act": None, "": None}
    rows = spark.createDataFrame(list(enumerate(want)), "i long, a string")
    got = {r.a: r.name for r in rows.select("a", metrics.act_name(F.col("a")).alias("name")).collect()}
    assert got == want and len(metrics.ACT_NAMES) == 51 and len(metrics.ACT_VARIANTS) == 16


@pytest.mark.parametrize(("act", "cited", "want"), [("PWDVA", "DOMESTIC VIOLENCE ACT 12", True), ("NIA", "N.I. ACT 138", True), ("ACA", "ARBITRATION ACT 34", True), ("EVIDENCE ACT", "INDIAN EVIDENCE ACT 65B", True), ("HMA", "HINDU SUCCESSION ACT", False), ("UNKNOWN ACT", "THE UNKNOWN ACT 3", True), ("SRA", "", False), ("", "", True)])
def test_act_mentioned(spark, act, cited, want):
    assert spark.range(1).select(metrics.act_mentioned(F.lit(act), F.lit(cited))).first()[0] is want


@pytest.mark.parametrize(("heading", "want"), [("Punishment for theft", "दंड के लिए चोरी"), ("Dishonestly inducing delivery of property", "बेईमानी से प्रेरित करना सुपुर्दगी का संपत्ति"), ("Culpable homicide.", "गैर इरादतन हत्या"), ("Anticipatory bail", "anticipatory जमानत"), ("Offence 3", "अपराध 3"), ("Miscellany", ""), ("", "")])
def test_heading_alias(spark, heading, want):
    assert spark.range(1).select(text.heading_alias(F.lit(heading))).first()[0] == want


@pytest.mark.parametrize(("query", "want"), [("What is Section 5 of the Indian Penal Code?", "Section 5 of the भारतीय दंड संहिता क्या है?"), (" What is the punishment for theft? ", "theft के लिए सजा क्या है?"), ("Has AIR 1950 SC 27 been overruled?", "क्या AIR 1950 SC 27 को निरस्त किया जा चुका है?"), ("bail?", "bail के बारे में कानूनी स्थिति क्या है?"), ("What does Section 9 say?", "Section 9 say के बारे में कानूनी स्थिति क्या है?")])
def test_hindi_query(spark, query, want):
    """The word that is replaced by nothing goes before the templates are tried, so that the first of them never matches."""
    assert spark.range(1).select(text.hindi_query(F.lit(query))).first()[0] == want


def test_act_file(spark):
    body = "ACT_NAME: The Act\nSHORT_NAME: TA\n\n[SECTION 1] Short title\n  This is \n\n one.\n[SECTION 2A] Next\nTwo"
    got = sorted(map(tuple, parsing.act_sections(spark.createDataFrame([(body,), ("\n",)], "v string"), "v").collect()))
    assert got == [("The Act", "TA", "TA_1", "1", "Short title", "Section 1 Short title. This is one."), ("The Act", "TA", "TA_2A", "2A", "Next", "Section 2A Next. Two")]
    with pytest.raises(Exception, match="missing"):
        parsing.act_sections(spark.createDataFrame([("no names",)], "v string"), "v").collect()


def rows_of(spark, name):
    from quillon.plans import QUERIES
    from tests.oracle import DATA

    return [tuple(r) for r in QUERIES[name](spark, DATA).collect()]


def frame(spark, name):
    from quillon.sources.tables import Tables
    from tests.oracle import DATA

    return getattr(Tables(spark, DATA), name).collect()


def test_fallback_split_by_hand(spark):
    want = []
    for r in frame(spark, "clauses"):
        a = re.split(r"\n(?=Section \d+)", r.text)
        parts = a if len(a) >= 10 else re.split(r"\n(?=\d+\.)", r.text)
        want += [(r.doc_id, i, x) for i, x in enumerate(parts) if len(x) >= 30]
    assert sorted(rows_of(spark, "t13_fallback_split")) == sorted(want)


def test_auto_numbers_by_hand(spark):
    want = []
    for r in frame(spark, "clauses"):
        top, out = 0, []
        for h in (x for x in r.text.split("\n") if re.search(r"(?i)^(section|article)\s+[0-9]+|^[0-9]+(\.[0-9]+)*\.?\s+[A-Z]|^[A-Z][A-Z ]{5,60}$", x, re.A)):
            m = re.match(r"(?i)(?:section|article)?\s*(\d+)", h)
            top = max(top, int(m[1])) if m else top + 1
            out.append(m[1] if m else str(top))
        want.append((r.doc_id, ",".join(out)))
    assert sorted(rows_of(spark, "t34_auto_numbers")) == sorted(want)


def test_round_robin_by_hand(spark):
    first = {}
    for r in sorted(frame(spark, "ground_truth"), key=lambda r: r.row_idx):
        first.setdefault(r.query_text, r)
    by = {}
    for r in sorted(first.values(), key=lambda r: r.row_idx):
        by.setdefault(r.category, []).append(r.row_idx)
    turns = [(i + 1, c, v[i]) for i in range(40) for c, v in sorted(by.items()) if i < len(v)]
    assert rows_of(spark, "w11_round_robin") == turns[:40]


def test_random_system_is_fair_and_repeatable(spark):
    got = rows_of(spark, "w17_random_system")
    assert got == rows_of(spark, "w17_random_system") and len({q for q, _ in got}) == len(got) == len(frame(spark, "ground_truth"))
    for s in ("full", "simple", "none"):
        assert len(got) / 3 - 4 * math.sqrt(len(got) * 2 / 9) < sum(x == s for _, x in got) < len(got) / 3 + 4 * math.sqrt(len(got) * 2 / 9)


def test_classifier_fit_by_hand(spark):
    quality = {r.doc_id: float(r.quality) for r in frame(spark, "labels")}
    rows = []
    for r in frame(spark, "documents"):
        if r.doc_id in quality and r.text is not None:
            n = max(len(r.text), 1)
            rows.append((r.doc_id, quality[r.doc_id], 10 * len(re.findall(r"[#*$%&|<>]", r.text)) / n, 10 * len(re.findall("[A-Z!]", r.text)) / n))
    train = np.array([(a, b, 1.0, y) for d, y, a, b in rows if d % 5])
    x, y, w, penalty = train[:, :3], train[:, 3], np.zeros(3), np.array([1.0, 1.0, 0.0])
    for _ in range(50):  # Newton's method on the penalised sum of losses
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    want = {r[0]: 1 / (1 + math.exp(-(r[2] * w[0] + r[3] * w[1] + w[2]))) for r in rows if r[0] % 5 == 0}
    assert {d: p for d, _, p in rows_of(spark, "e23_classifier_fit")} == {d: pytest.approx(p, abs=2e-5) for d, p in want.items()}


def test_works_without_the_optional_folders(tmp_path):
    """In a copy without them the entry point imports, has the engine's own queries, and they run."""
    root = Path(__file__).resolve().parents[1]
    for name in ("quillon", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
from quillon.plans import ORACLES, QUERIES
from quillon.session import session
from tests.oracle import DATA, compare, duck
import quillon, tests.test_queries, tests.test_units
assert quillon.__path__[0].startswith({here!r})
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)
spark = session("local[2]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
for name in ("a01_summary", "r14_structured_citations", "t24_acts_as_written"):
    compare(e.queries()[name](spark, DATA), e.oracle_sql()[name], duck())
assert e.entry(spark).count() > 0
print("fine")
""".format(here=str(tmp_path))
    before = os.environ.get("PYTHONPATH")
    path = os.pathsep.join([str(tmp_path), *([before] if before else []), *[p for p in sys.path if p and Path(p) != root]])
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("fine"), done.stderr


def test_precision_by_hand(spark):
    acts = spark.createDataFrame([(1, "Indian Penal Code 1860", "302"), (2, "Indian Penal Code 1860", "303"), (3, "Code of Criminal Procedure 1973", "302")], "id long, act_name string, section_number string")
    cases = spark.createDataFrame([(1, "AIR 1 SC 1"), (2, "AIR 2 SC 2")], "case_id long, citation string")
    truth = spark.createDataFrame([(0, "Section Lookup", "IPC", "302", ""), (1, "Case Law Search", "IPC", "302", "AIR 2 SC 2"), (2, "Section Lookup", "IPC", "302", ""), (3, "Section Lookup", "", "", "")], "row_idx long, category string, correct_act string, correct_section string, correct_citation string")
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 1, 4), (3, 9, 1)], "row_idx long, doc_id long, rank int")
    got = {r.row_idx: (r.p_at_1, r.p_at_3) for r in metrics.precision_at_k(ranked, truth, acts, cases).collect()}
    assert got == {0: (1.0, 0.5), 1: (0.0, 0.333333), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_semantic_by_hand(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], "a"), ([1.0, 0.0], [-2.0, 0.0], "a"), ([1.0, 0.0], [0.0, 3.0], "a"), ([1.0, 0.0], [1.0, 0.0], " "), (None, [1.0, 0.0], "a"), ([1.0, 0.0], None, "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b array<double>, c array<double>, answer string")
    got = [r[0] for r in df.orderBy("i").select(metrics.semantic(F.col("b"), F.col("c"), F.col("answer"), F.lit(33.3))).collect()]
    assert got == [100.0, 0.0, 50.0, 0.0, 33.3, 33.3]


def test_classified_by_hand(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4, "y int, p int")
    got = stats.classified(rows, F.col("y"), F.col("p")).first().asDict()
    assert got == {"tp": 3, "fp": 2, "fn": 1, "tn": 4, "accuracy": 0.7, "precision_": 0.6, "recall_": 0.75, "f1": 0.666667, "macro_precision": 0.7, "macro_recall": 0.708333, "macro_f1": 0.69697}
    assert set(stats.classified(rows.limit(0), F.col("y"), F.col("p")).first()) == {0}


def test_page_documents_by_hand(spark):
    html = "<html><title>no</title><nav>menu</nav><article class='x'><h1>State &amp; <b>Rao</b></h1><script>var s='Section 9';</script><!-- Section 8 --><p>Under Section 302 of the Indian Penal Code,&nbsp;S. 34.</p></article><footer>Section 7</footer></html>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<p>no article</p>"), (3, "u", None), (4, "u", "<article><p>plain</p></article>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in parsing.page_documents(pages, "page_id", "url", "html").collect()}
    title, content = "State  Rao", "State  Rao Under Section 302 of the Indian Penal Code, S. 34."
    assert set(got) == {1, 4} and (got[1].title, got[1].content, got[1].acts, got[1].sections) == (title, content, "Indian Penal Code", "302|34")
    assert got[1].id == hashlib.sha256((title + content).encode()).hexdigest()[:16] and (got[4].title, got[4].content) == ("Unknown Case", "plain")


def test_workbook_round_trip(spark, tmp_path):
    kinds = "a string, b double, c long, d boolean, e string"
    rows = [("x & <y>", 0.1, 7, True, "two\nlines"), (None, None, None, None, "_x0041_ \r\x0b _x"), ("  spaces ", -1e300, -(1 << 40), False, "\U0001f600 ü"), ("", 3.0, 0, None, '"quoted"')]
    df = spark.createDataFrame(rows, kinds)
    for i in range(2):
        workbooks.write_workbook({"First": spark.range(3), "Data & more": df}, f"{tmp_path}/book{i}.xlsx")
    read = lambda sheet, schema: sorted(map(repr, map(tuple, workbooks.read_sheet(spark, str(tmp_path), sheet, schema).collect())))
    assert read("Data & more", kinds) == sorted(map(repr, rows * 2))
    assert read("Data & more", "e string, gone int") == sorted(repr((r[4], None)) for r in rows * 2)
    assert read("First", "id int") == sorted(repr((i,)) for i in [0, 1, 2] * 2) and read("None", "id int") == []
    with pytest.raises(ValueError, match="more than 2 rows"):
        workbooks.write_workbook({"First": spark.range(3)}, f"{tmp_path}/more.xlsx", most=2)
    with pytest.raises(ValueError, match="longer than a cell"):
        workbooks.write_workbook({"First": spark.range(1).select(F.repeat(F.lit("x"), 32_768))}, f"{tmp_path}/long.xlsx")


def test_workbook_of_another_program(spark, tmp_path):
    """Shared strings, cells by reference with gaps, an absolute target, an empty row."""
    main, rel = workbooks.MAIN, workbooks.RELATIONS
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="4" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="q" Target="/xl/sheets/own.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>far</t></r><r><t> out</t></r></si></sst>')
        z.writestr("xl/sheets/own.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="AB1" t="str"><v>last</v></c></row><row r="2"><c r="AB2"><v>2.0</v></c></row><row r="3"/><row r="4"><c r="A4"><v>1</v></c><c r="B4" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert sorted(map(repr, map(tuple, workbooks.read_sheet(spark, str(tmp_path / "b.xlsx"), "S", "name string, last long").collect()))) == ["('far out', None)", "(None, 2)"]
