"""Picks against the loop, examples by hand, files by their bytes."""

import io
import random
import zipfile

import pytest

from quillon.operators import sampling as sa
from quillon.sources import files


def loop(rows, total):
    """The rule over all rows, one choice after the other."""
    rows = sorted(rows, key=lambda r: r[0])
    categories = list(dict.fromkeys(r[1] for r in rows if r[1] is not None))
    out, used, names = [], set(), set()
    ref = lambda r: "nan" if r[2] is None else r[2]
    while len(out) < total:
        moved = False
        for c in categories:
            left = [r for r in rows if r[1] == c and r[0] not in used]
            pick = next((r for r in left if ref(r) not in names), left[0] if left else None)
            if pick:
                out.append(pick)
                used.add(pick[0])
                names.add(ref(pick))
                moved = True
                if len(out) >= total:
                    break
        if not moved:
            break
    for r in rows:
        if len(out) < total and r[0] not in used:
            out.append(r)
    return [r[0] for r in out]


@pytest.mark.parametrize("seed", range(6))
def test_unique_pick_is_the_loop(spark, seed):
    rng = random.Random(seed)
    total = rng.choice([1, 5, 12])
    rows = [(i, rng.choice([None, *"abcdefgh"[: rng.randint(1, 8)]]), rng.choice([None, *map(str, range(rng.choice([1, 3, 40])))])) for i in rng.sample(range(1000), rng.choice([3, 30, 300]))]
    df = spark.createDataFrame(rows, "id long, category string, reference string").repartition(4)
    got = sorted((r.place, r.id) for r in sa.pick_unique(df, key="id", category="category", reference="reference", order=["id"], total=total).collect())
    assert [i for _, i in got] == loop(rows, total) and [p for p, _ in got] == list(range(1, len(got) + 1))


def test_examples(spark):
    rows = [("s", i, float(i % 4), "HIGH" if i < 6 else "low", i % 2 == 1) for i in range(14)]
    df = spark.createDataFrame(rows, "system string, row_idx int, x double, confidence string, right boolean")
    got = [(r.side, r.place, r.row_idx) for r in sa.examples(df, "system", "row_idx", df["x"], df["confidence"], df["right"], 2, 3).collect()]
    # the last two of the whole order are the worst: of equal scores the later rows
    assert sorted(got) == [("best", 1, 3), ("best", 2, 7), ("overconfident_error", 3, 2), ("underconfident_success", 1, 7), ("underconfident_success", 2, 11), ("worst", 1, 12), ("worst", 2, 8)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A &amp; B</dc:title><dc:creator>Me</dc:creator></c:coreProperties>')
    return out.getvalue()


def test_decoded_documents(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t)}</w:tc>"
    merged = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    table = f'<w:tbl><w:tr>{cell("wide", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}{cell("down", merged[0])}</w:tr><w:tr>{cell("x")}{cell(" y ")}{cell("", merged[1])}</w:tr></w:tbl>'
    (tmp_path / "a.docx").write_bytes(docx("<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two é</w:t><w:br/><w:t>three</w:t></w:r></w:p>" + table + p(" ") + p("after the table, and long enough to count as text")))
    (tmp_path / "b.docx").write_bytes(docx(p("short")))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.txt").write_bytes(b"plain")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    a = got["a.docx"]
    assert (a.format, a.page_count, a.title, a.author, a.problem) == ("DOCX", None, "A & B", "Me", None)
    assert a.text == "one\ttwo é\nthree\nafter the table, and long enough to count as text\nwide | wide | down\nx | y | down"
    assert got["b.docx"].problem.startswith("Document appears to be empty") and got["b.docx"].text == "short"
    assert got["c.docx"].problem.startswith("Failed to extract") and got["d.txt"].problem == "Unsupported file format: txt"
    (tmp_path / "e.pdf").write_bytes(b"p" * 120 + b"|" + b"q")
    with pytest.raises(Exception, match="no decoder for PDF"):
        files.read_documents(spark, str(tmp_path)).collect()
    decoder = lambda content: (content.decode().split("|"), "T", "")
    pdf = [r for r in files.read_documents(spark, str(tmp_path), decoder).collect() if r.format == "PDF"][0]
    assert (pdf.page_count, pdf.title, pdf.problem, len(pdf.text)) == (2, "T", None, 123)
    thin = [r for r in files.read_documents(spark, str(tmp_path), lambda c: (["x"] * 9, "", "")).collect() if r.format == "PDF"][0]
    assert thin.problem.startswith("Document appears to be scanned")
