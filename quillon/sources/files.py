"""Documents out of files: text, title and author, where the text is dense enough to have been typed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters a page (of DOCX, which has no pages, a file) below which a document counts as scanned or empty.
DENSITY = 50
SCHEMA = "path string, format string, page_count int, title string, author string, text string, problem string"


def _reader(pdf: Callable[[bytes], tuple[list[str], str, str]] | None):
    """Batches of (path, content) to rows of SCHEMA; nested, so that it travels to the workers by value."""
    density = DENSITY
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    core = "{http://purl.org/dc/elements/1.1/}"

    def said(e) -> str:
        marks = {f"{word}tab": "\t", f"{word}br": "\n", f"{word}cr": "\n"}
        return "".join((x.text or "") if x.tag == f"{word}t" else marks.get(x.tag, "") for x in e.iter())

    def cells(row, above: list[str]) -> list[str]:
        """A row's cells by column: a wide cell comes once a column, one merged with the cell above has its text."""
        out: list[str] = []
        for c in row.findall(f"{word}tc"):
            span, merge = c.find(f"{word}tcPr/{word}gridSpan"), c.find(f"{word}tcPr/{word}vMerge")
            text = "\n".join(map(said, c.findall(f"{word}p"))).strip()
            if merge is not None and merge.get(f"{word}val") != "restart" and len(out) < len(above):
                text = above[len(out)]
            out += [text] * int(span.get(f"{word}val") if span is not None else 1)
        return out

    def docx(content: bytes) -> tuple[str, str, str]:
        import io
        import zipfile
        from xml.etree import ElementTree

        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{word}body")
            about = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
        lines = [t for p in body.findall(f"{word}p") if (t := said(p)).strip()]
        for table in body.findall(f"{word}tbl"):
            above: list[str] = []
            for row in table.findall(f"{word}tr"):
                above = cells(row, above)
                line = " | ".join(above)
                lines += [line] if line.strip() else []
        of = lambda name: (about.findtext(f"{core}{name}") or "") if about is not None else ""
        return "\n".join(lines).strip(), of("title"), of("creator")

    def one(path: str, content: bytes) -> tuple:
        kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        if kind == "docx":
            try:
                text, title, author = docx(content)
            except Exception as e:  # one broken file isn't the others' end: its row says so
                return path, "DOCX", None, None, None, None, f"Failed to extract text from DOCX: {type(e).__name__}"
            return path, "DOCX", None, title, author, text, None if len(text) >= density else "Document appears to be empty or contains insufficient text."
        if kind == "pdf":
            if pdf is None:
                raise ValueError(f"no decoder for PDF is given: {path}")
            try:
                pages, title, author = pdf(content)
            except Exception as e:
                return path, "PDF", None, None, None, None, f"Failed to extract text from PDF: {type(e).__name__}"
            text = "".join(f"{p}\n\n" for p in pages).strip()
            return path, "PDF", len(pages), title, author, text, None if len(text) / max(len(pages), 1) >= density else "Document appears to be scanned or contains insufficient text."
        return path, kind.upper(), None, None, None, None, f"Unsupported file format: {kind}"

    def run(batches):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4]
        for b in batches:
            for i in range(b.num_rows):
                row = one(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["path", "format", "page_count", "title", "author", "text", "problem"])

    return run


def decoded(files: DataFrame, pdf: Callable[[bytes], tuple[list[str], str, str]] | None = None) -> DataFrame:
    """Of files (path, content) the rows of SCHEMA, one a file.

    A DOCX file's text is that of its paragraphs, then of its tables' rows; what
    is too short, broken or of another kind has a problem, which says what. ``pdf`` gives
    a PDF's pages, title and author from its bytes; a PDF without it is an error.
    """
    return files.filter(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content").mapInArrow(_reader(pdf), SCHEMA)


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], tuple[list[str], str, str]] | None = None) -> DataFrame:
    """decoded() of the files under a path."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), pdf)


def _writer():
    """Batches of (path, title, text) to (path, content): DOCX files, a paragraph for each line; nested, so that it travels to the workers by value."""

    def docx(title: str, paragraphs: list[str]) -> bytes:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        space = "http://schemas.openxmlformats.org"
        kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            z.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="{space}/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>')
        return made.getvalue()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, title, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([docx(title or "", (text or "").split("\n"))])], names=["path", "content"])

    return run


def as_docx(documents: DataFrame) -> DataFrame:
    """Rows (path, title, text) as files (path, content), which decoded() reads."""
    return documents.select("path", "title", "text").mapInArrow(_writer(), "path string, content binary")
