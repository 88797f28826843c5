"""Workbooks (.xlsx): reports that people read and fill in, and what they filled in."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

# Fixed values of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
MOST_ROWS, MOST_CHARACTERS = 1_048_575, 32_767


def read_sheet(spark: SparkSession, path: str, sheet: str, schema: str) -> DataFrame:
    """Rows of the named sheet of every workbook at ``path``, by the names in the sheet's first row.

    Columns that a workbook lacks are null, others aren't read; a workbook
    without the sheet, or with an empty one, has no rows; rows without any value
    are left out. Dates are the numbers that the workbook holds. Workbooks are
    read in parallel, one a row of ``binaryFile``.
    """
    fields = StructType.fromDDL(schema).fields
    strings = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_rows(sheet, [f.name for f in fields]), ", ".join(f"`{f.name}` string" for f in fields))
    value = lambda f: F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, IntegralType) else F.col(f"`{f.name}`")
    return strings.select(*[value(f).cast(f.dataType).alias(f.name) for f in fields])


def _rows(sheet: str, names: list[str], size: int = 1000):
    """A sheet's rows as strings; nested, so that it travels to the workers by value."""
    main, relation = f"{{{MAIN}}}", f"{{{RELATIONS}}}id"

    def run(batches):
        import io
        import re
        import zipfile
        from xml.etree.ElementTree import fromstring, iterparse

        import pyarrow as pa

        def said(e):
            return re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in e.iter(f"{main}t")))

        def rows(book):
            at = {s.get("name"): s.get(relation) for s in fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet")}.get(sheet)
            if at is None:
                return
            target = {r.get("Id"): r.get("Target") for r in fromstring(book.read("xl/_rels/workbook.xml.rels"))}[at]
            shared = [said(s) for s in fromstring(book.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in book.namelist() else []
            for _, e in iterparse(book.open(target[1:] if target[0] == "/" else f"xl/{target}")):
                if e.tag != f"{main}row":
                    continue
                cells, place = {}, 0
                for c in e.iter(f"{main}c"):
                    letters = re.match("[A-Z]*", c.get("r") or "")[0]
                    if letters:
                        place = 0
                        for x in letters:
                            place = place * 26 + ord(x) - 64
                    else:
                        place += 1
                    kind, v = c.get("t"), c.findtext(f"{main}v")
                    cells[place] = said(c) if kind == "inlineStr" else shared[int(v)] if kind == "s" and v else v
                e.clear()
                yield cells

        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    each, out = rows(book), []
                    column = {name: place for place, name in next(each, {}).items()}
                    for cells in each:
                        if any(v is not None for v in cells.values()):
                            out.append([cells.get(column.get(n)) for n in names])
                        if len(out) == size:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=names)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=names)

    return run


def write_workbook(sheets: dict[str, DataFrame], path: str, most: int = 100_000) -> None:
    """One workbook with a sheet for each name, at a path of any file system that Spark knows.

    A workbook is for people: its tables pass the driver, so one of more than
    ``most`` rows (at most MOST_ROWS) is an error, as is a text longer than a
    cell takes. Nulls are empty cells; what isn't a number or a boolean is written as text.
    """
    most = min(most, MOST_ROWS)
    spark = next(iter(sheets.values())).sparkSession
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as book:
        n = range(1, len(sheets) + 1)
        book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KINDS}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KINDS}.worksheet+xml"/>' for i in n) + "</Types>")
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, sheets, strict=True)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, (name, df) in zip(n, sheets.items(), strict=True):
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{name} has more than {most} rows: write it as CSV or Parquet")
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for r in (df.columns, *rows):
                    out.write(("<row>" + "".join(map(_cell, r)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(made.getvalue())
    finally:
        stream.close()


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, float) and abs(v) < float("inf") or isinstance(v, int) and abs(v) <= 1 << 53:
        return f"<c><v>{v!r}</v></c>"
    if len(str(v)) > MOST_CHARACTERS:
        raise ValueError(f"a text of {len(str(v))} characters is longer than a cell takes ({MOST_CHARACTERS})")
    text = re.sub("_(?=x[0-9A-F]{4}_)|[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", str(v))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
