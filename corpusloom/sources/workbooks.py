"""Excel workbooks (xlsx), read and written by the tasks: zip parts, shared strings, sheets as streams of XML.

A file is read by one task, row by row; only its shared strings are held. Values come back as text, as they are stored
(a date is a serial number), an empty cell as the empty text.

Defined results: a file that is no workbook gives one row with ``error``; a row without cells is left out; cells
without a reference follow the one before; an empty table writes no file.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, fromstring, iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, sheet string, row long, cells array<string>, error string"
# Fixed values of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA, from a cell's reference such as ``AA7``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def column_name(n: int) -> str:
    name = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def _text(element) -> str:
    """The text of a shared or inline string; phonetic runs are left out."""
    return "".join(t.text or "" for part in ([element] if element.find(f"{_MAIN}t") is not None else element.findall(f"{_MAIN}r")) for t in part.findall(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, element in iterparse(part):
            if element.tag == f"{_MAIN}si":
                found.append(_text(element))
                element.clear()
    return found


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in their order."""
    target = {r.get("Id"): r.get("Target") for r in fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), part(target[s.get(f"{_REL}id")])) for s in fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(row number from 1, cells) of a sheet, as a stream."""
    number = 0
    with book.open(part) as stream:
        for _, row in iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r") or number + 1)
            cells: list[str] = []
            for cell in row.findall(f"{_MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t", "n")
                if kind == "inlineStr":
                    inline = cell.find(f"{_MAIN}is")
                    text = _text(inline) if inline is not None else ""
                else:
                    text = (value.text or "") if value is not None else ""
                    text = shared[int(text)] if kind == "s" and text else text
                cells += [""] * (at - len(cells))
                cells.append(text)
            row.clear()
            if cells:
                yield number, cells


def workbook_rows(spark: SparkSession, path: str, *, first_sheet: bool = False, pattern: str = "*.xlsx") -> DataFrame:
    """ROWS of all workbooks below ``path``, of all their sheets or the first; a task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                name, held = batch.column(0)[k].as_py(), []
                try:
                    with zipfile.ZipFile(io.BytesIO(batch.column(1)[k].as_py())) as book:
                        shared = _shared(book)
                        for sheet, part in sheets(book)[: 1 if first_sheet else None]:
                            for row, cells in sheet_rows(book, part, shared):
                                held.append((name, sheet, row, cells, None))
                                if len(held) == 1024:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                                    held = []
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ParseError, OSError) as e:
                    held.append((name, None, None, None, f"{type(e).__name__}: {e}"))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ROWS)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of the workbooks below ``path`` as one table of text columns, named by the first file's first row (Column_i without a name).

    Only that row reaches the driver. Files that are no workbooks are left out; ``workbook_rows`` has their errors.
    """
    rows = workbook_rows(spark, path, first_sheet=True).where("error is null")
    heads = F.min_by(F.struct("row", "cells"), F.struct("path", "row"))
    head = rows.agg(heads.alias("h")).first()["h"]
    if head is None:
        return spark.createDataFrame([], "Column_0 string")
    names = [c.strip() or f"Column_{i}" for i, c in enumerate(head["cells"])]
    first = rows.groupBy("path").agg(F.min("row").alias("head"))
    body = rows.join(first, "path").where(F.col("row") > F.col("head"))
    return body.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def _sheet(names: list[str], rows: Iterator[list[str | None]]) -> bytes:
    def line(number: int, cells) -> str:
        each = (f'<c r="{column_name(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(cells) if v)
        return f'<row r="{number}">{"".join(each)}</row>'

    lines = [line(1, names), *(line(n, cells) for n, cells in enumerate(rows, 2))]
    return f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>'.encode()


def write_workbooks(df: DataFrame, path: str, *, most_rows: int = 100_000) -> DataFrame:
    """``df`` as workbooks below ``path``, ``most_rows`` rows each at most, written by the tasks and put in place by a rename; (path, rows) when it is run."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for lo in range(0, batch.num_rows, most_rows):
                part = batch.slice(lo, most_rows)
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as book:
                    for name, text in _PARTS.items():
                        book.writestr(name, text)
                    book.writestr("xl/worksheets/sheet1.xml", _sheet(names, zip(*(c.to_pylist() for c in part.columns))))
                name = f"{folder}/{uuid.uuid4().hex}"
                with store.open_output_stream(f"{name}.part") as out:
                    out.write(packed.getvalue())
                store.move(f"{name}.part", f"{name}.xlsx")
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.xlsx"]), pa.array([part.num_rows], pa.int64())], names=["path", "rows"])

    return df.select(*[F.col(c).cast("string").alias(c) for c in names]).mapInArrow(run, "path string, rows long")
