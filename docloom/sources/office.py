"""Spark data sources for spreadsheets and word-processing files, read with the standard library.

Both are zip archives of XML. A file is one input partition, so a folder of many files is read in parallel; files are
found and opened through Spark's binaryFile reader, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

SHEET_ROWS = "path string, sheet_index int, sheet_name string, sheet_row int, cells array<string>"
TABLES = "path string, sheet_index int, sheet_name string, table_index int, table_name string, first_row int, last_row int, first_col int, last_col int"
BLOCKS = "path string, block int, kind string, style string, text string, grid array<array<string>>"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheets(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(index from 1 among visible sheets, name, physical row, cells) of rows that aren't blank; values as cached."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        index = 0
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            if sheet.get("state", "visible") != "visible":
                continue
            index += 1
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            part = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for n, row in enumerate(part.iter(f"{_MAIN}row"), 1):
                cells: list[str] = []
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    cells += [""] * (at + 1 - len(cells))
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        text = ""
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    cells[at] = text
                if any(c.strip() for c in cells):
                    yield index, sheet.get("name"), int(row.get("r") or n), cells


def read_tables(content: bytes) -> Iterator[tuple[int, str, int, str, int, int, int, int]]:
    """(sheet's index, its name, table from 0, table's name, first and last row, first and last column from 1) of the tables that visible sheets declare."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        visible = [s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet") if s.get("state", "visible") == "visible"]
        for index, sheet in enumerate(visible, 1):
            part = targets[sheet.get(f"{_REL}id")].lstrip("/").removeprefix("xl/")
            folder, _, file = part.rpartition("/")
            links = f"xl/{folder}/_rels/{file}.rels"
            if links not in names:
                continue
            found = [r.get("Target").rpartition("/")[2] for r in ElementTree.fromstring(z.read(links)) if (r.get("Type") or "").endswith("/table")]
            for n, target in enumerate(found):
                table = ElementTree.fromstring(z.read(f"xl/tables/{target}"))
                first, _, last = table.get("ref").partition(":")
                rows = [int(re.search("[0-9]+", ref)[0]) for ref in (first, last or first)]
                yield index, sheet.get("name"), n, table.get("displayName") or table.get("name") or "", rows[0], rows[1], _column(first) + 1, _column(last or first) + 1


def read_blocks(content: bytes) -> Iterator[tuple[int, str, str, str, list[list[str]]]]:
    """(block from 1, paragraph or table, style, text, grid) of a document's body, in order."""

    def text_of(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_WORD}t"))

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    block = 0
    for node in body:
        if node.tag == f"{_WORD}p":
            block += 1
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            yield block, "paragraph", "" if style is None else style.get(f"{_WORD}val", ""), text_of(node), []
        elif node.tag == f"{_WORD}tbl":
            block += 1
            yield block, "table", "", "", [[text_of(c) for c in row.iter(f"{_WORD}tc")] for row in node.iter(f"{_WORD}tr")]


def _read(spark: SparkSession, path: str, suffix: str, schema: str, reader) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, *r) for r in reader(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES[schema], strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return files.mapInArrow(run, schema)


_TYPES = {
    SHEET_ROWS: [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string())],
    TABLES: [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4],
    BLOCKS: [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string()))],
}


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row of each visible sheet of the .xlsx files below path."""
    return _read(spark, path, "xlsx", SHEET_ROWS, read_sheets)


def declared_tables(spark: SparkSession, path: str) -> DataFrame:
    """A row for each table that a visible sheet of the .xlsx files below path declares."""
    return _read(spark, path, "xlsx", TABLES, read_tables)


def table_rows(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, sheet_index, table_index, sheet_row, cells) of the rows inside declared tables, cut to their columns, short rows padded."""
    both = rows.join(declared.drop("sheet_name"), ["path", "sheet_index"]).filter(F.col("sheet_row").between(F.col("first_row"), F.col("last_row")))
    width = F.col("last_col") - F.col("first_col") + 1
    cut = F.slice("cells", F.col("first_col"), width)
    return both.select("path", "sheet_index", "table_index", "sheet_row", F.concat(cut, F.array_repeat(F.lit(""), width - F.size(cut))).alias("cells"))


def word_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each paragraph and table of the .docx files below path."""
    return _read(spark, path, "docx", BLOCKS, read_blocks)
