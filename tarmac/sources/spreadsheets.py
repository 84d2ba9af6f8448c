"""Spreadsheets and archives of them as rows of cells: one row of text cells per sheet row, parsed file by file in tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the parts of an Office Open XML workbook.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

_ROWS_OF_A_BATCH = 2000


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for _, item in ElementTree.iterparse(f) if item.tag == f"{MAIN}si"]


def _sheets(book: zipfile.ZipFile) -> list[str]:
    """Members of the sheets, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return ["xl/" + targets[s.get(f"{LINKS}id")].removeprefix("/xl/") for s in listed]


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _rows(book: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[list[str | None]]:
    with book.open(member) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for i, cell in enumerate(row.iter(f"{MAIN}c")):
                at = _column(cell.get("r", "")) if cell.get("r") else i
                cells.extend([None] * (at + 1 - len(cells)))
                value = cell.find(f"{MAIN}v")
                if cell.get("t") == "s" and value is not None:
                    cells[at] = strings[int(value.text)]
                elif cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif value is not None:
                    cells[at] = value.text
            row.clear()
            if any(c is not None and c.strip() for c in cells):
                yield cells


def _first_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet that has any."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _strings(book)
        for sheet in _sheets(book):
            empty = True
            for row in _rows(book, sheet, strings):
                empty = False
                yield row
            if not empty:
                return


def _books(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """A workbook itself, or those in a zip file, in order, named behind an exclamation mark; lock files are skipped."""
    if name.lower().endswith(".xlsx"):
        yield name, content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in sorted(archive.namelist()):
            if member.lower().endswith(".xlsx") and not member.rpartition("/")[2].startswith("~$"):
                yield f"{name}!/{member}", archive.read(member)


def read_sheets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row, cells) of the first non-empty sheet of every workbook (xlsx) below ``path``; lock files are skipped.

    Workbooks in zip files are read without being unpacked, one in memory at a time; their path is that of the zip file,
    ``!/`` and the name in it. A workbook, as a zip file, is read by one task, row by row; numbers are texts as they stand in the file, empty rows are left out.
    Cells are given as text, so that codes and identifiers keep their digits.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xlsx,zip}").load(path)
    files = files.where(~F.regexp_extract("path", r"([^/]*)$", 1).startswith("~$")).select("path", "content")
    names = ["path", "row", "cells"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, book in _books(file, content.as_py()):
                    held: list[list[str | None]] = []
                    start = 0
                    for cells in _first_rows(book):
                        held.append(cells)
                        if len(held) == _ROWS_OF_A_BATCH:
                            yield _batch(name, start, held)
                            start, held = start + len(held), []
                    if held:
                        yield _batch(name, start, held)

    def _batch(name, start, rows):
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(start, start + n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=names)

    return files.mapInArrow(parse, "path string, row long, cells array<string>")


def with_header(sheets: DataFrame, columns: list[str]) -> DataFrame:
    """(path, row, one column per name): cells under the named headers of the first row of each file, matched by letters in any case.

    A header that a file lacks gives nulls. Files have one header each, so the join's small side has one row per file.
    """
    heads = sheets.where("row = 0").select("path", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("head"))
    at = sheets.where("row > 0").join(heads, "path")
    found = [F.when(F.array_position("head", c.strip().lower()) > 0, F.get("cells", (F.array_position("head", c.strip().lower()) - 1).cast("int"))).alias(c) for c in columns]
    return at.select("path", "row", *found)
