"""Report files, written by tasks and made valid all at once by a manifest.

Rows are (file, sheet, place, cells). A file's kind is that of its name: ``.csv`` (UTF-8 with a byte order mark), ``.json``
(its cells as they are) or ``.xlsx`` (a sheet for each value of ``sheet``, in order of their names).
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tarmac.sources.files import file_system

MANIFEST = "_manifest.json"
# The parts of an Office Open XML workbook.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Control characters that XML can't hold.
_BAD = {c: None for c in range(32) if c not in (9, 10, 13)}


class _Text:
    """A CSV or JSON file."""

    def __init__(self, stream, mark: bool):
        self.text = io.TextIOWrapper(stream, "utf-8-sig" if mark else "utf-8", newline="")
        self.rows = csv.writer(self.text) if mark else None

    def add(self, sheet: str, cells: list) -> None:
        if self.rows:
            self.rows.writerow(["" if c is None else c for c in cells])
        else:
            self.text.write("".join(c for c in cells if c is not None))

    def close(self) -> None:
        self.text.flush()
        self.text.detach()


class _Workbook:
    """An xlsx file, written row by row; texts that are plain numbers become numbers."""

    def __init__(self, stream):
        self.book, self.names, self.sheet = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), [], None

    def add(self, sheet: str, cells: list) -> None:
        if not self.names or sheet != self.names[-1]:
            self._end()
            self.names.append(sheet)
            self.sheet = self.book.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w")
            self._put(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>')
        self._put("<row>" + "".join(map(self._cell, cells)) + "</row>")

    def _cell(self, value: str | None) -> str:
        if value is None:
            return "<c/>"
        plain = value.lstrip("-")
        if plain.replace(".", "", 1).isdecimal() and plain.isascii() and str(float(value)) in (value, f"{value}.0"):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value.translate(_BAD))}</t></is></c>'

    def _put(self, text: str) -> None:
        self.sheet.write(text.encode())

    def _end(self) -> None:
        if self.sheet:
            self._put("</sheetData></worksheet>")
            self.sheet.close()

    def close(self) -> None:
        self._end()
        ids = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in zip(ids, self.names, strict=True))
        links = "".join(f'<Relationship Id="r{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KINDS}.worksheet+xml"/>' for i in ids)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KINDS}.sheet.main+xml"/>{kinds}</Types>',
        }
        for name, text in parts.items():
            self.book.writestr(name, _HEAD + text)
        self.book.close()


@dataclass
class Files(WriterCommitMessage):
    made: list


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ReportWriter(self.options["path"], self.options["run"])


class _ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        system, root = file_system(self.path)
        made, current, file, stream, target = [], None, None, None, None

        def finish():
            file.close()
            stream.close()
            with system.open_input_stream(target) as done:
                digest, size = hashlib.sha256(), 0
                while block := done.read(1 << 20):
                    digest.update(block)
                    size += len(block)
            made.append({"file": current, "at": target[len(root) + 1 :], "size": size, "sha256": digest.hexdigest()})

        for batch in iterator:
            for name, sheet, cells in zip(*[batch.column(c).to_pylist() for c in ("file", "sheet", "cells")], strict=True):
                if name != current:
                    if file:
                        finish()
                    current = name
                    # A task that runs again writes files of other names, so no two attempts meet.
                    target = f"{root}/{self.run}/{uuid.uuid4().hex}/{name}"
                    system.create_dir(target.rsplit("/", 1)[0])
                    stream = system.open_output_stream(target)
                    file = _Workbook(stream) if name.endswith(".xlsx") else _Text(stream, name.endswith(".csv"))
                file.add(sheet, cells)
        if file:
            finish()
        return Files(made)

    def commit(self, messages: list[Files | None]) -> None:
        """One file that is moved into place makes all the others valid."""
        system, root = file_system(self.path)
        made = sorted((f for m in messages if m for f in m.made), key=lambda f: f["file"])
        hidden = f"{root}/{self.run}/{MANIFEST}"
        system.create_dir(f"{root}/{self.run}")
        with system.open_output_stream(hidden) as out:
            out.write(json.dumps({"run": self.run, "files": made}).encode())
        if system.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File and not isinstance(system, pafs.LocalFileSystem):
            system.delete_file(f"{root}/{MANIFEST}")
        system.move(hidden, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Files | None]) -> None:
        """Files without a manifest are no report; they stay until the next report's ``clean``."""


def clashes(rows: DataFrame) -> DataFrame:
    """(name, files) of file names that differ in case only, and of those that are no relative path of a known kind."""
    names = rows.select("file").distinct()
    twice = names.groupBy(F.lower("file").alias("name")).agg(F.array_sort(F.collect_list("file")).alias("files")).where(F.size("files") > 1)
    bad = names.where(F.col("file").isNull() | ~F.col("file").rlike(r"^[^/.][^/]*(/[^/.][^/]*)*\.(csv|json|xlsx)$"))
    return twice.unionByName(bad.select(F.col("file").alias("name"), F.array("file").alias("files")))


def write_reports(rows: DataFrame, path: str) -> None:
    """Writes all files of a report below ``path``; what was valid there before is replaced as a whole, or stays.

    Names that clash are an error before anything is written. Each file is one task's, row by row in order of sheet and
    place. If a task or the driver fails, no manifest is written and the report before stays valid.
    """
    rows.sparkSession.dataSource.register(ReportFiles)
    bad = clashes(rows).limit(5).collect()
    if bad:
        raise ValueError(f"names of files clash or are not allowed: {[r.files for r in bad]}")
    ordered = rows.select("file", "sheet", "place", "cells").repartition("file").sortWithinPartitions("file", "sheet", "place")
    ordered.write.format("report_files").mode("append").options(path=path, run=f"run-{uuid.uuid4().hex}").save()


def valid_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, location, size, sha256) of the valid report below a path; no rows if there is none."""
    system, root = file_system(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return spark.createDataFrame([], "file string, location string, size long, sha256 string")
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        made = json.loads(f.read())["files"]
    return spark.createDataFrame([(f["file"], f"{path.rstrip('/')}/{f['at']}", f["size"], f["sha256"]) for f in made], "file string, location string, size long, sha256 string")


def clean(path: str) -> int:
    """Deletes runs that the manifest doesn't name, and returns their number."""
    system, root = file_system(path)
    valid = None
    if system.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            valid = json.loads(f.read())["run"]
    old = [e for e in system.get_file_info(pafs.FileSelector(root)) if e.base_name.startswith("run-") and e.base_name != valid]
    for e in old:
        system.delete_dir(e.path)
    return len(old)
