"""Python data sources that work on whole files: listings of folder trees, and prediction files with a header in the footer.

Folders are walked and files opened in tasks, through the Arrow file system of the path: a local path or a URI that Arrow
knows. ``register`` makes both formats known to a session.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


def _entries(path: str, recursive: bool = False) -> list[pafs.FileInfo]:
    system, root = file_system(path)
    return system.get_file_info(pafs.FileSelector(root, recursive=recursive, allow_not_found=False))


class Listing(DataSource):
    """(path, name, size, modified) of all files below ``path``, whose content is never opened.

    The upper levels (option ``levels``, 1 unless given; 0: none) are listed first; every folder below them is walked by a
    task of its own. Paths are relative to ``path``. A path that isn't there is an error; an empty folder has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "path string, name string, size long, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"], int(self.options.get("levels", "1")))


class _ListingReader(DataSourceReader):
    def __init__(self, path: str, levels: int):
        self.path, self.levels, self.root = path, levels, file_system(path)[1]

    def partitions(self) -> list[Folder]:
        found, open_ = [Folder(self.path, False)], [self.path]
        prefix = self.path[: len(self.path) - len(self.root)] if "://" in self.path else ""
        for _ in range(self.levels):
            open_ = [prefix + e.path for folder in open_ for e in _entries(folder) if e.type == pafs.FileType.Directory]
            found += [Folder(f, False) for f in open_]
        # The last level's folders are walked to the end.
        return [Folder(f.path, f.path in set(open_)) for f in found]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for e in _entries(partition.path, partition.recursive):
            if e.type == pafs.FileType.File:
                yield os.path.relpath(e.path, self.root), e.base_name, e.size, e.mtime


@dataclass
class File(InputPartition):
    path: str


class PredictionFiles(DataSource):
    """Prediction files, one row for each segment and one column for each attribute, with a JSON header in the footer.

    Reading gives (file, segment_id, attribute, probs, pred) or, with the option ``headerOnly``, (file, header) without any
    column read; each file is a task, read by row groups. Writing takes (file, header, segment_id, attributes ...), rows of
    a file together; the files appear when all are whole. Options: ``path``; ``headerKey``, of the footer's entry (by
    default the one whose name ends with ``predictions``, which is that written); ``codesField``, of the header's classes of
    each attribute, against which columns are checked if the header has it.
    """

    @classmethod
    def name(cls) -> str:
        return "prediction_files"

    def schema(self) -> str:
        if self.options.get("headeronly", self.options.get("headerOnly", "false")).lower() == "true":
            return "file string, header string"
        return "file string, segment_id string, attribute string, probs array<double>, pred int"

    def reader(self, schema) -> DataSourceReader:
        return _PredictionReader(dict(self.options), len(schema.fields) == 2)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PredictionWriter(dict(self.options), overwrite)


def _option(options: dict, name: str, default: str | None = None) -> str | None:
    return options.get(name, options.get(name.lower(), default))


def header_of(metadata: dict[bytes, bytes] | None, key: str | None) -> str:
    """The header among a footer's entries; an error if there is none or if its name is not clear."""
    metadata = metadata or {}
    names = [k for k in metadata if k.decode() == key or not key and k.decode().endswith("predictions")]
    if len(names) != 1:
        raise ValueError(f"{len(names)} headers in the footer, whose entries are {sorted(k.decode() for k in metadata)}")
    text = metadata[names[0]].decode()
    if not isinstance(json.loads(text), dict):
        raise ValueError("the header is no JSON object")
    return text


class _PredictionReader(DataSourceReader):
    def __init__(self, options: dict, header_only: bool):
        self.path, self.key, self.codes, self.header_only = options["path"], _option(options, "headerKey"), _option(options, "codesField"), header_only

    def partitions(self) -> list[File]:
        system, root = file_system(self.path)
        if system.get_file_info(root).type == pafs.FileType.File:
            return [File(root)]
        return [File(e.path) for e in sorted(_entries(self.path), key=lambda e: e.path) if e.type == pafs.FileType.File and e.base_name.endswith(".parquet") and not e.base_name.startswith((".", "_"))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        name = os.path.basename(partition.path)
        with pq.ParquetFile(partition.path, filesystem=system) as file:
            header = header_of(file.metadata.metadata, self.key)
            if self.header_only:
                yield pa.RecordBatch.from_pydict({"file": [name], "header": [header]})
                return
            columns = file.schema_arrow.names
            codes = json.loads(header).get(self.codes) if self.codes else None
            if "segment_id" not in columns or codes is not None and sorted(columns) != sorted(["segment_id", *codes]):
                raise ValueError(f"{name}: the columns {columns} are not those of the header")
            for batch in file.iter_batches(8192):
                yield from self._rows(name, batch, codes)

    def _rows(self, name: str, batch: pa.RecordBatch, codes: dict | None) -> Iterator[pa.RecordBatch]:
        ids = batch.column("segment_id").cast(pa.string())
        for attribute in batch.schema.names:
            if attribute == "segment_id":
                continue
            column, n = batch.column(attribute), len(batch)
            probs, pred = pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int32())
            if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                lengths = set(column.value_lengths().drop_null().to_pylist())
                if codes is not None and not lengths <= {len(codes[attribute])}:
                    raise ValueError(f"{name}: {attribute} has lists of {sorted(lengths)} values for {len(codes[attribute])} classes")
                probs = column.cast(probs.type)
            elif pa.types.is_integer(column.type):
                pred = column.cast(pred.type)
            elif not pa.types.is_null(column.type):
                raise ValueError(f"{name}: {attribute} is no prediction: {column.type}")
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), ids, pa.array([attribute] * n), probs, pred], names=["file", "segment_id", "attribute", "probs", "pred"])


@dataclass
class Written(WriterCommitMessage):
    """Names of hidden files and those that they get."""

    names: list


class _PredictionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.key, self.overwrite = options["path"], _option(options, "headerKey", "tarmac_predictions"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root)
        names, current, writer = [], None, None
        for batch in iterator:
            files = batch.column("file").to_pylist()
            at = 0
            while at < len(files):
                to = next((i for i in range(at, len(files)) if files[i] != files[at]), len(files))
                piece = batch.slice(at, to - at)
                if files[at] != current:
                    if writer:
                        writer.close()
                    current, hidden = files[at], f".{uuid.uuid4().hex}"
                    names.append((hidden, current))
                    kept = [f for f in batch.schema if f.name not in ("file", "header")]
                    schema = pa.schema(kept, {self.key: piece.column("header")[0].as_py()})
                    soft = any(pa.types.is_list(f.type) for f in kept)
                    writer = pq.ParquetWriter(f"{root}/{hidden}", schema, filesystem=system, use_dictionary=not soft)
                writer.write_batch(piece.select([f.name for f in schema]).replace_schema_metadata(schema.metadata))
                at = to
        if writer:
            writer.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        """Names of files clash before the first of them appears."""
        system, root = file_system(self.path)
        names = [n for m in messages if m for n in m.names]
        final = [f for _, f in names]
        there = [i.base_name for i in system.get_file_info([f"{root}/{f}" for f in set(final)]) if i.type != pafs.FileType.NotFound]
        if len(set(final)) < len(final) or there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"files would clash: {sorted(there) or sorted(f for f in set(final) if final.count(f) > 1)}")
        for hidden, name in names:
            system.move(f"{root}/{hidden}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        for hidden, _ in [n for m in messages if m for n in m.names]:
            if system.get_file_info(f"{root}/{hidden}").type == pafs.FileType.File:
                system.delete_file(f"{root}/{hidden}")


def register(spark: SparkSession) -> None:
    for source in (Listing, PredictionFiles):
        spark.dataSource.register(source)


def read_prediction_files(spark: SparkSession, path: str, header_only: bool = False, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("prediction_files").options(path=path, headerOnly=str(header_only).lower(), **options).load()


def write_prediction_files(wide: DataFrame, headers: DataFrame, path: str, **options: str) -> None:
    """Writes a file for each value of ``file``: rows of ``wide`` (file, segment_id, attributes ...) under the header of ``headers`` (file, header).

    A file without a header is an error. Rows of a file are one task's, in order of their ids.
    """
    register(wide.sparkSession)
    attributes = [c for c in wide.columns if c not in ("file", "segment_id")]
    met = wide.join(headers, "file", "left").withColumn("header", F.coalesce("header", F.raise_error(F.concat(F.lit("no header: "), F.col("file")))))
    rows = met.select("file", "header", F.col("segment_id").cast("string").alias("segment_id"), *attributes)
    rows.repartition("file").sortWithinPartitions("file", "segment_id").write.format("prediction_files").mode("append").options(path=path, **options).save()


def list_files(spark: SparkSession, path: str, levels: int = 1) -> DataFrame:
    register(spark)
    return spark.read.format("listing").options(path=path, levels=str(levels)).load()


def images_by_segment(listed: DataFrame, pattern: str = r"(?i)_seg(\d+)\.png$") -> DataFrame:
    """(segment_id, paths) of files whose name has the pattern; leading zeros of the id are dropped, paths are in order."""
    number = F.regexp_extract("name", pattern, 1)
    segment = F.regexp_replace(number, r"^0+(?=\d)", "")
    return listed.where(number != "").groupBy(segment.alias("segment_id")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def by_stem(listed: DataFrame, extensions: list[str] | None = None, preferred: list[str] | None = None) -> DataFrame:
    """(stem, path, error): the file of each name without its extension.

    With ``extensions`` only such files count. With ``preferred`` a file of such an extension is taken before others.
    Two files that are left for a stem are the error ``duplicate``, and the path is null. Extensions ignore case.
    """
    stem, extension = F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), F.lower(F.regexp_extract("name", r"(?<=.)(\.[^.]*)$", 1))
    rows = listed.select(stem.alias("stem"), "path", extension.alias("extension"))
    if extensions is not None:
        rows = rows.where(F.col("extension").isin(*extensions))
    first = ~F.col("extension").isin(*preferred) if preferred is not None and extensions is None else F.lit(False)
    ranked = rows.groupBy("stem", first.alias("other")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    best = ranked.groupBy("stem").agg(F.min(F.struct("other", "n", "path")).alias("b"))
    return best.select("stem", F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"), F.when(F.col("b.n") > 1, "duplicate").alias("error"))
