"""Shared plumbing of the operators: Arrow batch mapping, shared scratch tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one Arrow batch: about 2 MB of ordinary text, and still bounded if every text is long.
BATCH_ROWS = 500

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    compute: Callable[..., list],
    fields: Sequence[T.StructField],
    keep: Sequence[str],
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Rows of ``df`` as a struct ``row`` of the ``keep`` columns, with ``fields`` computed from ``inputs`` batch by batch.

    ``compute`` gets one Arrow array per input and returns one Arrow array or list per field, aligned with the rows.
    Kept columns travel inside the struct, so their names never clash with those of the new fields.
    """
    kept = T.StructType([df.schema[c] for c in keep])
    schema = T.StructType([T.StructField("row", kept, False), *fields])
    picked = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.struct(F.lit(1).alias("_")).alias("row"),
        *[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(inputs)],
    )
    if not keep:
        schema = T.StructType([T.StructField("row", T.StructType([T.StructField("_", T.IntegerType())]), False), *fields])
    arrow = to_arrow_schema(T.StructType(list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = compute(*[batch.column(i + 1) for i in range(len(inputs))])
            columns = [batch.column(0)]
            for field, values in zip(arrow, made, strict=True):
                columns.append(values if isinstance(values, pa.Array) and values.type == field.type else pa.array(values, field.type))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return picked.mapInArrow(run, schema)


def add_rows(df: DataFrame, input_: str, compute: Callable[..., tuple], fields: Sequence[T.StructField], keep: Sequence[str], batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Any number of rows for each row of ``df``: its ``keep`` columns, repeated, and ``fields`` computed from one column.

    ``compute`` gets an Arrow array and returns, for each new row, the number of the old row, and one array per field.
    No name of ``fields`` may be one of ``keep``.
    """
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    arrow = to_arrow_schema(T.StructType(list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, *made = compute(batch.column(len(keep)))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keep))], *[pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)]], names=[f.name for f in schema])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{input_}`").alias("in0")).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new path below the cluster's shared checkpoint folder; a local one is set only in local mode, and only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tarmac-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tarmac-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives a lost executor.

    The write's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
    """
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tarmac_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once all that reads them is written itself."""
    for table in tables:
        path = table._tarmac_path
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, with null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_SEED = np.random.RandomState(20240501)
_BYTE = _SEED.randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C13)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space words of every row: start bytes, end bytes, 64-bit hashes, and the index of each row's first word.

    Words are maximal runs of bytes other than space and 0x09-0x0D. Memory beyond a few values per word stays within a
    block of bytes, however long a text is.
    """
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < n]
    first[row_starts] = inside[row_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        s, length = starts[at:to] - lo, ends[at:to] - starts[at:to]
        block = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        powers = np.full(int(length.max()), _MULT, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        values = np.where(inside[lo:hi], _BYTE[block], np.uint64(0))
        spans = np.diff(np.append(s, hi - lo))
        place = np.arange(hi - lo) - np.repeat(s, spans)
        values *= powers[np.minimum(place, len(powers) - 1)]
        hashes[at:to] = mix(np.add.reduceat(values, s) + length.astype(np.uint64))
        at = to
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, (size * 0xD1B54A32D192ED03) % (1 << 64), np.uint64)
    for i in range(size):
        h = (h ^ hashes[i : i + n]) * _MULT
        h ^= h >> np.uint64(29)
    return mix(h)
