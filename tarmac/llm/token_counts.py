"""Token counts: rollups kept by signed deltas, with idempotent batch commits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.bpe import WordBpe
from tarmac.llm.byte_bpe import ByteBpe
from tarmac.llm.common import add_columns, texts_of

#: Versions counted without a vocabulary, by plain SQL functions: words between white space, and words with each other mark on its own.
VERSIONS = {"space-1": r"[^\x20\x09-\x0D]+", "mark-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]"}

_KEYS = ["source", "lang", "version"]


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text by a version of ``VERSIONS`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a vocabulary file, with word ends or over bytes, loaded once in each Python worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            ends = json.load(f)["model"]["end_of_word_suffix"]
        _loaded[path] = WordBpe(path) if ends else ByteBpe(path)
    return _loaded[path]


def vocabulary_counts(docs: DataFrame, versions: dict[str, str], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``row`` (its ``keep`` columns) and, by the name of each version, the tokens of the whole text (null: 0).

    ``versions`` gives the vocabulary file of each name. All versions are counted in one pass over the texts.
    """

    def compute(texts):
        whole = texts_of(texts)
        return [[len(ids) for ids in tokenizer(path).encode_batch(whole)] for path in versions.values()]

    return add_columns(docs, [text_col], compute, [T.StructField(v, T.LongType()) for v in versions], list(keep))


def counted(docs: DataFrame, version: str, sign: int = 1, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """One signed change per document: +1 for an insert, -1 for a delete; a revised count is a delete and an insert.

    Tokens are counted in ``text_col``, or were so before and stand in ``count_col`` (null: 0).
    """
    tokens = count_tokens(F.col(f"`{text_col}`"), version) if count_col is None else F.coalesce(F.col(f"`{count_col}`").cast("long"), F.lit(0))
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("version"),
        F.lit(sign).cast("long").alias("docs"),
        (sign * tokens).alias("tokens"),
    )


_TOTALS = "source string, lang string, version string, docs long, tokens long"


class Rollup:
    """Additive totals by source, language and tokenizer version below ``path``.

    A batch is pre-aggregated to one row per key and written to the folder of its id, so committing a batch again replaces
    it, also by no rows, and a commit that failed half way is simply done again. ``compact`` sums batches into a new
    generation, which counts from the moment that its list of batch ids is whole; a batch of that list that comes again
    is left alone. Totals are the sum of the last whole generation and of all batches it doesn't list; keys whose documents
    and tokens are both 0 are left out. Null sources and languages are keys of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder

    def _names(self, path: str) -> list[str]:
        fs, folder = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def _generation(self) -> tuple[int, set[int]]:
        """The last whole generation (0: none), and the ids of the batches in it."""
        whole = [int(g) for g in self._names(f"{self.path}/generations") if "_SUCCESS" in self._names(f"{self.path}/generations/{g}/ids")]
        if not whole:
            return 0, set()
        return max(whole), {r[0] for r in self.spark.read.schema("batch_id long").parquet(f"{self.path}/generations/{max(whole)}/ids").collect()}

    def _batches(self) -> set[int]:
        return {int(name.split("=")[1]) for name in self._names(f"{self.path}/batches") if name.startswith("batch_id=")}

    def _sums(self, generation: int, batches: set[int]) -> DataFrame:
        folders = [f"{self.path}/batches/batch_id={b}" for b in sorted(batches)] + ([f"{self.path}/generations/{generation}/sums"] if generation else [])
        rows = self.spark.read.schema(_TOTALS).parquet(*folders) if folders else self.spark.createDataFrame([], _TOTALS)
        return rows.groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def commit(self, batch_id: int, changes: DataFrame) -> None:
        """Adds the signed changes of a batch, once however often it is called."""
        if batch_id in self._generation()[1]:
            return
        sums = changes.groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")

    def totals(self) -> DataFrame:
        """Current totals: source, lang, version, docs, tokens."""
        generation, listed = self._generation()
        return self._sums(generation, self._batches() - listed).where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def compact(self, up_to: int) -> None:
        """Sums all batches up to an id into a new generation and deletes their folders (to be run while no batch is committed)."""
        generation, listed = self._generation()
        fresh = {b for b in self._batches() if b <= up_to} - listed
        target = f"{self.path}/generations/{generation + 1}"
        self._sums(generation, fresh).write.mode("overwrite").parquet(f"{target}/sums")
        ids = self.spark.createDataFrame([(b,) for b in sorted(listed | fresh)], "batch_id long")
        ids.coalesce(1).write.mode("overwrite").parquet(f"{target}/ids")
        for b in listed | fresh:
            fs, folder = self._fs(f"{self.path}/batches/batch_id={b}")
            fs.delete(folder, True)
