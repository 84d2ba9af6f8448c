"""Submissions that are due to be scored, from a stream of uploads: a queue without repeats whose state is what was queued last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

UPLOADS = "submission string, version long, fingerprint string"
#: Provider of state stores that keyed states need.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Due(StatefulProcessor):
    """Of each submission the newest upload, if its fingerprint isn't that which was queued last."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "version long, fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, fingerprint = self.last.get() if self.last.exists() else (None, None)
        before = fingerprint
        for uploads in rows:
            newest = uploads.sort_values(["version", "fingerprint"]).iloc[-1]
            if version is None or newest["version"] >= version:
                version, fingerprint = int(newest["version"]), newest["fingerprint"]
        self.last.update((version, fingerprint))
        if fingerprint != before:
            yield pd.DataFrame({"submission": [key[0]], "version": [version], "fingerprint": [fingerprint]})

    def close(self) -> None:
        pass


def due(uploads: DataFrame) -> DataFrame:
    """(submission, version, fingerprint) of what is to be scored, from a stream of uploads.

    A fingerprint is that of everything a score hangs on: the file, the settings and the evaluation sets. Uploads of a
    submission that come together count as one, the newest version of them; what comes late, with an older version, is
    left out, as is a fingerprint that was queued last. Rows with a null submission, version or fingerprint are left out.
    """
    whole = uploads.where("submission is not null and version is not null and fingerprint is not null")
    return whole.groupBy("submission").transformWithStateInPandas(statefulProcessor=Due(), outputStructType=UPLOADS, outputMode="Append", timeMode="None")


def score_due(uploads: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream to its present end; ``score`` turns due submissions of a batch into rows, which are written below ``path``.

    ``score`` keeps the columns of due submissions. A batch that runs again after a failure replaces its own rows only.
    """
    uploads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return due(uploads).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_scores(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last batch that scored each submission."""
    newest = Window.partitionBy("submission")
    return spark.read.parquet(path).withColumn("_last", F.max("batch_id").over(newest)).where("batch_id = _last").drop("_last", "batch_id")
