"""Incremental scoring: new predictions are counted as they arrive, batch by batch, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_SCHEMA = "attribute string, label int, pred int, n long, batch_id long"


def count_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs ``stream`` (attribute, label, pred) to its present end and adds each micro-batch's cells below ``path``.

    A batch overwrites its own partition only, so a batch that is run again after a failure counts once.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        cells = batch.where("label is not null").groupBy("attribute", "label", "pred").agg(F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.lit(batch_id).cast("long"))
        cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all batches so far, in the form that the scoring operators take."""
    return spark.read.schema(_SCHEMA).parquet(path).groupBy("attribute", "label", "pred").agg(F.sum("n").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, key: str) -> DataFrame:
    """Counts by key and time window of a stream; rows later than ``late`` are left out and closed windows are emitted once."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
