"""Forecasts that follow a feed: each micro-batch recomputes what it touches and appends snapshots, once however often it is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH = "batch_id"


def append_once(frame: DataFrame, path: str, batch_id: int) -> None:
    """Write ``frame`` as the partition ``batch_id`` below ``path``; a batch that is written again replaces its own partition and no other."""
    frame.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def snapshots(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All snapshots with ``is_current``: of each key the one of the newest batch; older ones stay, superseded."""
    newest = Window.partitionBy(key).orderBy(F.desc(BATCH))
    return spark.read.parquet(path).withColumn("is_current", F.row_number().over(newest) == 1)


def periods(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The period rows of each key's newest batch."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(key).agg(F.max(BATCH).alias(BATCH))
    return rows.join(newest, [key, BATCH], "left_semi").select(*rows.columns)


def on_batch(key: str, snapshot: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with each micro-batch: ``snapshot`` (one row for each of the distinct keys that the batch touches) is appended to folder/snapshots, and
    ``spread`` of it to folder/periods."""

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(key).where(F.col(key).isNotNull()).distinct()
        made = snapshot(touched)
        append_once(made, f"{folder}/snapshots", batch_id)
        append_once(spread(made), f"{folder}/periods", batch_id)

    return run


def follow(frame: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None]):
    """Start the stream over what is there now and end (``availableNow``)."""
    return frame.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
