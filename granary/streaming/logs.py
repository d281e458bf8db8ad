"""Structured Streaming: the latest state of an append log, daily partitions of events, and windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.keyed import latest
from granary.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of the parquet files of a folder, or of one file."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if folder:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(str(where.getParent()))


def latest_state(stream: DataFrame, keys: list[str], order: list[Column], folder: str, checkpoint: str) -> str:
    """Run an append log's stream to its end and keep the latest row of each key; returns the folder of the last state.

    Each micro-batch is joined with the state before it and written as a new version named after the batch, so a batch
    that runs again writes the same version again: the result is exactly once.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        rows = batch
        if n > 0:
            rows = spark.read.parquet(f"{folder}/v{n - 1}").unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{folder}/v{n}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(s.getPath().getName()[1:]) for s in fs.listStatus(where)] if fs.exists(where) else []
    return f"{folder}/v{max(versions)}" if versions else ""


def daily_partitions(stream: DataFrame, at: str, path: str, checkpoint: str) -> None:
    """Append a stream to folders of its days, whatever time zone the session has: timestamps are UTC wall time."""
    out = stream.withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    out.writeStream.partitionBy("day").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, at: str, group: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by event-time window and group; rows later than the watermark allows are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
