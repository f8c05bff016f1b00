"""Volumes that arrive as files: running label sizes, and chunk ingestion that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files_a_trigger: int = 100) -> DataFrame:
    """Voxel tables as they are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def running_sizes(stream: DataFrame, label: str = "label") -> DataFrame:
    """Sizes of all labels but the background so far; the state is one row a label."""
    return stream.where(F.col(label) > 0).groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("cnt"))


def ingest(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``each`` on what has arrived since the last run, then stops. Files that a finished run has seen are not read
    again; ``each`` should write by (chunk, run number), since a run that broke off is repeated."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def number_chunks(stream: DataFrame, chunk: list[str], folder: str, checkpoint: str, label: str = "label") -> StreamingQuery:
    """Makes labels of chunks distinct as they arrive: labels of a chunk rise by the sum of the largest labels of all chunks
    before it, in earlier runs or earlier in this one. Rows go to ``folder/labels``, one row a run with its sum to
    ``folder/sums``; a run that is repeated overwrites what it wrote, and sees the same sums."""
    from ..operators.relabel import offset_labels

    def each(batch: DataFrame, run: int) -> None:
        spark = batch.sparkSession
        sums = spark.createDataFrame([], "run long, top long") if run == 0 else spark.read.schema("run long, top long").parquet(f"{folder}/sums/*")
        before = sums.where(F.col("run") < run).agg(F.coalesce(F.sum("top"), F.lit(0))).first()[0]
        moved = offset_labels(batch, chunk, label)
        moved = moved.withColumn(label, F.when(F.col(label) > 0, F.col(label) + before).otherwise(F.col(label)))
        moved.write.mode("overwrite").parquet(f"{folder}/labels/run={run}")
        top = batch.groupBy(*chunk).agg(F.max(label).alias("top")).agg(F.lit(run).cast("long").alias("run"), F.coalesce(F.sum("top"), F.lit(0)).cast("long").alias("top"))
        top.write.mode("overwrite").parquet(f"{folder}/sums/{run}")

    return ingest(stream, each, checkpoint)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Events per key and window of event time, with a bound on lateness (an addition: volumes have no event time)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
