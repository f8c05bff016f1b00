"""Intermediate tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from .. import storage
from ..storage import folder, forget, fresh  # noqa: F401

#: Spark's setting by which the shuffle files of a query are deleted when it ends; a retry would make them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written and read again; the shuffle files of the step are deleted with its last row written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return storage.written(df, name)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def bounded(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in a batch between Spark and Python than the default of 10,000, so that long texts do not fill the workers.
    A session that sets less keeps its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose frames are gone; it does so when the driver collects garbage. The
    gateway tells the JVM of dropped frames from a queue, about once a second, so that is waited for."""
    gc.collect()
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    until = time.monotonic() + 5
    while len(queue) and time.monotonic() < until:
        time.sleep(0.02)
    time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()
