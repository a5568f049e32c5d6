"""Bucket metrics and executions of running applications as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bucket_metrics(tasks: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Attempts, failures and times per launch bucket, for batch and streaming frames alike.

    tasks: app_id, launch_ts (timestamp) and the task columns. Rows later than `late` are dropped by the watermark.
    """
    x = tasks.withWatermark("launch_ts", late)
    out = x.groupBy("app_id", F.window("launch_ts", width).alias("w")).agg(
        F.count("*").alias("attempts"), F.count_if("failed").alias("failed"), F.count_if("speculative").alias("speculative"), F.sum("run_ms").alias("run_ms"), F.sum("cpu_ns").alias("cpu_ns"), F.sum("gc_ms").alias("gc_ms"), F.sum("fetch_wait_ms").alias("fetch_ms"),
    )
    return out.select("app_id", F.unix_millis("w.start").alias("bucket_ms"), "attempts", "failed", "speculative", "run_ms", "cpu_ns", "gc_ms", "fetch_ms")


def with_launch_time(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("launch_ts", F.timestamp_millis("launch_ms"))
