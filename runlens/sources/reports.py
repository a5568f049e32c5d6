"""Nested reports of executions and applications as JSON rows and files, and what a log is known by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import redact
from runlens.operators.intervals import SQL
from runlens.operators.queue import SAMPLING, utilization_series
from runlens.operators.stages import ratio


def sql_report(execs: DataFrame, light: DataFrame, findings: DataFrame, estimates: DataFrame) -> DataFrame:
    """One nested row an execution: what it is, its measurements, findings (worst first) and estimates for other core counts."""
    f = findings.groupBy(*SQL).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "rule_id", "severity", "stage_id"))).alias("findings"))
    w = estimates.groupBy(*SQL).agg(F.sort_array(F.collect_list(F.struct("cores", "estimate_ms"))).alias("cores_curve"))
    m = light.select(*SQL, F.struct(*[c for c in light.columns if c not in SQL]).alias("metrics"))
    return execs.select(*SQL, F.struct("start_ms", "end_ms", redact(F.col("description")).alias("description")).alias("target")).join(m, SQL, "left").join(f, SQL, "left").join(w, SQL, "left")


def queue_report(summary: DataFrame, utilization: DataFrame, resources: DataFrame, contention: DataFrame, findings: DataFrame, meta: DataFrame) -> DataFrame:
    """One nested row an application; all texts that come from outside (in meta, see queue_meta) are masked. Lists hold buckets, the
    largest consumers and queue findings, which an application's length or a stated number bounds."""
    part = lambda df, name: df.select("app_id", F.struct(*[c for c in df.columns if c != "app_id"]).alias(name))
    f = findings.groupBy("app_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "rule_id", "severity"))).alias("findings"))
    x = part(summary, "summary").join(part(utilization_series(utilization), "utilization"), "app_id", "left").join(part(resources, "resources"), "app_id", "left")
    return x.join(part(contention, "contention"), "app_id", "left").join(f, "app_id", "left").join(part(meta, "meta"), "app_id", "left")


def queue_meta(summary: DataFrame, sample: DataFrame, partial: DataFrame, logs: DataFrame) -> DataFrame:
    """How far an application's figures can be trusted, one row each.

    sample: the executions of the deep sample; partial: app_id of those with missing events; logs: app_id, source, key (of
    log_snapshot_key) of each log that was read, null where unknown. Coverage is the share of completed executions that were
    analysed in depth. An application with executions that still run is a running snapshot. Source and key are masked.
    """
    deep = sample.groupBy("app_id").agg(F.count("*").alias("deep"))
    known = logs.groupBy("app_id").agg(F.min("source").alias("source"), F.min("key").alias("key"))
    x = summary.join(partial.select("app_id", F.lit(True).alias("p")).distinct(), "app_id", "left").join(deep, "app_id", "left").join(known, "app_id", "left")
    p, n, running = F.coalesce("p", F.lit(False)), F.coalesce("deep", F.lit(0)), F.col("running") > 0
    reason = F.concat_ws("; ", F.when(p, "events are missing"), F.when(running, "executions still run"))
    return x.select(
        "app_id", F.col("queries").alias("light_analysed"), n.alias("deep_analysed"), ratio(n, F.col("completed")).alias("coverage"), p.alias("incomplete"), running.alias("running_snapshot"),
        redact(F.col("source")).alias("source"), redact(F.col("key")).alias("snapshot_key"), F.lit(SAMPLING).alias("sampling"), F.nullif(reason, F.lit("")).alias("degraded"),
        F.lit("pool is the larger of configured and seen cores").alias("assumption"))


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines in a folder for each application."""
    reports.repartition("app_id").write.partitionBy("app_id").mode("overwrite").json(path)


def log_completeness(apps: DataFrame, files: DataFrame) -> DataFrame:
    """Logs without an end event or with a part that is still being written. apps: log, incomplete; files: log, name."""
    open_ = files.groupBy("log").agg(F.bool_or(F.col("name").contains(".inprogress")).alias("in_progress"), F.bool_or(F.col("name").contains(".compact")).alias("compacted"))
    x = apps.select("log", "incomplete").join(open_, "log", "left").na.fill(False, ["in_progress", "compacted"])
    return x.withColumn("incomplete", F.col("incomplete") | F.col("in_progress"))


def log_snapshot_key(files: DataFrame) -> DataFrame:
    """A key that changes with any part of a log. files: log, name, length, modified."""
    part = F.concat_ws(":", "name", F.col("length").cast("string"), F.col("modified").cast("string"))
    return files.groupBy("log").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(part))), 256).alias("key"))
