"""What failures, losses, restarts, holes and slow reads cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.evidence import effective
from runlens.operators.intervals import SQL
from runlens.operators.stages import STAGE, ratio


def failure_profile(tasks: DataFrame, stages: DataFrame, top: int = 3) -> DataFrame:
    """(app_id, reason, n, place, share, amplification): the most frequent reasons of an application's failed attempts, and its
    attempts over the tasks that its stages have. A reason is the text up to the first colon and the class after it."""
    reason = F.regexp_extract("reason", r"^([^:]*(?:: ?[\w.$]+)?)", 1)
    n = tasks.where("failed").groupBy("app_id", reason.alias("reason")).agg(F.count("*").alias("n"))
    total = n.groupBy("app_id").agg(F.sum("n").alias("total"))
    amp = tasks.groupBy("app_id").agg(F.count("*").alias("attempts")).join(stages.groupBy("app_id").agg(F.sum("num_tasks").alias("tasks")), "app_id")
    w = Window.partitionBy("app_id").orderBy(F.desc("n"), "reason")
    x = n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).join(total, "app_id").join(amp, "app_id")
    return x.select("app_id", "reason", "n", "place", ratio(F.col("n"), F.col("total")).alias("share"), ratio(F.col("attempts"), F.col("tasks")).alias("amplification"))


def host_reads(tasks: DataFrame) -> DataFrame:
    """Bytes that a host's tasks read (input and shuffles) for each second of their time, against the median host of the application."""
    x = tasks.groupBy("app_id", "host").agg(F.sum(F.col("input_bytes") + F.col("shuffle_read_bytes")).alias("read_bytes"), ratio(F.sum(F.col("input_bytes") + F.col("shuffle_read_bytes")) * 1000.0, F.sum("run_ms")).alias("bytes_per_s"))
    m = x.groupBy("app_id").agg(F.percentile("bytes_per_s", F.lit(0.5)).alias("median"))
    return x.join(m, "app_id").select("app_id", "host", "read_bytes", "bytes_per_s", ratio(F.col("bytes_per_s"), F.col("median")).alias("of_median"))


def driver_holes(execs: DataFrame, jobs: DataFrame, least_ms: int = 1000) -> DataFrame:
    """The times of `least_ms` or more within an ended execution in which none of its jobs runs: where the driver plans, lists or
    collects. A window holds the jobs of one execution."""
    e = execs.where("end_ms > start_ms").select(*SQL, "start_ms", "end_ms")
    j = jobs.select(*SQL, F.col("submission_ms").alias("a"), F.col("completion_ms").alias("z")).join(e, SQL)
    j = j.select(*SQL, F.greatest("a", "start_ms").alias("a"), F.least("z", "end_ms").alias("z")).where("z > a")
    edges = j.unionByName(e.select(*SQL, F.col("start_ms").alias("a"), F.col("start_ms").alias("z"))).unionByName(e.select(*SQL, F.col("end_ms").alias("a"), F.col("end_ms").alias("z")))
    before = Window.partitionBy(*SQL).orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    x = edges.withColumn("from_ms", F.max("z").over(before)).where(F.col("a") - F.col("from_ms") >= least_ms)
    return x.select(*SQL, "from_ms", F.col("a").alias("to_ms"), (F.col("a") - F.col("from_ms")).alias("hole_ms"))


def restart_waste(tasks: DataFrame, execs: DataFrame) -> DataFrame:
    """Executions of each application that never ended, the core time of their tasks, and its share of all core time."""
    open_ = execs.where("end_ms <= 0").select(*SQL, F.lit(1).alias("open"))
    x = tasks.groupBy(*SQL).agg(F.sum("run_ms").alias("core_ms")).join(open_, SQL, "left")
    lost = F.sum(F.when(F.col("open") == 1, F.col("core_ms")).otherwise(0)).cast("long")
    return x.groupBy("app_id").agg(F.count("open").alias("interrupted"), lost.alias("wasted_core_ms"), ratio(lost, F.sum("core_ms")).alias("wasted_share"))


def speculation_hosts(tasks: DataFrame) -> DataFrame:
    """Where an application's speculated partitions ran first: how many, over how many hosts they spread, and the worst host's share.
    Few hosts say that speculation makes up for them."""
    x = tasks.groupBy(*STAGE, "part_idx").agg(F.bool_or("speculative").alias("copied"), F.min_by("host", F.when(~F.col("speculative"), F.struct("launch_ms", "task_id"))).alias("host"))
    n = x.where("copied and host is not null").groupBy("app_id", "host").agg(F.count("*").alias("n"))
    return n.groupBy("app_id").agg(F.sum("n").alias("partitions"), effective(F.col("n")).alias("hosts"), F.max_by("host", F.struct("n", "host")).alias("worst_host"), ratio(F.max("n"), F.sum("n")).alias("worst_share"))


def executor_loss_retries(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """For each executor that went: its attempts still at work or cut off at that time, the executions they belong to, the core time that
    they had spent, and the attempts that failed on it. The join is by executor."""
    gone = events.where("not added").groupBy("app_id", "executor_id").agg(F.max("time_ms").alias("time_ms"))
    x = gone.join(tasks, ["app_id", "executor_id"])
    hit = (F.col("launch_ms") <= F.col("time_ms")) & (F.col("finish_ms") > F.col("time_ms"))
    return x.groupBy("app_id", "executor_id", "time_ms").agg(
        F.count_if(hit).alias("attempts"), F.count_distinct(F.when(hit, F.col("execution_id"))).alias("executions"), F.sum(F.when(hit, F.col("time_ms") - F.col("launch_ms")).otherwise(0)).cast("long").alias("spent_ms"), F.count_if("failed").alias("failed"))
