"""Feature tables behind the rules: delays, hosts, failures, gaps, shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.intervals import SQL
from runlens.operators.stages import STAGE, half_up, micros, percentile_of, ratio


def p(column: str, q: float):
    return half_up(F.percentile(column, F.lit(q)))


def task_scheduler_delay(tasks: DataFrame) -> DataFrame:
    """What a task's time on its executor does not explain: finish - launch - run - deserialisation, at least 0."""
    x = tasks.withColumn("delay", F.greatest(F.col("finish_ms") - F.col("launch_ms") - F.col("run_ms") - F.col("deser_ms"), F.lit(0)))
    return x.groupBy(*STAGE).agg(p("delay", 0.5).alias("delay_p50"), F.sum("delay").alias("delay_sum"))


def driver_gap(execs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Wall time of an execution that none of its jobs covers: the union of job intervals by running maxima."""
    w = Window.partitionBy(*SQL).orderBy("a", "z")
    e = execs.where("end_ms > start_ms").select(*SQL, "start_ms", "end_ms")
    j = jobs.join(e, SQL).select(*SQL, "start_ms", "end_ms", F.greatest("submission_ms", "start_ms").alias("a"), F.least("completion_ms", "end_ms").alias("z")).where("z > a")
    j = j.withColumn("before", F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.greatest(F.col("z") - F.greatest("a", F.coalesce("before", F.col("a"))), F.lit(0))
    x = e.join(j.groupBy(*SQL).agg(F.sum(new).alias("covered")), SQL, "left")
    wall = F.col("end_ms") - F.col("start_ms")
    gap = wall - F.coalesce("covered", F.lit(0))
    return x.select(*SQL, wall.alias("wall_ms"), gap.alias("gap_ms"), ratio(gap, wall).alias("gap_ratio"))


def job_fragmentation(jobs: DataFrame) -> DataFrame:
    x = jobs.withColumn("d", F.col("completion_ms") - F.col("submission_ms"))
    return x.groupBy(*SQL).agg(F.count("*").alias("jobs"), p("d", 0.5).alias("job_p50"))


def cpu_profile(tasks: DataFrame) -> DataFrame:
    x = tasks.groupBy(*STAGE).agg(ratio(F.sum("cpu_ns") / 1e6, F.sum("run_ms")).alias("cpu_ratio"))
    return x.withColumn("label", F.when(F.col("cpu_ratio") >= 0.7, "CPU").when(F.col("cpu_ratio") <= 0.3, "IO").otherwise("MIXED"))


def locality_mix(tasks: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("locality") == v)
    return tasks.groupBy(*STAGE).agg(*[n(v).alias(v.lower()) for v in ("PROCESS_LOCAL", "NODE_LOCAL", "RACK_LOCAL", "ANY")], ratio(n("ANY") + n("RACK_LOCAL"), F.count("*")).alias("bad_ratio"))


def shuffle_write_throughput(tasks: DataFrame) -> DataFrame:
    """Bytes a second by stage and by host (one pass over grouping sets), and the largest task's share of its stage's write."""
    total, ms = F.sum("shuffle_write_bytes"), F.sum("shuffle_write_ms")
    x = tasks.groupingSets([["app_id", "stage_id"], ["app_id", "host"]], "app_id", "stage_id", "host")
    return x.agg(total.alias("bytes"), ratio(total * 1000.0, ms).alias("bytes_per_s"), ratio(F.max("shuffle_write_bytes"), total).alias("task_share"))


def result_pressure(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(*STAGE).agg(F.sum("result_size").alias("result_sum"), F.max("result_size").alias("result_max"), p("deser_ms", 0.95).alias("deser_p95"))


CLASSES = (("OOM", "(?i)OutOfMemory"), ("FETCH_FAILED", "FetchFailed"), ("EXECUTOR_LOST", "ExecutorLost"), ("KILLED", "(?i)killed"), ("AUTH", "(?i)GSS|kerberos|token expired"))


def failure_classes(tasks: DataFrame) -> DataFrame:
    """Failed attempts of every execution by class of reason."""
    c = F.lit("EXCEPTION")
    for name, pattern in reversed(CLASSES):
        c = F.when(F.col("reason").rlike(pattern), name).otherwise(c)
    return tasks.where("failed").groupBy(*SQL, c.alias("class")).agg(F.count("*").alias("n"))


def normalised_task_time(tasks: DataFrame) -> DataFrame:
    """Run time of each task over its stage's median; the median joins back, so a large stage is not one window."""
    med = tasks.groupBy(*STAGE).agg(F.greatest(p("run_ms", 0.5), F.lit(1)).alias("median"))
    return tasks.join(med, STAGE).withColumn("norm", ratio(F.col("run_ms"), F.col("median")))


def host_score(tasks: DataFrame, score: float = 1.5, min_tasks: int = 20, min_stages: int = 3) -> DataFrame:
    x = normalised_task_time(tasks).groupBy("app_id", "host").agg(percentile_of(micros("norm"), 0.5).alias("score"), F.count("*").alias("tasks"), F.count_distinct("stage_id").alias("stages"))
    return x.withColumn("outlier", (F.col("score") >= score) & (F.col("tasks") >= min_tasks) & (F.col("stages") >= min_stages))


def host_io(tasks: DataFrame) -> DataFrame:
    """Shuffle write throughput and spill share of each host against the median host of its application."""
    x = tasks.groupBy("app_id", "host").agg(F.count("*").alias("tasks"), ratio(F.sum("shuffle_write_bytes") * 1000.0, F.sum("shuffle_write_ms")).alias("bytes_per_s"), F.sum("disk_spill_bytes").alias("spill"))
    m = x.groupBy("app_id").agg(F.percentile("bytes_per_s", F.lit(0.5)).alias("median"), F.sum("spill").alias("total"))
    return x.join(m, "app_id").select("app_id", "host", "tasks", "bytes_per_s", ratio(F.col("bytes_per_s"), F.col("median")).alias("of_median"), ratio(F.col("spill"), F.col("total")).alias("spill_share"))


def fetch_matrix(tasks: DataFrame) -> DataFrame:
    """Fetch failures by source and destination host, with totals by source and for the application."""
    x = tasks.where("src_host is not null").groupingSets([["app_id", "src_host", "host"], ["app_id", "src_host"], ["app_id"]], "app_id", "src_host", "host")
    return x.agg(F.count("*").alias("failures"), F.sum("fetch_wait_ms").alias("wait_ms"))


def failure_storms(buckets: DataFrame, ratio_: float = 0.1, least: int = 2) -> DataFrame:
    """Buckets whose failed attempts pass both thresholds."""
    return buckets.where((F.col("failed") >= least) & (F.col("failed") >= ratio_ * F.col("attempts"))).select("app_id", "bucket_ms", "attempts", "failed")


def executor_loss_impact(events: DataFrame, execs: DataFrame, width: int = 3_600_000) -> DataFrame:
    """Executions that were active when an executor went. Both meet by bucket, so a loss is held only against executions of its
    hour; an execution without an end reaches to its application's last loss."""
    gone = events.where("not added").select("app_id", "executor_id", "time_ms", F.expr(f"time_ms div {width}").alias("b"))
    e = execs.select(*SQL, "start_ms", "end_ms").join(gone.groupBy("app_id").agg((F.max("time_ms") + 1).alias("last")), "app_id")
    e = e.withColumn("z", F.least("last", F.when(F.col("end_ms") > 0, F.col("end_ms")))).where("z > start_ms")
    e = e.withColumn("b", F.explode(F.sequence(F.expr(f"start_ms div {width}"), F.expr(f"(z - 1) div {width}"))))
    return gone.join(e, ["app_id", "b"]).where("start_ms <= time_ms and time_ms < z").select("app_id", "executor_id", "execution_id", "time_ms")


def partial_stages(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Stages with fewer successful task ends than tasks."""
    done = tasks.where("not failed").groupBy(*STAGE).agg(F.count("*").alias("done"))
    x = stages.select(*STAGE, "num_tasks").join(done, STAGE, "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return x.where("done < num_tasks")


def clock_consistency(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("app_id", "host").agg(F.count_if(F.col("finish_ms") < F.col("launch_ms")).alias("negative"), p("deser_ms", 0.5).alias("deser_p50"), F.min("launch_ms").alias("first_ms"))


def restart_impact(execs: DataFrame, tail_ms: int = 1_800_000) -> DataFrame:
    """Executions still open at an application's end and those submitted in its last half hour."""
    end = execs.groupBy("app_id").agg(F.max(F.greatest("end_ms", "start_ms")).alias("app_end"))
    x = execs.join(end, "app_id")
    return x.groupBy("app_id").agg(F.count_if(F.col("end_ms") <= 0).alias("interrupted"), F.count_if(F.col("start_ms") >= F.col("app_end") - tail_ms).alias("tail_submissions"))


def template_regression(history: DataFrame, factor: float = 1.5, at_least_ms: int = 300_000, samples: int = 3, rounds: int = 14) -> DataFrame:
    """Each run's median time of a template against the median over its `rounds` runs before. history: template, run, duration_ms."""
    per = history.groupBy("template", "run").agg(F.count("*").alias("n"), p("duration_ms", 0.5).alias("p50"))
    before = Window.partitionBy("template").orderBy("run").rowsBetween(-rounds, -1)
    x = per.withColumns({"base": F.sum(F.col("p50") * F.col("n")).over(before) / F.sum("n").over(before), "seen": F.count("*").over(before)})
    x = x.where((F.col("seen") >= samples))
    slow = F.col("p50") >= F.greatest(F.col("base") * factor, F.col("base") + at_least_ms)
    return x.select("template", "run", "p50", F.round("base", 6).alias("base"), "seen", slow.alias("regressed"))
