"""Distributions and metrics of stages and executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAGE = ["app_id", "execution_id", "stage_id"]
METRICS = {"run": "run_ms", "read": "shuffle_read_bytes", "write": "shuffle_write_bytes", "input": "input_bytes", "output": "output_bytes", "spill": "disk_spill_bytes", "mem": "memory_spill_bytes", "gc": "gc_ms", "deser": "deser_ms"}
POINTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def half_up(x: Column) -> Column:
    return F.floor(F.round(x, 6) + 0.5).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive, rounded so that engines agree."""
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def micros(column: str) -> Column:
    """A value of six digits in whole millionths, so that means and percentiles of it are rounded alike everywhere."""
    return F.round(F.col(column) * 1_000_000).cast("long")


def mean_of(x: Column) -> Column:
    """Mean of whole millionths, rounded half up in whole numbers."""
    return F.floor((F.sum(x) * 2 + F.count(x)) / (F.count(x) * 2)) / 1_000_000.0


def percentile_of(x: Column, q: float) -> Column:
    """Interpolated percentile (q in twentieths) of whole millionths; between two values it is a whole number of
    twentieths, rounded half up."""
    return F.floor((F.round(F.percentile(x, F.lit(q)) * 20).cast("long") + 10) / 20) / 1_000_000.0


def task_distributions(tasks: DataFrame, exact: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per stage count, min, quantiles, max and sum of each metric; negatives count as 0.

    One shuffle by stage. With `exact` false the quantiles are mergeable sketches, which combine before the shuffle. extra: more
    aggregates by name, for the same shuffle.
    """
    aggs = [F.count("*").alias("n")]
    for name, column in METRICS.items():
        x = F.greatest(F.col(column), F.lit(0))
        q = F.percentile(x, F.array(*map(F.lit, POINTS.values()))) if exact else F.percentile_approx(x, list(POINTS.values()), 10_000)
        aggs += [F.min(x).alias(f"{name}_min"), q.alias(f"_{name}"), F.max(x).alias(f"{name}_max"), F.sum(x).alias(f"{name}_sum")]
    out = tasks.groupBy(*STAGE).agg(*aggs, *[c.alias(k) for k, c in (extra or {}).items()])
    points = [half_up(F.col(f"_{m}")[k]).alias(f"{m}_{p}") for m in METRICS for k, p in enumerate(POINTS)]
    return out.select(*[c for c in out.columns if not c.startswith("_")], *points)


def skew_ratio(stats: DataFrame) -> DataFrame:
    return stats.select(*STAGE, ratio(F.col("run_max"), F.col("run_p50")).alias("run_skew"), ratio(F.col("read_max"), F.col("read_p50")).alias("read_skew"))


def longest_task(tasks: DataFrame) -> DataFrame:
    """The task of the largest run time; of equal ones the smallest id."""
    return tasks.groupBy(*STAGE).agg(F.max_by("task_id", F.struct("run_ms", -F.col("task_id"))).alias("task_id"), F.max("run_ms").alias("run_ms"))


def stage_metrics(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Wall time, delay before the first launch, ratios and attempts of every stage."""
    t = tasks.groupBy(*STAGE).agg(
        F.count("*").alias("attempts"), F.sum("run_ms").alias("run_sum"), half_up(F.percentile("run_ms", F.lit(0.5))).alias("run_p50"), F.max("run_ms").alias("run_max"),
        F.sum("gc_ms").alias("gc_sum"), F.sum("fetch_wait_ms").alias("fetch_sum"), F.sum("disk_spill_bytes").alias("spill_sum"), F.sum("cpu_ns").alias("cpu_sum"),
        F.sum("shuffle_read_bytes").alias("read_sum"), F.sum("shuffle_write_bytes").alias("write_sum"), F.sum("input_bytes").alias("input_sum"),
    )
    s = stages.select(*STAGE, (F.col("completion_ms") - F.col("submission_ms")).alias("wall_ms"), F.greatest(F.col("first_launch_ms") - F.col("submission_ms"), F.lit(0)).alias("delay_ms"), "num_tasks", "failed_attempts", "extra_attempts")
    return s.join(t, STAGE).withColumns({
        "gc_ratio": ratio(F.col("gc_sum"), F.col("run_sum")),
        "fetch_ratio": ratio(F.col("fetch_sum"), F.col("run_sum")),
        "cpu_ratio": ratio(F.col("cpu_sum") / 1e6, F.col("run_sum")),
        "skew": ratio(F.col("run_max"), F.col("run_p50")),
    })


def stages_by_duration(stages: DataFrame) -> DataFrame:
    wall = F.col("completion_ms") - F.col("submission_ms")
    w = Window.partitionBy("app_id", "execution_id").orderBy(wall.desc(), "stage_id")
    return stages.select(*STAGE, wall.alias("wall_ms"), F.row_number().over(w).alias("place"))


def link_sql_stages(jobs: DataFrame) -> DataFrame:
    """Execution to stage through all jobs, distinct: a stage that two jobs list counts once."""
    return jobs.select("app_id", "execution_id", F.explode("stage_ids").alias("stage_id")).distinct()


def attribute_stage_to_sql(jobs: DataFrame) -> DataFrame:
    """Each stage with the execution of the first job that lists it."""
    x = jobs.select("app_id", "job_id", "execution_id", F.explode("stage_ids").alias("stage_id"))
    return x.groupBy("app_id", "stage_id").agg(F.min_by("execution_id", "job_id").alias("execution_id"))


def sql_light_metrics(metrics: DataFrame, jobs: DataFrame, execs: DataFrame) -> DataFrame:
    """Totals of every execution over the stages that its jobs list, and whether a job failed."""
    linked = link_sql_stages(jobs).join(metrics.drop("execution_id"), ["app_id", "stage_id"])
    total = linked.groupBy("app_id", "execution_id").agg(
        F.sum("read_sum").alias("read_bytes"), F.sum("write_sum").alias("write_bytes"), F.sum("spill_sum").alias("spill_bytes"), F.sum("input_sum").alias("input_bytes"),
        F.sum("run_sum").alias("task_ms"), F.sum("fetch_sum").alias("fetch_ms"), F.sum("failed_attempts").alias("failed_attempts"), F.sum("extra_attempts").alias("extra_attempts"),
        F.max("skew").alias("max_skew"), F.max("gc_ratio").alias("max_gc"), F.count("*").alias("n_stages"),
    )
    failed = jobs.groupBy("app_id", "execution_id").agg(F.bool_or("failed").alias("failed"))
    done = F.when(F.col("end_ms") > 0, F.col("end_ms") - F.col("start_ms")).otherwise(0)
    e = execs.select("app_id", "execution_id", done.alias("duration_ms"), (F.col("end_ms") <= 0).alias("running"))
    key = ["app_id", "execution_id"]
    return e.join(total, key, "left").join(failed, key, "left").withColumn("fetch_ratio", ratio(F.col("fetch_ms"), F.col("task_ms")))


def app_summary(execs: DataFrame, jobs: DataFrame, stages: DataFrame, cores: DataFrame) -> DataFrame:
    """Counts of executions, jobs and stages, the time from the first start to the last end, and the peak of cores (app_id, cores)."""
    a = execs.groupBy("app_id").agg(F.count("*").alias("n_sql"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))
    return a.join(jobs.groupBy("app_id").agg(F.count("*").alias("n_jobs")), "app_id").join(stages.groupBy("app_id").agg(F.count("*").alias("n_stages")), "app_id").join(cores, "app_id", "left")
