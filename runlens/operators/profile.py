"""Aggregates of stages, hosts and buckets that rules and reports share: each is one pass over the tasks, may be written as a
table, and everything about an application is then computed from these, not from its tasks again."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.intervals import SQL, cut_tasks, spine
from runlens.operators.stages import METRICS, POINTS, STAGE, half_up, mean_of, micros, percentile_of, ratio, task_distributions


def stage_profile(tasks: DataFrame, stages: DataFrame, big_bytes: int = 256 << 20) -> DataFrame:
    """One wide row a stage, from its tasks in one shuffle and from its own record. Stages without tasks have null measurements
    (`n` is null), tasks without a stage null times of the stage (`num_tasks` is null)."""
    delay = F.greatest(F.col("finish_ms") - F.col("launch_ms") - F.col("run_ms") - F.col("deser_ms"), F.lit(0))
    far = F.count_if(F.col("locality") == "ANY") + F.count_if(F.col("locality") == "RACK_LOCAL")
    own = {
        "fetch_sum": F.sum("fetch_wait_ms"), "cpu_sum": F.sum("cpu_ns"), "run_raw": F.sum("run_ms"), "gc_raw": F.sum("gc_ms"),
        "delay_p50": half_up(F.percentile(delay, F.lit(0.5))), "delay_sum": F.sum(delay), "result_sum": F.sum("result_size"), "result_max": F.max("result_size"),
        "big_results": F.count_if(F.col("result_size") >= big_bytes), "write_ms": F.sum("shuffle_write_ms"), "write_max_share": ratio(F.max("shuffle_write_bytes"), F.sum("shuffle_write_bytes")),
        "bad_ratio": ratio(far, F.count("*")), "done": F.count_if(~F.col("failed")), "negative": F.count_if(F.col("finish_ms") < F.col("launch_ms")), "last_ms": F.max("finish_ms"),
        "failed_tasks": F.count_if("failed"), "speculative": F.count_if("speculative"), "speculative_killed": F.count_if(F.col("reason").rlike("(?i)killed")),
    }
    t = task_distributions(tasks, extra={k: c for k, c in own.items()})
    s = stages.select(*STAGE, "parent_ids", "num_tasks", "failed_attempts", "extra_attempts", (F.col("completion_ms") - F.col("submission_ms")).alias("wall_ms"), F.greatest(F.col("first_launch_ms") - F.col("submission_ms"), F.lit(0)).alias("delay_ms"))
    x = s.join(t, STAGE, "full")
    return x.withColumns({
        "cpu_ratio": ratio(F.col("cpu_sum") / 1e6, F.col("run_raw")), "gc_ratio": ratio(F.col("gc_raw"), F.col("run_raw")),
        "fetch_ratio": ratio(F.col("fetch_sum"), F.col("run_raw")), "skew": ratio(F.col("run_max"), F.col("run_p50")),
    })


_NOT_CONTEXT = ("parent_ids", "num_tasks", "cpu_sum", "run_raw", "gc_raw", "big_results", "done", "negative", "last_ms", "failed_tasks", "speculative", "speculative_killed", "gc_ratio", "fetch_ratio", "skew")


def complete(profile: DataFrame) -> DataFrame:
    """Stages that have both tasks and a record."""
    return profile.where("n is not null and num_tasks is not null")


def contexts_of(profile: DataFrame, cores: int) -> DataFrame:
    """What the stage rules look at."""
    return complete(profile).drop(*_NOT_CONTEXT).withColumn("cores", F.lit(cores))


def attempts_of(profile: DataFrame) -> DataFrame:
    """Failed, speculative and killed attempts of each execution."""
    return profile.where("n is not null").groupBy(*SQL).agg(F.sum("failed_tasks").alias("failed_tasks"), F.sum("speculative").alias("speculative"), F.sum("speculative_killed").alias("speculative_killed"))


def host_profile(tasks: DataFrame, profile: DataFrame) -> DataFrame:
    """Tasks, stages, slowness (median of run time over the stage's median) and writes of each host."""
    med = profile.where("n is not null").select(*STAGE, F.greatest("run_p50", F.lit(1)).alias("median"))
    norm = tasks.select(*STAGE, "host", "run_ms").join(med, STAGE).select("app_id", "host", ratio(F.col("run_ms"), F.col("median")).alias("norm"))
    score = norm.repartition("app_id", "host").groupBy("app_id", "host").agg(percentile_of(micros("norm"), 0.5).alias("score"))  # whole groups: parts of medians are larger than their rows
    staged = tasks.where(" and ".join(f"{k} is not null" for k in STAGE))
    x = staged.groupBy("app_id", "host", "stage_id").agg(F.count("*").alias("tasks"), F.sum("shuffle_write_bytes").alias("bytes"), F.sum("shuffle_write_ms").alias("ms"), F.sum("disk_spill_bytes").alias("spill"))
    x = x.groupBy("app_id", "host").agg(F.sum("tasks").alias("tasks"), F.count("stage_id").alias("stages"), ratio(F.sum("bytes") * 1000.0, F.sum("ms")).alias("bytes_per_s"), F.sum("spill").alias("spill"))
    same = score.select(F.col("app_id").alias("_app"), F.col("host").alias("_host"), "score")
    x = x.join(same, (F.col("app_id") == F.col("_app")) & F.col("host").eqNullSafe(F.col("_host"))).drop("_app", "_host")
    m = x.groupBy("app_id").agg(F.percentile("bytes_per_s", F.lit(0.5)).alias("median"), F.sum("spill").alias("total"))
    return x.join(m, "app_id").select("app_id", "host", "score", "tasks", "stages", "bytes_per_s", ratio(F.col("bytes_per_s"), F.col("median")).alias("of_median"), ratio(F.col("spill"), F.col("total")).alias("spill_share"))


def bucket_profile(tasks: DataFrame, cores: int, width: int = 60_000) -> DataFrame:
    """Busy core time, task times by overlap, attempts and peak of each bucket that has tasks, in one pass: a task's measurements
    ride on the edge where its part of the bucket begins."""
    share = (F.col("z") - F.col("a")) / (F.col("finish_ms") - F.col("launch_ms"))
    run = F.when(F.col("run_ms") > 0, F.col("run_ms")).otherwise(F.col("finish_ms") - F.col("launch_ms"))
    here = F.col("a") == F.col("launch_ms")
    part = {"run_ms": run, "cpu_ns": F.col("cpu_ns"), "fetch_ms": F.col("fetch_wait_ms"), "gc_ms": F.col("gc_ms")}
    m = {k: F.floor(c * share + 0.5).cast("long") for k, c in part.items()} | {k: c.cast("long") for k, c in {"attempts": here, "failed": here & F.col("failed"), "speculative": here & F.col("speculative")}.items()}
    first = F.struct(F.col("a").alias("t"), F.lit(1).alias("d"), *[F.coalesce(c, F.lit(0)).alias(k) for k, c in m.items()])
    last = F.struct(F.col("z").alias("t"), F.lit(-1).alias("d"), *[F.lit(0).cast("long").alias(k) for k in m])
    x = cut_tasks(tasks, width).select("app_id", "b", F.explode(F.array(first, last)).alias("e")).select("app_id", "b", "e.*")
    x = x.groupBy("app_id", "b", "t").agg(F.sum("d").alias("d"), *[F.sum(k).alias(k) for k in m])
    w = Window.partitionBy("app_id", "b").orderBy("t")
    x = x.withColumn("running", F.sum("d").over(w)).withColumn("next", F.lead("t").over(w))
    busy = F.sum(F.when(F.col("next").isNotNull(), F.least("running", F.lit(cores)) * (F.col("next") - F.col("t"))))
    x = x.groupBy("app_id", "b").agg(busy.alias("busy_core_ms"), F.max("running").alias("peak_tasks"), *[F.sum(k).alias(k) for k in m])
    return x.select("app_id", (F.col("b") * width).alias("bucket_ms"), "busy_core_ms", "peak_tasks", *m)


def window_of(execs: DataFrame, profile: DataFrame) -> DataFrame:
    """From the first start to the last end of executions and tasks."""
    t = profile.groupBy("app_id").agg(F.max("last_ms").alias("last")).where("last is not null")
    e = execs.groupBy("app_id").agg(F.min(F.when(F.col("start_ms") > 0, F.col("start_ms"))).alias("window_start"), F.max(F.greatest("end_ms", "start_ms")).alias("end"))
    return e.join(t, "app_id").select("app_id", "window_start", F.greatest("end", "last").alias("window_end"))


def utilization_of(window: DataFrame, buckets: DataFrame, cores: int, width: int = 60_000) -> DataFrame:
    """All buckets of each application's window, empty ones too, with busy time, utilisation and shares of task time."""
    x = spine(window, width).select("app_id", (F.col("b") * width).alias("bucket_ms"), "span_ms").join(buckets, ["app_id", "bucket_ms"], "left")
    x = x.na.fill(0, [c for c in buckets.columns if c not in ("app_id", "bucket_ms")])
    return x.withColumns({
        "utilization": ratio(F.col("busy_core_ms"), F.col("span_ms") * cores), "cpu_efficiency": F.least(F.lit(1.0), ratio(F.col("cpu_ns") / 1e6, F.col("run_ms"))),
        "fetch_share": ratio(F.col("fetch_ms"), F.col("run_ms")), "gc_share": ratio(F.col("gc_ms"), F.col("run_ms")),
    }).drop("span_ms")


def bucket_means(utilization: DataFrame) -> DataFrame:
    """Means over an application's buckets, empty ones too, of utilisation, cpu efficiency, fetch share and gc share."""
    mean = lambda c: mean_of(micros(c))
    return utilization.groupBy("app_id").agg(mean("utilization").alias("mean_utilization"), mean("cpu_efficiency").alias("mean_cpu_efficiency"), mean("fetch_share").alias("mean_fetch_share"), mean("gc_share").alias("mean_gc_share"))


def profiles(tasks: DataFrame, stages: DataFrame, execs: DataFrame, cores: int, big_bytes: int = 256 << 20, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df, quantiles: Collection[str] | None = None, names: Collection[str] = ("stage", "host", "window", "bucket")) -> dict[str, DataFrame]:
    """The profiles by name: stage, host, bucket, window. keep: writes a table and reads it back, as sources.folders.written does;
    without it each use computes its profile again. quantiles: the quantile columns of stages that are looked at, as each costs a sort of
    its own; without it all are there. The median of run times always is. names: the profiles that are wanted; the others are not made."""
    stage = stage_profile(tasks, stages, big_bytes)
    if quantiles is not None:
        stage = stage.drop(*({f"{m}_{p}" for m in METRICS for p in POINTS} - {"run_p50", *quantiles}))
    stage = keep(stage, "stages")
    make = {
        "stage": lambda: stage, "host": lambda: keep(host_profile(tasks, stage), "hosts"), "window": lambda: window_of(execs, stage),
        "bucket": lambda: keep(utilization_of(window_of(execs, stage), bucket_profile(tasks, cores), cores), "buckets"),
    }
    return {k: f() for k, f in make.items() if k in names}
