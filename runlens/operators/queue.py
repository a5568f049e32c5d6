"""Sampling, leaderboards and roll-ups of whole applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions.text import template_hash
from runlens.operators.intervals import SQL
from runlens.operators.stages import mean_of, micros, ratio

COMPLETED = "not running and duration_ms > 0"
#: How the deep sample is drawn, as reports name it.
SAMPLING = "slowest executions, and some with spill, fetch waits, gc, skew and of each template"
#: Condition of each stratum of the deep sample, over light metrics.
STRATA = {"spill": "spill_bytes > 0", "fetch": "fetch_ratio >= 0.2", "gc": "max_gc >= 0.1", "skew": "max_skew >= 5"}


def _first(n: int, order: list[Column], *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= n


def deep_sample(light: DataFrame, execs: DataFrame, top: int = 50, k: int = 5) -> DataFrame:
    """Completed executions chosen for deep analysis: the slowest, some of each stratum, and some of one per template."""
    order = [F.desc("duration_ms"), F.col("execution_id")]
    x = light.where(COMPLETED).join(execs.select(*SQL, template_hash(F.col("description")).alias("template")), SQL)
    x = x.withColumn("slow", _first(top, order, "app_id"))
    for name, c in STRATA.items():
        x = x.withColumn("_c", F.coalesce(F.expr(c), F.lit(False))).withColumn(name, F.col("_c") & _first(k, order, "app_id", "_c"))
    x = x.withColumn("_t", _first(1, order, "app_id", "template")).withColumn("template_first", F.col("_t") & _first(k, order, "app_id", "_t"))
    names = ["slow", *STRATA, "template_first"]
    return x.select(*SQL, "duration_ms", *names).where(" or ".join(names))


def sampled_queries(sample: DataFrame) -> DataFrame:
    """The deep sample, slowest first."""
    w = Window.partitionBy("app_id").orderBy(F.desc("duration_ms"), "execution_id")
    return sample.select(*SQL, "duration_ms", F.row_number().over(w).alias("place"))


def top_slow_queries(light: DataFrame, contention: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("app_id").orderBy(F.desc("duration_ms"), "execution_id")
    x = light.where(COMPLETED).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return x.join(contention, SQL, "left").select(*SQL, "place", "duration_ms", "pool_utilization", "own_share", "limited", "inefficient")


def top_resource_hogs(contention: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("app_id").orderBy(F.desc("own_core_ms"), "execution_id")
    return contention.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*SQL, "place", "own_core_ms")


def template_stats(light: DataFrame, execs: DataFrame, own: DataFrame, n: int = 20) -> DataFrame:
    """Runs, time and bytes of every statement template, the costliest `n` an application. Core time is what an execution
    holds itself (own: app_id, execution_id, own_core_ms), where that is unknown its task time."""
    x = light.where(COMPLETED).join(own, SQL, "left").withColumn("task_ms", F.coalesce("own_core_ms", "task_ms")).join(execs.select(*SQL, template_hash(F.col("description")).alias("template")), SQL)
    x = x.groupBy("app_id", "template").agg(F.count("*").alias("queries"), F.sum("duration_ms").alias("duration_ms"), F.sum("task_ms").alias("core_ms"), F.sum("input_bytes").alias("input_bytes"), F.sum("read_bytes").alias("read_bytes"))
    w = Window.partitionBy("app_id").orderBy(F.desc("core_ms"), F.desc("duration_ms"), "template")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def dominant_shuffle_stage(metrics: DataFrame) -> DataFrame:
    size = F.greatest("read_sum", "write_sum")
    return metrics.groupBy(*SQL).agg(F.max_by("stage_id", F.struct(size, -F.col("stage_id"))).alias("stage_id"), F.max(size).alias("bytes"))


def queue_summary(light: DataFrame, window: DataFrame, cores: DataFrame) -> DataFrame:
    x = light.groupBy("app_id").agg(F.count("*").alias("queries"), F.count_if(F.expr(COMPLETED)).alias("completed"), F.count_if("running").alias("running"), F.count_if("failed").alias("failed"))
    return x.join(window, "app_id").join(cores, "app_id")


def utilization_series(buckets: DataFrame) -> DataFrame:
    """Mean and peak of an application's buckets and the buckets themselves in order, which the length of its window bounds."""
    points = F.sort_array(F.collect_list(F.struct("bucket_ms", "utilization")))
    return buckets.groupBy("app_id").agg(mean_of(micros("utilization")).alias("mean"), F.max("utilization").alias("peak"), F.count("*").alias("buckets"), points.alias("points"))


def resource_metrics(light: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Spill, quantiles of the largest gc share (basis points) and attempt ratios of every application, with the means of its
    buckets' ratios where they are given (profile.bucket_means)."""
    bp = F.floor(F.coalesce("max_gc", F.lit(0.0)) * 10_000 + 0.5).cast("long")
    x = light.withColumn("bp", bp)
    base = F.sum(F.col("failed_attempts") + F.col("extra_attempts") + F.greatest(F.lit(1), F.col("n_stages")))
    out = x.groupBy("app_id").agg(
        F.sum("spill_bytes").alias("spill_bytes"), mean_of(F.col("bp") * 1_000_000).alias("gc_mean_bp"), F.expr("percentile_disc(0.95) within group (order by bp)").cast("long").alias("gc_p95_bp"), F.max("bp").alias("gc_max_bp"),
        ratio(F.sum("failed_attempts"), base).alias("failed_ratio"), ratio(F.sum("extra_attempts"), base).alias("extra_ratio"),
    )
    return out if means is None else out.join(means, "app_id", "left")


def contention_report(contention: DataFrame, buckets: DataFrame, hogs: int = 10, hot_at: float = 0.95) -> DataFrame:
    """Shares of limited and inefficient executions, starved executions, hot buckets in order, and the executions that hold the most
    core time. `starvation_windows` has the starved ones one by one."""
    c = contention.groupBy("app_id").agg(
        ratio(F.count_if("limited"), F.count("*")).alias("limited_share"), ratio(F.count_if("inefficient"), F.count("*")).alias("inefficient_share"),
        F.count_if(F.col("limited") & (F.col("own_share") <= 0.2)).alias("starved"),
    )
    top = top_resource_hogs(contention, hogs).groupBy("app_id").agg(F.sort_array(F.collect_list(F.struct("place", "execution_id", "own_core_ms"))).alias("hogs"))
    hot = buckets.groupBy("app_id").agg(F.count_if(F.col("utilization") >= hot_at).alias("hot_buckets"), F.sort_array(F.collect_list(F.when(F.col("utilization") >= hot_at, F.col("bucket_ms")))).alias("hot_windows"))
    return c.join(hot, "app_id").join(top, "app_id", "left")


def throughput_leaderboards(light: DataFrame, execs: DataFrame) -> DataFrame:
    """Submitted, completed and failed executions an hour and the share of completed ones without a failed job, with a
    total for each application (hour null). `leaders` and `template_failures` have the boards themselves."""
    x = light.join(execs.select(*SQL, F.expr("start_ms div 3600000 * 3600000").alias("hour_ms")), SQL)
    done = F.expr(COMPLETED)
    x = x.groupingSets([["app_id", "hour_ms"], ["app_id"]], "app_id", "hour_ms").agg(F.count("*").alias("submitted"), F.count_if(done).alias("completed"), F.count_if("failed").alias("failed"), F.count_if(done & ~F.coalesce("failed", F.lit(False))).alias("good"))
    return x.withColumn("success_rate", ratio(F.col("good"), F.col("completed"))).drop("good")


def leaders(light: DataFrame, waiting: DataFrame, n: int = 20) -> DataFrame:
    """The `n` slowest, costliest (task time) and longest queued executions of each application: board, place, value.

    Places are cut at `n` in every partition before the shuffle, so a very large application sends few rows to its task.
    """
    slow = light.where(COMPLETED).select(*SQL, F.lit("slow").alias("board"), F.col("duration_ms").alias("value"))
    costly = light.where("task_ms > 0").select(*SQL, F.lit("costly").alias("board"), F.col("task_ms").alias("value"))
    queued = waiting.where("wait_ms > 0").select(*SQL, F.lit("queued").alias("board"), F.col("wait_ms").alias("value"))
    w = Window.partitionBy("app_id", "board").orderBy(F.desc("value"), "execution_id")
    return slow.unionByName(costly).unionByName(queued).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def template_failures(classes: DataFrame, execs: DataFrame) -> DataFrame:
    """Failed attempts by class and statement template, with totals by class and by application. classes: app_id, execution_id, class, n."""
    x = classes.join(execs.select(*SQL, template_hash(F.col("description")).alias("template")), SQL)
    sets = [["app_id", "class", "template"], ["app_id", "class"], ["app_id"]]
    return x.groupingSets(sets, "app_id", "class", "template").agg(F.sum("n").alias("failures"), F.count_distinct("execution_id").alias("executions"))
