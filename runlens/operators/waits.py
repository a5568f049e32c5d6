"""Who waits for whom: waits inside executions, consumers of buckets, monopolies, systemic slowness, speculation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.features import normalised_task_time
from runlens.operators.intervals import SQL, _edges, cut_tasks, runs_of_buckets
from runlens.operators.stages import STAGE, mean_of, micros, percentile_of, ratio


def buckets_of(execs: DataFrame, width: int = 60_000) -> DataFrame:
    """Each finished execution once for every bucket that its window touches."""
    b = F.explode(F.sequence(F.expr(f"start_ms div {width}"), F.expr(f"(end_ms - 1) div {width}"))).alias("b")
    return execs.where("end_ms > start_ms").select(*SQL, b)


def busy_ms(tasks: DataFrame, width: int = 60_000) -> DataFrame:
    """Time in which an execution has a task running. Unions of intervals are taken within buckets, so that a very
    large execution is dealt over its buckets."""
    w = Window.partitionBy(*SQL, "b").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    x = cut_tasks(tasks, width).select(*SQL, "b", "a", "z").withColumn("before", F.max("z").over(w))
    new = F.greatest(F.col("z") - F.greatest("a", F.coalesce("before", F.col("a"))), F.lit(0))
    return x.groupBy(*SQL).agg(F.sum(new).alias("busy_ms"))


def sql_queue_wait(execs: DataFrame, tasks: DataFrame, contention: DataFrame, wait_ratio: float = 0.4, busy_ratio: float = 0.85) -> DataFrame:
    """Time before an execution's first task and time between tasks with none running, against its wall time; where
    much is waited, a busy pool means a queue, an idle pool a scheduling anomaly."""
    t = tasks.groupBy(*SQL).agg(F.min("launch_ms").alias("first"), F.max("finish_ms").alias("last")).join(busy_ms(tasks), SQL)
    x = execs.where("end_ms > start_ms").join(t, SQL).join(contention.select(*SQL, "pool_utilization"), SQL)
    wait = F.greatest(F.col("first") - F.col("start_ms"), F.lit(0)) + F.greatest(F.col("last") - F.col("first") - F.col("busy_ms"), F.lit(0))
    x = x.select(*SQL, "pool_utilization", wait.alias("wait_ms"), ratio(wait, F.col("end_ms") - F.col("start_ms")).alias("wait_ratio"))
    verdict = F.when(F.col("wait_ratio") < wait_ratio, "SELF").when(F.col("pool_utilization") >= busy_ratio, "SLOW_DUE_TO_QUEUE").otherwise("SCHEDULING_ANOMALY")
    return x.withColumn("verdict", verdict)


def sql_queue_context(execs: DataFrame, utilization: DataFrame, width: int = 60_000) -> DataFrame:
    """Mean and p95 utilisation of the buckets of each execution's window, and how many executions share them on average."""
    x = buckets_of(execs, width)
    n = x.groupBy("app_id", "b").agg(F.count("*").alias("n"))
    u = utilization.select("app_id", F.expr(f"bucket_ms div {width}").alias("b"), "utilization").join(n, ["app_id", "b"])
    return x.join(u, ["app_id", "b"]).groupBy(*SQL).agg(
        mean_of(micros("utilization")).alias("mean_busy"), percentile_of(micros("utilization"), 0.95).alias("p95_busy"), mean_of(F.col("n") * 1_000_000).alias("mean_active"))


def sql_bucket_core_ms(tasks: DataFrame, cores: int, width: int = 60_000) -> DataFrame:
    """Core time of each execution in each bucket, capped at the pool."""
    w = Window.partitionBy(*SQL, "b").orderBy("t")
    x = _edges(cut_tasks(tasks, width), [*SQL, "b"], "a", "z").withColumn("n", F.sum("d").over(w)).withColumn("next", F.lead("t").over(w)).where("next is not null")
    return x.groupBy(*SQL, "b").agg(F.sum(F.least("n", F.lit(cores)) * (F.col("next") - F.col("t"))).alias("core_ms"))


def top_consumers_during(execs: DataFrame, bucket_cores: DataFrame, n: int = 5, width: int = 60_000) -> DataFrame:
    """The `n` others that use most core time in the buckets of each execution's window.

    The join is by (app, bucket): its size is that of the executions that share a bucket, which the pool bounds.
    """
    use = bucket_cores.select("app_id", "b", F.col("execution_id").alias("consumer"), "core_ms")
    x = buckets_of(execs, width).join(use, ["app_id", "b"]).where("consumer <> execution_id")
    x = x.groupBy(*SQL, "consumer").agg(F.sum("core_ms").alias("core_ms"))
    w = Window.partitionBy(*SQL).orderBy(F.desc("core_ms"), "consumer")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def monopoly_windows(bucket_cores: DataFrame, cores: int, share: float = 0.6, active: int = 3, minutes: float = 10, width: int = 60_000) -> DataFrame:
    """Runs of buckets in which one execution holds `share` of the pool while `active` or more use it."""
    n = bucket_cores.where("core_ms > 0").groupBy("app_id", "b").agg(F.count("*").alias("active"))
    x = bucket_cores.where(F.col("core_ms") >= share * cores * width).join(n, ["app_id", "b"]).where(F.col("active") >= active)
    key = F.struct(*SQL).alias("app_id")
    runs = runs_of_buckets(x.select(key, (F.col("b") * width).alias("bucket_ms")), F.lit(True), width).where(F.col("minutes") >= minutes)
    return runs.select("app_id.*", "start_ms", "minutes")


def systemic_windows(tasks: DataFrame, norm: float = 1.4, active: int = 3, host_share: float = 0.5, width: int = 60_000) -> DataFrame:
    """Launch buckets in which tasks of several executions are slow by the median of their normalised times, not those of one host alone."""
    x = normalised_task_time(tasks).withColumn("b", F.expr(f"launch_ms div {width}"))
    hosts = x.groupBy("app_id", "b", "host").agg(F.count("*").alias("k")).groupBy("app_id", "b").agg(ratio(F.max("k"), F.sum("k")).alias("top_host_share"))
    y = x.groupBy("app_id", "b").agg(F.round(F.percentile("norm", F.lit(0.5)), 6).alias("median_norm"), F.count_distinct("execution_id").alias("active")).join(hosts, ["app_id", "b"])
    y = y.where((F.col("median_norm") >= norm) & (F.col("active") >= active) & (F.col("top_host_share") <= host_share))
    return y.select("app_id", (F.col("b") * width).alias("bucket_ms"), "median_norm", "active", "top_host_share")


def speculation_outcomes(tasks: DataFrame) -> DataFrame:
    """Speculative copies of an execution's partitions: how many came first, how many did not, and the time of all attempts that lost.

    tasks: part_idx is the partition within its stage. One aggregation by partition stands for the join of copies.
    """
    order = F.when(~F.col("failed"), F.struct("finish_ms", "task_id"))
    x = tasks.groupBy(*STAGE, "part_idx").agg(
        F.count_if("speculative").alias("copies"), F.min_by("speculative", order).alias("won"), F.sum("run_ms").alias("total"), F.min_by("run_ms", order).alias("winner"))
    x = x.where("copies > 0")
    won = F.coalesce("won", F.lit(False)).cast("long")
    return x.groupBy(*SQL).agg(F.sum("copies").alias("copies"), F.sum(won).alias("won"), F.sum(F.col("copies") - won).alias("lost"), F.sum(F.col("total") - F.coalesce("winner", F.lit(0))).alias("extra_ms"))
