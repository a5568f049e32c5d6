"""Configuration, health of applications, and what changed against earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions.text import size_bytes, template_hash
from runlens.operators.features import p
from runlens.operators.intervals import SQL
from runlens.operators.queue import COMPLETED
from runlens.operators.stages import half_up, ratio

#: Configuration keys that are checked, with the advised value.
CHECKLIST = {"spark.sql.adaptive.enabled": "true", "spark.eventLog.rolling.enabled": "true", "spark.eventLog.logStageExecutorMetrics": "true", "spark.scheduler.mode": "FAIR"}


def conf_value(key: str) -> Column:
    return F.max(F.when(F.col("key") == key, F.col("value")))


def config_check(conf: DataFrame) -> DataFrame:
    """Each application's value of every key of the checklist, and whether it differs from what is advised. conf: app_id, key, value."""
    want = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("advised")) for k, v in CHECKLIST.items()]))
    x = conf.groupBy("app_id").agg(*[conf_value(k).alias(f"v{n}") for n, k in enumerate(CHECKLIST)])
    now = F.coalesce(*[F.when(F.col("c.key") == k, F.col(f"v{n}")) for n, k in enumerate(CHECKLIST)])
    x = x.withColumn("c", want).select("app_id", "c.key", now.alias("current"), "c.advised")
    return x.withColumn("issue", ~F.coalesce(F.lower("current") == F.lower("advised"), F.lit(False)))


def aqe_context(conf: DataFrame) -> DataFrame:
    """Adaptive execution as configured, with Spark's defaults for what is not set."""
    on = lambda k: F.coalesce(F.lower(conf_value(k)) == "true", F.lit(True))
    return conf.groupBy("app_id").agg(
        on("spark.sql.adaptive.enabled").alias("adaptive"), on("spark.sql.adaptive.coalescePartitions.enabled").alias("coalesce_partitions"), on("spark.sql.adaptive.skewJoin.enabled").alias("skew_join"),
        size_bytes(conf_value("spark.sql.adaptive.advisoryPartitionSizeInBytes"), 64 << 20).alias("advisory_bytes"),
        F.coalesce(conf_value("spark.sql.shuffle.partitions").try_cast("long"), F.lit(200).cast("long")).alias("shuffle_partitions"))


def task_memory_budget(conf: DataFrame) -> DataFrame:
    """Execution memory for one task: 0.6 of the executor's memory over its cores."""
    x = conf.groupBy("app_id").agg(size_bytes(conf_value("spark.executor.memory"), 4 << 30).alias("memory_bytes"), F.greatest(F.coalesce(conf_value("spark.executor.cores").try_cast("long"), F.lit(1)), F.lit(1)).cast("long").alias("cores"))
    return x.withColumn("task_bytes", F.floor(F.col("memory_bytes") * 0.6 / F.col("cores")).cast("long"))


def driver_health(tasks: DataFrame, delays: DataFrame, gaps: DataFrame, gc: float = 0.15, delay_ms: int = 1000, gap: float = 0.25, big_bytes: int = 256 << 20, big: int = 10) -> DataFrame:
    """Four dimensions of each application (gc share, median scheduler delay of its stages, median driver gap, big results) and how many are bad."""
    t = tasks.groupBy("app_id").agg(ratio(F.sum("gc_ms"), F.sum("run_ms")).alias("gc_ratio"), F.count_if(F.col("result_size") >= big_bytes).alias("big_results"))
    x = t.join(delays.groupBy("app_id").agg(p("delay_p50", 0.5).alias("delay_p50")), "app_id").join(gaps.groupBy("app_id").agg(F.round(F.percentile("gap_ratio", F.lit(0.5)), 6).alias("gap_p50")), "app_id")
    bad = sum((c.cast("int") for c in (F.col("gc_ratio") >= gc, F.col("delay_p50") >= delay_ms, F.col("gap_p50") >= gap, F.col("big_results") >= big)), F.lit(0))
    return x.withColumn("bad", bad.cast("long"))


def memory_attribution(light: DataFrame, top: float = 0.5, wide: float = 0.5) -> DataFrame:
    """Where an application's spill comes from: one execution, most of them (the waterline is too low), or what runs at once."""
    x = light.groupBy("app_id").agg(F.count_if(F.col("spill_bytes") > 0).alias("affected"), ratio(F.max("spill_bytes"), F.sum("spill_bytes")).alias("top_share"), ratio(F.count_if(F.col("spill_bytes") > 0), F.count("*")).alias("affected_share"))
    return x.withColumn("verdict", F.when(F.col("affected") == 0, "NONE").when(F.col("top_share") >= top, "SINGLE_SQL").when(F.col("affected_share") >= wide, "WATERLINE").otherwise("CONCURRENCY"))


def baseline_history(light: DataFrame, execs: DataFrame, run: Column) -> DataFrame:
    """What each run of a template leaves for later comparison: samples, median time, plan, bytes."""
    e = execs.select(*SQL, template_hash(F.col("description")).alias("template"), F.md5("plan").alias("plan"), run.alias("run"))
    return light.where(COMPLETED).join(e, SQL).groupBy("template", "run").agg(
        F.count("*").alias("samples"), p("duration_ms", 0.5).alias("p50"), F.min("plan").alias("plan"), F.sum("input_bytes").alias("input_bytes"), F.sum("read_bytes").alias("read_bytes"))


def queue_drift(history: DataFrame, regressions: DataFrame, factor: float = 1.3, fraction: float = 0.3, rounds: int = 14) -> DataFrame:
    """Each run of a queue against its runs before, and the share of its templates that regressed.

    history: queue, run, duration_ms; regressions: run, regressed. One row a run is left before the window.
    """
    per = history.groupBy("queue", "run").agg(p("duration_ms", 0.5).alias("p50"))
    w = Window.partitionBy("queue").orderBy("run").rowsBetween(-rounds, -1)
    r = regressions.groupBy("run").agg(ratio(F.count_if("regressed"), F.count("*")).alias("regressed_share"))
    x = per.withColumn("base", half_up(F.avg("p50").over(w))).where("base is not null").join(r, "run", "left").na.fill(0.0, ["regressed_share"])
    x = x.withColumn("ratio", ratio(F.col("p50"), F.col("base")))
    return x.withColumn("drift", F.when(F.col("regressed_share") >= fraction, "SYSTEMIC").when(F.col("ratio") >= factor, "INDIVIDUAL").otherwise("NONE"))


def locate_sql(execs: DataFrame, wanted: DataFrame, statement: Column) -> DataFrame:
    """For each wanted text the executions of every application whose statement id it is, slowest first, else the execution with that number."""
    e = execs.select(*SQL, statement.alias("statement_id"), F.when(F.col("end_ms") > 0, F.col("end_ms") - F.col("start_ms")).otherwise(0).alias("duration_ms"))
    by_name = wanted.join(e, F.col("wanted") == F.col("statement_id")).select("wanted", *SQL, "duration_ms", F.lit(0).alias("how"))
    by_id = wanted.join(e, F.col("wanted").try_cast("long") == F.col("execution_id")).select("wanted", *SQL, "duration_ms", F.lit(1).alias("how"))
    first = F.min("how").over(Window.partitionBy("wanted"))
    x = by_name.unionByName(by_id).withColumn("first", first).where("how = first")
    w = Window.partitionBy("wanted").orderBy(F.desc("duration_ms"), "app_id", "execution_id")
    return x.select("wanted", *SQL, F.row_number().over(w).alias("place"))
