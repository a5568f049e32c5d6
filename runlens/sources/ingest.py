"""Incremental ingest: changed logs become tables in a store, and a manifest says which of them count."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.stages import attribute_stage_to_sql
from runlens.sources import event_logs as L
from runlens.sources import plans
from runlens.sources.folders import small_files
from runlens.sources.reports import log_snapshot_key

MANIFEST = "log string, key string, parameters string, files long, lines long, run string, seq long"
#: Event kinds that stored lines are partitioned by; all others are one partition.
OTHER = "Other"
STORED = (*L.KINDS, "DriverAccumUpdates", "StageExecutorMetrics")


def parameter_key(parameters: Mapping[str, object] | None) -> str:
    """A hash of parameters by name and text, whatever their order."""
    text = "\n".join(f"{k}={v}" for k, v in sorted((parameters or {}).items()))
    return hashlib.sha256(text.encode()).hexdigest()


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table of the store, or none where it was never written."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(log, key, parameters, files, lines, run, seq): every log of every ingest that has come to its end."""
    got = _read(spark, f"{store}/manifest", MANIFEST)
    return spark.createDataFrame([], MANIFEST) if got is None else got


def latest(entries: DataFrame) -> DataFrame:
    """The entry of each log that counts: the one of the last ingest."""
    rest = [c for c in entries.columns if c != "log"]
    return entries.groupBy("log").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("log", "e.*")


def changed_logs(keys: DataFrame, entries: DataFrame, parameters: str) -> DataFrame:
    """(log, key) of the logs that must be read: not in the manifest, or with another key or other parameters than there."""
    same = latest(entries).where(F.col("parameters") == parameters).select("log", "key")
    return keys.join(same, ["log", "key"], "left_anti")


def _entities(lines: DataFrame, write: Callable[[str, DataFrame], DataFrame]) -> None:
    """Writes the entity tables of lines, each with the application's id; later ones are built from those written before. Lines of
    tasks, most of all, are decoded once: what accumulators and bad lines need of them is written with the tasks."""
    apps = L.build_apps(lines)
    name = F.concat_ws("_", "app_id", "attempt")
    apps = write("apps", apps.withColumn("app_id", F.coalesce(F.nullif(name, F.lit("")), F.col("log"))))
    owner = apps.select("log", "app_id")

    def named(table: str, rows: DataFrame) -> DataFrame:
        return write(table, rows.join(owner, "log", "left").withColumn("app_id", F.coalesce("app_id", "log")))

    jobs = named("jobs", L.build_jobs(lines))
    of = attribute_stage_to_sql(jobs.drop("app_id").withColumnRenamed("log", "app_id")).withColumnRenamed("app_id", "log")
    tasks = named("tasks", L.build_task_attempts(lines, rest=True).join(of, ["log", "stage_id"], "left"))
    named("stages", L.build_stages(lines, tasks).join(of, ["log", "stage_id"], "left"))
    named("executions", L.build_executions(lines))
    named("executor_events", L.executor_events(lines))
    partial = write("partial_logs", L.partial_logs(lines, tasks))
    named("plan_metrics", plans.plan_metrics(lines, tasks, partial))
    named("plan_changes", plans.plan_drift(lines))
    named("heaps", plans.heap_peaks(lines))
    named("bad_lines", L.bad_lines(lines, partial))


def ingest(spark: SparkSession, path: str, store: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """Brings the store up to date with the logs below a path; returns the manifest's entries of this run, none if nothing changed.

    Files are listed and chosen (`resolve_log_parts`); a log whose snapshot key (names, lengths and times of its parts) and
    parameters stand in the manifest is not opened. Lines of all other logs are written once, partitioned by event kind, then
    the entity tables, each in a folder that is named after what the run reads. At last the manifest gets the run's
    entries. Readers (`table`) see a log's rows only in the run that its last manifest entry names, so a run that dies in between
    leaves nothing visible, and when it is repeated it overwrites its own folders. A log that changed is read as a whole.
    """
    parameters_key = parameter_key(parameters)
    with small_files(spark):
        files = L.resolve_log_parts(L.list_logs(spark, path)).persist()  # each look at the files would open them all
        try:
            return _ingest(spark, files, store, parameters_key)
        finally:
            files.unpersist()


def _ingest(spark: SparkSession, files: DataFrame, store: str, parameters_key: str) -> DataFrame:
    """ingest of the chosen files."""
    entries = manifest(spark, store)
    todo = changed_logs(log_snapshot_key(files), entries, parameters_key)
    run = todo.agg(F.count("*").alias("n"), F.sum(F.xxhash64("log", "key", F.lit(parameters_key)).cast("decimal(38,0)")).alias("x")).first()
    if not run["n"]:
        return spark.createDataFrame([], MANIFEST)
    name = hashlib.sha256(f"{run['n']} {run['x']}".encode()).hexdigest()[:16]
    paths = [r["file"] for r in files.join(todo, "log", "left_semi").select("file").collect()]
    at = f"{store}/lines/run={name}"
    kind = L.kind_of(F.col("value"))
    L.read_parts(spark, paths).withColumn("kind", F.when(kind.isin(*STORED), kind).otherwise(OTHER)).write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(at)
    lines = spark.read.schema("log string, part int, value string, kind string").parquet(at)

    def write(table: str, rows: DataFrame) -> DataFrame:
        to = f"{store}/{table}/run={name}"
        plain = {f"parquet.enable.dictionary#{c}": "false" for c, t in rows.dtypes if t == "bigint" or c == "accumulables"}  # values that hardly repeat
        rows.write.mode("overwrite").options(**plain).parquet(to)
        return spark.read.schema(rows.schema).parquet(to)

    _entities(lines, write)
    seq = (entries.agg(F.max("seq")).first()[0] or 0) + 1
    n = files.join(todo, "log").groupBy("log").agg(F.first("key").alias("key"), F.count("*").alias("files"))
    new = n.join(lines.groupBy("log").agg(F.count("*").alias("lines")), "log", "left")
    new = new.select("log", "key", F.lit(parameters_key).alias("parameters"), "files", F.coalesce("lines", F.lit(0)).alias("lines"), F.lit(seq).cast("long").alias("seq"))
    new.write.mode("overwrite").parquet(f"{store}/manifest/run={name}")
    return manifest(spark, store).where(F.col("run") == name)


def table(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The visible rows of an entity table (or of `lines`): those of the run that each log's last manifest entry names."""
    rows = _read(spark, f"{store}/{name}")
    if rows is None:
        return None
    seen = latest(manifest(spark, store)).select("log", "run")
    return rows.withColumn("run", F.col("run").cast("string")).join(seen, ["log", "run"], "left_semi").drop("run")


def _long(c: str) -> Column:
    return F.col(c).cast("long")


def telemetry(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The store's tables as operators take them, by app_id: v_task, v_stage, v_job, v_exec, v_executor_event, v_conf, and, under their own
    names, plan_metrics, plan_changes, heaps, bad_lines and apps; clock_errors counts the attempts that v_task leaves out, as their
    times cannot be."""
    t = {name: table(spark, store, name) for name in ("apps", "jobs", "tasks", "stages", "executions", "executor_events", "plan_metrics", "plan_changes", "heaps", "bad_lines")}
    if t["apps"] is None:
        raise ValueError(f"nothing has been ingested into {store}")
    metrics = ("cpu_ns", "gc_ms", "fetch_wait_ms", "deser_ms", "shuffle_read_bytes", "shuffle_write_bytes", "input_bytes", "output_bytes", "disk_spill_bytes", "memory_spill_bytes", "result_size")
    out = {
        "v_task": t["tasks"].where("valid").select(
            "app_id", "execution_id", "stage_id", "task_id", "executor_id", "host", F.coalesce("run_ms", F.lit(0)).alias("run_ms"), "launch_ms", "finish_ms", *[_long(c) for c in metrics],
            F.expr("shuffle_write_ns div 1000000").alias("shuffle_write_ms"), "failed", "speculative", "reason", "src_host", _long("part_idx"), "locality",
        ),
        "v_stage": t["stages"].select("app_id", "execution_id", "stage_id", "submission_ms", "first_launch_ms", "completion_ms", _long("num_tasks"), _long("failed_attempts"), _long("extra_attempts"), "parent_ids"),
        "v_job": t["jobs"].select("app_id", "execution_id", _long("job_id"), "submission_ms", "completion_ms", "failed", "stage_ids"),
        "v_exec": t["executions"].select("app_id", "execution_id", F.coalesce("start_ms", F.lit(0)).alias("start_ms"), F.coalesce("end_ms", F.lit(0)).alias("end_ms"), "description", "plan"),
        "v_executor_event": t["executor_events"].select("app_id", "executor_id", "time_ms", _long("cores"), "added"),
        "v_conf": t["apps"].select("app_id", F.explode("conf").alias("key", "value")),
    }
    out["clock_errors"] = t["tasks"].where("not valid").groupBy("app_id").agg(F.count("*").alias("attempts"))
    return out | {name: t[name] for name in ("apps", "plan_metrics", "plan_changes", "heaps", "bad_lines")}
