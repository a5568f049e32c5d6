"""Queries that go through event lines: the views are written as events, read back by the sources and built into tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import dag, intervals, profile, queue, rules, stages, whatif
from runlens.plans.fixtures import duck, tasks_by_app, view, views_over
from runlens.plans.queries import ALL, CORES, E, QUERIES, SQL, WITH_LIGHT, _body, _light, _q, _ratio, findings, register
from runlens.plans.rule_queries import QVIEWS, profiled, profiled_contention, profiled_light, profiled_queue_findings
from runlens.sources import event_logs as L
from runlens.sources import ingest, plans, reports
from runlens.sources.folders import shared_folder, small_files, written
from runlens.streaming import executions, snapshots


def plan_tree() -> Column:
    """An execution's plan tree as JSON, up to 43 nodes deep; a text in it holds what a name of a node looks like."""
    m = lambda *ks: F.concat(F.lit('],"metadata":{},"metrics":['), *[x for i, (k, name, kind) in enumerate(ks) for x in (F.lit(("," if i else "") + '{"name":"' + name + '","accumulatorId":'), F.col("execution_id") * 100 + k, F.lit(',"metricType":"' + kind + '"}'))], F.lit("]}"))
    node = lambda name, children, metrics: F.concat(F.lit('{"nodeName":"' + name + '","simpleString":"see \\"nodeName\\":\\"x\\" [1]","children":['), *children, metrics)
    scan = node("Scan parquet", [], m((1, "number of files read", "sum"), (2, "size of files read", "size"), (6, "number of output rows", "sum")))
    join = node("SortMergeJoin", [node("Exchange", [scan], m((3, "data size", "size"))), F.lit(","), node("BroadcastExchange", [], m((4, "data size", "size")))], m((5, "number of output rows", "sum")))
    deep = (F.col("execution_id") % 40).cast("int")
    chain = F.concat(F.repeat(F.lit('{"nodeName":"Project","simpleString":"","children":['), deep), join, F.repeat(F.lit('],"metadata":{},"metrics":[]}'), deep))
    return node("Execute InsertIntoHadoopFsRelationCommand", [chain], m((7, "number of written files", "sum"), (8, "written output", "size")))


def event_lines(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda t: t, tasks: bool = True, views: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(log, part, value, kind): the fixture views as the lines of event logs, one log an application.

    Tasks, their spans and executions are written once, as most kinds are made of them. `kind` is what stored lines are partitioned by, so
    who reads one kind computes and encodes the lines of that kind alone. dealt: how the tasks are to lie before their lines are made.
    tasks: false for who reads no lines of tasks or stages; the spans alone are written then, which all other kinds are made of.
    views: the views by name, for who writes others of them.
    """
    v = views or views_over(spark, sf_dir, ("v_task", "spans", "v_exec") if tasks else ("spans",))
    at = lambda **c: [x.alias(k.replace("_", " ")) for k, x in c.items()]
    c, st = F.col, F.struct

    def lines(df: DataFrame, kind: str, *fields, value: Callable[[Column], Column] = lambda x: x) -> DataFrame:
        event = F.to_json(st(F.lit(kind).alias("Event"), *fields))
        return df.select(c("app_id").alias("log"), F.lit(1).alias("part"), value(event).alias("value"), F.lit(kind.rpartition("SparkListener")[2]).alias("kind"))

    def lines_of_plans(df: DataFrame, kind: str, *fields) -> DataFrame:
        return lines(df, kind, *fields, value=lambda x: F.concat(F.left(x, F.length(x) - 1), F.lit(',"sparkPlanInfo":'), plan_tree(), F.lit("}")))

    t, e, j, s, x = v("v_task"), v("v_exec"), v("v_job"), v("v_stage"), v("v_executor_event")
    info = st(*at(Task_ID=c("task_id"), Launch_Time=c("launch_ms"), Finish_Time=c("finish_ms"), Executor_ID=c("executor_id")), c("host").alias("Host"), c("locality").alias("Locality"), c("speculative").alias("Speculative"), c("part_idx").alias("Index"), F.array(st((c("execution_id") * 100 + 5).alias("ID"), c("run_ms").cast("string").alias("Update"))).alias("Accumulables")).alias("Task Info")
    read = st(*at(Fetch_Wait_Time=c("fetch_wait_ms"), Remote_Bytes_Read=c("shuffle_read_bytes")), F.lit(0).alias("Local Bytes Read"))
    metrics = st(*at(Executor_Run_Time=c("run_ms"), Executor_CPU_Time=c("cpu_ns"), JVM_GC_Time=c("gc_ms"), Executor_Deserialize_Time=c("deser_ms"), Result_Size=c("result_size"), Disk_Bytes_Spilled=c("disk_spill_bytes"), Memory_Bytes_Spilled=c("memory_spill_bytes")), read.alias("Shuffle Read Metrics"), st(*at(Shuffle_Bytes_Written=c("shuffle_write_bytes"), Shuffle_Write_Time=c("shuffle_write_ms") * 1_000_000)).alias("Shuffle Write Metrics"), st(*at(Bytes_Read=c("input_bytes"))).alias("Input Metrics"), st(*at(Bytes_Written=c("output_bytes"))).alias("Output Metrics")).alias("Task Metrics")
    stage = st(*at(Stage_ID=c("stage_id"), Stage_Attempt_ID=F.lit(0), Number_of_Tasks=c("num_tasks"), Parent_IDs=c("parent_ids"), Submission_Time=c("submission_ms"), Completion_Time=c("completion_ms"))).alias("Stage Info")
    ui, sl = "org.apache.spark.sql.execution.ui.SparkListener", "SparkListener"
    apps = e.groupBy("app_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z"))
    out = [
        lines(apps, f"{sl}ApplicationStart", c("app_id").alias("App ID"), c("app_id").alias("App Name"), c("a").alias("Timestamp")),
        lines(apps.where("app_id not like '%1'"), f"{sl}ApplicationEnd", c("z").alias("Timestamp")),
        lines(v("v_conf").groupBy("app_id").agg(F.map_from_entries(F.collect_list(st("key", "value"))).alias("m")), f"{sl}EnvironmentUpdate", c("m").alias("Spark Properties")),
        lines(v("v_node").where("k <> 5").groupBy("app_id", "execution_id").agg(F.collect_list(F.array(F.expr("execution_id * 100 + k"), c("total"))).alias("u")), f"{ui}DriverAccumUpdates", c("execution_id").alias("executionId"), c("u").alias("accumUpdates")),
        lines_of_plans(e, f"{ui}SQLExecutionStart", c("execution_id").alias("executionId"), c("description"), c("plan").alias("physicalPlanDescription"), c("start_ms").alias("time")),
        lines(e.where("end_ms > 0"), f"{ui}SQLExecutionEnd", c("execution_id").alias("executionId"), c("end_ms").alias("time")),
        lines_of_plans(e.where("execution_id % 3 = 0"), f"{ui}SQLAdaptiveExecutionUpdate", c("execution_id").alias("executionId"), F.concat("plan", F.when(c("execution_id") % 2 == 0, " final").otherwise("")).alias("physicalPlanDescription")),
        lines(j, f"{sl}JobStart", *at(Job_ID=c("job_id"), Submission_Time=c("submission_ms"), Stage_IDs=c("stage_ids")), F.create_map(F.lit("spark.sql.execution.id"), c("execution_id").cast("string")).alias("Properties")),
        lines(j, f"{sl}JobEnd", *at(Job_ID=c("job_id"), Completion_Time=c("completion_ms")), st(F.when(c("failed"), "JobFailed").otherwise("JobSucceeded").alias("Result")).alias("Job Result")),
        lines(s, f"{sl}StageCompleted", stage), lines(dealt(t), f"{sl}TaskEnd", *at(Stage_ID=c("stage_id"), Stage_Attempt_ID=F.lit(0)), st(c("reason").alias("Reason"), F.when(c("src_host").isNotNull(), st(c("src_host").alias("Host"))).alias("Block Manager Address")).alias("Task End Reason"), info, metrics),
        lines(x.where("added"), f"{sl}ExecutorAdded", c("time_ms").alias("Timestamp"), c("executor_id").alias("Executor ID"), st(F.lit("h").alias("Host"), c("cores").alias("Total Cores")).alias("Executor Info")),
        lines(x.where("not added"), f"{sl}ExecutorRemoved", c("time_ms").alias("Timestamp"), c("executor_id").alias("Executor ID"), F.lit("lost").alias("Removed Reason")),
    ]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def from_lines(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None, tasks: bool = True) -> None:
    QUERIES[name] = lambda spark, d: make(event_lines(spark, d, tasks=tasks))
    if sql:
        SQL[name] = duck(sql)


from_lines("parse_events", lambda x: L.parse_events(x, "TaskEnd").groupBy("log").agg(F.count("*").alias("events")), "SELECT app_id AS log, count(*) AS events FROM v_task GROUP BY app_id")
from_lines("build_apps", lambda x: L.build_apps(x).withColumn("cores", F.col("conf")["spark.executor.cores"]).drop("conf", "attempt"), "SELECT app_id AS log, app_id, app_id AS app_name, min(start_ms) AS start_ms, CASE WHEN app_id NOT LIKE '%1' THEN max(end_ms) END AS end_ms, app_id LIKE '%1' AS incomplete, (SELECT any_value(value) FROM v_conf c WHERE c.app_id = v_exec.app_id AND key = 'spark.executor.cores') AS cores FROM v_exec GROUP BY app_id", tasks=False)
from_lines("build_executions", lambda x: L.build_executions(x).withColumn("job_ids", F.array_join(F.col("job_ids").cast("array<string>"), ",")), "SELECT app_id AS log, execution_id, start_ms, CASE WHEN end_ms > 0 THEN end_ms END AS end_ms, description, plan, end_ms <= 0 AS incomplete, (SELECT string_agg(job_id, ',' ORDER BY job_id) FROM v_job j WHERE j.app_id = e.app_id AND j.execution_id = e.execution_id) AS job_ids FROM v_exec e", tasks=False)
from_lines("build_jobs", lambda x: L.build_jobs(x).withColumn("stage_ids", F.array_join(F.col("stage_ids").cast("array<string>"), ",")), "SELECT app_id AS log, job_id::int AS job_id, execution_id, array_to_string(stage_ids, ',') AS stage_ids, submission_ms, completion_ms, failed FROM v_job", tasks=False)
from_lines("build_stages", lambda x: L.build_stages(x).withColumn("parents", F.size("parent_ids")).drop("parent_ids", "last_attempt", "attempts"), """SELECT app_id AS log, stage_id, num_tasks::int AS num_tasks, len(parent_ids)::int AS parents, submission_ms, completion_ms, first_launch_ms, failed_attempts, extra_attempts,
  run_ms, fetch_wait_ms, shuffle_read_bytes, shuffle_write_bytes, input_bytes, output_bytes, disk_spill_bytes
FROM v_stage JOIN (SELECT app_id, stage_id, sum(run_ms)::bigint AS run_ms, sum(fetch_wait_ms)::bigint AS fetch_wait_ms, sum(shuffle_read_bytes)::bigint AS shuffle_read_bytes, sum(shuffle_write_bytes)::bigint AS shuffle_write_bytes, sum(input_bytes)::bigint AS input_bytes, sum(output_bytes)::bigint AS output_bytes, sum(disk_spill_bytes)::bigint AS disk_spill_bytes FROM v_task GROUP BY ALL) t USING (app_id, stage_id)""")
from_lines("build_task_attempts", lambda x: L.build_task_attempts(x).drop("attempt"), "SELECT app_id AS log, stage_id, task_id, part_idx::int AS part_idx, executor_id, host, locality, launch_ms, finish_ms, run_ms, cpu_ns, gc_ms, deser_ms, result_size, disk_spill_bytes, memory_spill_bytes, shuffle_write_ms * 1000000 AS shuffle_write_ns, fetch_wait_ms, shuffle_write_bytes, input_bytes, output_bytes, shuffle_read_bytes, speculative, reason, failed, src_host, finish_ms >= launch_ms AS valid FROM v_task")
from_lines("executor_events", L.executor_events, "SELECT app_id AS log, executor_id, time_ms, cores::int AS cores, added FROM v_executor_event", tasks=False)
from_lines("plan_metrics", lambda x: plans.plan_metrics(x).select("log", "execution_id", "node", "depth", "metric", "kind", "total"), """SELECT app_id AS log, execution_id, node, (CASE k WHEN 7 THEN 1 WHEN 8 THEN 1 WHEN 5 THEN 2 + execution_id % 40 WHEN 3 THEN 3 + execution_id % 40 WHEN 4 THEN 3 + execution_id % 40 ELSE 4 + execution_id % 40 END)::int AS depth,
  metric, CASE WHEN k IN (2, 3, 4, 8) THEN 'size' ELSE 'sum' END AS kind, total FROM v_node""")
from_lines("sql_plan_metrics", lambda x: plans.sql_plan_metrics(plans.plan_metrics(x)).drop("skewed_partitions", "coalesced_partitions", "row_amp"), """SELECT app_id AS log, execution_id, max(total) FILTER (k = 1) AS scan_files, max(total) FILTER (k = 2) AS scan_bytes, max(total) FILTER (k = 7) AS output_files, max(total) FILTER (k = 8) AS output_bytes,
  max(total) FILTER (k = 4) AS broadcast_bytes, max(total) FILTER (k = 3) AS small_side_bytes, max(total) FILTER (k = 5) AS join_rows, max(total) FILTER (k = 5) AS output_rows FROM v_node GROUP BY app_id, execution_id""")
from_lines("plan_drift", lambda x: plans.plan_drift(x).select("log", "execution_id", "changed"), "SELECT app_id AS log, execution_id, execution_id % 6 = 0 AS changed FROM v_exec", tasks=False)
from_lines("log_completeness", lambda x: reports.log_completeness(L.build_apps(x), x.select("log", F.concat("log", F.when(F.col("log").endswith("2"), ".inprogress").otherwise("")).alias("name")).distinct()), "SELECT DISTINCT app_id AS log, app_id LIKE '%1' OR app_id LIKE '%2' AS incomplete, app_id LIKE '%2' AS in_progress, false AS compacted FROM v_exec")
STATES = "SELECT app_id AS log, execution_id, start_ms, CASE WHEN end_ms > 0 THEN end_ms END AS end_ms, (SELECT string_agg(job_id, ',' ORDER BY job_id) FROM v_job j WHERE j.app_id = e.app_id AND j.execution_id = e.execution_id) AS job_ids, CASE WHEN end_ms > 0 THEN 'ended' ELSE 'running' END AS status FROM v_exec e"
from_lines("stream_execution_state", lambda x: executions.run_to_end(x).withColumn("job_ids", F.array_join(F.col("job_ids").cast("array<string>"), ",")), STATES)
from_lines("stream_snapshot", lambda x: snapshots.execution_percentiles(executions.run_to_end(x)), f"SELECT app_id AS log, count(*) FILTER (end_ms > 0) AS ended, count(*) FILTER (end_ms <= 0) AS running, 0::bigint AS timed_out, {_q('CASE WHEN end_ms > 0 THEN end_ms - start_ms END', 0.5)} AS p50_ms, {_q('CASE WHEN end_ms > 0 THEN end_ms - start_ms END', 0.95)} AS p95_ms FROM v_exec GROUP BY app_id")
register("critical_path_stages", dag.critical_path_stages, "v_stage v_task")
SQL["critical_path_stages"] = duck(_body("max(run_ms)", "critical_ms").replace("w AS dist FROM n", "w AS dist, [stage_id] AS path FROM n").replace("d.dist + n.w FROM", "d.dist + n.w, list_append(d.path, n.stage_id) FROM").split(f"\nSELECT {E}, max(dist)")[0] + f", best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY {E} ORDER BY dist DESC, stage_id, path) = 1) SELECT b.app_id, b.execution_id, b.p AS stage_id, n.w AS ms, round(n.w::double / dist, 6) AS share FROM (SELECT *, unnest(path) AS p FROM best) b JOIN n ON n.app_id = b.app_id AND n.stage_id = b.p").replace("WITH ", "WITH RECURSIVE ", 1)


def _sql_report(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    return reports.sql_report(e, _light(t, s, j, e), findings(t, s), whatif.whatif_cores(stages.stage_metrics(t, s), CORES))


def _logs_of(t: DataFrame) -> DataFrame:
    """Logs that the views stand for; a third of them lie on a file system whose address a report must not show."""
    at = F.when(F.substr("log", F.lit(5)).cast("long") % 3 == 0, F.concat(F.lit("hdfs://nn1:8020/logs?token=abc,"), "log")).otherwise(F.concat(F.lit("/logs/"), "log"))
    return reports.log_snapshot_key(_files(t)).select(F.col("log").alias("app_id"), at.alias("source"), F.when(~F.col("log").like("%5"), F.col("key")).alias("key"))


def _meta(light: DataFrame, window: DataFrame, t: DataFrame, e: DataFrame, x: DataFrame) -> DataFrame:
    summary = queue.queue_summary(light, window, intervals.peak_cores(x, CORES))
    return reports.queue_meta(summary, queue.deep_sample(light, e, 3, 2), t.where("failed and speculative").select("app_id"), _logs_of(t))


def _queue_report(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame, x: DataFrame, c: DataFrame) -> DataFrame:
    p = profiled(t, s, e)
    light, cont = written(profiled_light(p, j, e), "light"), profiled_contention(p, t, j, e)
    summary = queue.queue_summary(light, p["window"], intervals.peak_cores(x, CORES))
    found = profiled_queue_findings(p, t, j, e, x, c)
    resources = queue.resource_metrics(light, profile.bucket_means(p["bucket"]))
    return reports.queue_report(summary, p["bucket"], resources, queue.contention_report(cont, p["bucket"]), found, _meta(light, p["window"], t, e, x))


flat = lambda df, keys: df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("report"))
register("write_sql_report", lambda *v: flat(_sql_report(*v), ["app_id", "execution_id"]), ALL, written=True)
register("write_queue_report", lambda *v: flat(_queue_report(*v), ["app_id"]), QVIEWS, written=True)


# ---- logs as files, late ids, heaps and backlogs ----
def _read_back(spark: SparkSession, d: str) -> DataFrame:
    """Lines that were written as text files and are read as logs: how many there are of each kind."""
    at = shared_folder(spark, "logs")
    event_lines(spark, d).select("value").write.option("compression", "gzip").text(at)
    kind = F.regexp_extract("value", r'"Event":"(?:[\w.]+\.)?SparkListener([A-Za-z]+)"', 1).alias("kind")
    return L.read_event_logs(spark, at).select(kind).groupBy("kind").agg(F.count("*").alias("lines")).where(F.col("kind").isin("TaskEnd", "StageCompleted", "JobStart", "JobEnd", "SQLExecutionStart", "SQLExecutionEnd"))


QUERIES["read_event_logs"] = _read_back
SQL["read_event_logs"] = duck("SELECT 'TaskEnd' AS kind, count(*) AS lines FROM v_task UNION ALL SELECT 'StageCompleted', count(*) FROM v_stage UNION ALL SELECT 'JobStart', count(*) FROM v_job UNION ALL SELECT 'JobEnd', count(*) FROM v_job UNION ALL SELECT 'SQLExecutionStart', count(*) FROM v_exec UNION ALL SELECT 'SQLExecutionEnd', count(*) FROM v_exec WHERE end_ms > 0")


def _files(t: DataFrame) -> DataFrame:
    """Log parts of the views: one for each host of an application."""
    return t.groupBy(F.col("app_id").alias("log"), F.col("host").alias("name")).agg(F.sum("result_size").alias("length"), F.max("launch_ms").alias("modified"))


def _unchanged(t: DataFrame) -> DataFrame:
    """Logs to read again: those whose key was never seen, and those whose last entry has other parameters."""
    keys = reports.log_snapshot_key(_files(t))
    entry = lambda x, key, seq: x.select("log", key.alias("key"), F.when(F.col("log").endswith("7") & F.lit(seq == 2), "old").otherwise("now").alias("parameters"), F.lit(seq).alias("seq"))
    return ingest.changed_logs(keys, entry(keys, F.lit("old"), 1).unionAll(entry(keys.where("log not like '%3'"), F.col("key"), 2)), "now")


def _claimed(e: DataFrame) -> DataFrame:
    known = e.select(F.col("app_id").alias("log"), "execution_id", "start_ms", F.when(F.col("execution_id") % 3 == 0, F.concat(F.lit("s"), "execution_id")).alias("statement_id"))
    late = e.where("execution_id % 2 = 0").select(F.col("app_id").alias("log"), F.col("end_ms").alias("time_ms"), F.concat(F.lit("t"), "execution_id").alias("id"))
    return L.attach_thrift_ids(known, late).select("log", "execution_id", "statement_id")


def _heap_lines(t: DataFrame) -> DataFrame:
    x = t.groupBy(F.col("app_id").alias("log"), "executor_id", "stage_id").agg((F.max("result_size") * 20_000).alias("heap"))
    value = F.to_json(F.struct(F.lit("SparkListenerStageExecutorMetrics").alias("Event"), F.col("executor_id").alias("Executor ID"), F.col("stage_id").alias("Stage ID"), F.struct(F.col("heap").alias("JVMHeapMemory")).alias("Executor Metrics")))
    return x.select("log", F.lit(1).alias("part"), value.alias("value"))


def _heaps(t: DataFrame, c: DataFrame) -> DataFrame:
    memory = c.where("key = 'spark.executor.memory'").select(F.col("app_id").alias("log"), text.size_bytes(F.col("value"), 0).alias("memory_bytes"))
    return plans.heap_headroom(_heap_lines(t), memory)


def _backlog(e: DataFrame) -> DataFrame:
    found = e.select(F.col("app_id").alias("log"), "execution_id", F.explode(F.array_compact(F.array(F.when(F.col("execution_id") % 4 == 0, "S-05"), F.when(F.col("execution_id") % 5 == 0, "S-06"), F.lit("S-01")))).alias("rule_id"))
    return plans.small_file_backlog(found, e.select(F.col("app_id").alias("log"), "execution_id", F.concat(F.lit("FileScan parquet db.t"), F.col("execution_id") % 12, F.lit(" Scan parquet db.u")).alias("plan")))


KEYS = "SELECT app_id AS log, sha256(array_to_string(list_sort(list(host || ':' || length || ':' || modified)), '|')) AS key FROM (SELECT app_id, host, sum(result_size)::bigint AS length, max(launch_ms) AS modified FROM v_task GROUP BY ALL) GROUP BY app_id"
register("log_snapshot_key", lambda t: reports.log_snapshot_key(_files(t)), "v_task", KEYS)
register("queue_meta", lambda t, s, j, e, x: _meta(_light(t, s, j, e), intervals.queue_window(e, t), t, e, x), f"{ALL} v_executor_event", f"""{WITH_LIGHT}, dp AS (SELECT app_id, count(*) AS deep FROM ({SQL['deep_sample']}) GROUP BY app_id), ky AS ({KEYS}), g AS (SELECT app_id, count(*) AS q, count(*) FILTER (NOT running AND duration_ms > 0) AS done, count(*) FILTER (running) AS r FROM light GROUP BY app_id)
SELECT app_id, q AS light_analysed, coalesce(deep, 0) AS deep_analysed, {_ratio('coalesce(deep, 0)', 'done')} AS coverage, m AS incomplete, r > 0 AS running_snapshot, CASE WHEN substr(app_id, 5)::bigint % 3 = 0 THEN 'hdfs://***/logs?token=***,' ELSE '/logs/' END || app_id AS source,
  CASE WHEN app_id NOT LIKE '%5' THEN key END AS snapshot_key, 'slowest executions, and some with spill, fetch waits, gc, skew and of each template' AS sampling, CASE WHEN m AND r > 0 THEN 'events are missing; executions still run' WHEN m THEN 'events are missing' WHEN r > 0 THEN 'executions still run' END AS degraded, 'pool is the larger of configured and seen cores' AS assumption
FROM (SELECT g.*, deep, key, g.app_id IN (SELECT app_id FROM v_task WHERE failed AND speculative) AS m FROM g LEFT JOIN dp USING (app_id) LEFT JOIN ky ON ky.log = g.app_id)""", written=True)
register("skip_unchanged_logs", _unchanged, "v_task", f"SELECT * FROM ({KEYS}) WHERE log LIKE '%3' OR log LIKE '%7'")
register("attach_thrift_ids", _claimed, "v_exec", """WITH o AS (SELECT app_id, execution_id, row_number() OVER (PARTITION BY app_id ORDER BY start_ms, execution_id) AS k FROM v_exec WHERE execution_id % 3 <> 0),
i AS (SELECT app_id, 't' || execution_id AS id, row_number() OVER (PARTITION BY app_id ORDER BY end_ms, 't' || execution_id) AS k FROM v_exec WHERE execution_id % 2 = 0)
SELECT app_id AS log, execution_id, id AS statement_id FROM o LEFT JOIN i USING (app_id, k) UNION ALL SELECT app_id, execution_id, 's' || execution_id FROM v_exec WHERE execution_id % 3 = 0""")
register("heap_headroom", _heaps, "v_task v_conf", """WITH m AS (SELECT app_id, regexp_extract(value, '[0-9]+')::bigint * CASE WHEN value LIKE '%g' THEN 1073741824 ELSE 1048576 END AS memory_bytes FROM v_conf WHERE key = 'spark.executor.memory'),
x AS (SELECT app_id, executor_id, stage_id, max(result_size) * 20000 AS peak_bytes FROM v_task GROUP BY ALL)
SELECT app_id AS log, executor_id, stage_id::int AS stage_id, peak_bytes, memory_bytes, round(peak_bytes / memory_bytes::double, 6) AS heap_peak_ratio, floor(peak_bytes * 1.25)::bigint AS suggested_bytes FROM x JOIN m USING (app_id)""")
register("small_file_backlog", _backlog, "v_exec", "WITH f AS (SELECT execution_id, 'S-05' AS rule_id FROM v_exec WHERE execution_id % 4 = 0 UNION ALL SELECT execution_id, 'S-06' FROM v_exec WHERE execution_id % 5 = 0), t AS (SELECT *, 'db.t' || execution_id % 12 AS \"table\" FROM f UNION ALL SELECT *, 'db.u' FROM f) SELECT \"table\", rule_id, count(*) AS executions FROM t GROUP BY ALL")


def _forms(t: DataFrame) -> DataFrame:
    """Paths of log files of the views: each application rolled by host, every second one also as one file, every third still being written."""
    roll = t.select(F.concat_ws("/", F.lit("file:/logs"), F.concat(F.lit("eventlog_v2_"), "app_id"), F.concat(F.lit("events_"), F.substring("host", 6, 1), F.lit("_"), "app_id", F.lit(".zstd"))).alias("file"), "app_id").distinct()
    apps = t.select("app_id").distinct()
    one = apps.where("app_id rlike '[02468]$'").select(F.concat(F.lit("file:/logs/"), "app_id", F.lit(".lz4")).alias("file"), "app_id")
    late = apps.where("app_id rlike '[0369]$'").select(F.concat(F.lit("file:/logs/"), "app_id", F.lit(".inprogress")).alias("file"), "app_id")
    return roll.where("app_id rlike '[0-4]$'").unionAll(one).unionAll(late).select("file")


register("resolve_log_parts", lambda t: L.resolve_log_parts(_forms(t)), "v_task", """WITH a AS (SELECT DISTINCT app_id, host, right(app_id, 1)::int AS k FROM v_task)
SELECT DISTINCT 'file:/logs/' || CASE WHEN k <= 4 THEN 'eventlog_v2_' || app_id || '/events_' || substr(host, 6, 1) || '_' || app_id || '.zstd' WHEN k % 2 = 0 THEN app_id || '.lz4' ELSE app_id || '.inprogress' END AS file, app_id AS log,
  CASE WHEN k <= 4 THEN substr(host, 6, 1)::int ELSE 1073741824 END AS part FROM a WHERE k <= 4 OR k % 2 = 0 OR k % 3 = 0""")


# ---- from log files to tables, findings and plan metrics ----
def _gzip(to: DataFrameWriter) -> DataFrameWriter:
    """Logs are written once and read a few times, so their compression is the fast one."""
    return to.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")


def _folders(spark: SparkSession, rows: DataFrame, at: str, mode: str = "error") -> None:
    """Event lines as compressed log files: one folder a log."""
    _gzip(rows.select("log", "value").repartition("log").write.mode(mode)).partitionBy("log").text(at)


def _by_log(tasks: DataFrame) -> DataFrame:
    """Tasks in the order in which their logs are written: so rows are shuffled and sorted, not their lines, which are many times as long."""
    return tasks.withColumn("app_id", F.coalesce("app_id", F.lit(""))).repartition("app_id").sortWithinPartitions("app_id")


def _log_folders(spark: SparkSession, d: str, at: str) -> DataFrame:
    """The views as log files, one folder and one file a log. Returns the lines. Tasks are not written as a table before: stages are, and
    lines of tasks come straight from the rows that the window over orders numbers. These and all other lines are dealt by log into
    the same partitions, which the union then keeps together; a file costs as much as hundreds of lines, so a second one a log counts."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    x = event_lines(spark, d, lambda _: tasks_by_app(spark, d, parts), views=views_over(spark, d, ("v_stage", "spans", "v_exec")))
    others = x.where("kind <> 'TaskEnd'").select(F.coalesce("log", F.lit("")).alias("log"), "value").repartition(parts, "log")
    _gzip(x.where("kind = 'TaskEnd'").select("log", "value").unionByName(others).write).partitionBy("log").text(at)
    return x


def ingested(spark: SparkSession, d: str) -> tuple[str, str]:
    """(logs, store): the views as log files, ingested."""
    at = shared_folder(spark, "ingest")
    _log_folders(spark, d, f"{at}/logs")
    ingest.ingest(spark, f"{at}/logs", f"{at}/store", {"form": 1})
    return f"{at}/logs", f"{at}/store"


def _ingests(spark: SparkSession, d: str) -> DataFrame:
    """What four ingests read: all logs, none as nothing changed, those that got another part, one kind with new parameters."""
    logs, store = ingested(spark, d)
    runs = [ingest.manifest(spark, store)]
    runs.append(ingest.ingest(spark, logs, store, {"form": 1}))
    more = view(spark, d, "v_exec").where("app_id like '%7'").select(F.col("app_id").alias("log"), F.to_json(F.struct(F.lit("SparkListenerBlockManagerAdded").alias("Event"), F.col("start_ms").alias("Timestamp"))).alias("value"))
    _folders(spark, more, logs, "append")
    runs.append(ingest.ingest(spark, logs, store, {"form": 1}))
    runs.append(ingest.ingest(spark, logs, store, {"form": 2}))
    each = [r.select(F.lit(k + 1).alias("run"), "log", "lines") for k, r in enumerate(runs)]
    return each[0].unionAll(each[1]).unionAll(each[2]).unionAll(each[3])


QUERIES["ingest_logs"] = _ingests
SQL["ingest_logs"] = duck("""WITH n AS (SELECT app_id, sum(n)::bigint AS lines FROM (
  SELECT app_id, count(*) AS n FROM v_task GROUP BY 1 UNION ALL SELECT app_id, count(*) FROM v_stage GROUP BY 1 UNION ALL SELECT app_id, 2 * count(*) FROM v_job GROUP BY 1 UNION ALL SELECT app_id, count(*) FROM v_executor_event GROUP BY 1
  UNION ALL SELECT app_id, 2 * count(*) + count(*) FILTER (end_ms > 0) + count(*) FILTER (execution_id % 3 = 0) FROM v_exec GROUP BY 1 UNION ALL SELECT DISTINCT app_id, 2 + (app_id NOT LIKE '%1')::int FROM v_exec) GROUP BY app_id),
m AS (SELECT app_id, lines + CASE WHEN app_id LIKE '%7' THEN (SELECT count(*) FROM v_exec e WHERE e.app_id = n.app_id) ELSE 0 END AS lines FROM n)
SELECT 1 AS run, app_id AS log, lines FROM n UNION ALL SELECT 3, app_id, lines FROM m WHERE app_id LIKE '%7' UNION ALL SELECT 4, app_id, lines FROM m""")


def _logs_to_findings(spark: SparkSession, d: str) -> DataFrame:
    v = ingest.telemetry(spark, ingested(spark, d)[1])
    return rules.rank_findings(findings(v["v_task"], v["v_stage"]))


QUERIES["logs_to_findings"] = _logs_to_findings
SQL["logs_to_findings"] = SQL["rank_findings"]


# ---- streams ----
def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """Lines by log that a stream of log parts sees; every third log also lies there as one file, which it leaves out."""
    at = shared_folder(spark, "events")
    x = _log_folders(spark, d, f"{at}/logs")
    _gzip(x.where("log like '%3'").select("value").write).text(f"{at}/logs/whole")
    with small_files(spark):
        seen = executions.stream_events(spark, f"{at}/logs").select("log", F.col("value").contains("TaskEnd").alias("task"))
        seen.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("log string, task boolean").parquet(f"{at}/out").groupBy("log").agg(F.count_if("task").alias("tasks"))


QUERIES["stream_events"] = _event_stream
SQL["stream_events"] = duck("SELECT app_id AS log, count(*) AS tasks FROM v_task GROUP BY app_id")


def _bucket_stream(spark: SparkSession, d: str) -> DataFrame:
    """Tasks through a stream in two batches; the second brings some that come too late for their buckets, and is run again."""
    at, t = shared_folder(spark, "buckets"), view(spark, d, "v_task")
    write = snapshots.bucket_upsert(f"{at}/out")

    def run(batch: DataFrame, n: int) -> None:
        write(batch, n)
        write(batch, n)  # as after a failure: nothing counts twice

    for rows in (t.where("task_id % 97 <> 0"), t.where("task_id % 97 = 0")):
        rows.write.mode("append").parquet(f"{at}/in")
        x = spark.readStream.schema(t.schema).parquet(f"{at}/in")
        x.writeStream.foreachBatch(run).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    return snapshots.read_buckets(spark, f"{at}/out")


_ontime = lambda c, name: f"(sum(CASE WHEN late THEN 0 ELSE {c} END))::bigint AS {name}"
QUERIES["stream_bucket_metrics"] = _bucket_stream
SQL["stream_bucket_metrics"] = duck(f"""WITH w AS (SELECT max(launch_ms) - 600000 AS mark FROM v_task WHERE task_id % 97 <> 0), x AS (SELECT *, launch_ms // 60000 * 60000 AS bucket_ms, task_id % 97 = 0 AND launch_ms // 60000 * 60000 + 60000 <= mark AS late FROM v_task, w)
SELECT app_id, bucket_ms, {_ontime('1', 'attempts')}, {_ontime('failed::int', 'failed')}, {_ontime('speculative::int', 'speculative')}, {_ontime('run_ms', 'run_ms')}, {_ontime('cpu_ns', 'cpu_ns')}, {_ontime('gc_ms', 'gc_ms')}, {_ontime('fetch_wait_ms', 'fetch_ms')}, count(*) FILTER (late) AS late FROM x GROUP BY ALL""")
