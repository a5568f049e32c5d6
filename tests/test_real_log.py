"""Small logs made by hand: plan metrics, heaps, streams."""

import json

from pyspark.sql import functions as F

from runlens.sources import event_logs as L
from runlens.sources import ingest, plans
from runlens.sources.reports import log_snapshot_key
from runlens.streaming import executions, snapshots

UI = "org.apache.spark.sql.execution.ui.SparkListener"


def lines(spark, rows):
    return spark.createDataFrame([("a", 1, json.dumps(r, separators=(",", ":"))) for r in rows], "log string, part int, value string")


def test_plan_metrics(spark):
    scan = {"nodeName": "Scan parquet t", "children": [], "metrics": [{"name": "number of files read", "accumulatorId": 1, "metricType": "sum"}, {"name": "size of files read", "accumulatorId": 2, "metricType": "size"}, {"name": "number of output rows", "accumulatorId": 3, "metricType": "sum"}]}
    tree = {"nodeName": "SortMergeJoin", "children": [scan], "metrics": [{"name": "number of output rows", "accumulatorId": 4, "metricType": "sum"}]}
    x = lines(spark, [
        {"Event": UI + "SQLExecutionStart", "executionId": 7, "physicalPlanDescription": "Scan (1)", "sparkPlanInfo": tree, "time": 1},
        {"Event": UI + "SQLAdaptiveExecutionUpdate", "executionId": 7, "physicalPlanDescription": "Scan (2)", "sparkPlanInfo": tree},
        {"Event": UI + "DriverAccumUpdates", "executionId": 7, "accumUpdates": [[1, 2000], [2, 4000]]},
        {"Event": "SparkListenerTaskEnd", "Task Info": {"Accumulables": [{"ID": 3, "Update": "10"}, {"ID": 4, "Update": "70"}]}},
        {"Event": "SparkListenerTaskEnd", "Task Info": {"Accumulables": [{"ID": 4, "Update": 80}]}},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Completion Time": 3_600_000}},
        {"Event": "SparkListenerStageExecutorMetrics", "Executor ID": "1", "Stage ID": 0, "Executor Metrics": {"JVMHeapMemory": 900}},
    ])
    r = plans.sql_plan_metrics(plans.plan_metrics(x)).first()
    assert (r.execution_id, r.scan_files, r.scan_bytes, r.join_rows, r.row_amp) == (7, 2000, 4000, 150, 15.0)
    assert plans.plan_drift(x).first().changed is False
    h = plans.heap_headroom(x, spark.createDataFrame([("a", 1000)], "log string, memory_bytes long")).first()
    assert (h.heap_peak_ratio, h.suggested_bytes) == (0.9, 1125)
    t = plans.resource_trend(x).first()
    assert (t.heap_first_quartile, t.hours) == (900.0, 1)
    f = spark.createDataFrame([("a", 7, "S-05"), ("a", 7, "S-01")], "log string, execution_id long, rule_id string")
    p = spark.createDataFrame([("a", 7, "FileScan parquet db.t[x]")], "log string, execution_id long, plan string")
    assert [tuple(r) for r in plans.small_file_backlog(f, p).collect()] == [("db.t", "S-05", 1)]


def test_streams(spark, tmp_path):
    log = tmp_path / "logs" / "eventlog_v2_app-1"
    log.mkdir(parents=True)
    start, end = UI + "SQLExecutionStart", UI + "SQLExecutionEnd"
    (log / "events_1_app-1").write_text("\n".join(json.dumps(r, separators=(",", ":")) for r in [{"Event": start, "executionId": 1, "time": 5}, {"Event": start, "executionId": 2, "time": 6}, {"Event": end, "executionId": 1, "time": 9}]))
    job = {"Event": "SparkListenerJobStart", "Job ID": 7, "Submission Time": 7, "Properties": {"spark.sql.execution.id": "1"}}
    with (log / "events_1_app-1").open("a") as f:
        f.write("\n" + json.dumps(job, separators=(",", ":")))
    (tmp_path / "logs" / "app-1").write_text((log / "events_1_app-1").read_text())  # another form of the same log
    out, at = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        executions.run_executions(executions.stream_events(spark, str(tmp_path / "logs")), out, at, "0 seconds", 50)
        return [tuple(r) for r in executions.read_executions(spark, out).orderBy("execution_id").select("execution_id", "start_ms", "end_ms", "job_ids", "status").collect()]

    assert run() == [(1, 5, 9, [7], "ended"), (2, 6, None, [], "running")]
    (log / "events_2_app-1").write_text("\n".join(json.dumps({"Event": e, "executionId": i, "time": t}, separators=(",", ":")) for e, i, t in [(start, 3, 40), (end, 3, 45), (start, 4, 1000)]))
    run()
    (log / "events_3_app-1").write_text(json.dumps({"Event": end, "executionId": 4, "time": 1001}, separators=(",", ":")))
    assert run() == [(1, 5, 9, [7], "ended"), (2, 6, None, [], "timed_out"), (3, 40, 45, [], "ended"), (4, 1000, 1001, [], "ended")]


def test_snapshot_keeps_the_newest_row_and_other_partitions(spark, tmp_path):
    at = str(tmp_path / "out")
    write = snapshots.snapshot_upsert(at, ["k", "p"], ["p"], ["v"])
    frame = lambda *rows: spark.createDataFrame(rows, "k long, v long, p long")
    write(frame((1, 5, 0), (2, 1, 1)), 0)
    files = set((tmp_path / "out" / "p=1").glob("*.parquet"))
    write(frame((1, 4, 0), (3, 9, 0)), 1)
    write(frame((1, 4, 0), (3, 9, 0)), 1)
    assert set((tmp_path / "out" / "p=1").glob("*.parquet")) == files
    assert sorted(map(tuple, spark.read.parquet(at).select("k", "v", "p").collect())) == [(1, 5, 0), (2, 1, 1), (3, 9, 0)]


def test_snapshot_key_changes_with_any_part(spark):
    files = spark.createDataFrame([("a", "p1", 1, 1), ("a", "p2", 2, 2), ("b", "q", 1, 1)], "log string, name string, length long, modified long")
    done = log_snapshot_key(files).select("log", "key", F.lit("x").alias("parameters"), F.lit(1).alias("seq"))
    assert ingest.changed_logs(log_snapshot_key(files), done, "x").count() == 0
    assert ingest.changed_logs(log_snapshot_key(files), done, "y").count() == 2
    other = log_snapshot_key(files.withColumn("length", F.when(F.col("name") == "p2", 3).otherwise(F.col("length"))))
    assert [r.log for r in ingest.changed_logs(other, done, "x").collect()] == ["a"]
