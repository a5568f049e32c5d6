"""Tables of a log that has the events of one small application, with a broken tail."""

import json

from runlens.sources import event_logs as L


def events():
    info = {"Stage ID": 0, "Stage Attempt ID": 0, "Number of Tasks": 1, "Parent IDs": [], "Submission Time": 20}
    yield {"Event": "SparkListenerApplicationStart", "App ID": "app-1", "App Name": "n", "Timestamp": 5}
    yield {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"spark.executor.cores": "2"}}
    yield {"Event": "SparkListenerExecutorAdded", "Timestamp": 6, "Executor ID": "1", "Executor Info": {"Host": "h", "Total Cores": 2}}
    yield {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 0, "description": "/* s */ q", "physicalPlanDescription": "p", "time": 10}
    yield {"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": 15, "Stage IDs": [0], "Properties": {"spark.sql.execution.id": "0"}}
    yield {"Event": "SparkListenerStageSubmitted", "Stage Info": info}
    metrics = {"Executor Run Time": 30, "Executor CPU Time": 9, "JVM GC Time": -1, "Shuffle Read Metrics": {"Remote Bytes Read": 3, "Local Bytes Read": 4}}
    yield {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Stage Attempt ID": 0, "Task End Reason": {"Reason": "Success"}, "Task Info": {"Task ID": 7, "Launch Time": 21, "Finish Time": 60, "Executor ID": "1", "Host": "h", "Locality": "ANY", "Speculative": False}, "Task Metrics": metrics}
    yield {"Event": "SparkListenerStageCompleted", "Stage Info": info | {"Completion Time": 61}}
    yield {"Event": "SparkListenerJobEnd", "Job ID": 0, "Completion Time": 62, "Job Result": {"Result": "JobSucceeded"}}
    yield {"Event": "SparkListenerBlockManagerAdded", "Timestamp": 1}


def test_tables(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app-1"
    folder.mkdir()
    lines = [json.dumps(e, separators=(",", ":")) for e in events()]
    (folder / "events_1_app-1").write_text("\n".join([*lines, '{"Event":"SparkListenerTaskEnd","Sta']))
    (folder / "appstatus_app-1").write_text("")
    x = L.read_event_logs(spark, str(tmp_path)).cache()
    assert {r["log"] for r in x.collect()} == {"app-1"}
    app = L.build_apps(x).first()
    assert (app.app_id, app.start_ms, app.incomplete, app.conf["spark.executor.cores"]) == ("app-1", 5, True, "2")
    task = L.build_task_attempts(x).collect()
    assert [(t.task_id, t.run_ms, t.gc_ms, t.shuffle_read_bytes, t.failed) for t in task] == [(7, 30, 0, 7, False)]
    job = L.build_jobs(x).first()
    assert (job.execution_id, job.stage_ids, job.completion_ms, job.failed) == (0, [0], 62, False)
    stage = L.build_stages(x).first()
    assert (stage.submission_ms, stage.completion_ms, stage.num_tasks) == (20, 61, 1)
    run = L.build_executions(x).first()
    assert (run.start_ms, run.end_ms, run.incomplete) == (10, None, True)
    assert L.bad_lines(x).first().bad_lines == 1
    assert [(e.executor_id, e.cores, e.added) for e in L.executor_events(x).collect()] == [("1", 2, True)]
