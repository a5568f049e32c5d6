"""Profiles against the operators that look at the tasks themselves, and what reports say of logs."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import features, intervals, profile
from runlens.sources import reports

TASK = "app_id string, execution_id long, stage_id long, host string, launch_ms long, finish_ms long, run_ms long, cpu_ns long, gc_ms long, fetch_wait_ms long, deser_ms long, shuffle_read_bytes long, shuffle_write_bytes long, shuffle_write_ms long, input_bytes long, output_bytes long, disk_spill_bytes long, memory_spill_bytes long, result_size long, failed boolean, speculative boolean, reason string, locality string"
STAGE = "app_id string, execution_id long, stage_id long, parent_ids array<bigint>, num_tasks long, failed_attempts long, extra_attempts long, submission_ms long, first_launch_ms long, completion_ms long"


@pytest.fixture(scope="module")
def tables(spark):
    rng, rows = random.Random(11), []
    n = lambda top: rng.randint(0, top)
    for k in range(300):
        a = 1 + n(400_000)
        stage = n(8)
        rows.append((f"a{stage % 2}", stage % 3, stage, f"h{n(4)}", a, a + 1 + n(150_000), n(90_000), n(10**10), n(900), n(900), n(50), n(999), n(999), n(99), n(999), n(999), n(99), n(99), n(999), n(9) == 0, n(9) == 1, rng.choice(["Success", "task killed", None]), rng.choice(["ANY", "RACK_LOCAL", "NODE_LOCAL", None])))
    rows += rows[:3]  # repeated rows count as attempts of their own
    stages = [(f"a{k % 2}", k % 3, k, [], 4 + k, k % 2, k % 3, 1, 2, 500_000) for k in range(8)] + [("a0", 0, 90, [], 5, 0, 1, 1, 2, 9)]  # stage 8 has no record, stage 90 no tasks
    return spark.createDataFrame(rows, TASK), spark.createDataFrame(stages, STAGE)


def rows(df, *columns):
    return sorted(str(r) for r in df.select(*columns).collect())


def test_buckets_in_one_pass(tables):
    t, _ = tables
    got = profile.bucket_profile(t, 4)
    same = ["app_id", "bucket_ms", "run_ms", "cpu_ns", "fetch_ms", "gc_ms", "attempts", "failed", "speculative"]
    assert rows(got, *same) == rows(intervals.bucket_task_metrics(t), *same)
    assert rows(got, "app_id", "bucket_ms", "peak_tasks") == rows(intervals.bucket_peak_tasks(t), "app_id", "bucket_ms", "peak_tasks")
    busy = intervals.occupancy_segments(t, 4).groupBy("app_id", (F.col("b") * 60_000).alias("bucket_ms")).agg(F.sum(F.col("busy") * (F.col("end_ms") - F.col("start_ms"))).alias("busy_core_ms"))
    assert rows(got, *busy.columns) == rows(busy, *busy.columns)


def test_hosts_and_windows(spark, tables):
    t, s = tables
    p = profile.profiles(t, s, spark.createDataFrame([("a0", 0, 5, 900_000), ("a1", 1, 7, 0)], "app_id string, execution_id long, start_ms long, end_ms long"), 4)
    assert rows(p["host"], "app_id", "host", "score", "tasks", "stages") == rows(features.host_score(t), "app_id", "host", "score", "tasks", "stages")
    assert rows(p["host"], "app_id", "host", "bytes_per_s", "of_median", "spill_share") == rows(features.host_io(t), "app_id", "host", "bytes_per_s", "of_median", "spill_share")
    e = spark.createDataFrame([("a0", 0, 5, 900_000), ("a1", 1, 7, 0)], "app_id string, execution_id long, start_ms long, end_ms long")
    columns = ["app_id", "bucket_ms", "busy_core_ms", "utilization"]
    assert rows(p["bucket"], *columns) == rows(intervals.bucket_utilization(t, e, 4), *columns)


def test_stages_without_tasks_and_tasks_without_a_stage(spark, tables):
    t, s = tables
    x = {r["stage_id"]: r for r in profile.stage_profile(t, s).collect()}
    assert x[90]["n"] is None and x[90]["num_tasks"] == 5 and x[8]["num_tasks"] is None and x[8]["n"] > 0
    assert sorted(r["stage_id"] for r in profile.contexts_of(profile.stage_profile(t, s), 4).collect()) == list(range(8))
    partial = features.partial_stages(t, s).count()
    assert partial == profile.stage_profile(t, s).where("coalesce(done, 0) < num_tasks").count() > 0
    empty = profile.profiles(t.where("false"), s.where("false"), spark.createDataFrame([], "app_id string, execution_id long, start_ms long, end_ms long"), 4)
    assert all(df.count() == 0 for df in empty.values())


def test_meta_masks_and_knows_what_it_lacks(spark):
    summary = spark.createDataFrame([("a", 4, 4, 0), ("b", 3, 0, 1), ("c", 0, 0, 0)], "app_id string, queries long, completed long, running long")
    sample = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "app_id string, execution_id long")
    partial = spark.createDataFrame([("b",), ("b",), ("z",)], "app_id string")
    logs = spark.createDataFrame([("a", "hdfs://nn:8020/logs/a?token=abc,x", "k1"), ("b", None, None)], "app_id string, source string, key string")
    got = {r["app_id"]: r for r in reports.queue_meta(summary, sample, partial, logs).collect()}
    assert len(got) == 3 and got["a"]["source"] == "hdfs://***/logs/a?token=***,x" and got["a"]["snapshot_key"] == "k1"
    assert (got["a"]["coverage"], got["a"]["incomplete"], got["a"]["degraded"]) == (0.75, False, None)
    assert (got["b"]["incomplete"], got["b"]["running_snapshot"], got["b"]["source"]) == (True, True, None)
    assert got["b"]["degraded"] == "events are missing; executions still run" and got["c"]["coverage"] == 0.0
