"""Verdicts, thresholds, interactions, sketches and ingest on small cases whose outcome is planted."""

import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import evidence, rules, sketches
from runlens.sources import event_logs, ingest

TASK = "app_id string, execution_id long, host string, executor_id string, launch_ms long, finish_ms long, src_host string, failed boolean, reason string, disk_spill_bytes long"


def task(app="a", execution=1, host="h0", executor="e0", launch=0, src=None, reason="Success", spill=0):
    return app, execution, host, executor, launch, launch + 10, src, reason != "Success", reason, spill


def test_fetch_verdict_by_each_branch(spark):
    hosts = [f"h{k}" for k in range(6)]
    rows = [task(app=a, host=h) for a in ("host", "rack", "wide", "few", "mixed") for h in hosts]
    rows += [task("host", host=hosts[k % 6], src="h0") for k in range(30)] + [task("host", src="h5")] * 5
    rows += [task("rack", host=["h4", "h5"][k % 2], src=["h0", "h1", "h2"][k % 3]) for k in range(30)] + [task("rack", host="h0", src="h4")] * 5
    rows += [task("wide", host=hosts[(k + k // 6) % 6], src=hosts[k % 6]) for k in range(36)]
    rows += [task("few", src="h1")] * 3
    rows += [task("mixed", host=hosts[k % 6], src=["h0", "h3", "h0", "h3", "h1"][k % 5]) for k in range(30)]
    racks = spark.createDataFrame([("h0", "r0"), ("h1", "r0"), ("h2", "r0"), ("h4", "r1"), ("h5", "r1")], "host string, rack string")
    got = {r.app_id: r.verdict for r in evidence.fetch_verdict(spark.createDataFrame(rows, TASK), racks, spread=0.5).collect()}
    assert got == {"host": "SINGLE_HOST", "rack": "RACK", "wide": "CONGESTION", "few": "NONE", "mixed": "MIXED"}


def test_storm_kinds_and_first_burst(spark):
    rows = []
    for app, reasons, hosts in (("node", ["FetchFailed"], ["h0"]), ("auth", ["GSS token expired"], ["h0", "h1", "h2"]), ("res", ["OutOfMemoryError", "ExecutorLostFailure"], ["h0", "h1", "h2"]), ("mix", ["x", "FetchFailed"], ["h0", "h1", "h2"])):
        rows += [task(app, host=hosts[k % len(hosts)], launch=120_000 * (1 + k // 30), reason=reasons[k % len(reasons)]) for k in range(60)] + [task(app, launch=k) for k in range(50)]
    got = evidence.storm_profile(spark.createDataFrame(rows, TASK)).collect()
    assert {r.app_id: r.kind for r in got} == {"node": "NODE", "auth": "AUTH", "res": "RESOURCE", "mix": "MIXED"}
    assert {(r.bucket_ms, r.first_burst_ms) for r in got} == {(120_000, 120_000), (240_000, 120_000)}


def test_memory_branches(spark):
    rng = random.Random(2)
    rows, light = [], []
    for app in ("one", "level", "together", "mixed", "none"):
        for b in range(40):
            together = 6 if b % 10 == 0 else 1
            for k in range(together):
                spill = {"one": 100 * (b == 3), "level": 50 + rng.randrange(9), "together": 100 * (together > 1), "mixed": 100 * (b in (5, 16, 27, 38)), "none": 0}[app]
                rows.append(task(app, execution=100 * b + k, launch=b * 60_000, spill=spill))
                light.append((app, 100 * b + k, spill))
    x = evidence.memory_branches(spark.createDataFrame(light, "app_id string, execution_id long, spill_bytes long"), spark.createDataFrame(rows, TASK), None)
    assert {r.app_id: r.verdict for r in x.collect()} == {"one": "SINGLE_SQL", "level": "WATERLINE", "together": "CONCURRENCY", "mixed": "MIXED", "none": "NONE"}


def test_planted_clock_offset_is_found(spark):
    rng = random.Random(4)
    rows, events = [], []
    for h in range(8):
        for k in range(9):
            added, start = 1_000_000 + rng.randrange(10**6), rng.randint(900, 1100)
            events.append(("a", f"x{h}-{k}", added, 2, True))
            off = 8000 if h == 3 else 0
            wild = 500_000 if k < 3 else 0  # some executors sit idle for long before their first task
            rows += [task(host=f"h{h}", executor=f"x{h}-{k}", launch=added + start + wild + off + j) for j in range(3)]
    got = evidence.clock_offsets(spark.createDataFrame(rows, TASK), spark.createDataFrame(events, "app_id string, executor_id string, time_ms long, cores long, added boolean"))
    for r in got.collect():
        assert abs(r.offset_ms - (8000 if r.host == "h3" else 0)) <= 200 and r.executors == 9


def test_each_cause_of_a_slowdown(spark):
    base = {"duration_ms": 1000, "input_bytes": 100, "read_bytes": 100, "skew_micros": 1_000_000, "plan": "p", "wait_ms": 100}
    last = {"input": {"input_bytes": 160}, "shuffle": {"read_bytes": 400}, "skew": {"skew_micros": 3_000_000}, "plan": {"plan": "q"}, "queue": {"wait_ms": 900}, "none": {}, "fast": {"duration_ms": 1000}}
    rows = []
    for t, change in last.items():
        rows += [(t, run, *base.values()) for run in range(5) for _ in range(2)]
        rows += [(t, 5, *(base | {"duration_ms": 2000} | change).values())] * 2
    h = spark.createDataFrame(rows, "template string, run long, duration_ms long, input_bytes long, read_bytes long, skew_micros long, plan string, wait_ms long")
    got = {r.template: (r.cause, r.share) for r in evidence.template_causes(h, at_least_ms=0).collect()}
    assert got == {"input": ("INPUT", 0.6), "shuffle": ("SHUFFLE", 1.0), "skew": ("SKEW", 1.0), "plan": ("PLAN", 1.0), "queue": ("QUEUE", 0.8), "none": ("UNEXPLAINED", 0.0)}


def test_thresholds_of_applications(spark):
    ctx = spark.createDataFrame([(a, 1, 0, 30, 400_000, 50_000, 1000) for a in ("a", "b", "c")], "app_id string, execution_id long, stage_id long, n long, run_max long, run_p50 long, wall_ms long")
    conf = spark.createDataFrame([("a", "runlens.threshold.skew.ratio", "9"), ("b", "runlens.threshold.skew.ratio", "x"), ("c", "runlens.threshold.unknown", "1"), ("b", "other", "1")], "app_id string, key string, value string")
    s01 = tuple(r for r in rules.STAGE_RULES if r.id == "S-01")
    found = rules.evaluate_rules(rules.with_thresholds(ctx, conf), s01, rules.DEFAULTS, ["app_id"])
    assert {r.app_id for r in found.collect()} == {"b", "c"}
    with pytest.raises(KeyError):
        rules.whole_thresholds({"skew.ratio": 5})
    assert rules.whole_thresholds(rules.DEFAULTS) == rules.DEFAULTS


def test_all_interactions(spark):
    e = "app_id string, execution_id long, stage_id long, rule_id string, severity int, score double, join_path_share double"
    runs = [("a", 1, 0, "S-01", 2, 100.0, None), ("a", 2, 0, "S-03", 1, 10.0, None), ("a", 2, None, "S-17", 1, 10.0, 0.0), ("a", 3, None, "S-17", 1, 10.0, 0.4), ("a", 3, None, "S-28", 1, 10.0, None), ("a", 3, None, "S-26", 2, 100.0, None), ("b", 9, 0, "S-01", 2, 100.0, None), ("c", 5, 0, "S-07", 2, 100.0, None), ("c", 5, 0, "S-14", 1, 10.0, None)]
    queues = [("a", r, 2, 100.0) for r in ("Q-16", "DQ-01", "DQ-02", "Q-05", "Q-12", "Q-13", "Q-14")]
    got = rules.apply_interactions(spark.createDataFrame(runs, e), spark.createDataFrame(queues, "app_id string, rule_id string, severity int, score double"), spark.createDataFrame([("c", 5)], "app_id string, execution_id long"))
    got = {(r.app_id, r.execution_id, r.rule_id): (r.adjusted, r.score, r.confidence, r.caveats) for r in got.collect()}
    assert got["a", 1, "S-01"] == (1, 10.0, "MEDIUM", ["storm", "missing events"])
    assert got["a", 2, "S-03"] == (0, 1.0, "MEDIUM", ["storm"])
    assert got["a", 2, "S-17"] == (0, 1.0, "HIGH", ["off the longest path"]) and got["a", 3, "S-17"] == (1, 10.0, "HIGH", [])
    assert got["a", None, "Q-05"] == (1, 10.0, "LOW", ["clocks", "slow by its disks"]) and got["a", None, "Q-13"] == (1, 10.0, "LOW", ["clocks"])
    assert got["a", 3, "S-28"][3] == ["hides a slow host"] and got["a", None, "Q-14"] == (2, 100.0, "HIGH", ["rows multiply"])
    assert got["b", 9, "S-01"] == (2, 100.0, "HIGH", [])
    assert got["c", 5, "S-07"] == (1, 10.0, "MEDIUM", ["queue"]) and got["c", 5, "S-14"] == (1, 10.0, "HIGH", [])


def test_sketches_merge_to_what_all_rows_give(spark):
    rng = random.Random(1)
    rows = [(f"s{k % 50}", k % 7, int(rng.paretovariate(1.2) * 1000)) for k in range(40_000)] + [("empty", 0, None)]
    df = spark.createDataFrame(rows, "stage string, run int, v long").repartition(6)
    parts = sketches.metric_sketches(df, ["stage", "run"], {"v": "v"})
    whole = sketches.merged_sketches(parts.where("stage <> 'empty'").withColumn("all", F.lit(1)), ["all"], ("v",))
    points = sketches.sketch_points(whole, ["all"], ("v",))
    assert points.first().n == 40_000
    worst = sketches.rank_errors(points.drop("n"), df.where("stage <> 'empty'").withColumn("all", F.lit(1)), ["all"], {"v": "v"}).first()
    assert worst.worst < 0.02
    again = sketches.merged_sketches(sketches.merged_sketches(parts.where("stage <> 'empty'"), ["run"], ("v",)).withColumn("all", F.lit(1)), ["all"], ("v",))
    assert sketches.rank_errors(sketches.sketch_points(again, ["all"], ("v",)).drop("n"), df.where("stage <> 'empty'").withColumn("all", F.lit(1)), ["all"], {"v": "v"}).first().worst < 0.02


def _log(at, name, events):
    folder = at / f"eventlog_v2_{name}"
    folder.mkdir(parents=True, exist_ok=True)
    for k, part in enumerate(events, 1):
        (folder / f"events_{k}_{name}").write_text("\n".join(json.dumps(e, separators=(",", ":")) for e in part))


def _start(app):
    return {"Event": "SparkListenerApplicationStart", "App ID": app, "App Name": "n", "Timestamp": 5}


def test_ingest_reads_what_changed_and_repeats_safely(spark, tmp_path, monkeypatch):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    stage = {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Stage Attempt ID": 0, "Number of Tasks": 1, "Parent IDs": [], "Submission Time": 20, "Completion Time": 30}}
    _log(logs, "a", [[_start("app-a")], [stage]])
    _log(logs, "b", [[_start("app-b"), stage]])
    (logs / "b.lz4").write_bytes(b"not lz4 at all")  # another form of the log: must not be opened
    (logs / "c.zstd.inprogress").write_bytes(b"neither")
    run = lambda p=1: sorted((r.log, r.lines) for r in ingest.ingest(spark, str(logs), store, {"p": p}).collect())

    broken = ingest._entities
    monkeypatch.setattr(ingest, "_entities", lambda lines, write: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run()
    assert ingest.manifest(spark, store).count() == 0
    monkeypatch.setattr(ingest, "_entities", broken)
    assert run() == [("a", 2), ("b", 2)] and run() == []
    _log(logs, "a", [[_start("app-a")], [stage], [stage]])
    assert run() == [("a", 3)]
    assert run(2) == [("a", 3), ("b", 2)] and run(2) == []
    v = ingest.telemetry(spark, store)
    assert sorted((r.app_id, r.stage_id, r.completion_ms) for r in v["v_stage"].collect()) == [("app-a", 0, 30), ("app-b", 0, 30)]
    assert ingest.table(spark, store, "lines").count() == 5


def test_forms_of_log_names(spark):
    paths = ["/l/eventlog_v2_a/events_3_a.zstd", "/l/log=b/part-00012-x.txt", "/l/c.inprogress", "/l/c", "/l/d.lz4"]
    x = spark.createDataFrame([(p,) for p in paths], "file string")
    assert sorted((r.log, r.part) for r in event_logs.resolve_log_parts(x).collect()) == [("a", 3), ("b", 12), ("c", 1 << 30), ("d", 1 << 30)]


