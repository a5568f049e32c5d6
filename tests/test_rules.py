"""Rule sets on contexts made by hand: everything fires on bad ones, nothing but information on clean ones."""

from pyspark.sql import functions as F

from runlens.operators import rule_sets as R
from runlens.operators import rules

CAPS = sorted({c for r in R.ALL_RULES for c in r.needs})
GI = 1 << 30
STAGE = {"n": 3000, "run_max": 600_000, "run_p50": 1000, "run_sum": 3_000_000, "read_p50": 512 << 20, "read_max": 8 * GI, "read_sum": 99 * GI, "spill_sum": 20 * GI, "write_sum": 10 * GI, "write_ms": 1e9, "write_max_share": 0.1, "input_sum": 1, "gc_sum": 750_000, "fetch_sum": 750_000, "cpu_ratio": 0.8, "bad_ratio": 0.8, "delay_p50": 2000, "delay_sum": 2_000_000, "deser_sum": 0, "deser_p95": 9000, "result_sum": 0, "result_max": 0, "heap_peak_ratio": 0.95, "codegen_gap": True, "path_share": 0.5, "failed_attempts": 0, "cores": 8}
SQL = {"scan_files": 6000, "scan_bytes": 6000, "output_files": 600, "output_bytes": 600, "wait_ratio": 0.6, "gap_ratio": 0.5, "critical_ms": 1, "sort_merge_join": True, "shuffled_hash_join": False, "small_side_bytes": 32 << 20, "broadcast_bytes": GI, "empty_partition_filters": True, "adaptive": True, "failed_tasks": 2, "stage_retries": 0, "baseline_samples": 10, "p50_ms": 1_000_000, "baseline_p50_ms": 300_000, "plan_changed": True, "cartesian": False, "nested_loop": True, "join_rows": 1e9, "row_amp": 20, "output_rows": 1e9, "jobs": 60, "job_p50": 1000, "speculative": 100}
QUEUE = {"idle_minutes": 60, "overload_minutes": 0, "hot_buckets": 1, "monopoly_minutes": 20, "monopoly_share": 0.8, "monopoly_active": 3, "host_score": 2.0, "host_tasks": 100, "host_stages": 5, "executors_removed": 1, "heap_slope": 0.1, "config_issues": 1, "small_file_queries": 1, "systemic_norm": 2.0, "systemic_active": 4, "io_worst_ratio": 0.1, "io_worst_tasks": 200, "fetch_failures": 100, "fetch_row_share": 0.9, "memory_pressure": 1, "gc_ratio": 0.2, "storm_failed": 500, "storm_ratio": 0.2, "interrupted": 1, "tail_submissions": 0, "p50_ratio": 1.5, "partial_stages": 2, "clock_skew_ms": -10_000}


def fired(spark, values, rule_set, caps=CAPS):
    df = spark.createDataFrame([(1,)], "k int").select("k", F.lit(600_000).alias("wall_ms"), *[F.lit(v).cast("long" if type(v) is int else ("boolean" if isinstance(v, bool) else "double")).alias(c) for c, v in values.items()]).withColumn("capabilities", F.array(*map(F.lit, caps)).cast("array<string>"))
    return {r.rule_id: r.severity for r in rules.evaluate_rules(df, rule_set, rules.DEFAULTS, ["k"]).collect()}


def test_every_rule_fires(spark):
    got = {}
    for values, rule_set in ((STAGE, rules.STAGE_RULES), (SQL, R.SQL_RULES), (QUEUE, R.QUEUE_RULES + R.DQ_RULES)):
        assert set(fired(spark, values, rule_set)) == {r.id for r in rule_set}
        got |= fired(spark, values, rule_set)
    assert len(got) == 49 and got["S-01"] == got["S-22"] == got["Q-06"] == 2 and got["S-10"] == 0 and got["S-02"] == 1


def test_missing_inputs_and_capabilities_do_not_fire(spark):
    assert fired(spark, {}, R.SQL_RULES) == {}
    assert {r for r in fired(spark, SQL, R.SQL_RULES, [])} == {r.id for r in R.SQL_RULES if not r.needs}
    clean = {"n": 10, "run_max": 1000, "run_p50": 900, "run_sum": 9000, "gc_sum": 90, "spill_sum": 0, "cpu_ratio": 0.5, "write_sum": 0, "input_sum": 0}
    assert fired(spark, clean, rules.STAGE_RULES) == {"S-10": 0}


def test_registry():
    check = rules.validate_rules(R.ALL_RULES, rules.DEFAULTS)
    assert not check["duplicate"] and not check["missing"] and "cpu.io_ratio" in check["unused"]
    assert rules.validate_rules((rules.Rule("X", "a > {b.c}"),) * 2, {}) == {"duplicate": ["X"], "missing": ["b.c"], "unused": []}
    assert set(R.ADVICE) == {r.id for r in R.ALL_RULES}
