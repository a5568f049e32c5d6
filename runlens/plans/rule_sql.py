"""The rules once more, as DuckDB conditions written by hand from their definitions, with numbers at the scale of the views.

Nothing here is taken from the operators' rules. Rules whose inputs the views do not have (S-05, S-06, S-09, S-17 to S-19,
S-22, S-26, S-29, Q-04, Q-07, Q-10, Q-11, Q-18) have no text: they must not fire. Severity: 0 info, 1 warning, 2 critical.
"""

from __future__ import annotations


def share(a: str, b: str) -> str:
    """a / b, 0 where b is not positive."""
    return f"(CASE WHEN {b} > 0 THEN ({a})::double / {b} ELSE 0 END)"


_times, _gc = share("run_max", "greatest(run_p50, 1000)"), share("gc_sum", "run_sum")

STAGE = [
    ("S-01", f"n >= 10 AND run_max >= 60000 AND {_times} >= 5", f"CASE WHEN {_times} >= 10 THEN 2 ELSE 1 END"),
    ("S-02", f"read_max >= 50000000 AND {share('read_max', 'greatest(read_p50, 1048576)')} >= 8", "1"),
    ("S-03", f"n >= 30 AND run_p50 <= 12000 AND {share('delay_sum + deser_sum', 'run_sum')} >= 0.3", "1"),
    ("S-04", "read_p50 >= 536870912 OR (run_p50 >= 600000 AND n < 4)", "1"),
    ("S-07", f"spill_sum >= 10737418240 OR {share('spill_sum', 'greatest(write_sum + input_sum, 1)')} >= 0.05", "CASE WHEN spill_sum >= 21474836480 THEN 2 ELSE 1 END"),
    ("S-08", f"run_sum >= 60000 AND {_gc} >= 0.1", f"CASE WHEN {_gc} >= 0.2 THEN 2 ELSE 1 END"),
    ("S-10", "cpu_ratio IS NOT NULL", "0"),
    ("S-11", f"{share('fetch_sum', 'run_sum')} >= 0.15 AND read_sum >= 1000000", "1"),
    ("S-12", "deser_p95 >= 5000 OR result_sum >= 1073741824 OR result_max >= 268435456", "1"),
    ("S-13", "delay_p50 >= 1000", "1"),
    ("S-23", f"(write_sum >= 10737418240 AND {share('write_sum * 1000.0', 'greatest(write_ms, 1)')} <= 52428800) OR write_max_share >= 0.3", "1"),
    ("S-24", "input_sum > 0 AND n >= 10 AND bad_ratio >= 0.5", "1"),
]
EXECUTION = [
    ("S-14", "wait_ratio >= 0.1", "1"),
    ("S-15", "wall_ms >= 60000 AND gap_ratio >= 0.03", "1"),
    ("S-16", "true", "0"),
    ("S-20", "adaptive", "0"),
    ("S-21", "failed_tasks > 0", "1"),
    ("S-25", "cartesian", "2"),
    ("S-27", "jobs >= 2 AND job_p50 <= 200000 AND gap_ratio >= 0.02", "1"),
    ("S-28", "speculative >= 2", "1"),
]
QUEUE = [
    ("Q-01", "true", "0"),
    ("Q-02", "idle_minutes >= 5 OR overload_minutes >= 5", "1"),
    ("Q-03", "hot_buckets > 0", "1"),
    ("Q-05", "host_score >= 1.5 AND host_tasks >= 20 AND host_stages >= 3", "1"),
    ("Q-06", "executors_removed > 0", "2"),
    ("Q-08", "config_issues > 0", "1"),
    ("Q-09", "true", "0"),
    ("Q-12", "(io_worst_ratio <= 0.4 AND io_worst_tasks >= 100) OR io_spill_share >= 0.3", "2"),
    ("Q-13", "fetch_failures >= 20 AND fetch_row_share >= 0.5", "2"),
    ("Q-14", "memory_pressure > 0", "2"),
    ("Q-15", "gc_ratio >= 0.15 OR delay_p50 >= 1000 OR gap_p50 >= 0.25 OR big_results >= 10", "2"),
    ("Q-16", "(storm_failed >= 2 AND storm_ratio >= 0.1) OR stage_retries >= 20", "2"),
    ("Q-17", "interrupted > 0 OR tail_submissions > 0", "1"),
    ("DQ-01", "partial_stages > 0", "1"),
    ("DQ-02", "negative_durations > 0", "1"),
]
OLD_STAGE = [
    ("R1_DATA_SKEW", f"{share('run_max', 'run_p50')} >= 5 OR {share('read_max', 'read_p50')} >= 5", f"CASE WHEN {share('run_max', 'run_p50')} >= 10 THEN 2 ELSE 1 END"),
    ("R2_EXCESSIVE_SPILL", f"spill_sum > 0 AND {share('spill_sum', 'greatest(read_sum, 1)')} >= 0.5", "1"),
    ("R4_OVER_PARALLELISM", "n >= 2000 AND run_p50 BETWEEN 1 AND 199", "0"),
    ("R5_SMALL_FILES", "n >= 2000 AND input_sum > 0 AND input_p50 BETWEEN 1 AND 4194303", "1"),
    ("R6_GC_PRESSURE", f"{_gc} >= 0.1", "1"),
    ("R8_SCHEDULING_DELAY", f"{share('delay_ms', 'wall_ms')} >= 0.3", "0"),
    ("R9_SHUFFLE_FETCH_WAIT", f"{share('fetch_sum', 'run_sum')} >= 0.2", "1"),
    ("R10_TASK_RETRY", "failed_attempts > 0", "1"),
    ("R10_TASK_RETRY", f"failed_attempts = 0 AND {share('extra_attempts', 'n')} >= 0.1", "0"),
]
OLD_EXECUTION = [
    ("R3_LOW_PARALLELISM", "utilization > 0 AND utilization < 0.4", "1"),
    ("R7_BROADCAST_JOIN", "sort_merge_join AND NOT (broadcast_join OR nested_loop)", "0"),
    ("R11_SORT_AGG_SPILL", "spill_bytes > 0 AND regexp_matches(plan, 'Sort|Aggregate')", "0"),
]
#: Rules that need what no view has, with the first thing that is missing.
LACKING = {
    "PLAN_METRICS": ["S-05", "S-06", "S-17", "S-18", "S-26", "Q-10"], "STAGE_EXECUTOR_METRICS": ["S-09", "Q-07"], "BASELINE": ["S-22", "Q-18"],
    "HOST_METRICS": ["Q-05", "Q-12"], "NETWORK_MATRIX": ["Q-13"], "DATA_QUALITY": ["DQ-01", "DQ-02"],
}
LIGHT = [
    ("S-01", f"n >= 10 AND run_max >= 60000 AND {share('run_max', 'run_p50')} >= 5"),
    ("S-02", f"read_max >= 50000000 AND {share('read_max', 'read_p50')} >= 8"),
    ("S-04", "read_p50 >= 536870912"),
    ("S-07", STAGE[4][1]),
    ("S-08", STAGE[5][1]),
    ("S-11", f"read_sum >= 1000000 AND {share('fetch_sum', 'run_sum')} >= 0.15"),
    ("S-21", "failed_attempts > 0 OR extra_attempts > 0"),
]


def found(rules: list[tuple[str, str, str]], ctx: str, keys: str) -> str:
    """SQL of the findings of rules over the relation ctx."""
    each = [f"SELECT {keys}, wall_ms, '{r}' AS rule_id, {severity} AS severity FROM {ctx} WHERE {when}" for r, when, severity in rules]
    return f"SELECT {keys}, rule_id, severity, round((CASE severity WHEN 2 THEN 100 WHEN 1 THEN 10 ELSE 1 END) * log10(1 + greatest(wall_ms, 0) / 1000.0), 6) AS score FROM ({' UNION ALL '.join(each)})"

#: What the queries of advice, roll-ups, checklists and thresholds are held against: written out once more, not taken from the operators.
ADVICE = {
    "S-01": ("REWRITE", "spread hot keys, or let adaptive execution split skewed partitions"),
    "S-02": ("SESSION_SET", "lower the skew join thresholds"),
    "S-03": ("SESSION_SET", "coalesce shuffle partitions"),
    "S-04": ("SESSION_SET", "use more and smaller partitions"),
    "S-05": ("GOVERNANCE", "compact the files that are scanned"),
    "S-06": ("REWRITE", "rebalance rows before they are written"),
    "S-07": ("SESSION_SET", "give each task less data"),
    "S-08": ("RESTART_CONF", "review memory for each core"),
    "S-09": ("RESTART_CONF", "size the heap by its measured peak"),
    "S-10": ("REWRITE", "work on what the profile shows"),
    "S-11": ("RESTART_CONF", "look at the network and the shuffle service"),
    "S-12": ("REWRITE", "return less data to the driver"),
    "S-13": ("RESTART_CONF", "review locality waits and the driver"),
    "S-14": ("RESTART_CONF", "use fair pools or admission limits"),
    "S-15": ("REWRITE", "cut listing and planning work on the driver"),
    "S-16": ("REWRITE", "start with stages on the longest path"),
    "S-17": ("REWRITE", "broadcast the small side"),
    "S-18": ("SESSION_SET", "lower the broadcast threshold"),
    "S-19": ("REWRITE", "filter on partition columns"),
    "S-20": ("SESSION_SET", "judge by the final plan"),
    "S-21": ("RESTART_CONF", "sort failures by class first"),
    "S-22": ("GOVERNANCE", "compare data, plan and queue with earlier runs"),
    "S-23": ("RESTART_CONF", "check the local disks"),
    "S-24": ("RESTART_CONF", "review placement and locality waits"),
    "S-25": ("REWRITE", "add an equality to the join"),
    "S-26": ("REWRITE", "aggregate or filter before the join"),
    "S-27": ("REWRITE", "batch actions into fewer jobs"),
    "S-28": ("RESTART_CONF", "repair slow hosts or tune speculation"),
    "S-29": ("REWRITE", "use built-in functions"),
    "Q-01": ("GOVERNANCE", "read the timeline first"),
    "Q-02": ("RESTART_CONF", "fit capacity to the time of day"),
    "Q-03": ("GOVERNANCE", "move large consumers to other hours"),
    "Q-04": ("RESTART_CONF", "give pools minimum shares"),
    "Q-05": ("RESTART_CONF", "exclude the slow host"),
    "Q-06": ("RESTART_CONF", "find out why executors went"),
    "Q-07": ("RESTART_CONF", "check the restart interval against the trend"),
    "Q-08": ("RESTART_CONF", "apply the configuration checklist"),
    "Q-09": ("GOVERNANCE", "rank templates by total cost"),
    "Q-10": ("GOVERNANCE", "compact tables by backlog"),
    "Q-11": ("GOVERNANCE", "look for load outside of the queue"),
    "Q-12": ("RESTART_CONF", "exclude the host with slow disks"),
    "Q-13": ("GOVERNANCE", "report the host or rack to network operations"),
    "Q-14": ("REWRITE", "fix the largest memory user before raising memory"),
    "Q-15": ("RESTART_CONF", "relieve the driver"),
    "Q-16": ("RESTART_CONF", "repair the cause of failures first"),
    "Q-17": ("GOVERNANCE", "drain the queue before a restart"),
    "Q-18": ("GOVERNANCE", "tell systemic from individual slowdowns"),
    "DQ-01": ("RESTART_CONF", "give the event queue more room"),
    "DQ-02": ("GOVERNANCE", "synchronise the clocks of hosts"),
}
ROLLUP = {
    "q10": ("S-05", "S-06",),
    "q12": ("S-23",),
    "q13": ("S-11", "S-21",),
    "q14": ("S-07", "S-08", "S-09", "S-21",),
    "q15": ("S-12", "S-13", "S-15",),
    "q18": ("S-22",),
}
CHECKLIST = {
    "spark.sql.adaptive.enabled": "true",
    "spark.eventLog.rolling.enabled": "true",
    "spark.eventLog.logStageExecutorMetrics": "true",
    "spark.scheduler.mode": "FAIR",
}
THRESHOLDS = {
    "skew.min_tasks": 20,
    "skew.abs_ms": 120000,
    "skew.ratio": 5,
    "skew.bytes_ratio": 8,
    "skew.bytes_abs": 1073741824,
    "partitions.many_tasks": 2000,
    "partitions.tiny_ms": 2000,
    "partitions.overhead_ratio": 0.3,
    "partitions.huge_bytes": 536870912,
    "spill.abs_bytes": 10737418240,
    "spill.ratio": 0.2,
    "gc.warn": 0.1,
    "gc.crit": 0.2,
    "gc.min_runtime_ms": 600000,
    "fetch_wait.ratio": 0.15,
    "fetch_wait.min_shuffle_bytes": 1073741824,
    "serialization.deser_p95_ms": 5000,
    "serialization.result_sum_bytes": 1073741824,
    "serialization.result_task_bytes": 268435456,
    "shuffle_write.min_bytes": 10737418240,
    "shuffle_write.throughput_bytes_per_s": 52428800,
    "shuffle_write.task_ratio": 0.3,
    "locality.bad_ratio": 0.5,
    "locality.min_tasks": 200,
    "scheduler_delay.p50_ms": 1000,
    "small_files.scan_files": 1000,
    "small_files.scan_avg_bytes": 8388608,
    "small_files.out_files": 500,
    "small_files.out_avg_bytes": 16777216,
    "small_files.prune_files": 5000,
    "memory.peak_risk_ratio": 0.9,
    "memory.peak_waste_ratio": 0.5,
    "memory.sizing_factor": 1.25,
    "cpu.bound_ratio": 0.7,
    "cpu.io_ratio": 0.3,
    "serialization.result_ser_ratio": 0.1,
    "queue.wait_ratio": 0.4,
    "queue.busy_ratio": 0.85,
    "driver_gap.ratio": 0.3,
    "driver_gap.min_duration_ms": 60000,
    "fragmentation.min_jobs": 50,
    "fragmentation.job_median_ms": 3000,
    "fragmentation.gap_ratio": 0.2,
    "broadcast.opportunity_bytes": 67108864,
    "broadcast.risk_bytes": 536870912,
    "dangerous_join.bnlj_rows": 100000000,
    "dangerous_join.critical_path_ratio": 0.3,
    "row_amp.ratio": 10,
    "row_amp.min_rows": 100000000,
    "codegen.cpu_ratio": 0.7,
    "codegen.critical_path_ratio": 0.2,
    "speculation.min_tasks": 50,
    "regression.ratio": 1.5,
    "regression.abs_ms": 300000,
    "regression.min_samples": 3,
    "regression.baseline_rounds": 14,
    "host.score": 1.5,
    "host.min_tasks": 50,
    "host.min_stages": 3,
    "capacity.idle_window_min": 30,
    "capacity.idle_ratio": 0.2,
    "capacity.overload_ratio": 0.95,
    "monopoly.window_min": 10,
    "monopoly.core_ratio": 0.6,
    "monopoly.min_concurrent": 3,
    "systemic.norm_median": 1.4,
    "systemic.min_concurrent": 3,
    "io_hotspot.host_throughput_ratio": 0.4,
    "io_hotspot.min_tasks": 100,
    "io_hotspot.spill_share": 0.3,
    "net_matrix.min_fetchfail": 20,
    "net_matrix.src_row_ratio": 0.5,
    "net_matrix.rack_block_ratio": 0.5,
    "oom.waterline_ratio": 0.9,
    "oom.concurrent_statements": 3,
    "driver_health.gc_ratio": 0.15,
    "driver_health.sched_delay_ms": 1000,
    "driver_health.gap_ratio": 0.25,
    "driver_health.big_result_n": 10,
    "storm.fail_ratio": 0.1,
    "storm.fail_abs": 200,
    "storm.retry_abs": 20,
    "restart_win.tail_min": 30,
    "queue_baseline.global_p50_ratio": 1.3,
    "queue_baseline.regressed_fraction": 0.3,
    "queue_baseline.baseline_rounds": 14,
    "dq.partial_stage_warn": 1,
    "dq.clock_skew_ms": 5000,
}
