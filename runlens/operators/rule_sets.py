"""The rules of executions, queues and data quality, the older stage rules, and what to do about each finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import plan_features
from runlens.operators import features, history, intervals
from runlens.operators.intervals import SQL
from runlens.operators.rules import CRITICAL, INFO, STAGE_RULES, WARN, Rule
from runlens.operators.stages import ratio

SQL_RULES = (
    Rule("S-05", "scan_files >= {small_files.scan_files} and scan_bytes <= {small_files.scan_avg_bytes} * greatest(scan_files, 1)", needs=("PLAN_METRICS",)),
    Rule("S-06", "output_files >= {small_files.out_files} and output_bytes <= {small_files.out_avg_bytes} * greatest(output_files, 1)", needs=("PLAN_METRICS",)),
    Rule("S-14", "wait_ratio >= {queue.wait_ratio}", needs=("QUEUE_TIMELINE",)),
    Rule("S-15", "wall_ms >= {driver_gap.min_duration_ms} and gap_ratio >= {driver_gap.ratio}"),
    Rule("S-16", "critical_ms is not null", severity=INFO),
    Rule("S-17", "(sort_merge_join or shuffled_hash_join) and small_side_bytes > 0 and small_side_bytes <= {broadcast.opportunity_bytes}", needs=("PLAN_METRICS",)),
    Rule("S-18", "broadcast_bytes >= {broadcast.risk_bytes} or broadcast_error", severity=CRITICAL, needs=("PLAN_METRICS",)),
    Rule("S-19", "empty_partition_filters and scan_files >= {small_files.prune_files}", needs=("PLAN_TEXT",)),
    Rule("S-20", "adaptive or skewed_partitions > 0 or coalesced_partitions > 0", severity=INFO, needs=("PLAN_TEXT",)),
    Rule("S-21", "failed_tasks > 0 or stage_retries > 0"),
    Rule("S-22", "baseline_samples >= {regression.min_samples} and p50_ms >= greatest({regression.ratio} * baseline_p50_ms, baseline_p50_ms + {regression.abs_ms})", "plan_changed", needs=("BASELINE",)),
    Rule("S-25", "cartesian or (nested_loop and (join_rows >= {dangerous_join.bnlj_rows} or join_path_share >= {dangerous_join.critical_path_ratio}))", severity=CRITICAL, needs=("PLAN_TEXT",)),
    Rule("S-26", "row_amp >= {row_amp.ratio} and output_rows >= {row_amp.min_rows}", severity=CRITICAL, needs=("PLAN_METRICS",)),
    Rule("S-27", "jobs >= {fragmentation.min_jobs} and job_p50 <= {fragmentation.job_median_ms} and gap_ratio >= {fragmentation.gap_ratio}"),
    Rule("S-28", "speculative >= {speculation.min_tasks} or speculative_killed > 0"),
)
QUEUE_RULES = (
    Rule("Q-01", "true", severity=INFO, needs=("QUEUE_TIMELINE",)),
    Rule("Q-02", "idle_minutes >= {capacity.idle_window_min} or overload_minutes >= {capacity.idle_window_min}", needs=("QUEUE_TIMELINE",)),
    Rule("Q-03", "hot_buckets > 0", needs=("QUEUE_TIMELINE",)),
    Rule("Q-04", "monopoly_minutes >= {monopoly.window_min} and monopoly_share >= {monopoly.core_ratio} and monopoly_active >= {monopoly.min_concurrent}", severity=CRITICAL, needs=("QUEUE_TIMELINE",)),
    Rule("Q-05", "host_score >= {host.score} and host_tasks >= {host.min_tasks} and host_stages >= {host.min_stages}", needs=("HOST_METRICS",)),
    Rule("Q-06", "executors_removed > 0", severity=CRITICAL, needs=("QUEUE_TIMELINE",)),
    Rule("Q-07", "heap_slope <> 0 or heap_first_quartile is not null", severity=INFO, needs=("STAGE_EXECUTOR_METRICS",)),
    Rule("Q-08", "config_issues > 0"),
    Rule("Q-09", "true", severity=INFO, needs=("QUEUE_TIMELINE",)),
    Rule("Q-10", "small_file_queries > 0", needs=("PLAN_METRICS",)),
    Rule("Q-11", "systemic_norm >= {systemic.norm_median} and systemic_active >= {systemic.min_concurrent} and not coalesce(systemic_single_host, false)", needs=("QUEUE_TIMELINE",)),
    Rule("Q-12", "(io_worst_ratio <= {io_hotspot.host_throughput_ratio} and io_worst_tasks >= {io_hotspot.min_tasks}) or io_spill_share >= {io_hotspot.spill_share}", severity=CRITICAL, needs=("HOST_METRICS",)),
    Rule("Q-13", "fetch_failures >= {net_matrix.min_fetchfail} and (fetch_row_share >= {net_matrix.src_row_ratio} or fetch_rack_share >= {net_matrix.rack_block_ratio} or fetch_diffuse)", severity=CRITICAL, needs=("NETWORK_MATRIX",)),
    Rule("Q-14", "memory_pressure > 0", severity=CRITICAL, needs=("QUEUE_TIMELINE",)),
    Rule("Q-15", "gc_ratio >= {driver_health.gc_ratio} or delay_p50 >= {driver_health.sched_delay_ms} or gap_p50 >= {driver_health.gap_ratio} or big_results >= {driver_health.big_result_n}", severity=CRITICAL, needs=("QUEUE_TIMELINE",)),
    Rule("Q-16", "(storm_failed >= {storm.fail_abs} and storm_ratio >= {storm.fail_ratio}) or stage_retries >= {storm.retry_abs}", severity=CRITICAL, needs=("QUEUE_TIMELINE",)),
    Rule("Q-17", "interrupted > 0 or tail_submissions > 0", needs=("QUEUE_TIMELINE",)),
    Rule("Q-18", "p50_ratio >= {queue_baseline.global_p50_ratio} or regressed_share >= {queue_baseline.regressed_fraction}", severity=CRITICAL, needs=("BASELINE",)),
)
DQ_RULES = (
    Rule("DQ-01", "({dq.partial_stage_warn} > 0 and partial_stages > 0) or compacted or in_progress or unknown_events > 0", needs=("DATA_QUALITY",)),
    Rule("DQ-02", "negative_durations > 0 or abs(clock_skew_ms) >= {dq.clock_skew_ms}", needs=("DATA_QUALITY",)),
)
#: The older rules, with the limits that they have always had.
LEGACY_RULES = (
    Rule("R1_DATA_SKEW", "(run_p50 > 0 and run_max >= 5 * run_p50) or (read_p50 > 0 and read_max >= 5 * read_p50)", "run_p50 > 0 and run_max >= 10 * run_p50"),
    Rule("R2_EXCESSIVE_SPILL", "spill_sum > 0 and 2 * spill_sum >= greatest(read_sum, 1)"),
    Rule("R4_OVER_PARALLELISM", "run_p50 > 0 and run_p50 < 200 and n >= 2000", severity=INFO),
    Rule("R5_SMALL_FILES", "input_sum > 0 and n >= 2000 and input_p50 > 0 and input_p50 < 4194304"),
    Rule("R6_GC_PRESSURE", "run_sum > 0 and 10 * gc_sum >= run_sum"),
    Rule("R8_SCHEDULING_DELAY", "wall_ms > 0 and 10 * delay_ms >= 3 * wall_ms", severity=INFO),
    Rule("R9_SHUFFLE_FETCH_WAIT", "run_sum > 0 and 5 * fetch_sum >= run_sum"),
    Rule("R10_TASK_RETRY", "failed_attempts >= 1"),
    Rule("R10_TASK_RETRY", "failed_attempts = 0 and n > 0 and 10 * extra_attempts >= n", severity=INFO),
)
LEGACY_SQL_RULES = (
    Rule("R3_LOW_PARALLELISM", "utilization > 0 and utilization < 0.4"),
    Rule("R7_BROADCAST_JOIN", "sort_merge_join and not broadcast_join and not nested_loop", severity=INFO),
    Rule("R11_SORT_AGG_SPILL", "(plan like '%Sort%' or plan like '%Aggregate%') and spill_bytes > 0", severity=INFO),
)
ALL_RULES = STAGE_RULES + SQL_RULES + QUEUE_RULES + DQ_RULES
#: Roll-up of execution findings into queue inputs.
ROLLUP = {"q10": ("S-05", "S-06"), "q12": ("S-23",), "q13": ("S-11", "S-21"), "q14": ("S-07", "S-08", "S-09", "S-21"), "q15": ("S-12", "S-13", "S-15"), "q18": ("S-22",)}

SESSION, RESTART, REWRITE, GOVERN = "SESSION_SET", "RESTART_CONF", "REWRITE", "GOVERNANCE"
#: Kind of action and advice for each rule.
ADVICE = {
    "S-01": (REWRITE, "spread hot keys, or let adaptive execution split skewed partitions"), "S-02": (SESSION, "lower the skew join thresholds"), "S-03": (SESSION, "coalesce shuffle partitions"),
    "S-04": (SESSION, "use more and smaller partitions"), "S-05": (GOVERN, "compact the files that are scanned"), "S-06": (REWRITE, "rebalance rows before they are written"), "S-07": (SESSION, "give each task less data"),
    "S-08": (RESTART, "review memory for each core"), "S-09": (RESTART, "size the heap by its measured peak"), "S-10": (REWRITE, "work on what the profile shows"), "S-11": (RESTART, "look at the network and the shuffle service"),
    "S-12": (REWRITE, "return less data to the driver"), "S-13": (RESTART, "review locality waits and the driver"), "S-14": (RESTART, "use fair pools or admission limits"), "S-15": (REWRITE, "cut listing and planning work on the driver"),
    "S-16": (REWRITE, "start with stages on the longest path"), "S-17": (REWRITE, "broadcast the small side"), "S-18": (SESSION, "lower the broadcast threshold"), "S-19": (REWRITE, "filter on partition columns"), "S-20": (SESSION, "judge by the final plan"),
    "S-21": (RESTART, "sort failures by class first"), "S-22": (GOVERN, "compare data, plan and queue with earlier runs"), "S-23": (RESTART, "check the local disks"), "S-24": (RESTART, "review placement and locality waits"), "S-25": (REWRITE, "add an equality to the join"),
    "S-26": (REWRITE, "aggregate or filter before the join"), "S-27": (REWRITE, "batch actions into fewer jobs"), "S-28": (RESTART, "repair slow hosts or tune speculation"), "S-29": (REWRITE, "use built-in functions"),
    "Q-01": (GOVERN, "read the timeline first"), "Q-02": (RESTART, "fit capacity to the time of day"), "Q-03": (GOVERN, "move large consumers to other hours"), "Q-04": (RESTART, "give pools minimum shares"), "Q-05": (RESTART, "exclude the slow host"), "Q-06": (RESTART, "find out why executors went"),
    "Q-07": (RESTART, "check the restart interval against the trend"), "Q-08": (RESTART, "apply the configuration checklist"), "Q-09": (GOVERN, "rank templates by total cost"), "Q-10": (GOVERN, "compact tables by backlog"), "Q-11": (GOVERN, "look for load outside of the queue"), "Q-12": (RESTART, "exclude the host with slow disks"),
    "Q-13": (GOVERN, "report the host or rack to network operations"), "Q-14": (REWRITE, "fix the largest memory user before raising memory"), "Q-15": (RESTART, "relieve the driver"), "Q-16": (RESTART, "repair the cause of failures first"), "Q-17": (GOVERN, "drain the queue before a restart"), "Q-18": (GOVERN, "tell systemic from individual slowdowns"),
    "DQ-01": (RESTART, "give the event queue more room"), "DQ-02": (GOVERN, "synchronise the clocks of hosts"),
}


def sql_contexts(attempts: DataFrame, execs: DataFrame, jobs: DataFrame, waiting: DataFrame, critical: DataFrame, plan_metrics: DataFrame | None = None) -> DataFrame:
    """One wide row an execution. attempts: profile.attempts_of; measurements of plan nodes (app_id, execution_id, scan_files, ...)
    join where they are known."""
    e = execs.select(*SQL, *[c.alias(k) for k, c in plan_features(F.col("plan")).items()])
    x = features.driver_gap(execs, jobs).join(e, SQL).join(attempts, SQL).join(features.job_fragmentation(jobs), SQL).join(critical, SQL, "left").join(waiting.select(*SQL, "wait_ratio"), SQL, "left")
    return x if plan_metrics is None else x.join(plan_metrics, SQL, "left")


def queue_contexts(profiles: dict[str, DataFrame], fetches: DataFrame, execs: DataFrame, jobs: DataFrame, events: DataFrame, conf: DataFrame, findings: DataFrame) -> DataFrame:
    """One wide row an application: what the queue and data-quality rules look at. profiles: profile.profiles; fetches:
    features.fetch_matrix. No tasks are read here but what these stand for."""
    app = "app_id"
    stage, host, buckets = profiles["stage"], profiles["host"], profiles["bucket"]
    tasked = stage.where("n is not null").groupBy(app).agg(
        ratio(F.sum("gc_raw"), F.sum("run_raw")).alias("gc_ratio"), F.sum("big_results").alias("big_results"), features.p("delay_p50", 0.5).alias("delay_p50"), F.sum("negative").alias("negative_durations"))
    recorded = stage.where("num_tasks is not null").groupBy(app).agg(F.sum("extra_attempts").alias("stage_retries"), F.nullif(F.count_if(F.coalesce("done", F.lit(0)) < F.col("num_tasks")), F.lit(0)).alias("partial_stages"))
    gaps = features.driver_gap(execs, jobs).groupBy(app).agg(F.round(F.percentile("gap_ratio", F.lit(0.5)), 6).alias("gap_p50"))
    storm = F.struct("failed", ratio(F.col("failed"), F.col("attempts")).alias("r"))
    timed = buckets.groupBy(app).agg(F.count_if(F.col("utilization") >= 0.95).alias("hot_buckets"), F.max(storm).alias("s"))
    hosts = host.groupBy(app).agg(
        F.max(F.struct("score", "tasks", "stages")).alias("w"), F.min("of_median").alias("io_worst_ratio"), F.min_by("tasks", F.struct("of_median", "host")).alias("io_worst_tasks"), F.max("spill_share").alias("io_spill_share"))
    net = fetches.where("host is null").groupBy(app).agg(F.max(F.when(F.col("src_host").isNull(), F.col("failures"))).alias("fetch_failures"), ratio(F.max(F.when(F.col("src_host").isNotNull(), F.col("failures"))), F.max("failures")).alias("fetch_row_share"))
    parts = [
        gaps, intervals.longest_run_of_buckets(buckets), timed.select(app, "hot_buckets", F.col("s.failed").alias("storm_failed"), F.col("s.r").alias("storm_ratio")),
        events.groupBy(app).agg(F.count_if(~F.col("added")).alias("executors_removed")), history.config_check(conf).groupBy(app).agg(F.count_if("issue").alias("config_issues")), recorded, features.restart_impact(execs),
        hosts.select(app, F.col("w.score").alias("host_score"), F.col("w.tasks").alias("host_tasks"), F.col("w.stages").alias("host_stages"), "io_worst_ratio", "io_worst_tasks", "io_spill_share"), net,
        findings.groupBy(app).agg(F.count_distinct(F.when(F.col("rule_id").isin("S-07", "S-08", "S-09"), F.struct("rule_id", "execution_id"))).alias("memory_pressure")),
        profiles["window"].select(app, (F.col("window_end") - F.col("window_start")).alias("wall_ms")),
    ]
    out = tasked
    for x in parts:
        out = out.join(x, app, "left")
    return out


def rollup_s_to_q(findings: DataFrame) -> DataFrame:
    """Executions of each application that a group of rules affects, one column for each queue rule that builds on them."""
    n = lambda ids: F.count_distinct(F.when(F.col("rule_id").isin(*ids), F.col("execution_id")))
    return findings.groupBy("app_id").agg(*[n(ids).alias(q) for q, ids in ROLLUP.items()])


def light_signals(contexts: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Cheap signals on every execution from stage measurements alone: app_id, execution_id, rule_id.

    Unlike the rules they use raw ratios, and retries count as a reliability signal.
    """
    t = thresholds
    q = lambda a, b, r: (F.col(b) > 0) & (F.col(a) >= r * F.col(b))
    hit = {
        "S-01": (F.col("n") >= t["skew.min_tasks"]) & (F.col("run_max") >= t["skew.abs_ms"]) & q("run_max", "run_p50", t["skew.ratio"]),
        "S-02": (F.col("read_max") >= t["skew.bytes_abs"]) & q("read_max", "read_p50", t["skew.bytes_ratio"]),
        "S-04": F.col("read_p50") >= t["partitions.huge_bytes"],
        "S-07": (F.col("spill_sum") >= t["spill.abs_bytes"]) | (F.col("spill_sum") >= t["spill.ratio"] * F.greatest(F.col("write_sum") + F.col("input_sum"), F.lit(1))),
        "S-08": (F.col("run_sum") >= t["gc.min_runtime_ms"]) & (F.col("gc_sum") >= t["gc.warn"] * F.col("run_sum")),
        "S-11": (F.col("read_sum") >= t["fetch_wait.min_shuffle_bytes"]) & (F.col("run_sum") > 0) & (F.col("fetch_sum") >= t["fetch_wait.ratio"] * F.col("run_sum")),
        "S-21": (F.col("failed_attempts") > 0) | (F.col("extra_attempts") > 0),
    }
    any_ = contexts.groupBy(*SQL).agg(*[F.bool_or(c).alias(k) for k, c in hit.items()])
    return any_.select(*SQL, F.explode(F.array_compact(F.array(*[F.when(F.col(f"`{k}`"), F.lit(k)) for k in hit]))).alias("rule_id"))


def queue_recommendations(findings: DataFrame) -> DataFrame:
    """Advice for every finding of a queue rule."""
    action = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(a)) for r, (a, _) in ADVICE.items()])
    words = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(t)) for r, (_, t) in ADVICE.items()])
    return findings.withColumns({"action": action, "advice": words})


def recommendation_digest(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct advice for each key, most severe first, with a line of summary."""
    x = queue_recommendations(findings).groupBy(*keys, "action", "advice").agg(F.max("severity").alias("severity"), F.min("rule_id").alias("rule_id"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("severity")).alias("order"), "rule_id", "action", "advice")))
    x = x.groupBy(*keys).agg(rows.alias("r"), F.count_if(F.col("severity") == CRITICAL).alias("c"), F.count_if(F.col("severity") == WARN).alias("w"))
    return x.select(*keys, F.array_join(F.transform("r", lambda s: F.concat(s["action"], F.lit(": "), s["advice"])), "; ").alias("advice"), F.format_string("%d critical, %d warnings", "c", "w").alias("summary"))
