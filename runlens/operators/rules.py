"""Threshold rules as columns: one wide context row in, one row a finding out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators import profile
from runlens.operators.stages import micros, ratio

INFO, WARN, CRITICAL = 0, 1, 2
MI, GI = 1 << 20, 1 << 30

#: Default thresholds of the stage and execution rules.
DEFAULTS = {
    "skew.min_tasks": 20, "skew.abs_ms": 120_000, "skew.ratio": 5, "skew.bytes_ratio": 8, "skew.bytes_abs": GI,
    "partitions.many_tasks": 2000, "partitions.tiny_ms": 2000, "partitions.overhead_ratio": 0.3, "partitions.huge_bytes": 512 * MI,
    "spill.abs_bytes": 10 * GI, "spill.ratio": 0.2, "gc.warn": 0.1, "gc.crit": 0.2, "gc.min_runtime_ms": 600_000,
    "fetch_wait.ratio": 0.15, "fetch_wait.min_shuffle_bytes": GI,
    "serialization.deser_p95_ms": 5000, "serialization.result_sum_bytes": GI, "serialization.result_task_bytes": 256 * MI,
    "shuffle_write.min_bytes": 10 * GI, "shuffle_write.throughput_bytes_per_s": 50 * MI, "shuffle_write.task_ratio": 0.3,
    "locality.bad_ratio": 0.5, "locality.min_tasks": 200, "scheduler_delay.p50_ms": 1000,
    "small_files.scan_files": 1000, "small_files.scan_avg_bytes": 8 * MI, "small_files.out_files": 500, "small_files.out_avg_bytes": 16 * MI, "small_files.prune_files": 5000,
    "memory.peak_risk_ratio": 0.9, "memory.peak_waste_ratio": 0.5, "memory.sizing_factor": 1.25, "cpu.bound_ratio": 0.7, "cpu.io_ratio": 0.3, "serialization.result_ser_ratio": 0.1,
    "queue.wait_ratio": 0.4, "queue.busy_ratio": 0.85, "driver_gap.ratio": 0.3, "driver_gap.min_duration_ms": 60_000, "fragmentation.min_jobs": 50, "fragmentation.job_median_ms": 3000, "fragmentation.gap_ratio": 0.2,
    "broadcast.opportunity_bytes": 64 * MI, "broadcast.risk_bytes": 512 * MI, "dangerous_join.bnlj_rows": 100_000_000, "dangerous_join.critical_path_ratio": 0.3, "row_amp.ratio": 10, "row_amp.min_rows": 100_000_000,
    "codegen.cpu_ratio": 0.7, "codegen.critical_path_ratio": 0.2, "speculation.min_tasks": 50, "regression.ratio": 1.5, "regression.abs_ms": 300_000, "regression.min_samples": 3, "regression.baseline_rounds": 14,
    "host.score": 1.5, "host.min_tasks": 50, "host.min_stages": 3, "capacity.idle_window_min": 30, "capacity.idle_ratio": 0.2, "capacity.overload_ratio": 0.95, "monopoly.window_min": 10, "monopoly.core_ratio": 0.6, "monopoly.min_concurrent": 3,
    "systemic.norm_median": 1.4, "systemic.min_concurrent": 3, "io_hotspot.host_throughput_ratio": 0.4, "io_hotspot.min_tasks": 100, "io_hotspot.spill_share": 0.3, "net_matrix.min_fetchfail": 20, "net_matrix.src_row_ratio": 0.5, "net_matrix.rack_block_ratio": 0.5,
    "oom.waterline_ratio": 0.9, "oom.concurrent_statements": 3, "driver_health.gc_ratio": 0.15, "driver_health.sched_delay_ms": 1000, "driver_health.gap_ratio": 0.25, "driver_health.big_result_n": 10,
    "storm.fail_ratio": 0.1, "storm.fail_abs": 200, "storm.retry_abs": 20, "restart_win.tail_min": 30, "queue_baseline.global_p50_ratio": 1.3, "queue_baseline.regressed_fraction": 0.3, "queue_baseline.baseline_rounds": 14, "dq.partial_stage_warn": 1, "dq.clock_skew_ms": 5000,
}
#: Thresholds at the scale of the fixture views.
FIXTURE = DEFAULTS | {
    "skew.min_tasks": 10, "skew.abs_ms": 60_000, "skew.bytes_abs": 50_000_000, "spill.ratio": 0.05, "gc.min_runtime_ms": 60_000,
    "fetch_wait.min_shuffle_bytes": 1_000_000, "locality.min_tasks": 10, "partitions.many_tasks": 30, "partitions.tiny_ms": 12_000,
    "speculation.min_tasks": 2, "fragmentation.min_jobs": 2, "fragmentation.job_median_ms": 200_000, "fragmentation.gap_ratio": 0.02, "driver_gap.ratio": 0.03, "queue.wait_ratio": 0.1, "host.min_tasks": 20, "storm.fail_abs": 2, "capacity.idle_window_min": 5,
}


@dataclass(frozen=True)
class Rule:
    id: str
    when: str  # over the context's columns, with thresholds in braces
    critical: str = "false"
    severity: int = WARN
    needs: tuple[str, ...] = ()  # capabilities that the context must have


STAGE_RULES = (
    Rule("S-01", "n >= {skew.min_tasks} and run_max >= {skew.abs_ms} and run_max >= {skew.ratio} * greatest(run_p50, 1000)", "run_max >= 10 * greatest(run_p50, 1000)"),
    Rule("S-02", "read_max >= {skew.bytes_abs} and read_max >= {skew.bytes_ratio} * greatest(read_p50, 1048576)"),
    Rule("S-03", "n >= {partitions.many_tasks} and run_p50 <= {partitions.tiny_ms} and run_sum > 0 and delay_sum + deser_sum >= {partitions.overhead_ratio} * run_sum"),
    Rule("S-04", "read_p50 >= {partitions.huge_bytes} or (run_p50 >= 600000 and n < cores)"),
    Rule("S-07", "spill_sum >= {spill.abs_bytes} or spill_sum >= {spill.ratio} * greatest(write_sum + input_sum, 1)", "spill_sum >= 2 * {spill.abs_bytes}"),
    Rule("S-08", "run_sum >= {gc.min_runtime_ms} and gc_sum >= {gc.warn} * run_sum", "gc_sum >= {gc.crit} * run_sum"),
    Rule("S-10", "cpu_ratio is not null", severity=INFO),
    Rule("S-11", "run_sum > 0 and fetch_sum >= {fetch_wait.ratio} * run_sum and read_sum >= {fetch_wait.min_shuffle_bytes}"),
    Rule("S-12", "deser_p95 >= {serialization.deser_p95_ms} or result_sum >= {serialization.result_sum_bytes} or result_max >= {serialization.result_task_bytes}"),
    Rule("S-13", "delay_p50 >= {scheduler_delay.p50_ms}"),
    Rule("S-09", "heap_peak_ratio >= {memory.peak_risk_ratio} or heap_peak_ratio <= {memory.peak_waste_ratio}", needs=("STAGE_EXECUTOR_METRICS",)),
    Rule("S-23", "(write_sum >= {shuffle_write.min_bytes} and write_sum * 1000 <= {shuffle_write.throughput_bytes_per_s} * greatest(write_ms, 1)) or write_max_share >= {shuffle_write.task_ratio}"),
    Rule("S-24", "n >= {locality.min_tasks} and bad_ratio >= {locality.bad_ratio} and input_sum > 0"),
    Rule("S-29", "codegen_gap and cpu_ratio >= {codegen.cpu_ratio} and path_share >= {codegen.critical_path_ratio}", needs=("PLAN_TEXT",)),
)
_WORD = re.compile(r"'[^']*'|[a-z_][a-z_0-9]*(?![a-z_0-9(]| *\()")
_NOT_COLUMNS = frozenset("and or not is null true false like".split())
_FLAGS = frozenset("codegen_gap broadcast_error plan_changed systemic_single_host fetch_diffuse compacted in_progress adaptive cartesian nested_loop broadcast_join sort_merge_join shuffled_hash_join empty_partition_filters".split())


def inputs(rule: Rule) -> set[str]:
    """Names of the columns that a rule looks at."""
    text = re.sub(r"\{[^}]*\}", "0", f"{rule.when} ; {rule.critical}")
    return {w for w in _WORD.findall(text) if not w.startswith("'")} - _NOT_COLUMNS


def completed(contexts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The contexts with a null column for each input that they lack: missing is not 0, such a condition does not hold."""
    lacking = sorted(set().union(*map(inputs, rules)) - set(contexts.columns))
    return contexts.withColumns({c: F.lit(None).cast("boolean" if c in _FLAGS else "double") for c in lacking}) if lacking else contexts


def filled(text: str, thresholds: dict[str, float], own: bool = False) -> str:
    """The condition with numbers for its thresholds; with `own`, a number in the context's map column `thresholds` goes first."""

    def number(m: re.Match) -> str:
        if m[1] not in thresholds:
            raise KeyError(f"a threshold is missing: {m[1]} in {text}")
        value = repr(thresholds[m[1]])
        return f"coalesce(thresholds['{m[1]}'], {value})" if own else value

    return re.sub(r"\{([^}]+)\}", number, text)


def stage_contexts(tasks: DataFrame, stages: DataFrame, cores: int) -> DataFrame:
    """One wide row a stage with everything that the stage rules look at, in one pass over the tasks."""
    return profile.contexts_of(profile.stage_profile(tasks, stages), cores)


def evaluate_rules(contexts: DataFrame, rules: tuple[Rule, ...], thresholds: dict[str, float], keys: list[str]) -> DataFrame:
    """Every rule on every context in one pass: keys, rule_id, severity, score. A rule whose inputs are null or absent does
    not fire, nor does one that needs a capability which the context's array `capabilities`, if there is one, lacks.

    Thresholds are those given, but for keys that the context's map column `thresholds`, if there is one, has: so applications with
    thresholds of their own are tested in the same pass (with_thresholds). The score weighs severity (100, 10, 1) by the
    impact, log10(1 + the larger of wall seconds and, where the context has impact_core_ms, core seconds).
    """
    gated, own = "capabilities" in contexts.columns, "thresholds" in contexts.columns
    contexts = completed(contexts, rules)
    may = lambda r: F.size(F.array_except(F.array(*map(F.lit, r.needs)), F.col("capabilities"))) == 0 if gated and r.needs else F.lit(True)
    found = [F.when(may(r) & F.expr(filled(r.when, thresholds, own)), F.struct(F.lit(r.id).alias("rule_id"), F.when(F.expr(filled(r.critical, thresholds, own)), CRITICAL).otherwise(r.severity).alias("severity"))) for r in rules]
    impact = F.greatest("wall_ms", "impact_core_ms") if "impact_core_ms" in contexts.columns else F.col("wall_ms")
    x = contexts.select(*keys, impact.alias("wall_ms"), F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keys, "wall_ms", "f.*")
    base = F.when(F.col("severity") == CRITICAL, 100).when(F.col("severity") == WARN, 10).otherwise(1)
    return x.select(*keys, "rule_id", "severity", F.round(base * F.log10(1 + F.greatest("wall_ms", F.lit(0)) / 1000), 6).alias("score"))


def with_thresholds(contexts: DataFrame, conf: DataFrame, prefix: str = "runlens.threshold.") -> DataFrame:
    """Contexts with the thresholds that their application's configuration (app_id, key, value) sets, as a map column. Values that
    are no numbers and keys that no threshold has are left out. The map holds at most as many entries as there are thresholds."""
    key = F.substr("key", F.lit(len(prefix) + 1))
    x = conf.where(F.startswith("key", F.lit(prefix))).select("app_id", key.alias("k"), F.col("value").try_cast("double").alias("v"))
    x = x.where(F.col("v").isNotNull() & F.col("k").isin(*DEFAULTS)).groupBy("app_id", "k").agg(F.max("v").alias("v"))
    return contexts.join(x.groupBy("app_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("thresholds")), "app_id", "left")


def whole_thresholds(values: dict[str, float]) -> dict[str, float]:
    """Thresholds that replace all defaults, as from a file of one's own: each default key must be there."""
    lacking = sorted(set(DEFAULTS) - set(values))
    if lacking:
        raise KeyError(f"thresholds are missing: {', '.join(lacking)}")
    return dict(values)


_HOST_RULES = ("Q-05", "Q-12", "Q-13")


def apply_interactions(executions: DataFrame, queues: DataFrame, busy: DataFrame) -> DataFrame:
    """Findings after what other findings say: adjusted severity, score rescaled with it, confidence, caveats.

    executions: app_id, execution_id, stage_id, rule_id, severity, score, join_path_share (null: unknown); queues: app_id, rule_id, severity, score;
    busy: (app_id, execution_id) of executions whose S-14 found a busy pool. First the queue findings of an application, and the
    rules that its executions fire, become flags; then these join every finding: a busy pool or a storm (Q-16) lowers S-01 to S-13 by a
    step; missing events (DQ-01) cap S-01, S-02, S-07, S-08 and S-11 at a warning; bad clocks (DQ-02) lower Q-05, Q-12 and Q-13; S-17 off the
    longest path is information; Q-05 with Q-12, S-28 with Q-05 and Q-14 with S-26 get a caveat.
    """
    fired = lambda r, name: F.bool_or(F.col("rule_id") == r).alias(name)
    flags = queues.groupBy("app_id").agg(fired("Q-16", "storm"), fired("DQ-01", "partial"), fired("DQ-02", "clocks"), fired("Q-05", "bad_host"), fired("Q-12", "bad_io"))
    amp = executions.where("rule_id = 'S-26'").select("app_id", F.lit(True).alias("row_amp")).distinct()
    none = lambda t: F.lit(None).cast(t)
    q = queues.select("app_id", none("long").alias("execution_id"), none("long").alias("stage_id"), "rule_id", "severity", "score", none("double").alias("join_path_share"))
    x = executions.select(*q.columns).unionByName(q).join(flags, "app_id", "left").join(amp, "app_id", "left")
    x = x.join(busy.select("app_id", "execution_id", F.lit(True).alias("queued")).distinct(), ["app_id", "execution_id"], "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    rule, n = F.col("rule_id"), F.regexp_extract("rule_id", r"^S-(\d+)$", 1).try_cast("int")
    low = is_(n.between(1, 13)) & (is_("queued") | is_("storm"))
    capped = is_(n.isin(1, 2, 7, 8, 11)) & is_("partial")
    hosts = rule.isin(*_HOST_RULES) & is_("clocks")
    off = (rule == "S-17") & (F.coalesce("join_path_share", F.lit(0.0)) <= 0)
    down = lambda s: F.greatest(s - 1, F.lit(INFO))
    s = F.when(low, down(F.col("severity"))).otherwise(F.col("severity"))
    s = F.when(capped, F.least(s, F.lit(WARN))).otherwise(s)
    s = F.when(hosts, down(s)).otherwise(s)
    s = F.when(off, INFO).otherwise(s)
    weight = lambda c: F.when(c == CRITICAL, 100).when(c == WARN, 10).otherwise(1)
    caveats = F.array_compact(F.array(
        F.when(low, F.when(is_("queued"), "queue").otherwise("storm")), F.when(capped, "missing events"), F.when(hosts, "clocks"), F.when(off, "off the longest path"),
        F.when((rule == "Q-05") & is_("bad_io"), "slow by its disks"), F.when((rule == "S-28") & is_("bad_host"), "hides a slow host"), F.when((rule == "Q-14") & is_("row_amp"), "rows multiply"),
    ))
    confidence = F.when(hosts, "LOW").when(low | capped, "MEDIUM").otherwise("HIGH")
    out = x.withColumns({"adjusted": s, "confidence": confidence, "caveats": caveats})
    was = weight(F.col("severity"))
    scaled = F.floor((micros("score") * weight(F.col("adjusted")) * 2 + was) / (was * 2)) / 1_000_000.0  # half up in whole millionths, so that engines agree
    return out.select("app_id", "execution_id", "stage_id", "rule_id", "severity", "adjusted", scaled.alias("score"), "confidence", "caveats")


def rank_findings(findings: DataFrame) -> DataFrame:
    """Place of each finding in its application: those that are not suppressed first (where that is known), then score, then
    severity, then rule and stage."""
    hidden = [F.col("suppressed").cast("int")] if "suppressed" in findings.columns else []
    w = Window.partitionBy("app_id").orderBy(*hidden, F.desc("score"), F.desc("severity"), "rule_id", "stage_id")
    return findings.withColumn("place", F.row_number().over(w))


def dominant_bottleneck(findings: DataFrame, execs: DataFrame) -> DataFrame:
    """The first finding's rule of each execution, else `none`."""
    w = Window.partitionBy("app_id", "execution_id").orderBy(F.desc("score"), F.desc("severity"), "rule_id", "stage_id")
    first = findings.withColumn("r", F.row_number().over(w)).where("r = 1").select("app_id", "execution_id", "rule_id")
    return execs.select("app_id", "execution_id").join(first, ["app_id", "execution_id"], "left").na.fill("none", ["rule_id"])


def capability_gate(contexts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules that none of an application's contexts could be tested for, with what is missing. contexts: app_id, capabilities."""
    need = F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.array(*map(F.lit, r.needs)).alias("needs")) for r in rules if r.needs])).alias("r")
    x = contexts.select("app_id", "capabilities").distinct().select("app_id", "capabilities", need)
    x = x.select("app_id", "r.rule_id", "r.needs", F.array_except("r.needs", "capabilities").alias("lacks"))
    x = x.groupBy("app_id", "rule_id").agg(F.min(F.size("lacks")).alias("n"), F.min_by(F.array_join("lacks", ", "), F.size("lacks")).alias("missing"))
    return x.where("n > 0").select("app_id", "rule_id", "missing")


def finding_evidence(findings: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to each finding the numbers and flags of its context that are known, as a map of texts; whole numbers have no fraction."""
    names = [c for c, t in contexts.dtypes if c not in keys and not t.startswith(("array", "map", "struct"))]

    def shown(name: str):
        c = F.col(name)
        kind = dict(contexts.dtypes)[name]
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")) if kind in ("double", "float") else c.cast("string")

    all_ = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(shown, names)))
    known = contexts.select(*keys, F.map_filter(all_, lambda k, v: v.isNotNull()).alias("evidence"))
    return findings.join(known, keys, "left")


def partial_degrade(findings: DataFrame, partial_apps: DataFrame) -> DataFrame:
    """Confidence and severity of findings whose events are incomplete: medium, and a stage's critical is a warning."""
    x = findings.join(partial_apps.select("app_id", F.lit(True).alias("_p")).distinct(), "app_id", "left")
    p = F.coalesce("_p", F.lit(False))
    s = F.when(p & (F.col("severity") == CRITICAL), WARN).otherwise(F.col("severity"))
    return x.withColumns({"severity": s, "confidence": F.when(p, "MEDIUM").otherwise("HIGH")}).drop("_p")


def suppress_findings(findings: DataFrame, suppressions: DataFrame, day: str) -> DataFrame:
    """Marks findings that a suppression names with its reason; nothing is dropped.

    findings: rule_id, fingerprint, statement_id, table; suppressions: rule, fingerprint, statement_id, table, reason,
    until. A null selector matches everything, a date before `day` nothing; of several matches the least reason is
    taken. The join is by rule, so it needs no bound on either side.
    """
    names = ["fingerprint", "statement_id", "table"]
    s = suppressions.where(F.col("until").isNull() | (F.col("until") >= F.lit(day))).select(F.col("rule").alias("rule_id"), *[F.col(c).alias(f"_{c}") for c in names], "reason")
    one = s.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct("reason", *[f"_{c}" for c in names]))).alias("_s"))
    x = findings.join(one, "rule_id", "left")
    fits = lambda m: (m["_fingerprint"].isNull() | m["_fingerprint"].eqNullSafe(F.col("fingerprint"))) & (m["_statement_id"].isNull() | m["_statement_id"].eqNullSafe(F.col("statement_id"))) & (m["_table"].isNull() | m["_table"].eqNullSafe(F.col("table")))
    hits = F.filter("_s", fits)
    return x.withColumns({"reason": F.get(hits, F.lit(0))["reason"], "suppressed": F.coalesce(F.size(hits) > 0, F.lit(False))}).drop("_s")


def validate_rules(rules: tuple[Rule, ...], thresholds: dict[str, float]) -> dict[str, list[str]]:
    """Identifiers that are given twice, thresholds that rules name but are missing, and thresholds that no rule names."""
    ids = [r.id for r in rules]
    used = {k for r in rules for k in re.findall(r"\{([^}]+)\}", r.when + r.critical)}
    return {"duplicate": sorted({i for i in ids if ids.count(i) > 1}), "missing": sorted(used - set(thresholds)), "unused": sorted(set(thresholds) - used)}


def rule_interactions(findings: DataFrame, partial_apps: DataFrame, storm_apps: DataFrame) -> DataFrame:
    """Severity after what else is known of the application: a failure storm lowers S-01 to S-13 by one step, missing
    events cap S-01, S-02, S-07, S-08 and S-11 at a warning."""
    x = findings.join(partial_apps.select("app_id", F.lit(True).alias("partial")), "app_id", "left").join(storm_apps.select("app_id", F.lit(True).alias("storm")), "app_id", "left")
    n = F.regexp_extract("rule_id", r"^S-(\d+)$", 1).try_cast("int")
    s = F.when(F.col("storm") & n.between(1, 13), F.greatest(F.col("severity") - 1, F.lit(0))).otherwise(F.col("severity"))
    s = F.when(F.col("partial") & n.isin(1, 2, 7, 8, 11), F.least(s, F.lit(WARN))).otherwise(s)
    return x.withColumn("adjusted", s).drop("partial", "storm")


def bottleneck_clusters(findings: DataFrame, execs: DataFrame) -> DataFrame:
    """Distinct executions that each rule affects, and their share of the application's."""
    total = execs.groupBy("app_id").agg(F.count("*").alias("total"))
    x = findings.groupBy("app_id", "rule_id").agg(F.count_distinct("execution_id").alias("affected"))
    return x.join(total, "app_id").select("app_id", "rule_id", "affected", ratio(F.col("affected"), F.col("total")).alias("share"))


def clusters_of_evidence(signals: DataFrame, findings: DataFrame, light: DataFrame, sampled: DataFrame) -> DataFrame:
    """For each application and rule the distinct completed executions that a cheap signal or a finding of a sampled one affects.

    signals: light_signals of all executions; findings: rule findings; light: sql_light_metrics; sampled: (app_id, execution_id) of the deep
    sample. A rule with any cheap evidence was looked for in every completed execution, which are its denominator and give it full
    coverage; one that only findings know of was looked for in the sample. scope says which.
    """
    done = light.where("not running and duration_ms > 0").select("app_id", "execution_id")
    deep = done.join(sampled.select("app_id", "execution_id").distinct(), ["app_id", "execution_id"], "left_semi")
    n = light.groupBy("app_id").agg(F.count("*").alias("queries")).join(done.groupBy("app_id").agg(F.count("*").alias("done")), "app_id", "left").join(deep.groupBy("app_id").agg(F.count("*").alias("deep")), "app_id", "left").na.fill(0)
    cols = ["app_id", "execution_id", "rule_id"]
    x = signals.select(*cols, F.lit(True).alias("cheap")).join(done, ["app_id", "execution_id"], "left_semi").unionByName(findings.select(*cols, F.lit(False).alias("cheap")).join(deep, ["app_id", "execution_id"], "left_semi"))
    x = x.groupBy("app_id", "rule_id").agg(F.count_distinct("execution_id").alias("affected"), F.bool_or("cheap").alias("cheap"), F.bool_or(~F.col("cheap")).alias("found")).join(n, "app_id")
    scope = F.when(F.col("cheap") & F.col("found"), "FULL_QUEUE_LIGHT+DEEP_SAMPLE").when(F.col("cheap"), "FULL_QUEUE_LIGHT").otherwise("DEEP_SAMPLE")
    share = F.round(F.col("affected") / F.greatest(F.when(F.col("cheap"), F.col("done")).otherwise(F.col("deep")), F.lit(1)), 6)
    coverage = F.when(F.col("cheap"), F.lit(1.0)).otherwise(ratio(F.col("deep"), F.col("queries")))
    return x.select("app_id", "rule_id", "affected", share.alias("share"), scope.alias("scope"), coverage.alias("coverage"))


def load_thresholds(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(key, value) of all thresholds; with overrides (app_id, key, value) one full set for each application named there."""
    base = spark.createDataFrame([(k, float(v)) for k, v in DEFAULTS.items()], "key string, value double")
    if overrides is None:
        return base
    pairs = F.explode(F.create_map(*[x for k, v in DEFAULTS.items() for x in (F.lit(k), F.lit(float(v)))])).alias("key", "value")
    apps = overrides.select("app_id").distinct().select("app_id", pairs)
    o = overrides.select("app_id", "key", F.col("value").alias("own"))
    return apps.join(o, ["app_id", "key"], "left").select("app_id", "key", F.coalesce("own", "value").alias("value"))
