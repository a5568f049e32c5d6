"""Queries of the rule sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import dag, features, intervals, profile, rule_sets, rules, stages, waits
from runlens.operators.intervals import SQL as EXEC
from runlens.plans import rule_sql
from runlens.plans.fixtures import duck
from runlens.plans.queries import ALL, CONT, CORES, CTX, E, FIND, K, QUERIES, SQL, _light, findings, register
from runlens.plans.rule_sql import found
from runlens.plans.wait_queries import STMT
from runlens.sources.folders import written

T = rules.FIXTURE


# ---- executions ----
def profiled(t: DataFrame, s: DataFrame, e: DataFrame, big_bytes: int = 70_000, names: tuple[str, ...] = ("stage", "host", "window", "bucket")) -> dict[str, DataFrame]:
    """Profiles as tables, with the stage findings. names: those that the query looks at."""
    p = profile.profiles(t, s, e, CORES, big_bytes, written, set().union(*map(rules.inputs, rules.STAGE_RULES)), names)
    p["findings"] = rules.evaluate_rules(profile.contexts_of(p["stage"], CORES), rules.STAGE_RULES, T, stages.STAGE)
    return p


def profiled_light(p: dict[str, DataFrame], j: DataFrame, e: DataFrame) -> DataFrame:
    return stages.sql_light_metrics(profile.complete(p["stage"]), j, e)


def profiled_contention(p: dict[str, DataFrame], t: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    """Contention over the pool's segments; both are written when they are first wanted."""
    if "contention" not in p:
        segments = written(intervals.occupancy_segments(t, CORES), "segments")
        p["contention"] = written(intervals.query_contention(t, e, profiled_light(p, j, e), CORES, segments=segments), "contention")
    return p["contention"]


def profiled_wait(p: dict[str, DataFrame], t: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    """Waits of executions, written when they are first wanted."""
    if "wait" not in p:
        p["wait"] = written(waits.sql_queue_wait(e, t, profiled_contention(p, t, j, e)), "wait")
    return p["wait"]


def profiled_sql_findings(p: dict[str, DataFrame], t: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    wait = profiled_wait(p, t, j, e)
    return rules.evaluate_rules(rule_sets.sql_contexts(profile.attempts_of(p["stage"]), e, j, wait, dag.longest_by_profile(p["stage"])), rule_sets.SQL_RULES, T, EXEC)


def sql_findings(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    return profiled_sql_findings(profiled(t, s, e, names=("stage",)), t, j, e)


SCTX = f"""WITH sctx AS (SELECT g.app_id, g.execution_id, wall_ms, gap_ratio, jobs, job_p50, wait_ratio, 1 AS critical_ms, failed_tasks, speculative, 0 AS speculative_killed, sort_merge_join, shuffled_hash_join, cartesian, nested_loop, empty_partition_filters, adaptive
FROM ({SQL['driver_gap']}) g JOIN ({SQL['job_fragmentation']}) USING ({E}) JOIN ({SQL['plan_features']}) USING ({E}) LEFT JOIN ({SQL['sql_queue_wait']}) USING ({E}) JOIN (SELECT {E}, count(*) FILTER (failed) AS failed_tasks, count(*) FILTER (speculative) AS speculative FROM v_task GROUP BY {E}) USING ({E}))"""
register("evaluate_sql_rules", sql_findings, ALL, f"{SCTX} {found(rule_sql.EXECUTION, 'sctx', E)}", written=True)


# ---- applications ----
def profiled_queue_findings(p: dict[str, DataFrame], t: DataFrame, j: DataFrame, e: DataFrame, x: DataFrame, c: DataFrame) -> DataFrame:
    ctx = rule_sets.queue_contexts(p, features.fetch_matrix(t), e, j, x, c, p["findings"])
    return rules.evaluate_rules(ctx, BOTH, T, ["app_id"])


def queue_findings(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame, x: DataFrame, c: DataFrame) -> DataFrame:
    return profiled_queue_findings(profiled(t, s, e), t, j, e, x, c)


QVIEWS = f"{ALL} v_executor_event v_conf"
QCTX = f"""WITH qctx AS (SELECT d.*, idle_minutes, overload_minutes, hot_buckets, executors_removed, config_issues, storm_failed, storm_ratio, stage_retries, interrupted, tail_submissions, host_score, host_tasks, host_stages, io_worst_ratio, io_worst_tasks, io_spill_share, fetch_failures, fetch_row_share, memory_pressure, partial_stages, negative_durations, window_end - window_start AS wall_ms
FROM (SELECT * EXCLUDE (bad) FROM ({SQL['driver_health']})) d LEFT JOIN ({SQL['longest_run_of_buckets']}) USING (app_id)
LEFT JOIN (SELECT app_id, count(*) FILTER (utilization >= 0.95) AS hot_buckets FROM ({SQL['bucket_utilization']}) GROUP BY app_id) USING (app_id)
LEFT JOIN (SELECT app_id, count(*) FILTER (NOT added) AS executors_removed FROM v_executor_event GROUP BY app_id) USING (app_id)
LEFT JOIN (SELECT app_id, count(*) FILTER (issue) AS config_issues FROM ({SQL['config_check']}) GROUP BY app_id) USING (app_id)
LEFT JOIN (SELECT app_id, failed AS storm_failed, r AS storm_ratio FROM (SELECT *, round(failed::double / greatest(attempts, 1), 6) AS r FROM ({SQL['bucket_task_metrics']})) QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY failed DESC, r DESC) = 1) USING (app_id)
LEFT JOIN (SELECT app_id, sum(extra_attempts) AS stage_retries FROM v_stage GROUP BY app_id) USING (app_id) LEFT JOIN ({SQL['restart_impact']}) USING (app_id)
LEFT JOIN (SELECT app_id, score AS host_score, tasks AS host_tasks, stages AS host_stages FROM ({SQL['host_score']}) QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY score DESC, tasks DESC, stages DESC) = 1) USING (app_id)
LEFT JOIN (SELECT app_id, of_median AS io_worst_ratio, tasks AS io_worst_tasks, max(spill_share) OVER (PARTITION BY app_id) AS io_spill_share FROM ({SQL['host_io']}) QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY of_median, host) = 1) USING (app_id)
LEFT JOIN (SELECT app_id, sum(n)::bigint AS fetch_failures, round(max(n)::double / sum(n), 6) AS fetch_row_share FROM (SELECT app_id, src_host, count(*) AS n FROM v_task WHERE src_host IS NOT NULL GROUP BY ALL) GROUP BY app_id) USING (app_id)
LEFT JOIN (SELECT app_id, count(DISTINCT rule_id || execution_id) AS memory_pressure FROM ({SQL['evaluate_rules']}) WHERE rule_id IN ('S-07', 'S-08', 'S-09') GROUP BY app_id) USING (app_id)
LEFT JOIN (SELECT app_id, count(*) AS partial_stages FROM ({SQL['partial_stages']}) GROUP BY app_id) USING (app_id)
LEFT JOIN (SELECT app_id, count(*) FILTER (finish_ms < launch_ms) AS negative_durations FROM v_task GROUP BY app_id) USING (app_id) LEFT JOIN ({SQL['queue_window']}) USING (app_id))"""
BOTH = rule_sets.QUEUE_RULES + rule_sets.DQ_RULES
register("evaluate_queue_rules", queue_findings, QVIEWS, f"{QCTX} {found(rule_sql.QUEUE, 'qctx', 'app_id')}", written=True)
_case = lambda k: "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{a[k]}'" for r, a in rule_sql.ADVICE.items()) + " END"
register("queue_recommendations", lambda *v: rule_sets.queue_recommendations(queue_findings(*v)), QVIEWS, f"{QCTX} SELECT *, {_case(0)} AS action, {_case(1)} AS advice FROM ({found(rule_sql.QUEUE, 'qctx', 'app_id')})", written=True)

# ---- older rules ----
register("legacy_rules", lambda t, s: rules.evaluate_rules(rules.stage_contexts(t, s, CORES), rule_sets.LEGACY_RULES, {}, stages.STAGE), "v_task v_stage", f"{CTX} {found(rule_sql.OLD_STAGE, 'ctx', K)}")


def _legacy_sql(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame, x: DataFrame) -> DataFrame:
    flags = e.select(*EXEC, "plan", *[c.alias(k) for k, c in text.plan_features(F.col("plan")).items()])
    ctx = _light(t, s, j, e).select(*EXEC, F.col("duration_ms").alias("wall_ms"), "spill_bytes").join(flags, EXEC).join(intervals.core_utilization(e, x, t).select(*EXEC, "utilization"), EXEC, "left")
    return rules.evaluate_rules(ctx, rule_sets.LEGACY_SQL_RULES, {}, EXEC)


register("legacy_sql_rules", _legacy_sql, f"{ALL} v_executor_event", f"WITH lctx AS (SELECT {E}, duration_ms AS wall_ms, spill_bytes, plan, sort_merge_join, broadcast_join, nested_loop, utilization FROM ({SQL['sql_light_metrics']}) JOIN ({SQL['plan_features']}) USING ({E}) JOIN (SELECT {E}, plan FROM v_exec) USING ({E}) LEFT JOIN (SELECT {E}, utilization FROM ({SQL['core_utilization']})) USING ({E})) {found(rule_sql.OLD_EXECUTION, 'lctx', E)}")

# ---- signals, roll-ups, gates ----
LIGHT_SIG = f"{CTX} " + " UNION ".join(f"SELECT DISTINCT {E}, '{r}' AS rule_id FROM ctx WHERE {w}" for r, w in rule_sql.LIGHT)


def _signals(t: DataFrame, s: DataFrame) -> DataFrame:
    return rule_sets.light_signals(rules.stage_contexts(t, s, CORES), T)


register("light_signals", _signals, "v_task v_stage", LIGHT_SIG)
_n = lambda ids: "count(DISTINCT execution_id) FILTER (rule_id IN (" + ", ".join(f"'{i}'" for i in ids) + "))"


def _rollup(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    p = profiled(t, s, e, names=("stage",))
    return rule_sets.rollup_s_to_q(p["findings"].select(*EXEC, "rule_id").unionByName(profiled_sql_findings(p, t, j, e).select(*EXEC, "rule_id")))


register("rollup_s_to_q", _rollup, ALL, f"WITH x AS (SELECT {E}, rule_id FROM ({SQL['evaluate_rules']}) UNION ALL SELECT {E}, rule_id FROM ({SQL['evaluate_sql_rules']})) SELECT app_id, {', '.join(f'{_n(i)} AS {q}' for q, i in rule_sql.ROLLUP.items())} FROM x GROUP BY app_id", written=True)


def _capable(e: DataFrame) -> DataFrame:
    has = F.array_compact(F.array(F.lit("QUEUE_TIMELINE"), F.when(F.col("plan") != "", "PLAN_TEXT"), F.when(F.col("plan").contains("Scan"), "PLAN_METRICS")))
    return e.select("app_id", has.alias("capabilities"))


register("capability_gate", lambda e: rules.capability_gate(_capable(e), rule_sets.ALL_RULES), "v_exec", "SELECT DISTINCT app_id, rule_id, missing FROM v_exec CROSS JOIN (SELECT unnest([" + ", ".join(f"{{'rule_id': '{r}', 'missing': '{m}'}}" for m, ids in rule_sql.LACKING.items() for r in ids) + "], recursive := true))")
register("partial_degrade", lambda t, s: rules.partial_degrade(findings(t, s), t.where("failed and speculative").select("app_id")), "v_task v_stage", f"{FIND} SELECT {K}, rule_id, score, CASE WHEN p AND severity = 2 THEN 1 ELSE severity END AS severity, CASE WHEN p THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM (SELECT *, app_id IN (SELECT app_id FROM v_task WHERE failed AND speculative) AS p FROM found)")


def _suppressed(t: DataFrame, s: DataFrame, e: DataFrame) -> DataFrame:
    f = findings(t, s).join(e.select(*EXEC, text.statement_id(F.col("description")).alias("statement_id"), text.template_hash(F.col("description")).alias("fingerprint")), EXEC).withColumn("table", F.lit(None).cast("string"))
    rows = [("S-01", "execution_id % 10 = 3", "2030-01-01", "known skew"), ("S-07", "execution_id % 10 = 4", "2020-01-01", "too old"), ("S-01", "execution_id % 20 = 3", None, "a first reason")]
    each = [e.where(w).select(F.lit(r).alias("rule"), F.lit(None).cast("string").alias("fingerprint"), text.statement_id(F.col("description")).alias("statement_id"), F.lit(None).cast("string").alias("table"), F.lit(why).alias("reason"), F.lit(u).cast("string").alias("until")).distinct() for r, w, u, why in rows]
    out = rules.suppress_findings(f, each[0].unionByName(each[1]).unionByName(each[2]), "2025-01-01")
    return out.select(*stages.STAGE, "rule_id", "severity", "score", "reason", "suppressed")


register("suppress_findings", _suppressed, "v_task v_stage v_exec", f"{FIND}, z AS (SELECT f.*, {STMT} AS s FROM found f JOIN v_exec USING ({E})), a AS (SELECT DISTINCT {STMT} AS s FROM v_exec WHERE execution_id % 10 = 3), b AS (SELECT DISTINCT {STMT} AS s FROM v_exec WHERE execution_id % 20 = 3), y AS (SELECT *, CASE WHEN rule_id = 'S-01' AND s IN (FROM b) THEN 'a first reason' WHEN rule_id = 'S-01' AND s IN (FROM a) THEN 'known skew' END AS reason FROM z) SELECT {K}, rule_id, severity, score, reason, reason IS NOT NULL AS suppressed FROM y")
QUERIES["load_thresholds"] = lambda spark, d: rules.load_thresholds(spark, _overrides(spark, d))


def _overrides(spark, d: str) -> DataFrame:
    from runlens.plans.fixtures import view

    key = F.regexp_extract("key", r"^runlens\.threshold\.(.+)$", 1)
    return view(spark, d, "v_conf").where(key != "").select("app_id", key.alias("key"), F.col("value").try_cast("double").alias("value"))


SQL["load_thresholds"] = duck("SELECT a.app_id, k.key, coalesce(v.value::double, k.value) AS value FROM (SELECT DISTINCT app_id FROM v_conf) a CROSS JOIN (SELECT unnest([" + ", ".join(f"{{'key': '{k}', 'value': {float(v)}::double}}" for k, v in rule_sql.THRESHOLDS.items()) + "], recursive := true)) k LEFT JOIN v_conf v ON v.app_id = a.app_id AND v.key = 'runlens.threshold.' || k.key")


def _evidence(t: DataFrame, s: DataFrame) -> DataFrame:
    """Findings with what their contexts show; the contexts are written once, as both are made of them."""
    ctx = written(rules.stage_contexts(t, s, CORES), "contexts")
    return rules.finding_evidence(rules.evaluate_rules(ctx, rules.STAGE_RULES, T, stages.STAGE), ctx, stages.STAGE)


register("finding_evidence", lambda t, s: _evidence(t, s).select(*stages.STAGE, "rule_id", F.col("evidence")["run_max"].alias("run_max"), F.col("evidence")["n"].alias("n"), F.col("evidence")["heap_peak_ratio"].alias("heap")), "v_task v_stage", f"{FIND} SELECT {K}, rule_id, run_max::varchar AS run_max, n::varchar AS n, NULL::varchar AS heap FROM found JOIN (SELECT {K}, run_max, n FROM ctx) USING ({K})", written=True)
_texts = f"SELECT DISTINCT {E}, severity, rule_id, {_case(0)} || ': ' || {_case(1)} AS a FROM found"
register("recommendation_digest", lambda t, s: rule_sets.recommendation_digest(findings(t, s), EXEC), "v_task v_stage", f"{FIND}, x AS ({_texts}), y AS (SELECT {E}, rule_id, a, max(severity) AS severity FROM x GROUP BY ALL) SELECT {E}, string_agg(a, '; ' ORDER BY severity DESC, rule_id) AS advice, count(*) FILTER (severity = 2) || ' critical, ' || count(*) FILTER (severity = 1) || ' warnings' AS summary FROM y GROUP BY {E}")
