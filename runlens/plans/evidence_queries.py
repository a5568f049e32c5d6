"""Queries of what rules need beyond task measurements, and of rules that need it, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import dag, evidence, features, history, intervals, losses, profile, queue, rule_sets, rules, sketches, waits
from runlens.operators.intervals import SQL as EXEC
from runlens.operators.stages import METRICS, micros, stage_metrics
from runlens.plans import rule_sql
from runlens.plans.fixtures import duck
from runlens.plans.queries import ALL, CORES, CTX, E, K, SQL, TEMPLATE, WITH_LIGHT, _contention, _light, _q, _ratio, findings, register
from runlens.plans.rule_queries import BOTH, QCTX, QVIEWS, SCTX, T, profiled, profiled_light, profiled_queue_findings, profiled_sql_findings, profiled_wait
from runlens.plans.source_queries import _heap_lines
from runlens.plans.wait_queries import RUN_SQL, _run, _runs
from runlens.sources import plans
from runlens.sources.folders import written

#: Thresholds at the scale of the views for rules on plans, heaps, baselines and windows.
WIDE = T | {
    "small_files.prune_files": 2000, "dangerous_join.bnlj_rows": 1_200_000, "row_amp.min_rows": 1_000_000, "regression.ratio": 1.1, "regression.abs_ms": 1000, "codegen.cpu_ratio": 0.55,
    "monopoly.window_min": 1, "monopoly.min_concurrent": 2, "systemic.norm_median": 1.05, "systemic.min_concurrent": 2, "queue_baseline.global_p50_ratio": 1.05, "net_matrix.min_fetchfail": 5,
}


# ---- thresholds of applications, impact ----
register("evaluate_rules_by_app", lambda t, s, c: rules.evaluate_rules(rules.with_thresholds(rules.stage_contexts(t, s, CORES), c), rules.STAGE_RULES, T, ["app_id", "execution_id", "stage_id"]), "v_task v_stage v_conf",
         f"{CTX} {rule_sql.found([('S-01', f'n >= 10 AND run_max >= 60000 AND {rule_sql._times} >= CASE WHEN substr(app_id, 5)::bigint % 3 = 0 THEN 7 ELSE 6 END', rule_sql.STAGE[0][2]), *rule_sql.STAGE[1:]], 'ctx', K)}")
register("finding_score", lambda t, s: rules.evaluate_rules(rules.stage_contexts(t, s, CORES).withColumn("impact_core_ms", F.col("run_sum")), rules.STAGE_RULES, T, ["app_id", "execution_id", "stage_id"]), "v_task v_stage",
         f"{CTX}, wide AS (SELECT * REPLACE (greatest(wall_ms, run_sum) AS wall_ms) FROM ctx) {rule_sql.found(rule_sql.STAGE, 'wide', K)}")


# ---- fetches, storms, memory, clocks ----
def _racks(t: DataFrame) -> DataFrame:
    return t.select("host").distinct().select("host", F.concat(F.lit("rack-"), F.expr("cast(substr(host, 6) as bigint) div 4")).alias("rack"))


_eff = lambda n: _ratio(f"sum({n})::double * sum({n})", f"sum({n} * {n})::double")
FETCH = f"""p AS (SELECT app_id, src_host, host, count(*) AS n FROM v_task WHERE src_host IS NOT NULL GROUP BY ALL), r AS (SELECT app_id, src_host, sum(n)::bigint AS n FROM p GROUP BY ALL),
bl AS (SELECT app_id, substr(src_host, 6)::int // 4 AS a, substr(host, 6)::int // 4 AS b, sum(n)::bigint AS n FROM p GROUP BY ALL),
f AS (SELECT app_id, sum(n)::bigint AS fetch_failures, arg_max(src_host, n * 1000 + substr(src_host, 6)::int) AS worst_source, {_ratio('max(n)', 'sum(n)')} AS fetch_row_share, {_eff('n')} AS sources FROM r GROUP BY app_id),
g AS (SELECT app_id, {_ratio('max(n)', 'sum(n)')} AS fetch_rack_share FROM bl GROUP BY app_id), o AS (SELECT app_id, count(DISTINCT host) AS hosts FROM v_task GROUP BY app_id),
fv AS (SELECT *, fetch_row_share < 0.5 AND fetch_rack_share < 0.5 AND sources >= 0.5 * hosts AS fetch_diffuse FROM f JOIN g USING (app_id) JOIN o USING (app_id))"""
register("fetch_verdict", lambda t: evidence.fetch_verdict(t, _racks(t), 5), "v_task", f"WITH {FETCH} SELECT *, CASE WHEN fetch_failures < 5 THEN 'NONE' WHEN fetch_row_share >= 0.5 THEN 'SINGLE_HOST' WHEN fetch_rack_share >= 0.5 THEN 'RACK' WHEN fetch_diffuse THEN 'CONGESTION' ELSE 'MIXED' END AS verdict FROM fv")
_of = lambda *names: "count(*) FILTER (failed AND reason IN ('" + "', '".join(names) + "'))"
register("storm_profile", evidence.storm_profile, "v_task", f"""WITH h AS (SELECT app_id, launch_ms // 60000 * 60000 AS bucket_ms, host, count(*) AS attempts, count(*) FILTER (failed) AS failed, {_of('GSS token expired')} AS auth, {_of('OutOfMemoryError', 'ExecutorLostFailure')} AS resource FROM v_task GROUP BY ALL),
b AS (SELECT app_id, bucket_ms, sum(attempts)::bigint AS attempts, sum(failed)::bigint AS failed, sum(auth)::bigint AS auth, sum(resource)::bigint AS resource, {_eff('failed')} AS hosts FROM h GROUP BY ALL HAVING sum(failed) >= 2 AND sum(failed) >= 0.1 * sum(attempts))
SELECT *, min(bucket_ms) OVER (PARTITION BY app_id) AS first_burst_ms, CASE WHEN hosts < 2 THEN 'NODE' WHEN 2 * auth >= failed THEN 'AUTH' WHEN 2 * resource >= failed THEN 'RESOURCE' ELSE 'MIXED' END AS kind FROM b""")
register("memory_branches", lambda t, s, j, e: evidence.memory_branches(_light(t, s, j, e), t, e, wide=0.7), ALL, f"""{WITH_LIGHT}, a AS (SELECT app_id, count(*) FILTER (spill_bytes > 0) AS affected, {_ratio('max(spill_bytes)', 'sum(spill_bytes)')} AS top_share FROM light GROUP BY app_id),
b AS (SELECT app_id, launch_ms // 60000 AS b, count(DISTINCT execution_id) AS x, sum(disk_spill_bytes)::hugeint AS y FROM v_task GROUP BY ALL),
c AS (SELECT app_id, count(*)::double AS n, {_ratio('count(*) FILTER (y > 0)', 'count(*)')} AS bucket_share, sum(x)::double AS sx, sum(y)::double AS sy, sum(x * y)::double AS sxy, sum(x * x)::double AS sxx, sum(y * y)::double AS syy FROM b GROUP BY app_id),
d AS (SELECT app_id, affected, top_share, bucket_share, CASE WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN round((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)), 6) ELSE 0 END AS concurrency_corr FROM a JOIN c USING (app_id))
SELECT *, CASE WHEN affected = 0 THEN 'NONE' WHEN top_share >= 0.5 THEN 'SINGLE_SQL' WHEN bucket_share >= 0.7 THEN 'WATERLINE' WHEN concurrency_corr >= 0.3 THEN 'CONCURRENCY' ELSE 'MIXED' END AS verdict FROM d""")
CLOCK = f"""a AS (SELECT app_id, executor_id, min(time_ms) AS added_ms FROM v_executor_event WHERE added GROUP BY ALL), x AS (SELECT t.app_id, host, t.executor_id, min(launch_ms) - any_value(added_ms) AS d, count(*) FILTER (finish_ms < launch_ms) AS negative FROM v_task t LEFT JOIN a USING (app_id, executor_id) GROUP BY ALL),
w AS (SELECT app_id, {_q('d', 0.5)} AS usual FROM x GROUP BY app_id), clocks AS (SELECT app_id, host, count(d) AS executors, {_q('d', 0.5)} - any_value(usual) AS offset_ms, sum(negative)::bigint AS negative FROM x JOIN w USING (app_id) GROUP BY ALL)"""
register("clock_offsets", evidence.clock_offsets, "v_task v_executor_event", f"WITH {CLOCK} SELECT * FROM clocks")


def _heaps(t: DataFrame) -> DataFrame:
    return plans.heap_peaks(_heap_lines(t)).withColumnRenamed("log", "app_id")


HOURS = """ho AS (SELECT s.app_id, completion_ms // 3600000 AS hour, max(peak) AS peak FROM v_stage s JOIN (SELECT app_id, stage_id, max(result_size) * 20000 AS peak FROM v_task GROUP BY ALL) USING (app_id, stage_id) GROUP BY ALL),
trend AS (SELECT app_id, round(regr_slope(peak, hour), 6) AS heap_slope, round(avg(peak) FILTER (q = 1), 6) AS heap_first_quartile, arg_max(peak, hour) AS last_peak, count(*) AS hours FROM (SELECT *, ntile(4) OVER (PARTITION BY app_id ORDER BY hour) AS q FROM ho) GROUP BY app_id)"""
register("resource_trend", lambda t, s: plans.heap_trend(_heaps(t), s, "app_id"), "v_task v_stage", f"WITH {HOURS} SELECT * FROM trend")


# ---- templates ----
def _template_history(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    return _history_of(e, _light(t, s, j, e), waits.sql_queue_wait(e, t, _contention(t, s, j, e), 0.1))


def _history_of(e: DataFrame, light: DataFrame, wait: DataFrame) -> DataFrame:
    wait = wait.select(*EXEC, "wait_ms")
    own = e.where("end_ms > start_ms").select(*EXEC, text.template_hash(F.col("description")).alias("template"), F.md5("plan").alias("plan"), _run().alias("run"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    x = own.join(light.select(*EXEC, "input_bytes", "read_bytes", micros("max_skew").alias("skew_micros")), EXEC).join(wait, EXEC, "left")
    return x.withColumn("wait_ms", F.coalesce("wait_ms", F.lit(0)))


_mean = lambda c: f"(sum({c}) * 2 + count({c})) // (count({c}) * 2)"
_names = {"duration_ms": "time", "input_bytes": "input", "read_bytes": "shuffle", "skew_micros": "skew", "wait_ms": "wait"}
_grow = lambda n: f"least({_ratio(f'({n} - base_{n})::double * greatest(base_time, 1)', f'greatest(base_{n}, 1)::double * (time - base_time)')}, 1)"
_more = lambda n: f"{n} >= greatest(base_{n}, 1) * 1.05"
_before = "(PARTITION BY template ORDER BY run ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
HIST = f"""hi AS (SELECT md5({TEMPLATE}) AS template, md5(plan) AS plan, {RUN_SQL} AS run, e.end_ms - e.start_ms AS duration_ms, input_bytes, read_bytes, round(max_skew * 1000000)::bigint AS skew_micros, coalesce(wait_ms, 0) AS wait_ms
FROM v_exec e JOIN ({SQL['sql_light_metrics']}) l USING (app_id, execution_id) LEFT JOIN ({SQL['sql_queue_wait']}) q USING (app_id, execution_id) WHERE e.end_ms > e.start_ms),
pl AS (SELECT template, run, plan FROM (SELECT template, run, plan, count(*) AS k FROM hi GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY template, run ORDER BY k DESC, plan DESC) = 1),
pe AS (SELECT template, run, {', '.join(f'({_mean(c)})::bigint AS {n}' for c, n in _names.items())} FROM hi GROUP BY ALL),
ba AS (SELECT *, {', '.join(f'((sum({n}) OVER w * 2 + count({n}) OVER w) // (count({n}) OVER w * 2))::bigint AS base_{n}' for n in _names.values())}, count(*) OVER w AS seen, lag(plan) OVER (PARTITION BY template ORDER BY run) AS last_plan FROM pe JOIN pl USING (template, run) WINDOW w AS {_before})"""
register("template_causes", lambda *v: evidence.template_causes(_template_history(*v), 1.05, 500, 3, 14, 1.05), ALL, f"""WITH {HIST}, x AS (SELECT * FROM ba WHERE seen >= 3 AND time >= greatest(base_time * 1.05, base_time + 500))
SELECT template, run, time, base_time, seen, plan <> last_plan AS plan_changed, CASE WHEN {_more('input')} THEN 'INPUT' WHEN {_more('shuffle')} THEN 'SHUFFLE' WHEN {_more('skew')} THEN 'SKEW' WHEN plan <> last_plan THEN 'PLAN' WHEN {_more('wait')} THEN 'QUEUE' ELSE 'UNEXPLAINED' END AS cause,
CASE WHEN {_more('input')} THEN {_grow('input')} WHEN {_more('shuffle')} THEN {_grow('shuffle')} WHEN {_more('skew')} THEN {_grow('skew')} WHEN plan <> last_plan THEN 1 WHEN {_more('wait')} THEN least({_ratio('wait - base_wait', 'time - base_time')}, 1) ELSE 0 END::double AS share FROM x""", written=True)


# ---- rules that need plans, heaps, baselines and windows ----
def _path(t: DataFrame, s: DataFrame) -> DataFrame:
    return dag.critical_path_stages(s, t)


def _stage_rules(t: DataFrame, s: DataFrame, e: DataFrame, c: DataFrame) -> DataFrame:
    memory = c.where("key = 'spark.executor.memory'").select("app_id", text.size_bytes(F.col("value"), 0).alias("memory_bytes"))
    flags = e.select(*EXEC, text.plan_features(F.col("plan"))["codegen_gap"].alias("codegen_gap"))
    ctx = evidence.stage_evidence(rules.stage_contexts(t, s, CORES), evidence.heap_ratios(_heaps(t), memory), flags, _path(t, s))
    return rules.evaluate_rules(ctx, tuple(r for r in rules.STAGE_RULES if r.id in ("S-09", "S-29")), WIDE, ["app_id", "execution_id", "stage_id"])


HEAP = f"(SELECT app_id, stage_id::bigint AS stage_id, {_ratio('max(peak_bytes)', 'any_value(memory_bytes)')} AS heap_peak_ratio FROM (SELECT log AS app_id, * EXCLUDE (log) FROM ({SQL['heap_headroom']})) GROUP BY ALL)"
PATHS = f"(SELECT app_id, execution_id, stage_id, share FROM ({SQL['critical_path_stages']}))"
register("stage_rules_of_evidence", _stage_rules, "v_task v_stage v_exec v_conf", f"""{CTX}, sx AS (SELECT ctx.*, heap_peak_ratio, NOT regexp_matches(plan, '\\*\\(\\d+\\)|codegen id :|\\* \\w') AS codegen_gap, coalesce(p.share, 0) AS path_share FROM ctx LEFT JOIN {HEAP} h USING (app_id, stage_id) LEFT JOIN (SELECT app_id, execution_id, plan FROM v_exec) USING (app_id, execution_id) LEFT JOIN {PATHS} p USING (app_id, execution_id, stage_id))
{rule_sql.found([('S-09', 'heap_peak_ratio >= 0.9 OR heap_peak_ratio <= 0.5', '1'), ('S-29', 'codegen_gap AND cpu_ratio >= 0.55 AND path_share >= 0.2', '1')], 'sx', K)}""")
PLAN_RULES = ("S-05", "S-06", "S-17", "S-18", "S-19", "S-22", "S-25", "S-26")


def _node_metrics(n: DataFrame) -> DataFrame:
    return plans.sql_plan_metrics(n.withColumnRenamed("app_id", "log")).withColumnRenamed("log", "app_id")


def _plan_rules(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame, n: DataFrame) -> DataFrame:
    return _plan_rules_of(e, n, _template_history(t, s, j, e), _path(t, s), stage_metrics(t, s))


def _plan_rules_of(e: DataFrame, n: DataFrame, past: DataFrame, path: DataFrame, reads: DataFrame) -> DataFrame:
    runs = _runs(e).select("template", "run", "duration_ms")
    base = features.template_regression(runs, 1.1, 1000).select("template", "run", F.col("p50").alias("p50_ms"), F.col("base").alias("baseline_p50_ms"), F.col("seen").alias("baseline_samples"))
    changed = evidence.template_causes(past, 0.0, -(10**15), 3).select("template", "run", "plan_changed")
    own = e.select(*EXEC, text.template_hash(F.col("description")).alias("template"), _run().alias("run"))
    baselines = own.join(base, ["template", "run"]).join(changed, ["template", "run"], "left").drop("template", "run")
    flags = e.select(*EXEC, *[c.alias(k) for k, c in text.plan_features(F.col("plan")).items()], F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms") - F.col("start_ms")).otherwise(0).alias("wall_ms"))
    ctx = evidence.execution_evidence(flags, _node_metrics(n), path, reads, baselines)
    return rules.evaluate_rules(ctx, tuple(r for r in rule_sets.SQL_RULES if r.id in PLAN_RULES), WIDE, EXEC)


PCTX = f"""WITH {HIST}, mx AS (SELECT app_id, execution_id, max(total) FILTER (k = 1) AS scan_files, max(total) FILTER (k = 2) AS scan_bytes, max(total) FILTER (k = 7) AS output_files, max(total) FILTER (k = 8) AS output_bytes, max(total) FILTER (k = 4) AS broadcast_bytes, max(total) FILTER (k = 3) AS small_side_bytes,
max(total) FILTER (k = 5) AS join_rows, max(total) FILTER (k = 5)::double / greatest(max(total) FILTER (k = 6), 1) AS row_amp FROM v_node GROUP BY ALL),
jp AS (SELECT p.app_id, p.execution_id, round(sum(share), 6) AS join_path_share FROM {PATHS} p JOIN (SELECT app_id, execution_id, stage_id FROM v_task GROUP BY ALL HAVING sum(shuffle_read_bytes) > 0) USING (app_id, execution_id, stage_id) GROUP BY ALL),
rg AS ({SQL['template_regression']}), bs AS (SELECT app_id, execution_id, p50 AS p50_ms, base AS baseline_p50_ms, seen AS baseline_samples, plan_changed FROM (SELECT app_id, execution_id, md5({TEMPLATE}) AS template, {RUN_SQL} AS run FROM v_exec) JOIN rg USING (template, run) LEFT JOIN (SELECT template, run, plan <> last_plan AS plan_changed FROM ba WHERE seen >= 3) USING (template, run)),
pctx AS (SELECT f.*, mx.* EXCLUDE (app_id, execution_id), coalesce(join_path_share, 0) AS join_path_share, bs.* EXCLUDE (app_id, execution_id), CASE WHEN e.end_ms > e.start_ms THEN e.end_ms - e.start_ms ELSE 0 END AS wall_ms
FROM ({SQL['plan_features']}) f JOIN v_exec e USING (app_id, execution_id) LEFT JOIN mx USING (app_id, execution_id) LEFT JOIN jp USING (app_id, execution_id) LEFT JOIN bs USING (app_id, execution_id))"""
register("plan_rules_of_evidence", _plan_rules, f"{ALL} v_node", f"""{PCTX} {rule_sql.found([
    ('S-05', 'scan_files >= 1000 AND scan_bytes <= 8388608 * scan_files', '1'), ('S-06', 'output_files >= 500 AND output_bytes <= 16777216 * output_files', '1'),
    ('S-17', '(sort_merge_join OR shuffled_hash_join) AND small_side_bytes BETWEEN 1 AND 67108864', '1'), ('S-18', 'broadcast_bytes >= 536870912', '2'), ('S-19', 'empty_partition_filters AND scan_files >= 2000', '1'),
    ('S-22', 'baseline_samples >= 3 AND p50_ms >= greatest(1.1 * baseline_p50_ms, baseline_p50_ms + 1000)', 'CASE WHEN plan_changed THEN 2 ELSE 1 END'),
    ('S-25', 'cartesian OR (nested_loop AND (join_rows >= 1200000 OR join_path_share >= 0.3))', '2'), ('S-26', 'row_amp >= 10 AND join_rows >= 1000000', '2')], 'pctx', E)}""", written=True)


def _drift(e: DataFrame) -> DataFrame:
    """How each application's run stands against its queue's earlier runs."""
    d = history.queue_drift(_runs(e), features.template_regression(_runs(e), 1.1, 1000), 1.05, 0.3).select("run", F.col("ratio").alias("p50_ratio"), "regressed_share")
    return e.select("app_id", _run().alias("run")).distinct().join(d, "run").drop("run")


def _queue_rules(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame, x: DataFrame, n: DataFrame) -> DataFrame:
    own = waits.sql_bucket_core_ms(t, CORES)
    flags = e.select(*EXEC, F.lit(0).alias("wall_ms")).join(_node_metrics(n), EXEC)
    small = rules.evaluate_rules(flags, rule_sets.SQL_RULES[:2], WIDE, EXEC)
    ctx = evidence.queue_evidence(own, waits.monopoly_windows(own, CORES, 0.6, 2, 1), waits.systemic_windows(t, 1.05, 2, 0.4), plans.heap_trend(_heaps(t), s, "app_id"), small, _drift(e), evidence.fetch_verdict(t, _racks(t), 5), evidence.clock_offsets(t, x), CORES)
    wall = e.groupBy("app_id").agg((F.max("end_ms") - F.min("start_ms")).alias("wall_ms"))
    wanted = tuple(r for r in BOTH if r.id in ("Q-04", "Q-07", "Q-10", "Q-11", "Q-13", "Q-18", "DQ-02"))
    return rules.evaluate_rules(ctx.join(wall, "app_id"), wanted, WIDE, ["app_id"])


register("queue_rules_of_evidence", _queue_rules, f"{ALL} v_executor_event v_node", f"""WITH {FETCH}, {CLOCK}, {HOURS}, ow AS ({SQL['sql_bucket_core_ms']}), mo AS (SELECT app_id, max(minutes) AS monopoly_minutes FROM ({SQL['monopoly_windows']}) GROUP BY app_id),
he AS (SELECT app_id, {_ratio('max(most)', f'{CORES} * 60000')} AS monopoly_share, max(active) AS monopoly_active FROM (SELECT app_id, b, count(*) AS active, max(core_ms) AS most FROM ow WHERE core_ms > 0 GROUP BY ALL) WHERE most >= 0.6 * {CORES} * 60000 GROUP BY app_id),
sy AS (SELECT app_id, max(median_norm) AS systemic_norm, max(active) AS systemic_active FROM ({SQL['systemic_windows']}) GROUP BY app_id),
sm AS (SELECT app_id, count(DISTINCT execution_id) AS small_file_queries FROM (SELECT app_id, execution_id, max(total) FILTER (k = 1) AS a, max(total) FILTER (k = 2) AS b, max(total) FILTER (k = 7) AS c, max(total) FILTER (k = 8) AS d FROM v_node GROUP BY ALL) WHERE (a >= 1000 AND b <= 8388608 * a) OR (c >= 500 AND d <= 16777216 * c) GROUP BY app_id),
dr AS (SELECT app_id, ratio AS p50_ratio, regressed_share FROM (SELECT DISTINCT app_id, {RUN_SQL} AS run FROM v_exec) JOIN ({SQL['queue_drift']}) USING (run)), ck AS (SELECT app_id, max(abs(offset_ms)) AS clock_skew_ms, sum(negative) AS negative_durations FROM clocks GROUP BY app_id),
z AS (SELECT * FROM (SELECT app_id, max(end_ms) - min(start_ms) AS wall_ms FROM v_exec GROUP BY app_id) LEFT JOIN mo USING (app_id) LEFT JOIN he USING (app_id) LEFT JOIN sy USING (app_id) LEFT JOIN sm USING (app_id) LEFT JOIN dr USING (app_id) LEFT JOIN ck USING (app_id) LEFT JOIN fv USING (app_id) LEFT JOIN trend USING (app_id))
{rule_sql.found([
    ('Q-04', 'monopoly_minutes >= 1 AND monopoly_share >= 0.6 AND monopoly_active >= 2', '2'), ('Q-07', 'heap_slope <> 0 OR heap_first_quartile IS NOT NULL', '0'), ('Q-10', 'small_file_queries > 0', '1'), ('Q-11', 'systemic_norm >= 1.05 AND systemic_active >= 2', '1'),
    ('Q-13', 'fetch_failures >= 5 AND (fetch_row_share >= 0.5 OR fetch_rack_share >= 0.5 OR fetch_diffuse)', '2'), ('Q-18', 'p50_ratio >= 1.05 OR regressed_share >= 0.3', '2'), ('DQ-02', 'negative_durations > 0 OR abs(clock_skew_ms) >= 5000', '1')], 'z', 'app_id')}""", written=True)


# ---- interactions ----
def _interactions(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame, x: DataFrame, c: DataFrame, n: DataFrame) -> DataFrame:
    p = profiled(t, s, e)
    wait = profiled_wait(p, t, j, e)
    busy = wait.where((F.col("wait_ratio") >= T["queue.wait_ratio"]) & (F.col("pool_utilization") >= T["queue.busy_ratio"])).select(*EXEC)
    unknown = F.lit(None).cast("double").alias("join_path_share")
    path, reads = dag.path_by_profile(p["stage"]), profile.complete(p["stage"])
    shares = path.join(reads.where("read_sum > 0").select("app_id", "execution_id", "stage_id"), ["app_id", "execution_id", "stage_id"], "left_semi").where("execution_id % 2 = 0").groupBy(*EXEC).agg(F.round(F.sum("share"), 6).alias("join_path_share"))
    plan = _plan_rules_of(e, n, _history_of(e, profiled_light(p, j, e), wait), path, reads).where("rule_id in ('S-17', 'S-26')").join(shares, EXEC, "left").select("app_id", "execution_id", F.lit(None).cast("long").alias("stage_id"), "rule_id", "severity", "score", "join_path_share")
    stage = p["findings"].select("app_id", "execution_id", "stage_id", "rule_id", "severity", "score", unknown)
    run = profiled_sql_findings(p, t, j, e).where("rule_id = 'S-28'").select("app_id", "execution_id", F.lit(None).cast("long").alias("stage_id"), "rule_id", "severity", "score", unknown)
    queues = profiled_queue_findings(p, t, j, e, x, c)
    clocks = queues.select("app_id").distinct().where("app_id like '%4'").select("app_id", F.lit("DQ-02").alias("rule_id"), F.lit(1).alias("severity"), F.lit(1.0).alias("score"))
    out = rules.apply_interactions(stage.unionByName(run).unionByName(plan), queues.unionByName(clocks), busy)
    return out.withColumn("caveats", F.array_join("caveats", "; "))


_weight = lambda c: f"(CASE {c} WHEN 2 THEN 100 WHEN 1 THEN 10 ELSE 1 END)"
_has = lambda r: f"(app_id IN (SELECT app_id FROM qf WHERE rule_id = '{r}'))"
register("apply_interactions", _interactions, f"{QVIEWS} v_node", f"""WITH qf AS (SELECT * FROM ({SQL['evaluate_queue_rules']}) UNION ALL SELECT DISTINCT app_id, 'DQ-02', 1, 1.0 FROM v_exec WHERE app_id LIKE '%4'),
jq AS (SELECT p.app_id, p.execution_id, round(sum(share), 6) AS join_path_share FROM {PATHS} p JOIN (SELECT app_id, execution_id, stage_id FROM v_task GROUP BY ALL HAVING sum(shuffle_read_bytes) > 0) USING (app_id, execution_id, stage_id) WHERE execution_id % 2 = 0 GROUP BY ALL),
wt AS (SELECT app_id, execution_id FROM ({SQL['sql_queue_wait']}) WHERE wait_ratio >= 0.1 AND pool_utilization >= 0.85),
al AS (SELECT app_id, execution_id, stage_id, rule_id, severity, score, NULL::double AS join_path_share FROM ({SQL['evaluate_rules']}) UNION ALL SELECT app_id, execution_id, NULL, rule_id, severity, score, NULL FROM ({SQL['evaluate_sql_rules']}) WHERE rule_id = 'S-28'
UNION ALL SELECT f.app_id, f.execution_id, NULL, rule_id, severity, score, join_path_share FROM ({SQL['plan_rules_of_evidence']}) f LEFT JOIN jq USING (app_id, execution_id) WHERE rule_id IN ('S-17', 'S-26') UNION ALL SELECT app_id, NULL, NULL, rule_id, severity, score, NULL FROM qf),
fl AS (SELECT *, rule_id IN ('S-01', 'S-02', 'S-03', 'S-04', 'S-05', 'S-06', 'S-07', 'S-08', 'S-09', 'S-10', 'S-11', 'S-12', 'S-13') AND execution_id IS NOT NULL AND (app_id, execution_id) IN (SELECT (app_id, execution_id) FROM wt) AS queued, left(rule_id, 2) = 'S-' AND right(rule_id, 2)::int <= 13 AND {_has('Q-16')} AS storm,
  rule_id IN ('S-01', 'S-02', 'S-07', 'S-08', 'S-11') AND {_has('DQ-01')} AS part, rule_id IN ('Q-05', 'Q-12', 'Q-13') AND {_has('DQ-02')} AS clk, rule_id = 'S-17' AND coalesce(join_path_share, 0) <= 0 AS off_path FROM al),
s1 AS (SELECT *, CASE WHEN queued OR storm THEN greatest(severity - 1, 0) ELSE severity END AS a FROM fl), s2 AS (SELECT *, CASE WHEN part THEN least(a, 1) ELSE a END AS b FROM s1), s3 AS (SELECT *, CASE WHEN off_path THEN 0 WHEN clk THEN greatest(b - 1, 0) ELSE b END AS adjusted FROM s2)
SELECT app_id, execution_id, stage_id, rule_id, severity, adjusted, ((round(score * 1000000)::BIGINT * {_weight('adjusted')} * 2 + {_weight('severity')}) // ({_weight('severity')} * 2)) / 1000000.0::DOUBLE AS score, CASE WHEN clk THEN 'LOW' WHEN queued OR storm OR part THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
concat_ws('; ', CASE WHEN queued THEN 'queue' WHEN storm THEN 'storm' END, CASE WHEN part THEN 'missing events' END, CASE WHEN clk THEN 'clocks' END, CASE WHEN off_path THEN 'off the longest path' END, CASE WHEN rule_id = 'Q-05' AND {_has('Q-12')} THEN 'slow by its disks' END,
  CASE WHEN rule_id = 'S-28' AND {_has('Q-05')} THEN 'hides a slow host' END, CASE WHEN rule_id = 'Q-14' AND app_id IN (SELECT app_id FROM al WHERE rule_id = 'S-26') THEN 'rows multiply' END) AS caveats FROM s3""", written=True)


# ---- sketches ----
def _sketched(t: DataFrame) -> DataFrame:
    """Nine distributions of each application from the sketches of its stages: whether each quantile's rank is within 0.02 of its place."""
    by_stage = sketches.metric_sketches(t, ["app_id", "execution_id", "stage_id"])
    points = sketches.sketch_points(sketches.merged_sketches(by_stage, ["app_id"]), ["app_id"]).drop("n")
    return sketches.rank_errors(points, t, ["app_id"], METRICS).select("app_id", "n", (F.col("worst") <= 0.02).alias("within"))


def _sketched_baselines(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    light = _light(t, s, j, e)
    runs = sketches.baseline_sketches(light, e, _run())
    points = sketches.sketch_points(sketches.merged_sketches(runs, ["template"], ("duration",)), ["template"], ("duration",)).drop("n")
    all_ = light.where("duration_ms > 0 and not running").join(e.select(*EXEC, text.template_hash(F.col("description")).alias("template")), EXEC)
    return sketches.rank_errors(points, all_, ["template"], {"duration": "duration_ms"}).select("template", "n", (F.col("worst") <= 0.02).alias("within"))


register("sketched_distributions", _sketched, "v_task", "SELECT app_id, count(*) AS n, true AS within FROM v_task GROUP BY app_id")
register("sketched_baselines", _sketched_baselines, ALL, f"SELECT md5({TEMPLATE}) AS template, count(*) AS n, true AS within FROM v_exec WHERE end_ms > start_ms GROUP BY 1")


# ---- clusters, windows ----
def _clusters(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    p = profiled(t, s, e, names=("stage",))
    light = written(profiled_light(p, j, e), "light")
    return rules.clusters_of_evidence(rule_sets.light_signals(profile.contexts_of(p["stage"], CORES), T), p["findings"], light, queue.deep_sample(light, e, 3, 2))


register("clusters_of_evidence", _clusters, ALL, f"""{WITH_LIGHT}, dn AS (SELECT app_id, execution_id FROM light WHERE NOT running AND duration_ms > 0), dp AS (SELECT DISTINCT app_id, execution_id FROM ({SQL['deep_sample']}) JOIN dn USING (app_id, execution_id)),
nn AS (SELECT app_id, count(*) AS queries, (SELECT count(*) FROM dn WHERE dn.app_id = light.app_id) AS done, (SELECT count(*) FROM dp WHERE dp.app_id = light.app_id) AS deep FROM light GROUP BY app_id),
ev AS (SELECT app_id, execution_id, rule_id, true AS cheap FROM ({SQL['light_signals']}) JOIN dn USING (app_id, execution_id) UNION ALL SELECT app_id, execution_id, rule_id, false FROM ({SQL['evaluate_rules']}) JOIN dp USING (app_id, execution_id)),
g AS (SELECT app_id, rule_id, count(DISTINCT execution_id) AS affected, bool_or(cheap) AS cheap, bool_or(NOT cheap) AS found FROM ev GROUP BY ALL)
SELECT app_id, rule_id, affected, round(affected::double / greatest(CASE WHEN cheap THEN done ELSE deep END, 1), 6) AS share, CASE WHEN cheap AND found THEN 'FULL_QUEUE_LIGHT+DEEP_SAMPLE' WHEN cheap THEN 'FULL_QUEUE_LIGHT' ELSE 'DEEP_SAMPLE' END AS scope,
CASE WHEN cheap THEN 1.0 ELSE {_ratio('deep', 'queries')} END::double AS coverage FROM g JOIN nn USING (app_id)""", written=True)


def _windows(e: DataFrame, t: DataFrame) -> DataFrame:
    a = e.groupBy("app_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("z"))
    apps = a.select("app_id", F.when(~F.col("app_id").endswith("2"), F.col("a") - 5000).alias("start_ms"), F.when(~F.col("app_id").endswith("1"), F.col("z") + 900_000).alias("end_ms"))
    return intervals.queue_window(e, t, apps)


register("queue_window_of_apps", _windows, "v_exec v_task", """SELECT app_id, min(start_ms) - CASE WHEN app_id LIKE '%2' THEN 0 ELSE 5000 END AS window_start, greatest(max(end_ms) + CASE WHEN app_id LIKE '%1' THEN 0 ELSE 900000 END, max(start_ms), (SELECT max(finish_ms) FROM v_task t WHERE t.app_id = e.app_id)) AS window_end FROM v_exec e GROUP BY app_id""")


# ---- losses ----
register("failure_profile", losses.failure_profile, "v_task v_stage", f"""WITH n AS (SELECT app_id, reason, count(*) AS n FROM v_task WHERE failed GROUP BY ALL), a AS (SELECT app_id, {_ratio('count(*)', '(SELECT sum(num_tasks) FROM v_stage s WHERE s.app_id = v_task.app_id)')} AS amplification FROM v_task GROUP BY app_id)
SELECT app_id, reason, n, row_number() OVER (PARTITION BY app_id ORDER BY n DESC, reason) AS place, {_ratio('n', 'sum(n) OVER (PARTITION BY app_id)')} AS share, amplification FROM n JOIN a USING (app_id) QUALIFY place <= 3""")
register("host_reads", losses.host_reads, "v_task", f"""WITH x AS (SELECT app_id, host, sum(input_bytes + shuffle_read_bytes)::bigint AS read_bytes, {_ratio('sum(input_bytes + shuffle_read_bytes) * 1000.0', 'sum(run_ms)')} AS bytes_per_s FROM v_task GROUP BY ALL), m AS (SELECT app_id, quantile_cont(bytes_per_s, 0.5) AS median FROM x GROUP BY app_id)
SELECT app_id, host, read_bytes, bytes_per_s, {_ratio('bytes_per_s', 'median')} AS of_median FROM x JOIN m USING (app_id)""")
register("driver_holes", losses.driver_holes, "v_exec v_job", """WITH e AS (SELECT * FROM v_exec WHERE end_ms > start_ms), j AS (SELECT app_id, execution_id, greatest(submission_ms, start_ms) AS a, least(completion_ms, end_ms) AS z FROM v_job JOIN e USING (app_id, execution_id)),
x AS (SELECT * FROM j WHERE z > a UNION ALL SELECT app_id, execution_id, start_ms, start_ms FROM e UNION ALL SELECT app_id, execution_id, end_ms, end_ms FROM e),
y AS (SELECT *, max(z) OVER (PARTITION BY app_id, execution_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_ms FROM x) SELECT app_id, execution_id, from_ms, a AS to_ms, a - from_ms AS hole_ms FROM y WHERE a - from_ms >= 1000""")
register("restart_waste", losses.restart_waste, "v_task v_exec", f"""WITH x AS (SELECT app_id, execution_id, sum(run_ms)::bigint AS c FROM v_task GROUP BY ALL), y AS (SELECT x.*, end_ms <= 0 AS open FROM x JOIN v_exec USING (app_id, execution_id))
SELECT app_id, count(*) FILTER (open) AS interrupted, coalesce(sum(c) FILTER (open), 0)::bigint AS wasted_core_ms, {_ratio('coalesce(sum(c) FILTER (open), 0)', 'sum(c)')} AS wasted_share FROM y GROUP BY app_id""")
register("speculation_hosts", losses.speculation_hosts, "v_task", f"""WITH g AS (SELECT {K}, part_idx, bool_or(speculative) AS copied FROM v_task GROUP BY {K}, part_idx), h AS (SELECT {K}, part_idx, host FROM v_task WHERE NOT speculative QUALIFY row_number() OVER (PARTITION BY {K}, part_idx ORDER BY launch_ms, task_id) = 1),
n AS (SELECT app_id, host, count(*) AS n FROM g JOIN h USING ({K}, part_idx) WHERE copied GROUP BY ALL) SELECT app_id, sum(n)::bigint AS partitions, {_eff('n')} AS hosts, arg_max(host, n * 1000 + substr(host, 6)::int) AS worst_host, {_ratio('max(n)', 'sum(n)')} AS worst_share FROM n GROUP BY app_id""")
register("executor_loss_retries", losses.executor_loss_retries, "v_task v_executor_event", """WITH g AS (SELECT app_id, executor_id, max(time_ms) AS time_ms FROM v_executor_event WHERE NOT added GROUP BY ALL), x AS (SELECT *, launch_ms <= time_ms AND finish_ms > time_ms AS hit FROM g JOIN v_task USING (app_id, executor_id))
SELECT app_id, executor_id, time_ms, count(*) FILTER (hit) AS attempts, count(DISTINCT execution_id) FILTER (hit) AS executions, coalesce(sum(time_ms - launch_ms) FILTER (hit), 0)::bigint AS spent_ms, count(*) FILTER (failed) AS failed FROM x GROUP BY ALL""")
