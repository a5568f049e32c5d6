"""Queries of waits, consumers, configuration and history, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import features, history, queue, waits
from runlens.plans import rule_sql
from runlens.plans.queries import ALL, CONT, CORES, CUT, DONE, E, K, NORM, SQL, TEMPLATE, UTIL, WITH_LIGHT, _contention, _light, _q, _ratio, _util, register



def _run() -> Column:
    return F.regexp_extract("app_id", r"(\d+)$", 1).cast("long")


RUN_SQL = "regexp_extract(app_id, '(\\d+)$', 1)::bigint"

register("sampled_queries", lambda t, s, j, e: queue.sampled_queries(queue.deep_sample(_light(t, s, j, e), e, 3, 2)), ALL)
SQL["sampled_queries"] = SQL["deep_sample"].replace("SELECT app_id, execution_id, duration_ms, slow, spill", "SELECT app_id, execution_id, duration_ms, row_number() OVER (PARTITION BY app_id ORDER BY duration_ms DESC, execution_id) AS place FROM (SELECT app_id, execution_id, duration_ms, slow, spill") + ")"

HOLES = f"""busy AS (SELECT {E}, min(a) AS first, max(z) AS last, sum(l)::bigint AS busy FROM (SELECT {E}, g, min(launch_ms) AS a, max(finish_ms) AS z, max(finish_ms) - min(launch_ms) AS l FROM (SELECT *, sum(n) OVER (PARTITION BY {E} ORDER BY launch_ms, finish_ms, task_id) AS g FROM (
  SELECT *, CASE WHEN launch_ms > coalesce(max(finish_ms) OVER (PARTITION BY {E} ORDER BY launch_ms, finish_ms, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS n FROM v_task)) GROUP BY ALL) GROUP BY {E})"""
register("sql_queue_wait", lambda t, s, j, e: waits.sql_queue_wait(e, t, _contention(t, s, j, e), 0.1), ALL, f"""{CONT}, {HOLES}, w AS (SELECT {E}, pool_utilization, greatest(first - start_ms, 0) + greatest(last - first - busy, 0) AS wait_ms, end_ms - start_ms AS wall FROM v_exec JOIN busy USING ({E}) JOIN cont USING ({E})),
r AS (SELECT {E}, pool_utilization, wait_ms::bigint AS wait_ms, {_ratio('wait_ms', 'wall')} AS wait_ratio FROM w) SELECT *, CASE WHEN wait_ratio < 0.1 THEN 'SELF' WHEN pool_utilization >= 0.85 THEN 'SLOW_DUE_TO_QUEUE' ELSE 'SCHEDULING_ANOMALY' END AS verdict FROM r""", written=True)
register("leaders", lambda t, s, j, e: queue.leaders(_light(t, s, j, e), waits.sql_queue_wait(e, t, _contention(t, s, j, e), 0.1), 3), ALL, f"""{WITH_LIGHT}, b AS (SELECT {E}, 'slow' AS board, duration_ms AS value FROM light WHERE {DONE} UNION ALL SELECT {E}, 'costly', task_ms FROM light WHERE task_ms > 0 UNION ALL SELECT {E}, 'queued', wait_ms FROM ({SQL['sql_queue_wait']}) WHERE wait_ms > 0)
SELECT {E}, board, value::bigint AS value, row_number() OVER (PARTITION BY app_id, board ORDER BY value DESC, execution_id) AS place FROM b QUALIFY place <= 3""", written=True)
register("template_failures", lambda t, e: queue.template_failures(features.failure_classes(t), e), "v_task v_exec", f"SELECT app_id, class, template, sum(n)::bigint AS failures, count(DISTINCT execution_id) AS executions FROM (SELECT f.*, md5({TEMPLATE}) AS template FROM ({SQL['failure_classes']}) f JOIN v_exec USING ({E})) GROUP BY GROUPING SETS ((app_id, class, template), (app_id, class), (app_id))")
EB = f"eb AS (SELECT {E}, unnest(range(start_ms // 60000, (end_ms - 1) // 60000 + 1)) AS b FROM v_exec WHERE end_ms > start_ms)"
register("sql_queue_context", lambda t, e: waits.sql_queue_context(e, _util(t, e)), "v_task v_exec", f"WITH {UTIL}, {EB}, act AS (SELECT app_id, b, count(*) AS n FROM eb GROUP BY ALL) SELECT {E}, ((2 * sum((round(utilization * 1000000)::BIGINT))::BIGINT + count(*)) // (2 * count(*))) / 1000000.0::DOUBLE AS mean_busy, ((round(quantile_cont((round(utilization * 1000000)::BIGINT), 0.95) * 20)::BIGINT + 10) // 20) / 1000000.0::DOUBLE AS p95_busy, ((2 * sum((n * 1000000))::BIGINT + count(*)) // (2 * count(*))) / 1000000.0::DOUBLE AS mean_active FROM eb JOIN act USING (app_id, b) JOIN util ON util.app_id = eb.app_id AND bucket_ms = b * 60000 GROUP BY eb.app_id, execution_id".replace(f"SELECT {E}, ((2 *", "SELECT eb.app_id, execution_id, ((2 *"))
OWN = f"""c AS ({CUT}), ed AS (SELECT {E}, b, t, sum(d) AS d FROM (SELECT {E}, b, a AS t, 1 AS d FROM c UNION ALL SELECT {E}, b, z, -1 FROM c) GROUP BY ALL),
own AS (SELECT {E}, b, sum(least(n, {CORES}) * (z - t))::bigint AS core_ms FROM (SELECT *, sum(d) OVER w AS n, lead(t) OVER w AS z FROM ed WINDOW w AS (PARTITION BY {E}, b ORDER BY t)) WHERE z IS NOT NULL GROUP BY ALL)"""
register("sql_bucket_core_ms", lambda t: waits.sql_bucket_core_ms(t, CORES), "v_task", f"WITH {OWN} SELECT * FROM own")
register("top_consumers_during", lambda t, e: waits.top_consumers_during(e, waits.sql_bucket_core_ms(t, CORES)), "v_task v_exec", f"WITH {OWN}, {EB}, x AS (SELECT eb.app_id, eb.execution_id, own.execution_id AS consumer, sum(core_ms)::bigint AS core_ms FROM eb JOIN own ON own.app_id = eb.app_id AND own.b = eb.b AND own.execution_id <> eb.execution_id GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {E} ORDER BY core_ms DESC, consumer) AS place FROM x) WHERE place <= 5")
register("monopoly_windows", lambda t: waits.monopoly_windows(waits.sql_bucket_core_ms(t, CORES), CORES, 0.6, 2, 1), "v_task", f"""WITH {OWN}, n AS (SELECT app_id, b, count(*) AS active FROM own WHERE core_ms > 0 GROUP BY ALL), h AS (SELECT {E}, b, b - row_number() OVER (PARTITION BY {E} ORDER BY b) AS g FROM own JOIN n USING (app_id, b) WHERE active >= 2 AND core_ms >= 0.6 * {CORES} * 60000)
SELECT {E}, min(b) * 60000 AS start_ms, count(*)::double AS minutes FROM h GROUP BY {E}, g""")
register("systemic_windows", lambda t: waits.systemic_windows(t, 1.05, 2, 0.4), "v_task", f"""WITH x AS (SELECT *, launch_ms // 60000 AS b FROM ({NORM})), h AS (SELECT app_id, b, {_ratio('max(k)', 'sum(k)')} AS top_host_share FROM (SELECT app_id, b, host, count(*) AS k FROM x GROUP BY ALL) GROUP BY ALL),
m AS (SELECT app_id, b, round(quantile_cont(norm, 0.5), 6) AS median_norm, count(DISTINCT execution_id) AS active FROM x GROUP BY ALL) SELECT app_id, b * 60000 AS bucket_ms, median_norm, active, top_host_share FROM m JOIN h USING (app_id, b) WHERE median_norm >= 1.05 AND active >= 2 AND top_host_share <= 0.4""")
register("speculation_outcomes", waits.speculation_outcomes, "v_task", f"""WITH g AS (SELECT {K}, part_idx, count(*) FILTER (speculative) AS copies, sum(run_ms) AS total FROM v_task GROUP BY {K}, part_idx), f AS (SELECT * FROM (SELECT {K}, part_idx, speculative, run_ms, row_number() OVER (PARTITION BY {K}, part_idx ORDER BY finish_ms, task_id) AS r FROM v_task WHERE NOT failed) WHERE r = 1)
SELECT {E}, sum(copies)::bigint AS copies, count(*) FILTER (speculative) AS won, (sum(copies) - count(*) FILTER (speculative))::bigint AS lost, sum(total - coalesce(run_ms, 0))::bigint AS extra_ms FROM g LEFT JOIN f USING ({K}, part_idx) WHERE copies > 0 GROUP BY {E}""")

_conf = lambda k: f"max(value) FILTER (key = '{k}')"
register("config_check", history.config_check, "v_conf", "WITH k AS (SELECT unnest([{" + "}, {".join(f"'key': '{k}', 'advised': '{v}'" for k, v in rule_sql.CHECKLIST.items()) + "}]) AS c) SELECT a.app_id, c.key, value AS current, c.advised, coalesce(lower(value) <> lower(c.advised), true) AS issue FROM (SELECT DISTINCT app_id FROM v_conf) a CROSS JOIN k LEFT JOIN v_conf v ON v.app_id = a.app_id AND v.key = c.key")
SIZE = "CASE WHEN regexp_full_match({x}, '\\d+[kmgt]?') THEN regexp_extract({x}, '^\\d+')::bigint * CASE right({x}, 1) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN 't' THEN 1099511627776 ELSE 1 END ELSE {d} END"
_on = lambda k: f"coalesce(lower({_conf(k)}) = 'true', true)"
register("aqe_context", history.aqe_context, "v_conf", f"SELECT app_id, {_on('spark.sql.adaptive.enabled')} AS adaptive, {_on('spark.sql.adaptive.coalescePartitions.enabled')} AS coalesce_partitions, {_on('spark.sql.adaptive.skewJoin.enabled')} AS skew_join, {SIZE.format(x=_conf('spark.sql.adaptive.advisoryPartitionSizeInBytes'), d=64 << 20)} AS advisory_bytes, coalesce({_conf('spark.sql.shuffle.partitions')}::bigint, 200) AS shuffle_partitions FROM v_conf GROUP BY app_id")
register("task_memory_budget", history.task_memory_budget, "v_conf", f"WITH x AS (SELECT app_id, {SIZE.format(x=_conf('spark.executor.memory'), d=4 << 30)} AS memory_bytes, greatest(coalesce({_conf('spark.executor.cores')}::bigint, 1), 1) AS cores FROM v_conf GROUP BY app_id) SELECT *, floor(memory_bytes * 0.6::double / cores)::bigint AS task_bytes FROM x")
register("parse_size_conf", lambda c: c.where("key = 'spark.executor.memory'").select("app_id", text.size_bytes(F.col("value"), 4 << 30).alias("bytes")), "v_conf", f"SELECT app_id, {SIZE.format(x='value', d=4 << 30)} AS bytes FROM v_conf WHERE key = 'spark.executor.memory'")
register("parse_duration", lambda e: e.select("app_id", "execution_id", text.duration_ms(F.concat((F.col("execution_id") % 90).cast("string"), F.element_at(F.array(*map(F.lit, ("s", "m", "h", "ms"))), (F.col("execution_id") % 4 + 1).cast("int")))).alias("bucket_ms")), "v_exec", f"SELECT {E}, greatest((execution_id % 90) * CASE execution_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 60000 WHEN 2 THEN 3600000 ELSE 1 END, 60000)::bigint AS bucket_ms FROM v_exec")

GAP = SQL["driver_gap"][SQL["driver_gap"].index("e AS (SELECT * FROM v_exec WHERE"):].replace("\n    SELECT", "\nSELECT")
_at = GAP.rindex(f"SELECT {E}, end_ms - start_ms AS wall_ms")
GAP = GAP[:_at].rstrip() + f", gaps AS ({GAP[_at:]})"
DELAY = f"dl AS (SELECT {K}, {_q('greatest(finish_ms - launch_ms - run_ms - deser_ms, 0)', 0.5)} AS delay_p50 FROM v_task GROUP BY {K})"
register("driver_health", lambda t, e, j: history.driver_health(t, features.task_scheduler_delay(t), features.driver_gap(e, j), 0.07, 100, 0.05, 70_000, 10), "v_task v_exec v_job", f"""WITH {GAP}, {DELAY}, x AS (SELECT * FROM (SELECT app_id, {_ratio('sum(gc_ms)', 'sum(run_ms)')} AS gc_ratio, count(*) FILTER (result_size >= 70000) AS big_results FROM v_task GROUP BY app_id)
JOIN (SELECT app_id, {_q('delay_p50', 0.5)} AS delay_p50 FROM dl GROUP BY app_id) USING (app_id) JOIN (SELECT app_id, round(quantile_cont(gap_ratio, 0.5), 6) AS gap_p50 FROM gaps GROUP BY app_id) USING (app_id)) SELECT *, (gc_ratio >= 0.07)::bigint + (delay_p50 >= 100)::bigint + (gap_p50 >= 0.05)::bigint + (big_results >= 10)::bigint AS bad FROM x""")
register("memory_attribution", lambda *v: history.memory_attribution(_light(*v)), ALL, f"{WITH_LIGHT}, x AS (SELECT app_id, count(*) FILTER (spill_bytes > 0) AS affected, {_ratio('max(spill_bytes)', 'sum(spill_bytes)')} AS top_share, {_ratio('count(*) FILTER (spill_bytes > 0)', 'count(*)')} AS affected_share FROM light GROUP BY app_id) SELECT *, CASE WHEN affected = 0 THEN 'NONE' WHEN top_share >= 0.5 THEN 'SINGLE_SQL' WHEN affected_share >= 0.5 THEN 'WATERLINE' ELSE 'CONCURRENCY' END AS verdict FROM x")
register("baseline_history", lambda t, s, j, e: history.baseline_history(_light(t, s, j, e), e, _run()), ALL, f"{WITH_LIGHT} SELECT md5({TEMPLATE}) AS template, {RUN_SQL} AS run, count(*) AS samples, {_q('duration_ms', 0.5)} AS p50, min(md5(plan)) AS plan, sum(input_bytes)::bigint AS input_bytes, sum(read_bytes)::bigint AS read_bytes FROM light JOIN v_exec USING ({E}) WHERE {DONE} GROUP BY 1, 2")


def _runs(e: DataFrame) -> DataFrame:
    return e.where("end_ms > start_ms").select(F.concat(F.lit("q"), (_run() % 2).cast("string")).alias("queue"), _run().alias("run"), text.template_hash(F.col("description")).alias("template"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


REG = SQL["template_regression"]
REG = REG[REG.index("h AS (SELECT md5"):]
_at = REG.rindex("SELECT template, run, p50, round(base")
REG = REG[:_at].rstrip() + f", reg AS ({REG[_at:]})"
register("queue_drift", lambda e: history.queue_drift(_runs(e), features.template_regression(_runs(e), 1.1, 1000), 1.05, 0.3), "v_exec", f"""WITH {REG}, u AS (SELECT 'q' || ({RUN_SQL} % 2) AS queue, {RUN_SQL} AS run, {_q('end_ms - start_ms', 0.5)} AS p50 FROM v_exec WHERE end_ms > start_ms GROUP BY 1, 2),
y AS (SELECT *, floor(round(avg(p50) OVER (PARTITION BY queue ORDER BY run ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 6) + 0.5)::bigint AS base FROM u), rr AS (SELECT run, {_ratio('count(*) FILTER (regressed)', 'count(*)')} AS regressed_share FROM reg GROUP BY run),
z AS (SELECT queue, run, p50, base, coalesce(regressed_share, 0) AS regressed_share, {_ratio('p50', 'base')} AS ratio FROM y LEFT JOIN rr USING (run) WHERE base IS NOT NULL) SELECT *, CASE WHEN regressed_share >= 0.3 THEN 'SYSTEMIC' WHEN ratio >= 1.05 THEN 'INDIVIDUAL' ELSE 'NONE' END AS drift FROM z""")
STMT = r"nullif(trim(regexp_replace(regexp_extract(description, '(?s)^\s*/\*\s*(.*?)\s*\*/', 1), '\s+', ' ', 'g')), '')"
register("locate_sql", lambda e: history.locate_sql(e, e.select(F.explode(F.array(text.statement_id(F.col("description")), F.col("execution_id").cast("string"))).alias("wanted")).distinct(), text.statement_id(F.col("description"))), "v_exec", f"""WITH e AS (SELECT {E}, {STMT} AS s, CASE WHEN end_ms > 0 THEN end_ms - start_ms ELSE 0 END AS d FROM v_exec), w AS (SELECT DISTINCT s AS wanted FROM e UNION SELECT execution_id::varchar FROM e)
SELECT wanted, {E}, row_number() OVER (PARTITION BY wanted ORDER BY d DESC, app_id, execution_id) AS place FROM w JOIN e ON wanted = s OR wanted = execution_id::varchar""")
register("prefer_statement_source", lambda e: e.select("app_id", "execution_id", F.coalesce(text.statement_id(F.col("plan")), text.statement_id(F.col("description"))).alias("statement_id")), "v_exec", f"SELECT {E}, {STMT} AS statement_id FROM v_exec")
