"""Every operator over the telemetry views of the given tables, and DuckDB SQL written on its own that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import dag, features, intervals, profile, queue, rules, stages, whatif
from runlens.plans import rule_sql
from runlens.plans.fixtures import duck, view, written_views
from runlens.sources.folders import written
from runlens.streaming import buckets

Query = Callable[[SparkSession, str], DataFrame]
CORES = 4
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, make: Callable[..., DataFrame], views: str, sql: str | None = None, written: bool = False) -> None:
    """Registers make(view, ...) over the named views, with its SQL. written: the views become tables first, as many parts of the
    query look at them."""
    QUERIES[name] = lambda spark, d: make(*(written_views(spark, d, views.split()) if written else [view(spark, d, v) for v in views.split()]))
    if sql:
        SQL[name] = duck(sql)


def _r(x: str) -> str:
    return f"round({x}, 6)"


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN ({b}) > 0 THEN ({a})::double / ({b}) ELSE 0 END, 6)"


def _whole_ratio(a: str, b: str) -> str:
    """The ratio of whole numbers, rounded half up in whole numbers: six digits of a double fall to either side of a tie."""
    return f"(CASE WHEN ({b}) > 0 THEN (2000000 * ({a})::HUGEINT + ({b})) // (2 * ({b})) ELSE 0 END)::DOUBLE / 1000000"


def _q(x: str, q: float) -> str:
    return f"floor(round(quantile_cont({x}, {q}), 6) + 0.5)::bigint"


K = "app_id, execution_id, stage_id"
E = "app_id, execution_id"

# ---- distributions and stages ----
_parts = ["count(*) AS n"]
for _m, _c in stages.METRICS.items():
    _parts += [f"min({_c}) AS {_m}_min", f"max({_c}) AS {_m}_max", f"sum({_c})::bigint AS {_m}_sum"]
    _parts += [f"{_q(_c, v)} AS {_m}_{k}" for k, v in stages.POINTS.items()]
STATS = f"SELECT {K}, {', '.join(_parts)} FROM v_task GROUP BY {K}"
register("task_distributions", stages.task_distributions, "v_task", STATS)
register("skew_ratio", lambda t: stages.skew_ratio(stages.task_distributions(t)), "v_task", f"WITH s AS ({STATS}) SELECT {K}, {_ratio('run_max', 'run_p50')} AS run_skew, {_ratio('read_max', 'read_p50')} AS read_skew FROM s")
register("longest_task", stages.longest_task, "v_task", f"SELECT {K}, task_id, run_ms FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY run_ms DESC, task_id) AS r FROM v_task) WHERE r = 1")
METRICS = f"""SELECT s.app_id, s.execution_id, s.stage_id, s.completion_ms - s.submission_ms AS wall_ms, greatest(s.first_launch_ms - s.submission_ms, 0) AS delay_ms, s.num_tasks, s.failed_attempts, s.extra_attempts, t.* EXCLUDE (app_id, execution_id, stage_id),
  {_ratio('gc_sum', 'run_sum')} AS gc_ratio, {_ratio('fetch_sum', 'run_sum')} AS fetch_ratio, {_ratio('cpu_sum / 1e6', 'run_sum')} AS cpu_ratio, {_ratio('run_max', 'run_p50')} AS skew
FROM v_stage s JOIN (SELECT {K}, count(*) AS attempts, sum(run_ms)::bigint AS run_sum, {_q('run_ms', 0.5)} AS run_p50, max(run_ms) AS run_max, sum(gc_ms)::bigint AS gc_sum, sum(fetch_wait_ms)::bigint AS fetch_sum,
  sum(disk_spill_bytes)::bigint AS spill_sum, sum(cpu_ns)::bigint AS cpu_sum, sum(shuffle_read_bytes)::bigint AS read_sum, sum(shuffle_write_bytes)::bigint AS write_sum, sum(input_bytes)::bigint AS input_sum FROM v_task GROUP BY {K}) t USING ({K})"""
register("stage_metrics", stages.stage_metrics, "v_task v_stage", METRICS)
register("stages_by_duration", stages.stages_by_duration, "v_stage", f"SELECT {K}, completion_ms - submission_ms AS wall_ms, row_number() OVER (PARTITION BY {E} ORDER BY completion_ms - submission_ms DESC, stage_id) AS place FROM v_stage")
register("link_sql_stages", stages.link_sql_stages, "v_job", f"SELECT DISTINCT app_id, execution_id, unnest(stage_ids) AS stage_id FROM v_job")
register("attribute_stage_to_sql", stages.attribute_stage_to_sql, "v_job", "WITH x AS (SELECT app_id, job_id, execution_id, unnest(stage_ids) AS stage_id FROM v_job) SELECT app_id, stage_id, arg_min(execution_id, job_id) AS execution_id FROM x GROUP BY app_id, stage_id")
LIGHT = f"""SELECT e.app_id, e.execution_id, CASE WHEN e.end_ms > 0 THEN e.end_ms - e.start_ms ELSE 0 END AS duration_ms, e.end_ms <= 0 AS running, t.* EXCLUDE (app_id, execution_id), f.failed, {_ratio('t.fetch_ms', 't.task_ms')} AS fetch_ratio
FROM v_exec e LEFT JOIN (SELECT l.app_id, l.execution_id, sum(read_sum)::bigint AS read_bytes, sum(write_sum)::bigint AS write_bytes, sum(spill_sum)::bigint AS spill_bytes, sum(input_sum)::bigint AS input_bytes, sum(run_sum)::bigint AS task_ms,
    sum(fetch_sum)::bigint AS fetch_ms, sum(failed_attempts)::bigint AS failed_attempts, sum(extra_attempts)::bigint AS extra_attempts, max(skew) AS max_skew, max(gc_ratio) AS max_gc, count(*) AS n_stages
  FROM (SELECT DISTINCT app_id, execution_id, unnest(stage_ids) AS stage_id FROM v_job) l JOIN m ON m.app_id = l.app_id AND m.stage_id = l.stage_id GROUP BY l.app_id, l.execution_id) t ON t.app_id = e.app_id AND t.execution_id = e.execution_id
LEFT JOIN (SELECT {E}, bool_or(failed) AS failed FROM v_job GROUP BY {E}) f ON f.app_id = e.app_id AND f.execution_id = e.execution_id"""
WITH_LIGHT = f"WITH m AS ({METRICS}), light AS ({LIGHT})"


def _light(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    return stages.sql_light_metrics(stages.stage_metrics(t, s), j, e)


register("sql_light_metrics", _light, "v_task v_stage v_job v_exec", f"{WITH_LIGHT} SELECT * FROM light")
register("app_summary", lambda e, j, s, x: stages.app_summary(e, j, s, intervals.peak_cores(x, CORES)), "v_exec v_job v_stage v_executor_event", "WITH c AS (SELECT app_id, sum(sum(CASE WHEN added THEN cores ELSE -cores END)) OVER (PARTITION BY app_id ORDER BY time_ms) AS c FROM v_executor_event GROUP BY app_id, time_ms) SELECT app_id, count(*) AS n_sql, max(end_ms) - min(start_ms) AS duration_ms, (SELECT count(*) FROM v_job j WHERE j.app_id = e.app_id) AS n_jobs, (SELECT count(*) FROM v_stage s WHERE s.app_id = e.app_id) AS n_stages, (SELECT greatest(max(c), 4) FROM c WHERE c.app_id = e.app_id)::bigint AS cores FROM v_exec e GROUP BY app_id")

# ---- intervals ----
CORE_TL = """WITH n AS (SELECT app_id, time_ms, sum(CASE WHEN added THEN cores ELSE -cores END)::bigint AS d FROM v_executor_event GROUP BY ALL),
tl AS (SELECT app_id, time_ms AS start_ms, lead(time_ms) OVER w AS end_ms, sum(d) OVER w AS cores FROM n WINDOW w AS (PARTITION BY app_id ORDER BY time_ms))"""
register("core_timeline", intervals.core_timeline, "v_executor_event", f"{CORE_TL} SELECT app_id, start_ms, end_ms, cores::bigint AS cores FROM tl")
register("peak_cores", lambda x: intervals.peak_cores(x, CORES), "v_executor_event", f"{CORE_TL} SELECT app_id, greatest(max(cores), {CORES})::bigint AS cores FROM tl GROUP BY app_id")
CAP = f"{CORE_TL}, cap AS (SELECT e.app_id, e.execution_id, sum(CASE WHEN t.start_ms IS NULL THEN {CORES} * (e.end_ms - e.start_ms) ELSE greatest(least(e.end_ms, coalesce(t.end_ms, 1152921504606846976)) - greatest(e.start_ms, t.start_ms), 0) * cores END)::bigint AS capacity_core_ms FROM v_exec e LEFT JOIN tl t USING (app_id) WHERE e.end_ms > e.start_ms GROUP BY ALL)"
register("capacity_core_ms", intervals.capacity_core_ms, "v_exec v_executor_event", f"{CAP} SELECT * FROM cap")
register("core_utilization", intervals.core_utilization, "v_exec v_executor_event v_task", f"{CAP}, r AS (SELECT {E}, sum(run_ms)::bigint AS task_ms FROM v_task GROUP BY {E}) SELECT {E}, task_ms, capacity_core_ms, {_ratio('task_ms', 'capacity_core_ms')} AS utilization FROM cap JOIN r USING ({E})")
EDGES = "SELECT {k}, t, sum(d)::bigint AS d FROM (SELECT {k}, launch_ms AS t, 1 AS d FROM v_task WHERE finish_ms > launch_ms UNION ALL SELECT {k}, finish_ms, -1 FROM v_task WHERE finish_ms > launch_ms) GROUP BY ALL"
register("sql_max_concurrency", intervals.sql_max_concurrency, "v_task", f"WITH x AS ({EDGES.format(k=E)}), y AS (SELECT *, sum(d) OVER (PARTITION BY {E} ORDER BY t) AS n FROM x) SELECT {E}, max(n)::bigint AS max_tasks FROM y GROUP BY {E}")
register("sql_avg_concurrency", intervals.sql_avg_concurrency, "v_task v_exec", f"SELECT e.app_id, e.execution_id, {_ratio('sum(greatest(least(finish_ms, end_ms) - greatest(launch_ms, start_ms), 0))', 'any_value(end_ms - start_ms)')} AS avg_tasks FROM v_task t JOIN v_exec e USING ({E}) WHERE end_ms > start_ms GROUP BY ALL")
register("sql_own_core_ms", lambda t: intervals.sql_own_core_ms(t, CORES), "v_task", f"WITH x AS ({EDGES.format(k=E)}), y AS (SELECT *, sum(d) OVER w AS n, lead(t) OVER w AS z FROM x WINDOW w AS (PARTITION BY {E} ORDER BY t)) SELECT {E}, sum(least(n, {CORES}) * (z - t))::bigint AS own_core_ms FROM y WHERE z IS NOT NULL GROUP BY {E}")
register("queue_window", intervals.queue_window, "v_exec v_task", "SELECT app_id, min(start_ms) AS window_start, greatest(max(end_ms), (SELECT max(finish_ms) FROM v_task t WHERE t.app_id = e.app_id)) AS window_end FROM v_exec e GROUP BY app_id")
# one sweep an application, segments then cut at bucket edges: another way than the operator's
SWEEP = f"""x AS ({EDGES.format(k='app_id')}), seg AS (SELECT * FROM (SELECT app_id, t AS a, lead(t) OVER w AS z, least(sum(d) OVER w, {CORES}) AS busy FROM x WINDOW w AS (PARTITION BY app_id ORDER BY t)) WHERE z IS NOT NULL AND busy > 0),
cutseg AS (SELECT app_id, b, greatest(a, b * 60000) AS a, least(z, (b + 1) * 60000) AS z, busy FROM (SELECT *, unnest(range(a // 60000, (z - 1) // 60000 + 1)) AS b FROM seg))"""
register("occupancy_segments", lambda t: intervals.occupancy_segments(t, CORES).groupBy("app_id", "b").agg(F.sum(F.col("busy") * (F.col("end_ms") - F.col("start_ms"))).alias("core_ms"), F.max("busy").cast("long").alias("peak")), "v_task", f"WITH {SWEEP} SELECT app_id, b, sum(busy * (z - a))::bigint AS core_ms, max(busy)::bigint AS peak FROM cutseg GROUP BY ALL")
UTIL = f"""{SWEEP}, win AS (SELECT app_id, min(start_ms) AS s, greatest(max(end_ms), (SELECT max(finish_ms) FROM v_task t WHERE t.app_id = e.app_id)) AS z FROM v_exec e GROUP BY app_id),
sp AS (SELECT app_id, b, least(z, (b + 1) * 60000) - greatest(s, b * 60000) AS span FROM (SELECT *, unnest(range(s // 60000, (z - 1) // 60000 + 1)) AS b FROM win)),
util AS (SELECT app_id, b * 60000 AS bucket_ms, coalesce(busy, 0)::bigint AS busy_core_ms, {_whole_ratio('coalesce(busy, 0)', f'span * {CORES}')} AS utilization FROM sp LEFT JOIN (SELECT app_id, b, sum(busy * (z - a)) AS busy FROM cutseg GROUP BY ALL) USING (app_id, b))"""


def _util(t: DataFrame, e: DataFrame) -> DataFrame:
    return intervals.bucket_utilization(t, e, CORES)


register("bucket_utilization", _util, "v_task v_exec", f"WITH {UTIL} SELECT * FROM util")
register("hot_windows", lambda t, e: _util(t, e).where("utilization >= 0.95"), "v_task v_exec", f"WITH {UTIL} SELECT * FROM util WHERE utilization >= 0.95")
_micros = lambda c: f"(round({c} * 1000000)::BIGINT)"
_mean = lambda c: f"((2 * sum({c})::BIGINT + count(*)) // (2 * count(*))) / 1000000.0::DOUBLE"
_listed = lambda a, *c: F.array_join(F.transform(a, lambda x: F.concat_ws(":", *[f(x).cast("string") for f in c])), " ")


def points_as_text(x: DataFrame) -> DataFrame:
    """Points as `bucket:millionths`, so that all of them are compared."""
    return x.withColumn("points", _listed("points", lambda p: p["bucket_ms"], lambda p: F.round(p["utilization"] * 1_000_000).cast("long")))


register("utilization_series", lambda t, e: points_as_text(queue.utilization_series(_util(t, e))), "v_task v_exec", f"WITH {UTIL} SELECT app_id, {_mean(_micros('utilization'))} AS mean, max(utilization) AS peak, count(*) AS buckets, string_agg(bucket_ms || ':' || {_micros('utilization')}, ' ' ORDER BY bucket_ms) AS points FROM util GROUP BY app_id")
LONG = "SELECT app_id, max(n) AS n FROM (SELECT app_id, g, count(*)::double AS n FROM (SELECT app_id, bucket_ms - 60000 * row_number() OVER (PARTITION BY app_id ORDER BY bucket_ms) AS g FROM util WHERE utilization {c}) GROUP BY ALL) GROUP BY app_id"
register("longest_run_of_buckets", lambda t, e: intervals.longest_run_of_buckets(_util(t, e)), "v_task v_exec", f"WITH {UTIL} SELECT a.app_id, coalesce(i.n, 0) AS idle_minutes, coalesce(o.n, 0) AS overload_minutes FROM (SELECT DISTINCT app_id FROM util) a LEFT JOIN ({LONG.format(c='< 0.2')}) i USING (app_id) LEFT JOIN ({LONG.format(c='> 0.95')}) o USING (app_id)")
CUT = "SELECT *, greatest(launch_ms, b * 60000) AS a, least(finish_ms, (b + 1) * 60000) AS z FROM (SELECT *, unnest(range(launch_ms // 60000, (finish_ms - 1) // 60000 + 1)) AS b FROM v_task)"
_share = lambda c: f"sum(floor({c} * ((z - a)::double / (finish_ms - launch_ms)) + 0.5)::bigint)::bigint"
BUCKETS = f"""SELECT app_id, b * 60000 AS bucket_ms, {_share('(CASE WHEN run_ms > 0 THEN run_ms ELSE finish_ms - launch_ms END)')} AS run_ms, {_share('cpu_ns')} AS cpu_ns, {_share('fetch_wait_ms')} AS fetch_ms, {_share('gc_ms')} AS gc_ms,
  count(*) FILTER (a = launch_ms) AS attempts, count(*) FILTER (a = launch_ms AND failed) AS failed, count(*) FILTER (a = launch_ms AND speculative) AS speculative FROM ({CUT}) GROUP BY app_id, b"""
register("bucket_task_metrics", intervals.bucket_task_metrics, "v_task", f"WITH y AS ({BUCKETS}) SELECT *, least(1.0, {_ratio('cpu_ns / 1e6', 'run_ms')})::double AS cpu_efficiency FROM y")
register("failure_storms", lambda t: features.failure_storms(intervals.bucket_task_metrics(t)), "v_task", f"WITH y AS ({BUCKETS}) SELECT app_id, bucket_ms, attempts, failed FROM y WHERE failed >= 2 AND failed >= 0.1 * attempts")
register("stream_bucket_metrics", lambda t: buckets.stream_bucket_metrics(buckets.with_launch_time(t)), "v_task", "SELECT app_id, launch_ms // 60000 * 60000 AS bucket_ms, count(*) AS attempts, count(*) FILTER (failed) AS failed, count(*) FILTER (speculative) AS speculative, sum(run_ms)::bigint AS run_ms, sum(cpu_ns)::bigint AS cpu_ns, sum(gc_ms)::bigint AS gc_ms, sum(fetch_wait_ms)::bigint AS fetch_ms FROM v_task GROUP BY 1, 2")
register("bucket_peak_tasks", intervals.bucket_peak_tasks, "v_task", f"WITH c AS ({CUT}), x AS (SELECT app_id, b, t, sum(d) AS d FROM (SELECT app_id, b, a AS t, 1 AS d FROM c UNION ALL SELECT app_id, b, z, -1 FROM c) GROUP BY ALL), y AS (SELECT *, sum(d) OVER (PARTITION BY app_id, b ORDER BY t) AS n FROM x) SELECT app_id, b * 60000 AS bucket_ms, max(n)::bigint AS peak_tasks FROM y GROUP BY app_id, b")
CONT = f"""{WITH_LIGHT}, {SWEEP}, own AS (SELECT {E}, sum(least(n, {CORES}) * (z - t))::bigint AS own FROM (SELECT *, sum(d) OVER w AS n, lead(t) OVER w AS z FROM ({EDGES.format(k=E)}) WINDOW w AS (PARTITION BY {E} ORDER BY t)) WHERE z IS NOT NULL GROUP BY {E}),
pool AS (SELECT e.app_id, e.execution_id, sum(greatest(least(e.end_ms, g.z) - greatest(e.start_ms, g.a), 0) * busy)::bigint AS pool FROM v_exec e JOIN seg g ON g.app_id = e.app_id AND g.a < e.end_ms AND g.z > e.start_ms WHERE e.end_ms > e.start_ms GROUP BY ALL),
c0 AS (SELECT e.app_id, e.execution_id, {_ratio('coalesce(pool, 0)', f'(e.end_ms - e.start_ms) * {CORES}')} AS pool_utilization, {_ratio('coalesce(own, 0)', 'coalesce(pool, 0)')} AS own_share, coalesce(own, 0) AS own_core_ms, l.fetch_ratio, l.max_gc, l.failed_attempts, l.extra_attempts
  FROM v_exec e LEFT JOIN pool USING ({E}) LEFT JOIN own USING ({E}) LEFT JOIN light l USING ({E}) WHERE e.end_ms > e.start_ms),
cont AS (SELECT {E}, pool_utilization, own_share, own_core_ms, pool_utilization >= 0.85 AND own_share <= 0.5 AND own_core_ms > 0 AS limited, pool_utilization >= 0.85 AND coalesce(fetch_ratio >= 0.2 OR max_gc >= 0.1 OR failed_attempts > 0 OR extra_attempts > 0, false) AS inefficient FROM c0)"""


def _contention(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    return intervals.query_contention(t, e, _light(t, s, j, e), CORES)


ALL = "v_task v_stage v_job v_exec"
register("query_contention", _contention, ALL, f"{CONT} SELECT * FROM cont", written=True)
register("starvation_windows", lambda *v: _contention(*v).where("limited and own_share <= 0.2").select("app_id", "execution_id", "own_share"), ALL, f"{CONT} SELECT {E}, own_share FROM cont WHERE limited AND own_share <= 0.2")
register("top_resource_hogs", lambda *v: queue.top_resource_hogs(_contention(*v)), ALL, f"{CONT} SELECT {E}, place, own_core_ms FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY own_core_ms DESC, execution_id) AS place FROM cont) WHERE place <= 10")


def contention_as_text(x: DataFrame) -> DataFrame:
    return x.withColumns({"hogs": _listed("hogs", lambda h: h["execution_id"], lambda h: h["own_core_ms"]), "hot_windows": F.array_join(F.col("hot_windows").cast("array<string>"), " ")})


def _report(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    """The pool's segments and the contention over them are written once, as several parts of the report look at them."""
    pool = written(intervals.occupancy_segments(t, CORES), "segments")
    cont = written(intervals.query_contention(t, e, _light(t, s, j, e), CORES, segments=pool), "contention")
    return contention_as_text(queue.contention_report(cont, intervals.bucket_utilization(t, e, CORES, segments=pool), 3))


register("contention_report", _report, ALL, f"""{CONT}, {UTIL[len(SWEEP) + 2:]}, hg AS (SELECT app_id, string_agg(execution_id || ':' || own_core_ms, ' ' ORDER BY place) AS hogs FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY own_core_ms DESC, execution_id) AS place FROM cont) WHERE place <= 3 GROUP BY app_id),
hw AS (SELECT app_id, count(*) FILTER (utilization >= 0.95) AS hot_buckets, coalesce(string_agg(bucket_ms, ' ' ORDER BY bucket_ms) FILTER (utilization >= 0.95), '') AS hot_windows FROM util GROUP BY app_id)
SELECT app_id, {_ratio('count(*) FILTER (limited)', 'count(*)')} AS limited_share, {_ratio('count(*) FILTER (inefficient)', 'count(*)')} AS inefficient_share, count(*) FILTER (limited AND own_share <= 0.2) AS starved, any_value(hot_buckets) AS hot_buckets, any_value(hot_windows) AS hot_windows, any_value(hogs) AS hogs FROM cont JOIN hw USING (app_id) LEFT JOIN hg USING (app_id) GROUP BY app_id""", written=True)
_fill = ", ".join(f"coalesce({c}, 0)::bigint AS {c}" for c in "completed run_ms cpu_ns fetch_ms gc_ms attempts failed speculative".split())
register("latency_timeline", lambda t, e: intervals.latency_timeline(e, t, CORES), "v_task v_exec", f"""WITH {UTIL.replace('60000', '300000')}, y AS ({BUCKETS.replace('60000', '300000')}), d AS (SELECT app_id, start_ms // 300000 * 300000 AS bucket_ms, count(*) AS completed, quantile_disc(end_ms - start_ms, 0.5) AS p50, quantile_disc(end_ms - start_ms, 0.95) AS p95, quantile_disc(end_ms - start_ms, 0.99) AS p99 FROM v_exec WHERE end_ms > start_ms GROUP BY ALL)
SELECT app_id, bucket_ms, busy_core_ms, utilization, p50, p95, p99, {_fill}, CASE WHEN y.run_ms IS NULL THEN NULL ELSE least(1.0, {_ratio('y.cpu_ns / 1e6', 'y.run_ms')})::double END AS cpu_efficiency FROM util LEFT JOIN d USING (app_id, bucket_ms) LEFT JOIN y USING (app_id, bucket_ms)""")
_wide = "(SELECT unnest([60000, 300000, 900000])::bigint AS w)"
_zero = ", ".join(f"coalesce({c}, 0)::bigint AS {c}" for c in "submitted completed failed active bytes".split())
register("occupancy_rollup", lambda t, j, e: intervals.occupancy_rollup(t, e, j, CORES), "v_task v_job v_exec", f"""WITH {UTIL.replace('60000', '10000')}, k AS (SELECT app_id, w, bucket_ms // w * w AS b, ((2 * sum((round(utilization * 1000000)::BIGINT))::BIGINT + count(*)) // (2 * count(*))) / 1000000.0::DOUBLE AS mean, max(utilization) AS peak, {_ratio('count(*) FILTER (utilization >= 0.85)', 'count(*)')} AS busy_ratio FROM util, {_wide} GROUP BY app_id, w, bucket_ms // w * w),
su AS (SELECT app_id, w, start_ms // w * w AS b, count(*) AS submitted FROM v_exec, {_wide} GROUP BY ALL), co AS (SELECT app_id, w, (end_ms - 1) // w * w AS b, count(*) AS completed, count(*) FILTER (f) AS failed FROM v_exec LEFT JOIN (SELECT {E}, bool_or(failed) AS f FROM v_job GROUP BY {E}) USING ({E}), {_wide} WHERE end_ms > start_ms GROUP BY ALL),
rd AS (SELECT app_id, w, launch_ms // w * w AS b, sum(input_bytes + shuffle_read_bytes) AS bytes FROM v_task, {_wide} GROUP BY ALL), ac AS (SELECT k.app_id, k.w, k.b, count(*) AS active FROM k JOIN (SELECT v.app_id, start_ms, CASE WHEN end_ms > start_ms THEN end_ms ELSE win.z END AS z FROM v_exec v JOIN win USING (app_id)) e ON e.app_id = k.app_id AND e.start_ms < k.b + k.w AND e.z > k.b AND e.z > e.start_ms GROUP BY ALL)
SELECT app_id, w AS width_ms, b AS bucket_ms, mean, peak, busy_ratio, {_zero} FROM k LEFT JOIN su USING (app_id, w, b) LEFT JOIN co USING (app_id, w, b) LEFT JOIN rd USING (app_id, w, b) LEFT JOIN ac USING (app_id, w, b)""", written=True)

# ---- stage graphs and estimates ----
_path = lambda w, name: f"""WITH RECURSIVE n AS (SELECT {E}, stage_id, {w} AS w, any_value(parent_ids) AS ps FROM v_stage JOIN v_task USING ({K}) GROUP BY {K}), d AS (SELECT {E}, stage_id, w AS dist FROM n UNION ALL SELECT n.app_id, n.execution_id, n.stage_id, d.dist + n.w FROM d JOIN n ON n.app_id = d.app_id AND n.execution_id = d.execution_id AND list_contains(n.ps, d.stage_id))
SELECT {E}, max(dist)::bigint AS {name} FROM d GROUP BY {E}"""  # noqa: E731
CRIT = _path("max(run_ms)", "critical_ms")
register("critical_path_ms", dag.critical_path_ms, "v_stage v_task")
register("ideal_time_ms", lambda s, t: dag.ideal_time_ms(s, t, CORES), "v_stage v_task")
register("path_deviation", lambda s, t, e: dag.path_deviation(e, dag.critical_path_ms(s, t)), "v_stage v_task v_exec")
_body = lambda w, name: _path(w, name).replace("WITH RECURSIVE ", "WITH ")
for _name, _sql in (("critical_path_ms", _body("max(run_ms)", "critical_ms")), ("ideal_time_ms", _body(f"sum(run_ms) // {CORES}", "ideal_ms"))):
    SQL[_name] = duck(_sql).replace("WITH ", "WITH RECURSIVE ", 1)
SQL["path_deviation"] = duck(_body("max(run_ms)", "critical_ms").replace(f"SELECT {E}, max(dist)", f", cp AS (SELECT {E}, max(dist)").rstrip() + f") SELECT {E}, {_ratio('(CASE WHEN end_ms > 0 THEN end_ms - start_ms ELSE 0 END) - critical_ms', 'critical_ms')} AS deviation FROM v_exec JOIN cp USING ({E})").replace("WITH ", "WITH RECURSIVE ", 1)
register("whatif_cores", lambda t, s: whatif.whatif_cores(stages.stage_metrics(t, s), CORES), "v_task v_stage", f"""WITH m AS ({METRICS}), x AS (SELECT {E}, c AS cores, sum(greatest(run_max, floor(ceil(attempts::double / c) * run_sum / attempts + 0.5)))::bigint AS estimate_ms FROM m, (SELECT unnest([1, 2, 4, 6, 8, 16]) AS c) GROUP BY {E}, c),
y AS (SELECT *, lead(estimate_ms) OVER (PARTITION BY {E} ORDER BY cores) AS nx FROM x) SELECT {E}, cores, estimate_ms, coalesce(min(CASE WHEN (estimate_ms - nx)::double / estimate_ms < 0.05 THEN cores END) OVER (PARTITION BY {E}), 16) AS knee_cores FROM y""")
MEMORY = 1_000_000
register("whatif_partitions", lambda t: whatif.whatif_partitions(stages.task_distributions(t), CORES, MEMORY), "v_task", f"""WITH s AS (SELECT *, greatest(run_p50, 1) AS med, greatest(CASE WHEN run_p50 > 0 THEN run_max::double / run_p50 ELSE 0 END, CASE WHEN read_p50 > 0 THEN read_max::double / read_p50 ELSE 0 END) AS skew, greatest(read_sum, write_sum) AS bytes FROM ({STATS})),
o AS (SELECT {K}, n, med, bytes, unnest([0.25, 0.5, 1, 2, 4]::double[]) AS f, unnest([0, 1, 2, 3, 4]) AS place FROM s WHERE bytes > 0 AND skew < 5),
p AS (SELECT {K}, n, med, bytes, greatest(floor(n * f + 0.5), 1)::bigint AS p, place FROM o UNION ALL SELECT DISTINCT {K}, n, med, bytes, k * {CORES}, 4 + k FROM o, (SELECT unnest([1, 2, 4]) AS k)),
c AS (SELECT *, floor(ceil(p::double / {CORES}) * (0.2 * med + (bytes::double / p) / ((bytes::double / n) / (0.8 * med)) + 2 * greatest(bytes::double / p - {MEMORY}, 0) / ((bytes::double / n) / (0.8 * med))) + 0.5)::bigint AS ms FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ms, place) AS k, min(CASE WHEN p = n THEN ms END) OVER (PARTITION BY {K}) AS now_ms FROM c)
SELECT {K}, n AS partitions, p AS best_partitions, ms AS best_ms, now_ms, CASE WHEN p > n THEN 'FASTER_IF_INCREASED' WHEN p < n THEN 'FASTER_IF_DECREASED' ELSE 'ALREADY_OPTIMAL' END AS direction FROM r WHERE k = 1
UNION ALL SELECT {K}, n, NULL, NULL, NULL, CASE WHEN skew >= 5 THEN 'SKEW_LIMITED' ELSE 'ALREADY_OPTIMAL' END FROM s WHERE NOT (bytes > 0 AND skew < 5)""")

# ---- texts ----
TEMPLATE = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '''(?:[^'']|'''')*''', '?', 'g'), '\b\d+\b', '?', 'g'), '\s+', ' ', 'g')))"
register("extract_statement_id", lambda e: e.select("app_id", "execution_id", text.statement_id(F.col("description")).alias("statement_id")), "v_exec", rf"SELECT {E}, nullif(trim(regexp_replace(regexp_extract(description, '(?s)^\s*/\*\s*(.*?)\s*\*/', 1), '\s+', ' ', 'g')), '') AS statement_id FROM v_exec")
register("sql_template_hash", lambda e: e.select("app_id", "execution_id", text.template_hash(F.col("description")).alias("template")), "v_exec", f"SELECT {E}, md5({TEMPLATE}) AS template FROM v_exec")
register("redact_text", lambda e: e.select("app_id", "execution_id", text.redact(F.concat(F.lit("hdfs://nn:8020/x?token=abc, "), "description")).alias("masked")), "v_exec", f"SELECT {E}, 'hdfs://***/x?token=***, ' || description AS masked FROM v_exec")
register("plan_features", lambda e: e.select("app_id", "execution_id", *[c.alias(n) for n, c in text.plan_features(F.col("plan")).items()]), "v_exec", rf"SELECT {E}, contains(plan, 'SortMergeJoin') AS sort_merge_join, contains(plan, 'ShuffledHashJoin') AS shuffled_hash_join, contains(plan, 'CartesianProduct') AS cartesian, contains(plan, 'BroadcastHashJoin') AS broadcast_join, contains(plan, 'BroadcastNestedLoopJoin') AS nested_loop, contains(plan, 'PartitionFilters: []') AS empty_partition_filters, contains(plan, 'AdaptiveSparkPlan') AS adaptive, NOT regexp_matches(plan, '\*\(\d+\)|codegen id :|\* \w') AS codegen_gap FROM v_exec")
register("plan_shape", lambda e: e.select("app_id", "execution_id", text.plan_shape(F.col("plan")).alias("shape")), "v_exec", f"SELECT {E}, array_to_string(list_filter([CASE WHEN contains(plan, 'Broadcast') THEN 'broadcast' END, CASE WHEN contains(plan, 'SortMergeJoin') THEN 'sort-merge join' END, CASE WHEN contains(plan, 'Exchange') THEN 'exchange' END, CASE WHEN contains(plan, 'Aggregate') THEN 'aggregate' END, CASE WHEN contains(plan || ' ', 'Sort ') THEN 'sort' END], lambda x: x IS NOT NULL), ', ') AS shape FROM v_exec")
register("slowest_sql", lambda e: e.where("end_ms > start_ms").groupBy("app_id").agg(F.max_by("execution_id", F.struct(F.col("end_ms") - F.col("start_ms"), -F.col("execution_id"))).alias("execution_id")), "v_exec", "SELECT app_id, execution_id FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY end_ms - start_ms DESC, execution_id) AS r FROM v_exec WHERE end_ms > start_ms) WHERE r = 1")

# ---- samples and roll-ups ----
DONE = "NOT running AND duration_ms > 0"
_stratum = lambda c, n: f"coalesce({c}, false) AND row_number() OVER (PARTITION BY app_id, coalesce({c}, false) ORDER BY duration_ms DESC, execution_id) <= {n}"
register("deep_sample", lambda t, s, j, e: queue.deep_sample(_light(t, s, j, e), e, 3, 2), ALL, f"""{WITH_LIGHT}, x AS (SELECT l.*, md5({TEMPLATE}) AS template FROM light l JOIN v_exec USING ({E}) WHERE {DONE}),
y AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY duration_ms DESC, execution_id) <= 3 AS slow, {_stratum('spill_bytes > 0', 2)} AS spill, {_stratum('fetch_ratio >= 0.2', 2)} AS "fetch", {_stratum('max_gc >= 0.1', 2)} AS gc, {_stratum('max_skew >= 5', 2)} AS skew, row_number() OVER (PARTITION BY app_id, template ORDER BY duration_ms DESC, execution_id) = 1 AS tf FROM x),
z AS (SELECT *, tf AND row_number() OVER (PARTITION BY app_id, tf ORDER BY duration_ms DESC, execution_id) <= 2 AS template_first FROM y) SELECT {E}, duration_ms, slow, spill, "fetch", gc, skew, template_first FROM z WHERE slow OR spill OR "fetch" OR gc OR skew OR template_first""")


def _slow(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    light, pool = written(_light(t, s, j, e), "light"), written(intervals.occupancy_segments(t, CORES), "segments")
    return queue.top_slow_queries(light, intervals.query_contention(t, e, light, CORES, segments=pool))


register("top_slow_queries", _slow, ALL, f"{CONT} SELECT {E}, place, duration_ms, pool_utilization, own_share, limited, inefficient FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY duration_ms DESC, execution_id) AS place FROM light WHERE {DONE}) LEFT JOIN cont USING ({E}) WHERE place <= 5", written=True)
register("template_stats", lambda t, s, j, e: queue.template_stats(_light(t, s, j, e), e, intervals.sql_own_core_ms(t, CORES)), ALL, f"{CONT}, ts AS (SELECT app_id, md5({TEMPLATE}) AS template, count(*) AS queries, sum(duration_ms)::bigint AS duration_ms, sum(coalesce(own, task_ms))::bigint AS core_ms, sum(input_bytes)::bigint AS input_bytes, sum(read_bytes)::bigint AS read_bytes FROM light JOIN v_exec USING ({E}) LEFT JOIN own USING ({E}) WHERE {DONE} GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY core_ms DESC, duration_ms DESC, template) AS place FROM ts) WHERE place <= 20")
register("dominant_shuffle_stage", lambda t, s: queue.dominant_shuffle_stage(stages.stage_metrics(t, s)), "v_task v_stage", f"WITH m AS ({METRICS}) SELECT {E}, stage_id, greatest(read_sum, write_sum) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY {E} ORDER BY greatest(read_sum, write_sum) DESC, stage_id) AS r FROM m) WHERE r = 1")
register("queue_summary", lambda t, s, j, e, x: queue.queue_summary(_light(t, s, j, e), intervals.queue_window(e, t), intervals.peak_cores(x, CORES)), f"{ALL} v_executor_event", f"{WITH_LIGHT}, win AS (SELECT app_id, min(start_ms) AS window_start, greatest(max(end_ms), (SELECT max(finish_ms) FROM v_task t WHERE t.app_id = e.app_id)) AS window_end FROM v_exec e GROUP BY app_id), {CORE_TL[5:]} SELECT app_id, count(*) AS queries, count(*) FILTER ({DONE}) AS completed, count(*) FILTER (running) AS running, count(*) FILTER (failed) AS failed, any_value(window_start) AS window_start, any_value(window_end) AS window_end, (SELECT greatest(max(cores), {CORES}) FROM tl WHERE tl.app_id = light.app_id)::bigint AS cores FROM light JOIN win USING (app_id) GROUP BY app_id")


def _resources(t: DataFrame, s: DataFrame, j: DataFrame, e: DataFrame) -> DataFrame:
    u = profile.utilization_of(intervals.queue_window(e, t), profile.bucket_profile(t, CORES), CORES)
    return queue.resource_metrics(_light(t, s, j, e), profile.bucket_means(u))


_failed = _ratio('sum(failed_attempts)', 'sum(failed_attempts + extra_attempts + greatest(1, n_stages))')
register("resource_metrics", _resources, ALL, f"""{WITH_LIGHT}, {UTIL}, y AS ({BUCKETS}), rx AS (SELECT *, floor(coalesce(max_gc, 0) * 10000 + 0.5)::bigint AS bp FROM light),
bm AS (SELECT app_id, utilization, least(1.0, {_ratio('cpu_ns / 1e6', 'run_ms')}) AS ce, {_ratio('y.fetch_ms', 'y.run_ms')} AS fs, {_ratio('y.gc_ms', 'y.run_ms')} AS gs FROM util LEFT JOIN y USING (app_id, bucket_ms)),
me AS (SELECT app_id, {_mean(_micros('utilization'))} AS mean_utilization, {_mean(_micros('ce'))} AS mean_cpu_efficiency, {_mean(_micros('fs'))} AS mean_fetch_share, {_mean(_micros('gs'))} AS mean_gc_share FROM bm GROUP BY app_id)
SELECT app_id, sum(spill_bytes)::bigint AS spill_bytes, {_mean('bp * 1000000')} AS gc_mean_bp, quantile_disc(bp, 0.95) AS gc_p95_bp, max(bp) AS gc_max_bp, {_failed} AS failed_ratio, {_failed.replace('sum(failed_attempts))', 'sum(extra_attempts))', 1)} AS extra_ratio, any_value(mean_utilization) AS mean_utilization, any_value(mean_cpu_efficiency) AS mean_cpu_efficiency, any_value(mean_fetch_share) AS mean_fetch_share, any_value(mean_gc_share) AS mean_gc_share
FROM rx LEFT JOIN me USING (app_id) GROUP BY app_id""", written=True)
register("throughput_leaderboards", lambda t, s, j, e: queue.throughput_leaderboards(_light(t, s, j, e), e), ALL, f"{WITH_LIGHT}, x AS (SELECT l.*, start_ms // 3600000 * 3600000 AS hour_ms FROM light l JOIN v_exec USING ({E})) SELECT app_id, hour_ms, count(*) AS submitted, count(*) FILTER ({DONE}) AS completed, count(*) FILTER (failed) AS failed, {_ratio(f'count(*) FILTER ({DONE} AND failed IS NOT TRUE)', f'count(*) FILTER ({DONE})')} AS success_rate FROM x GROUP BY GROUPING SETS ((app_id, hour_ms), (app_id))")

# ---- features ----
register("task_scheduler_delay", features.task_scheduler_delay, "v_task", f"WITH x AS (SELECT *, greatest(finish_ms - launch_ms - run_ms - deser_ms, 0) AS delay FROM v_task) SELECT {K}, {_q('delay', 0.5)} AS delay_p50, sum(delay)::bigint AS delay_sum FROM x GROUP BY {K}")
register("driver_gap", features.driver_gap, "v_exec v_job", f"""WITH e AS (SELECT * FROM v_exec WHERE end_ms > start_ms), j AS (SELECT e.app_id, e.execution_id, greatest(submission_ms, start_ms) AS a, least(completion_ms, end_ms) AS z FROM v_job JOIN e USING ({E}) WHERE least(completion_ms, end_ms) > greatest(submission_ms, start_ms)),
i AS (SELECT *, sum(n) OVER (PARTITION BY {E} ORDER BY a, z) AS g FROM (SELECT *, CASE WHEN a > coalesce(max(z) OVER (PARTITION BY {E} ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS n FROM j)), u AS (SELECT {E}, sum(l)::bigint AS covered FROM (SELECT {E}, g, max(z) - min(a) AS l FROM i GROUP BY ALL) GROUP BY {E})
SELECT {E}, end_ms - start_ms AS wall_ms, (end_ms - start_ms - coalesce(covered, 0))::bigint AS gap_ms, {_ratio('end_ms - start_ms - coalesce(covered, 0)', 'end_ms - start_ms')} AS gap_ratio FROM e LEFT JOIN u USING ({E})""")
register("job_fragmentation", features.job_fragmentation, "v_job", f"SELECT {E}, count(*) AS jobs, {_q('completion_ms - submission_ms', 0.5)} AS job_p50 FROM v_job GROUP BY {E}")
register("cpu_profile", features.cpu_profile, "v_task", f"WITH x AS (SELECT {K}, {_ratio('sum(cpu_ns) / 1e6', 'sum(run_ms)')} AS cpu_ratio FROM v_task GROUP BY {K}) SELECT *, CASE WHEN cpu_ratio >= 0.7 THEN 'CPU' WHEN cpu_ratio <= 0.3 THEN 'IO' ELSE 'MIXED' END AS label FROM x")
_n = lambda v: f"count(*) FILTER (locality = '{v}')"
register("locality_mix", features.locality_mix, "v_task", f"SELECT {K}, {', '.join(f'{_n(v)} AS {v.lower()}' for v in ('PROCESS_LOCAL', 'NODE_LOCAL', 'RACK_LOCAL'))}, {_n('ANY')} AS \"any\", {_ratio(_n('ANY') + ' + ' + _n('RACK_LOCAL'), 'count(*)')} AS bad_ratio FROM v_task GROUP BY {K}")
register("shuffle_write_throughput", features.shuffle_write_throughput, "v_task", f"SELECT app_id, stage_id, host, sum(shuffle_write_bytes)::bigint AS bytes, {_ratio('sum(shuffle_write_bytes) * 1000.0', 'sum(shuffle_write_ms)')} AS bytes_per_s, {_ratio('max(shuffle_write_bytes)', 'sum(shuffle_write_bytes)')} AS task_share FROM v_task GROUP BY GROUPING SETS ((app_id, stage_id), (app_id, host))")
register("result_pressure", features.result_pressure, "v_task", f"SELECT {K}, sum(result_size)::bigint AS result_sum, max(result_size) AS result_max, {_q('deser_ms', 0.95)} AS deser_p95 FROM v_task GROUP BY {K}")
register("failure_classes", features.failure_classes, "v_task", f"SELECT {E}, CASE WHEN reason LIKE '%OutOfMemory%' THEN 'OOM' WHEN reason LIKE '%FetchFailed%' THEN 'FETCH_FAILED' WHEN reason LIKE '%ExecutorLost%' THEN 'EXECUTOR_LOST' WHEN reason LIKE '%GSS%' THEN 'AUTH' ELSE 'EXCEPTION' END AS class, count(*) AS n FROM v_task WHERE failed GROUP BY ALL")
NORM = f"SELECT t.*, {_ratio('t.run_ms', 'greatest(med, 1)')} AS norm FROM v_task t JOIN (SELECT {K}, {_q('run_ms', 0.5)} AS med FROM v_task GROUP BY {K}) USING ({K})"
register("normalised_task_time", lambda t: features.normalised_task_time(t).select("app_id", "task_id", "norm"), "v_task", f"WITH x AS ({NORM}) SELECT app_id, task_id, norm FROM x")
register("host_score", features.host_score, "v_task", f"WITH x AS ({NORM}), y AS (SELECT app_id, host, ((round(quantile_cont((round(norm * 1000000)::BIGINT), 0.5) * 20)::BIGINT + 10) // 20) / 1000000.0::DOUBLE AS score, count(*) AS tasks, count(DISTINCT stage_id) AS stages FROM x GROUP BY ALL) SELECT *, score >= 1.5 AND tasks >= 20 AND stages >= 3 AS outlier FROM y")
register("host_io", features.host_io, "v_task", f"WITH x AS (SELECT app_id, host, count(*) AS tasks, {_ratio('sum(shuffle_write_bytes) * 1000.0', 'sum(shuffle_write_ms)')} AS bytes_per_s, sum(disk_spill_bytes) AS spill FROM v_task GROUP BY ALL), m AS (SELECT app_id, quantile_cont(bytes_per_s, 0.5) AS median, sum(spill) AS total FROM x GROUP BY app_id) SELECT app_id, host, tasks, bytes_per_s, {_ratio('bytes_per_s', 'median')} AS of_median, {_ratio('spill', 'total')} AS spill_share FROM x JOIN m USING (app_id)")
register("fetch_matrix", features.fetch_matrix, "v_task", "SELECT app_id, src_host, host, count(*) AS failures, sum(fetch_wait_ms)::bigint AS wait_ms FROM v_task WHERE src_host IS NOT NULL GROUP BY GROUPING SETS ((app_id, src_host, host), (app_id, src_host), (app_id))")
register("executor_loss_impact", features.executor_loss_impact, "v_executor_event v_exec", "SELECT g.app_id, g.executor_id, e.execution_id, g.time_ms FROM v_executor_event g JOIN v_exec e ON e.app_id = g.app_id AND e.start_ms <= g.time_ms AND (e.end_ms > g.time_ms OR e.end_ms <= 0) WHERE NOT g.added")
register("partial_stages", features.partial_stages, "v_task v_stage", f"SELECT {K}, num_tasks, coalesce(done, 0) AS done FROM v_stage LEFT JOIN (SELECT {K}, count(*) AS done FROM v_task WHERE NOT failed GROUP BY {K}) USING ({K}) WHERE coalesce(done, 0) < num_tasks")
register("clock_consistency", features.clock_consistency, "v_task", f"SELECT app_id, host, count(*) FILTER (finish_ms < launch_ms) AS negative, {_q('deser_ms', 0.5)} AS deser_p50, min(launch_ms) AS first_ms FROM v_task GROUP BY ALL")
register("restart_impact", features.restart_impact, "v_exec", "WITH a AS (SELECT app_id, max(greatest(end_ms, start_ms)) AS z FROM v_exec GROUP BY app_id) SELECT app_id, count(*) FILTER (end_ms <= 0) AS interrupted, count(*) FILTER (start_ms >= z - 1800000) AS tail_submissions FROM v_exec JOIN a USING (app_id) GROUP BY app_id")


def _history(e: DataFrame) -> DataFrame:
    run = F.regexp_extract("app_id", r"(\d+)$", 1).cast("long")
    return e.where("end_ms > start_ms").select(text.template_hash(F.col("description")).alias("template"), run.alias("run"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


register("template_regression", lambda e: features.template_regression(_history(e), 1.1, 1000), "v_exec", f"""WITH h AS (SELECT md5({TEMPLATE}) AS template, regexp_extract(app_id, '(\\d+)$', 1)::bigint AS run, end_ms - start_ms AS d FROM v_exec WHERE end_ms > start_ms), p AS (SELECT template, run, count(*) AS n, {_q('d', 0.5)} AS p50 FROM h GROUP BY ALL),
x AS (SELECT *, sum(p50 * n) OVER w / sum(n) OVER w AS base, count(*) OVER w AS seen FROM p WINDOW w AS (PARTITION BY template ORDER BY run ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) SELECT template, run, p50, round(base, 6) AS base, seen, p50 >= greatest(base * 1.1, base + 1000) AS regressed FROM x WHERE seen >= 3""")

# ---- rules ----
CTX = f"""WITH m AS ({METRICS}), st AS ({STATS}), dl AS (SELECT {K}, {_q('greatest(finish_ms - launch_ms - run_ms - deser_ms, 0)', 0.5)} AS delay_p50, sum(greatest(finish_ms - launch_ms - run_ms - deser_ms, 0)) AS delay_sum, sum(result_size) AS result_sum, max(result_size) AS result_max, sum(shuffle_write_ms) AS write_ms, {_ratio('max(shuffle_write_bytes)', 'sum(shuffle_write_bytes)')} AS write_max_share, {_ratio(_n('ANY') + ' + ' + _n('RACK_LOCAL'), 'count(*)')} AS bad_ratio FROM v_task GROUP BY {K}),
ctx AS (SELECT st.*, m.fetch_sum, m.cpu_ratio, m.wall_ms, m.delay_ms, m.failed_attempts, m.extra_attempts, dl.* EXCLUDE (app_id, execution_id, stage_id), {CORES} AS cores FROM st JOIN m USING ({K}) JOIN dl USING ({K}))"""
FIND = f"{CTX}, found AS ({rule_sql.found(rule_sql.STAGE, 'ctx', K)})"


def findings(t: DataFrame, s: DataFrame) -> DataFrame:
    return rules.evaluate_rules(rules.stage_contexts(t, s, CORES), rules.STAGE_RULES, rules.FIXTURE, stages.STAGE)


register("evaluate_rules", findings, "v_task v_stage", f"{FIND} SELECT * FROM found")
register("rank_findings", lambda t, s: rules.rank_findings(findings(t, s)), "v_task v_stage", f"{FIND} SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY score DESC, severity DESC, rule_id, stage_id) AS place FROM found")
register("dominant_bottleneck", lambda t, s, e: rules.dominant_bottleneck(findings(t, s), e), "v_task v_stage v_exec", f"{FIND} SELECT e.app_id, e.execution_id, coalesce(rule_id, 'none') AS rule_id FROM v_exec e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {E} ORDER BY score DESC, severity DESC, rule_id, stage_id) AS r FROM found) f ON f.app_id = e.app_id AND f.execution_id = e.execution_id AND r = 1")
register("bottleneck_clusters", lambda t, s, e: rules.bottleneck_clusters(findings(t, s), e), "v_task v_stage v_exec", f"{FIND} SELECT app_id, rule_id, count(DISTINCT execution_id) AS affected, {_ratio('count(DISTINCT execution_id)', '(SELECT count(*) FROM v_exec e WHERE e.app_id = found.app_id)')} AS share FROM found GROUP BY app_id, rule_id")
register("rule_interactions", lambda t, s: rules.rule_interactions(findings(t, s), features.partial_stages(t, s).select("app_id").distinct(), features.failure_storms(intervals.bucket_task_metrics(t)).select("app_id").distinct()), "v_task v_stage", f"""{FIND}, y AS ({BUCKETS}), storm AS (SELECT DISTINCT app_id FROM y WHERE failed >= 2 AND failed >= 0.1 * attempts), part AS (SELECT DISTINCT app_id FROM v_stage LEFT JOIN (SELECT {K}, count(*) AS done FROM v_task WHERE NOT failed GROUP BY {K}) USING ({K}) WHERE coalesce(done, 0) < num_tasks),
a AS (SELECT *, CASE WHEN app_id IN (SELECT app_id FROM storm) AND substr(rule_id, 3)::int BETWEEN 1 AND 13 THEN greatest(severity - 1, 0) ELSE severity END AS s1 FROM found) SELECT {K}, rule_id, severity, score, CASE WHEN app_id IN (SELECT app_id FROM part) AND rule_id IN ('S-01', 'S-02', 'S-07', 'S-08', 'S-11') THEN least(s1, 1) ELSE s1 END AS adjusted FROM a""")
