"""Telemetry views over the given tables: one text for both SQL dialects (`//` is Spark's `div`)."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.folders import written

BASE = 1704067200000  # fixed value: the first millisecond of the fixture applications

V_TASK = f"""
SELECT {{app}} AS app_id, {{execution}} AS execution_id, e * 10 + si AS stage_id, si AS stage_idx,
  task_id, concat('exec-', cast(sk % 3 as {{string}})) AS executor_id, concat('host-', cast(sk % 8 as {{string}})) AS host,
  run_ms, launch_ms, launch_ms + run_ms + 100 + (sk % 10) * 20 AS finish_ms,
  run_ms * 1000000 * (20 + sk % 70) // 100 AS cpu_ns, run_ms * (ln % 4) // 20 AS gc_ms,
  CASE WHEN si = 2 THEN run_ms * (sk % 5) // 10 ELSE 0 END AS fetch_wait_ms, (sk % 10) * 10 AS deser_ms,
  CASE WHEN si = 2 THEN cents * (CASE WHEN pk % 41 = 0 THEN 50 ELSE 1 END) ELSE 0 END AS shuffle_read_bytes,
  write_bytes AS shuffle_write_bytes, CASE WHEN si < 2 THEN cents ELSE 0 END AS input_bytes,
  CASE WHEN pk % 11 = 0 THEN cents // 4 ELSE 0 END AS disk_spill_bytes, CASE WHEN pk % 11 = 0 THEN cents ELSE 0 END AS memory_spill_bytes,
  CASE WHEN si = 2 THEN cents // 3 ELSE 0 END AS output_bytes,
  (flag = 'R' AND pk % 10 = 0) AS failed, pk % 50 = 1 AS speculative,
  write_bytes // (1000 + 9000 * (sk % 3)) AS shuffle_write_ms, 1000 + pk * 37 AS result_size,
  CASE WHEN NOT (flag = 'R' AND pk % 10 = 0) THEN 'Success' WHEN sk % 4 = 0 THEN 'OutOfMemoryError' WHEN sk % 4 = 1 THEN 'FetchFailed'
    WHEN sk % 4 = 2 THEN 'ExecutorLostFailure' ELSE 'GSS token expired' END AS reason,
  CASE WHEN flag = 'R' AND pk % 10 = 0 AND sk % 4 = 1 THEN concat('host-', cast(pk % 8 as {{string}})) END AS src_host,
  ok % 10 AS part_idx, CASE ln % 4 WHEN 0 THEN 'ANY' WHEN 1 THEN 'NODE_LOCAL' WHEN 2 THEN 'PROCESS_LOCAL' ELSE 'RACK_LOCAL' END AS locality
FROM (
  SELECT *, task_id // 100 AS ok, {BASE} + ((e * 787) % 3600) * 1000 + si * 120000 + (pk % 100) * 1000 AS launch_ms,
    CASE WHEN si < 2 THEN cents // 2 ELSE 0 END AS write_bytes
  FROM (
    SELECT {{dealt}}ok // 25 AS e, (rn - 1) % 3 AS si, ok * 100 + rn AS task_id, sk, pk, ln, flag, cents,
      qty * 400 * (CASE WHEN pk % 37 = 0 THEN 10 ELSE 1 END) AS run_ms
    FROM (
      SELECT {{dealt}}cast(l_orderkey as bigint) AS ok, cast(l_partkey as bigint) AS pk, cast(l_suppkey as bigint) AS sk, cast(l_linenumber as bigint) AS ln,
        l_returnflag AS flag, cast(l_quantity as bigint) AS qty, cast(floor(l_extendedprice * 100 + 0.5) as bigint) AS cents,
        cast(row_number() OVER (PARTITION BY l_orderkey{{by}} ORDER BY {{order}}) as bigint) AS rn
      FROM lineitem
    ) a
  ) b
) c
"""

V_STAGE = """
SELECT app_id, execution_id, stage_id, stage_idx, min(launch_ms) - 500 AS submission_ms, min(launch_ms) AS first_launch_ms, max(finish_ms) AS completion_ms,
  count(CASE WHEN NOT failed AND NOT speculative THEN 1 END) AS num_tasks, count(CASE WHEN failed THEN 1 END) AS failed_attempts,
  count(*) - count(CASE WHEN NOT failed AND NOT speculative THEN 1 END) AS extra_attempts,
  CASE WHEN stage_idx = 2 THEN {array}(execution_id * 10, execution_id * 10 + 1) ELSE {empty} END AS parent_ids
FROM v_task GROUP BY app_id, execution_id, stage_id, stage_idx
"""

V_JOB = """
SELECT app_id, execution_id, execution_id * 2 + k AS job_id, min(launch_ms) - 1000 AS submission_ms, max(finish_ms) AS completion_ms,
  k = 1 AND execution_id % 11 = 0 AS failed, {array}(execution_id * 10 + k, execution_id * 10 + k + 1) AS stage_ids
FROM v_task, (SELECT cast(0 as bigint) AS k UNION ALL SELECT cast(1 as bigint)) j
WHERE stage_idx = k OR stage_idx = k + 1
GROUP BY app_id, execution_id, k
"""

V_EXEC = f"""
SELECT app_id, execution_id, {BASE} + ((execution_id * 787) % 3600) * 1000 AS start_ms,
  CASE WHEN execution_id % 29 = 0 THEN 0 ELSE max(finish_ms) + (execution_id % 7) * 1000 END AS end_ms,
  concat('/* stmt ', cast(execution_id % 40 as {{string}}), ' */ select * from t', cast(execution_id % 12 as {{string}}), ' where id = ', cast(execution_id as {{string}})) AS description,
  CASE execution_id % 6 WHEN 0 THEN 'SortMergeJoin' WHEN 1 THEN 'BroadcastHashJoin' WHEN 2 THEN 'CartesianProduct' WHEN 3 THEN 'BroadcastNestedLoopJoin'
    WHEN 4 THEN 'PartitionFilters: [] AdaptiveSparkPlan' ELSE 'HashAggregate Sort' END AS plan
FROM v_task GROUP BY app_id, execution_id
"""

V_EXECUTOR_EVENT = f"""
SELECT app_id, concat('exec-', cast(k as {{string}})) AS executor_id, {BASE} + k * 60000 AS time_ms, cast(2 as bigint) AS cores, true AS added
FROM (SELECT DISTINCT app_id FROM v_task) a, (SELECT cast(0 as bigint) AS k UNION ALL SELECT cast(1 as bigint) UNION ALL SELECT cast(2 as bigint)) j
UNION ALL
SELECT DISTINCT app_id, 'exec-2', cast({BASE} + 1800000 as bigint), cast(2 as bigint), false FROM v_task
"""

#: What applications are configured with; those whose number is a multiple of 3 differ.
V_CONF = """
SELECT app_id, key, CASE WHEN cast(substr(app_id, 5) as bigint) % 3 = 0 THEN other ELSE value END AS value
FROM (SELECT DISTINCT app_id FROM v_task) a, (
  SELECT 'spark.executor.cores' AS key, '2' AS value, '4' AS other UNION ALL SELECT 'spark.executor.memory', '4g', '512m' UNION ALL SELECT 'spark.executor.instances', '2', '2'
  UNION ALL SELECT 'spark.sql.adaptive.enabled', 'true', 'false' UNION ALL SELECT 'spark.scheduler.mode', 'FIFO', 'FAIR' UNION ALL SELECT 'spark.eventLog.rolling.enabled', 'TRUE', 'false'
  UNION ALL SELECT 'spark.sql.adaptive.advisoryPartitionSizeInBytes', '128m', 'x' UNION ALL SELECT 'runlens.threshold.skew.ratio', '6', '7') c
"""

#: Measurements of plan nodes, k numbering a plan's metrics; the join's rows are counted by its tasks, all others by the driver.
V_NODE = """
SELECT app_id, execution_id, k, node, metric, CASE k WHEN 1 THEN (e % 7) * 500 WHEN 2 THEN (e % 7) * 500 * (e % 3 + 1) * 4194304 WHEN 3 THEN (e % 11) * 16777216
  WHEN 4 THEN (e % 13) * 67108864 WHEN 6 THEN 1 + (e % 5) * 40000 WHEN 7 THEN (e % 6) * 200 ELSE (e % 6) * 200 * (e % 4) * 8388608 END AS total
FROM (SELECT app_id, execution_id, execution_id AS e FROM v_exec) x, (
  SELECT cast(1 as bigint) AS k, 'Scan parquet' AS node, 'number of files read' AS metric UNION ALL SELECT 2, 'Scan parquet', 'size of files read' UNION ALL SELECT 6, 'Scan parquet', 'number of output rows'
  UNION ALL SELECT 3, 'Exchange', 'data size' UNION ALL SELECT 4, 'BroadcastExchange', 'data size'
  UNION ALL SELECT 7, 'Execute InsertIntoHadoopFsRelationCommand', 'number of written files' UNION ALL SELECT 8, 'Execute InsertIntoHadoopFsRelationCommand', 'written output') m
UNION ALL
SELECT app_id, execution_id, 5, 'SortMergeJoin', 'number of output rows', cast(sum(run_ms) as bigint) FROM v_task GROUP BY app_id, execution_id
"""

VIEWS = {"v_task": V_TASK, "v_stage": V_STAGE, "v_job": V_JOB, "v_exec": V_EXEC, "v_executor_event": V_EXECUTOR_EVENT, "v_conf": V_CONF, "v_node": V_NODE}
#: Views that ask of the tasks no more than when the stages of each execution began and ended.
OF_SPANS = ("v_job", "v_exec", "v_executor_event", "v_conf")


#: By what the tasks of an order are numbered. Launch and finish of a task depend on its number and the columns of SPAN_ORDER alone, so tasks
#: that tie on these may change places without changing when a stage begins or ends.
ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
SPAN_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity"

#: What the texts' names stand for in each dialect. Spark finds each line's application and execution (`app_of`, `execution_of`) before the
#: window, whose partitions then lie by them, too.
SPARK = {"string": "string", "array": "array", "empty": "cast(array() as array<bigint>)", "app": "app_of", "execution": "execution_of", "dealt": "app_of, execution_of, ", "by": ", app_of, execution_of", "order": ORDER}
DUCK = {"string": "varchar", "array": "list_value", "empty": "[]::bigint[]", "app": "concat('app-', cast(e // 15 as varchar))", "execution": "e", "dealt": "", "by": "", "order": ORDER}


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the application and execution that they stand for."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("*", "cast(l_orderkey as bigint) div 25 AS execution_of")
    return x.selectExpr("*", "concat('app-', cast(execution_of div 15 as string)) AS app_of")


def _made(spark: SparkSession, sf_dir: str, name: str, get: Callable[[str], DataFrame], order: str = ORDER) -> DataFrame:
    text = VIEWS[name].replace("//", "div").format(**SPARK | {"order": order})
    if name == "v_task":
        # what looks at the tasks of an execution or of a stage finds them together: one shuffle of lines serves the window and all that follows
        return spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_lineitem(spark, sf_dir).repartition("app_of", "execution_of"))
    needs = [x for x in VIEWS if x != name and re.search(rf"\b{x}\b", text)]
    for x in needs:
        text = re.sub(rf"\b{x}\b", "{" + x + "}", text)
    return spark.sql(text, **{x: get(x) for x in needs})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry view over the given tables."""
    return _made(spark, sf_dir, name, lambda x: view(spark, sf_dir, x))


def tasks_by_app(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """v_task, dealt into `parts` partitions by application, as logs are written: the shuffle that the window over orders needs serves
    the files, too, so no task is shuffled once more. A missing application is an empty text."""
    text = V_TASK.replace("//", "div").format(**SPARK)
    x = _lineitem(spark, sf_dir).withColumn("app_of", F.coalesce("app_of", F.lit(""))).repartition(parts, "app_of")
    return spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=x)


def _spans(tasks: DataFrame) -> DataFrame:
    """The first launch and the last finish of each stage of an execution, under the names that tasks have them."""
    return tasks.groupBy("app_id", "execution_id", "stage_idx").agg(F.min("launch_ms").alias("launch_ms"), F.max("finish_ms").alias("finish_ms"))


def views_over(spark: SparkSession, sf_dir: str, tables: Collection[str], by: Collection[str] = ()) -> Callable[[str], DataFrame]:
    """Views by name: those among `tables` are written when they are first asked for, as tables of a store would be, and all
    others are computed over them. With `spans` among them, the views of OF_SPANS are made of these instead of all tasks, three
    rows an execution; where no one asks for the tasks themselves, few of their columns are read. Written stages hold the spans
    already. by: columns that written tasks are dealt by."""
    got: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in got:
            if name == "spans" and "v_stage" in tables:
                got[name] = get("v_stage").selectExpr("app_id", "execution_id", "stage_idx", "first_launch_ms AS launch_ms", "completion_ms AS finish_ms")
                return got[name]
            if name == "spans":
                made = _spans(get("v_task") if "v_task" in tables else _made(spark, sf_dir, "v_task", get, SPAN_ORDER))
            else:
                tasks = "spans" if "spans" in tables and name in OF_SPANS else "v_task"
                made = _made(spark, sf_dir, name, lambda x: get(tasks if x == "v_task" else x))
            got[name] = written(made, name, by if name == "v_task" else ()) if name in tables else made
        return got[name]

    return get


def written_views(spark: SparkSession, sf_dir: str, names: list[str]) -> list[DataFrame]:
    """Views that are written once, for queries that look at them many times."""
    get = views_over(spark, sf_dir, VIEWS, ("app_id", "execution_id"))
    return [get(x) for x in names]


def duck(sql: str) -> str:
    """DuckDB text of a query over the views: they go before it as common table expressions."""
    names = {"v_task"}

    def add(text: str) -> None:
        for x in VIEWS:
            if re.search(rf"\b{x}\b", text) and x not in names:
                names.add(x)
                add(VIEWS[x])

    add(sql)
    parts = [f"{x} AS ({text.format(**DUCK)})" for x, text in VIEWS.items() if x in names]
    body = sql.strip()
    return "WITH " + ", ".join(parts) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
