"""What event logs say of plans and heaps: node metrics from accumulators, plan changes, headroom, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.sources.event_logs import build_stages, decoded, parse_events

#: What a walk of a plan tree looks at, in the order of the text: a node's name, and its metrics, which Spark writes after the
#: node's children. Quotes within a JSON text are escaped, so neither pattern can match inside of one.
_TEXT = r'''"[^"\\]*+(?:\\.[^"\\]*+)*+"'''
_TOKEN = rf'''"nodeName":{_TEXT}|"metrics":\[[^\]"]*+(?:{_TEXT}[^\]"]*+)*+\]'''
_METRICS = "array<struct<name:string,accumulatorId:bigint,metricType:string>>"


def plan_walk(tree: str) -> Column:
    """(node, depth, metrics) of every node of a plan tree of any depth, as an array; metrics is still text.

    Built-in functions alone: the tree's text is cut into names and lists of metrics, and one pass over these keeps the
    open nodes on a stack. A name opens a node; a list of metrics closes the last one that is open.
    """
    tokens = F.regexp_extract_all(tree, F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<struct<node:string,depth:int,metrics:string>>").alias("nodes"))

    def step(s: Column, t: Column) -> Column:
        n = F.size(s["open"])
        closed = F.struct(F.get(s["open"], n - 1).alias("node"), n.alias("depth"), F.substr(t, F.lit(len('"metrics":') + 1)).alias("metrics"))
        is_name, name = t.startswith('"nodeName"'), F.substr(t, F.lit(len('"nodeName":"') + 1), F.length(t) - len('"nodeName":""'))
        return F.struct(
            F.when(is_name, F.concat(s["open"], F.array(name))).otherwise(F.slice(s["open"], 1, F.greatest(n - 1, F.lit(0)))).alias("open"),
            F.when(is_name | (n == 0), s["nodes"]).otherwise(F.concat(s["nodes"], F.array(closed))).alias("nodes"),
        )

    return F.aggregate(tokens, start, step, lambda s: s["nodes"])


def plan_nodes(lines: DataFrame) -> DataFrame:
    """(log, execution_id, node, depth, metric, id, kind) of the first and all adaptive plans, each metric once."""
    tree = lambda kind: parse_events(lines, kind, "executionId long, sparkPlanInfo string").select("log", F.col("executionId").alias("execution_id"), F.col("sparkPlanInfo").alias("tree"))
    x = tree("SQLExecutionStart").unionByName(tree("SQLAdaptiveExecutionUpdate")).where("tree is not null")
    x = x.select("log", "execution_id", F.explode(plan_walk("tree")).alias("n")).select("log", "execution_id", "n.node", "n.depth", "n.metrics").where("metrics <> '[]'").select("log", "execution_id", "node", "depth", F.explode(F.from_json("metrics", _METRICS)).alias("m"))
    x = x.select("log", "execution_id", "node", "depth", F.col("m.name").alias("metric"), F.col("m.accumulatorId").alias("id"), F.col("m.metricType").alias("kind"))
    return x.groupBy("log", "execution_id", "node", "metric", "id", "kind").agg(F.min("depth").alias("depth"))


def accumulators(lines: DataFrame, tasks: DataFrame | None = None, partial: DataFrame | None = None) -> DataFrame:
    """(log, id, total, most): values that tasks and the driver added to each accumulator. tasks: build_task_attempts with their rest, where
    they are there already; lines of tasks are then decoded of the logs of `partial` (partial_logs) alone, whose tasks may lack some."""
    kept, values = lines if tasks is None else lines.join(partial, "log", "left_semi"), "array<struct<ID:bigint,Update:string>>"
    t = parse_events(kept, "TaskEnd", f"`Task Info` struct<Accumulables:{values}>").select("log", F.col("Task Info.Accumulables").alias("a"))
    if tasks is not None:
        texts = tasks.join(partial, "log", "left_anti").select("log", F.concat(F.lit('{"a":'), "accumulables", F.lit("}")).alias("value"))
        t = t.unionByName(texts.select("log", decoded(f"a {values}")).select("log", "a"))
    t = t.select("log", F.explode("a").alias("a")).select("log", F.col("a.ID").alias("id"), F.col("a.Update").try_cast("long").alias("v"))
    d = parse_events(lines, "DriverAccumUpdates", "accumUpdates array<array<bigint>>").select("log", F.explode("accumUpdates").alias("a")).select("log", F.col("a")[0].alias("id"), F.col("a")[1].alias("v"))
    return t.unionByName(d).where("v is not null").groupBy("log", "id").agg(F.sum("v").alias("total"), F.max("v").alias("most"))


def plan_metrics(lines: DataFrame, tasks: DataFrame | None = None, partial: DataFrame | None = None) -> DataFrame:
    """Every measured metric of every plan node; an accumulator belongs to one node, so the join is by (log, id). tasks, partial: as for accumulators."""
    return plan_nodes(lines).join(accumulators(lines, tasks, partial), ["log", "id"]).select("log", "execution_id", "node", "depth", "metric", "kind", "id", "total", "most")


def sql_plan_metrics(metrics: DataFrame) -> DataFrame:
    """The measurements that the rules of executions look at, from plan_metrics."""
    of = lambda node, metric: F.col("node").rlike(node) & (F.col("metric") == metric)
    total = lambda c: F.sum(F.when(c, F.col("total")))
    join_ = "Join|CartesianProduct|Generate"
    rows_in = F.max(F.when(~F.col("node").rlike(join_) & (F.col("metric") == "number of output rows"), F.col("total")))
    rows_out = F.max(F.when(of(join_, "number of output rows"), F.col("total")))
    return metrics.groupBy("log", "execution_id").agg(
        total(of("Scan", "number of files read")).alias("scan_files"), total(of("Scan", "size of files read")).alias("scan_bytes"),
        total(F.col("metric") == "number of written files").alias("output_files"), total(F.col("metric") == "written output").alias("output_bytes"),
        F.max(F.when(of("BroadcastExchange", "data size"), F.col("total"))).alias("broadcast_bytes"), F.min(F.when(of("^Exchange", "data size"), F.col("total"))).alias("small_side_bytes"),
        total(F.col("metric") == "number of skewed partitions").alias("skewed_partitions"), total(F.col("metric") == "number of coalesced partitions").alias("coalesced_partitions"),
        rows_out.alias("join_rows"), rows_out.alias("output_rows"), (rows_out / F.greatest(rows_in, F.lit(1))).alias("row_amp"))


def plan_drift(lines: DataFrame) -> DataFrame:
    """Hashes of the first and the last plan of each execution, without node numbers, and whether they differ."""
    clean = F.md5(F.regexp_replace("plan", r"\(\d+\)|#\d+L?|plan_id=\d+", ""))
    get = lambda kind, n: parse_events(lines, kind, "executionId long, physicalPlanDescription string").select("log", F.col("executionId").alias("execution_id"), F.col("physicalPlanDescription").alias("plan"), F.struct("part", F.lit(n), F.get_json_object("line", "$.time"), F.length("plan"), "plan").alias("at"))
    x = get("SQLExecutionStart", 0).unionByName(get("SQLAdaptiveExecutionUpdate", 1)).withColumn("h", clean)
    x = x.groupBy("log", "execution_id").agg(F.min_by("h", "at").alias("first_plan"), F.max_by("h", "at").alias("last_plan"))
    return x.withColumn("changed", F.col("first_plan") != F.col("last_plan"))


_HEAP = "`Executor ID` string, `Stage ID` int, `Executor Metrics` struct<JVMHeapMemory:bigint>"


def heap_peaks(lines: DataFrame) -> DataFrame:
    """(log, stage_id, executor_id, peak_bytes): the largest heap of each executor in each stage."""
    return parse_events(lines, "StageExecutorMetrics", _HEAP).groupBy("log", F.col("Stage ID").alias("stage_id"), F.col("Executor ID").alias("executor_id")).agg(F.max("Executor Metrics.JVMHeapMemory").alias("peak_bytes"))


def heap_headroom(lines: DataFrame, memory: DataFrame, factor: float = 1.25) -> DataFrame:
    """Largest heap of each executor in each stage over its memory (log, memory_bytes), and the memory that it suggests."""
    x = heap_peaks(lines)
    x = x.join(memory, "log").where("memory_bytes > 0")
    return x.withColumns({"heap_peak_ratio": F.round(F.col("peak_bytes") / F.col("memory_bytes"), 6), "suggested_bytes": F.floor(F.col("peak_bytes") * factor).cast("long")})


def heap_trend(heaps: DataFrame, stages: DataFrame, key: str = "log") -> DataFrame:
    """Slope of an application's hourly heap peaks in bytes an hour, the mean of its first quarter of hours, the last hour's peak.
    heaps: heap_peaks; stages: completion_ms says which hour a stage's peak belongs to. At most a row an hour is sorted."""
    hour = stages.where("completion_ms > 0").select(key, F.col("stage_id").cast("long").alias("stage_id"), F.expr("completion_ms div 3600000").alias("hour"))
    x = heaps.withColumn("stage_id", F.col("stage_id").cast("long")).join(hour, [key, "stage_id"])
    h = x.groupBy(key, "hour").agg(F.max("peak_bytes").alias("peak")).withColumn("q", F.ntile(4).over(Window.partitionBy(key).orderBy("hour")))
    first = F.avg(F.when(F.col("q") == 1, F.col("peak")))
    return h.groupBy(key).agg(F.round(F.regr_slope("peak", "hour"), 6).alias("heap_slope"), F.round(first, 6).alias("heap_first_quartile"), F.max_by("peak", "hour").alias("last_peak"), F.count("*").alias("hours"))


def resource_trend(lines: DataFrame) -> DataFrame:
    """heap_trend of event lines."""
    return heap_trend(heap_peaks(lines), build_stages(lines))


def small_file_backlog(findings: DataFrame, plans: DataFrame) -> DataFrame:
    """Small-file findings by the table that an execution scans or writes. findings: log, execution_id, rule_id; plans: log, execution_id, plan."""
    table = F.explode(F.array_distinct(F.expr(r"regexp_extract_all(plan, '(?:Scan|InsertInto\\w*) (?:\\w+ )?([\\w]+(?:\\.[\\w]+)+)', 1)"))).alias("table")
    return findings.where(F.col("rule_id").isin("S-05", "S-06")).join(plans, ["log", "execution_id"]).select("rule_id", "execution_id", "log", table).groupBy("table", "rule_id").agg(F.count_distinct("log", "execution_id").alias("executions"))
