"""Spark event logs of many applications as tables. Schemas are fixed, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The events that are read.
KINDS = ("ApplicationStart", "ApplicationEnd", "EnvironmentUpdate", "ExecutorAdded", "ExecutorRemoved", "JobStart", "JobEnd", "StageSubmitted", "StageCompleted", "TaskEnd", "SQLExecutionStart", "SQLExecutionEnd", "SQLAdaptiveExecutionUpdate")
_STAGE = "`Stage ID` int, `Stage Attempt ID` int, `Number of Tasks` int, `Parent IDs` array<int>, `Submission Time` long, `Completion Time` long"
SCHEMAS = {
    "ApplicationStart": "`App ID` string, `App Attempt ID` string, `App Name` string, Timestamp long",
    "ApplicationEnd": "Timestamp long",
    "EnvironmentUpdate": "`Spark Properties` map<string,string>",
    "ExecutorAdded": "Timestamp long, `Executor ID` string, `Executor Info` struct<Host:string,`Total Cores`:int>",
    "ExecutorRemoved": "Timestamp long, `Executor ID` string, `Removed Reason` string",
    "JobStart": "`Job ID` int, `Submission Time` long, `Stage IDs` array<int>, Properties map<string,string>",
    "JobEnd": "`Job ID` int, `Completion Time` long, `Job Result` struct<Result:string>",
    "StageSubmitted": f"`Stage Info` struct<{_STAGE.replace('` ', '`:')}>",
    "StageCompleted": f"`Stage Info` struct<{_STAGE.replace('` ', '`:')}>",
    "TaskEnd": "`Stage ID` int, `Stage Attempt ID` int, `Task End Reason` struct<Reason:string,`Class Name`:string,`Block Manager Address`:struct<Host:string>>, `Task Info` struct<`Task ID`:long,Index:int,Attempt:int,`Launch Time`:long,`Finish Time`:long,`Executor ID`:string,Host:string,Locality:string,Speculative:boolean,Failed:boolean,Killed:boolean>, "
    "`Task Metrics` struct<`Executor Run Time`:long,`Executor CPU Time`:long,`JVM GC Time`:long,`Executor Deserialize Time`:long,`Result Size`:long,`Disk Bytes Spilled`:long,`Memory Bytes Spilled`:long,`Shuffle Read Metrics`:struct<`Fetch Wait Time`:long,`Remote Bytes Read`:long,`Local Bytes Read`:long>,`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:long,`Shuffle Write Time`:long>,`Input Metrics`:struct<`Bytes Read`:long>,`Output Metrics`:struct<`Bytes Written`:long>>",
    "SQLExecutionStart": "executionId long, description string, details string, physicalPlanDescription string, time long",
    "SQLExecutionEnd": "executionId long, time long",
    "SQLAdaptiveExecutionUpdate": "executionId long, physicalPlanDescription string",
}


def log_of(file: Column) -> tuple[Column, Column, Column]:
    """(log, part, rank) of a log file's path. A rolled log's parts are numbered in their names (`events_<n>_`) and lie in a
    folder `eventlog_v2_<log>`; lines that Spark itself wrote, one folder `log=<log>` a log, count as rolled. Of several forms of
    one log the least rank counts: rolled, whole, being written. It is computed for every line, so paths are cut without patterns, which
    would try each of their places, and a pattern meets a name only where it can match."""
    name, folder = _name(file), _folder(file, _name(file))
    part = _part(name, folder)
    return _cut(name, part, F.when(part.isNotNull(), folder).otherwise(name))


def _name(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def _folder(file: Column, name: Column) -> Column:
    return F.when(F.contains(file, F.lit("/")) & (name != ""), F.substring_index(F.substring_index(file, "/", -2), "/", 1)).otherwise("")


def _part(name: Column, folder: Column) -> Column:
    """The number of a rolled log's part as text, null for whole files."""
    event = F.when(name.startswith("events_"), F.nullif(F.regexp_extract(name, r"^events_(\d+)_", 1), F.lit("")))
    spark_part = F.when(name.startswith("part-"), F.regexp_extract(name, r"^part-(\d+)", 1)).otherwise("")
    return F.coalesce(event, F.when(folder.startswith("log="), spark_part))


def _cut(name: Column, part: Column, own: Column) -> tuple[Column, Column, Column]:
    """(log, part, rank) by the name that a log has as its own: its folder's or its file's."""
    dot = F.contains(own, F.lit("."))
    plain = F.when(own.startswith("log="), F.substr(own, F.lit(5))).when(own.startswith("eventlog_v2_"), F.substr(own, F.lit(13))).otherwise(own)
    log = F.when(dot, F.regexp_replace(own, r"^(eventlog_v2_|log=)|(\.(inprogress|zstd|lz4|snappy|lzf))+$", "")).otherwise(plain)
    codec = F.when(dot, F.regexp_extract(own, r"\.(zstd|lz4|snappy|lzf)", 1)).otherwise("")
    rank = F.when(part.isNotNull(), F.lit("0")).when(name.endswith(".inprogress"), F.lit("2")).otherwise(F.lit("1"))
    return log, F.coalesce(part.try_cast("int"), F.lit(1 << 30)), F.concat_ws(" ", rank, codec)


def lines_by_log(lines: DataFrame, rolled: bool = False) -> DataFrame:
    """(log, part, value) of lines that are read from files, by log_of their paths. Each piece of a path is a column of its own, so it is cut
    once a line: as one expression it would be cut again wherever it is named. rolled: only lines of rolled logs."""
    x = lines.select("value", file_path().alias("file"))
    if rolled:  # as log_of ranks them; moved to the file scan, so it is kept short
        name = _name(F.col("file"))
        x = x.where((name.startswith("events_") & name.rlike(r"^events_\d+_")) | _folder(F.col("file"), name).startswith("log="))
    name, folder, text = F.col("name"), F.col("folder"), F.col("text")
    x = x.withColumn("name", _name(F.col("file"))).withColumn("folder", _folder(F.col("file"), name))
    x = x.withColumn("text", _part(name, folder)).withColumn("own", F.when(text.isNotNull(), folder).otherwise(name))
    log, part, _ = _cut(name, text, F.col("own"))
    return x.select(log.alias("log"), part.alias("part"), "value")


def file_path() -> Column:
    """The path of the file that a line is read from, as it is listed; most paths hold nothing to decode."""
    at = F.col("_metadata.file_path")
    return F.when(at.contains("%"), F.url_decode(F.replace(at, F.lit("+"), F.lit("%2B")))).otherwise(at)


def list_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, length, modified) of all files below a path; their contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.unix_millis("modificationTime").alias("modified"))


def resolve_log_parts(files: DataFrame) -> DataFrame:
    """(file, log, part, ...): the files to read of each log. files: file, ... If a log is there as rolled parts, as one file, as one
    that is still being written or in several codecs, one form alone is read, so no event counts twice. Status
    files and files that are still being written in compressed form are left out, as they cannot be read as text."""
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    rows = files.where(~name.startswith("appstatus_") & ~name.rlike(r"\.(zstd|lz4|snappy|lzf)\.inprogress$") & ~name.rlike(r"^[_.]"))
    log, part, rank = log_of(F.col("file"))
    rows = rows.withColumns({"log": log, "part": part, "rank": rank})
    return rows.join(rows.groupBy("log").agg(F.min("rank").alias("rank")), ["log", "rank"]).select("file", "log", "part", *[c for c in files.columns if c != "file"])


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(log, part, value): the lines of these log files, and no others. Each line's log and part come from its file's path, so
    nothing is shuffled, and a long plain file is split."""
    if not paths:
        return spark.createDataFrame([], "log string, part int, value string")
    return lines_by_log(spark.read.option("recursiveFileLookup", "true").text(paths))


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log, part, value): the lines of all logs below a path, single files and rolled ones, also compressed ones. The files are
    listed first and chosen by `resolve_log_parts`; only these are opened. The driver holds their names, as for any read."""
    return read_parts(spark, [r["file"] for r in resolve_log_parts(list_logs(spark, path)).select("file").collect()])


def kind_of(value: Column) -> Column:
    """The event kind of a line, from its text alone; empty where the line names none."""
    return F.regexp_extract(F.regexp_extract(value, r'^\s*\{"Event":"([^"]+)"', 1), r"(?:SparkListener)?([A-Za-z]+)$", 1)


def decoded(schema: str) -> Column:
    """The columns of whole events; broken lines give no row. A condition on the event would be moved below it and decode each line again."""
    typed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return F.inline(F.filter(F.array(typed), lambda e: e.isNotNull() & e["_broken"].isNull()))


def parse_events(lines: DataFrame, kind: str, schema: str | None = None) -> DataFrame:
    """One typed table of an event kind; lines are filtered by their text (or the column `kind` that stored lines are
    partitioned by) before any JSON is decoded, broken lines are dropped. With a schema of one's own the text of the event
    stays as `line`."""
    of = F.col("kind") == kind if "kind" in lines.columns else F.col("value").contains(f"{kind}\"") & (kind_of(F.col("value")) == kind)
    return lines.where(of).select("log", "part", *([F.col("value").alias("line")] if schema else []), decoded(schema or SCHEMAS[kind])).drop("_broken")


def parse_kinds(lines: DataFrame, kinds: Sequence[str], schema: str) -> DataFrame:
    """(log, part, kind, ...): events of several kinds as one table with the fields of all, in one pass over the lines."""
    kind = F.col("kind") if "kind" in lines.columns else kind_of(F.col("value"))
    return lines.where(kind.isin(*kinds)).select("log", "part", kind.alias("kind"), decoded(schema)).drop("_broken")


def _closed(value: str) -> Column:
    return F.trim(value).endswith("}")


def bad_lines(lines: DataFrame, partial: DataFrame | None = None) -> DataFrame:
    """Lines of each log that are not whole JSON objects, such as the broken tail of a log that was cut off. partial: partial_logs of
    the lines; no line of tasks of another log is bad, so these are counted but not looked at."""
    bad = ~_closed("value") | F.get_json_object("value", "$.Event").isNull()
    if partial is None:
        return lines.groupBy("log").agg(F.count_if(bad).alias("bad_lines"))
    of_tasks = F.col("kind") == "TaskEnd"
    looked = lines.where(~of_tasks).unionByName(lines.where(of_tasks).join(partial, "log", "left_semi"))
    found = looked.groupBy("log").agg(F.count_if(bad).alias("n")).unionByName(lines.where(of_tasks).groupBy("log").agg(F.lit(0).cast("long").alias("n")))
    return found.groupBy("log").agg(F.sum("n").alias("bad_lines"))


def partial_logs(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """(log): logs with a line of a task's end that gave no row of the tasks, or that goes on behind its object. lines: with `kind`; tasks:
    build_task_attempts with their rest, of these lines. All lines of tasks of all other logs are whole JSON objects with the types of SCHEMAS."""
    n = lines.where(F.col("kind") == "TaskEnd").groupBy("log").agg(F.count("*").alias("n"))
    return n.join(tasks.groupBy("log").agg(F.count_if("closed").alias("whole")), "log", "left").where("n > coalesce(whole, 0)").select("log")


def build_apps(lines: DataFrame) -> DataFrame:
    """One row for each log: application, times, conf (first wins) and whether its end is missing."""
    s = parse_events(lines, "ApplicationStart").groupBy("log").agg(F.min_by("App ID", "part").alias("app_id"), F.min_by("App Attempt ID", "part").alias("attempt"), F.min_by("App Name", "part").alias("app_name"), F.min("Timestamp").alias("start_ms"))
    e = parse_events(lines, "ApplicationEnd").groupBy("log").agg(F.max("Timestamp").alias("end_ms"))
    c = parse_events(lines, "EnvironmentUpdate").groupBy("log").agg(F.min_by("Spark Properties", "part").alias("conf"))
    return s.join(e, "log", "left").join(c, "log", "left").withColumn("incomplete", F.col("end_ms").isNull())


def build_executions(lines: DataFrame) -> DataFrame:
    """One row an execution, with the ids of its jobs; incomplete where its start or end is missing."""
    s = parse_events(lines, "SQLExecutionStart").groupBy("log", "executionId").agg(F.min("time").alias("start_ms"), F.min_by("description", "time").alias("description"), F.min_by("physicalPlanDescription", "time").alias("plan"))
    e = parse_events(lines, "SQLExecutionEnd").groupBy("log", "executionId").agg(F.max("time").alias("end_ms"))
    own = parse_events(lines, "JobStart").select("log", F.col("Properties")["spark.sql.execution.id"].try_cast("long").alias("executionId"), F.col("Job ID").cast("long").alias("id"))
    own = own.where("executionId is not null").groupBy("log", "executionId").agg(F.sort_array(F.collect_set("id")).alias("job_ids"))
    x = s.join(e, ["log", "executionId"], "full").join(own, ["log", "executionId"], "left")
    return x.select("log", F.col("executionId").alias("execution_id"), "start_ms", "end_ms", "description", "plan", F.coalesce("job_ids", F.array().cast("array<bigint>")).alias("job_ids"), (F.col("start_ms").isNull() | F.col("end_ms").isNull()).alias("incomplete"))


def build_jobs(lines: DataFrame) -> DataFrame:
    s = parse_events(lines, "JobStart").select("log", F.col("Job ID").alias("job_id"), F.col("Properties")["spark.sql.execution.id"].try_cast("long").alias("execution_id"), F.col("Stage IDs").cast("array<bigint>").alias("stage_ids"), F.col("Submission Time").alias("submission_ms"))
    e = parse_events(lines, "JobEnd").select("log", F.col("Job ID").alias("job_id"), F.col("Completion Time").alias("completion_ms"), (F.col("Job Result.Result") != "JobSucceeded").alias("failed"))
    return s.join(e, ["log", "job_id"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def build_stages(lines: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """One row a stage over all its attempts: times of the last state seen, its first launch, failed attempts, attempts beyond its
    number of tasks, and the totals of its tasks. tasks: build_task_attempts, where they are there already. A stage that only tasks
    or only stage events know of has a row too."""
    x = parse_events(lines, "StageSubmitted").unionByName(parse_events(lines, "StageCompleted")).select("log", F.col("Stage Info").alias("i"))
    x = x.groupBy("log", F.col("i.Stage ID").cast("long").alias("stage_id")).agg(
        F.max("i.Number of Tasks").alias("num_tasks"), F.max("i.Parent IDs").cast("array<bigint>").alias("parent_ids"), F.min("i.Submission Time").alias("submission_ms"), F.max("i.Completion Time").alias("completion_ms"), F.max("i.Stage Attempt ID").alias("last_attempt"),
    )
    t = (build_task_attempts(lines) if tasks is None else tasks).groupBy("log", "stage_id").agg(
        F.min(F.when(F.col("launch_ms") > 0, F.col("launch_ms"))).alias("first_launch_ms"), F.count_if("failed").alias("failed_attempts"), F.count("*").alias("attempts"),
        *[F.sum(c).alias(c) for c in ("run_ms", "fetch_wait_ms", "shuffle_read_bytes", "shuffle_write_bytes", "input_bytes", "output_bytes", "disk_spill_bytes")],
    )
    x = x.join(t, ["log", "stage_id"], "full")
    return x.withColumns({"failed_attempts": F.coalesce("failed_attempts", F.lit(0)), "extra_attempts": F.greatest(F.coalesce("attempts", F.lit(0)) - F.coalesce("num_tasks", F.lit(0)), F.lit(0))})


def _at_least_0(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))


#: A task attempt of more than 30 days has a broken clock; cut at bucket edges it would become tens of thousands of rows.
LONGEST_MS = 30 * 86_400_000


_TASK_AND_REST = SCHEMAS["TaskEnd"].replace("Killed:boolean>", "Killed:boolean,Accumulables:string>")


def build_task_attempts(lines: DataFrame, rest: bool = False) -> DataFrame:
    """One row for each task end. Attempts without metrics keep a null run time, so that they count but enter no distribution.
    valid: launched and finished, in this order and
    within LONGEST_MS; only such attempts take part in sweeps over time. rest: what else is read of a line is there too, so that it is
    decoded once: `accumulables`, the text of the values that the task added to accumulators, and `closed`, whether the line ends with its object."""
    x = parse_events(lines, "TaskEnd", _TASK_AND_REST if rest else None)
    m, i = "Task Metrics.", "Task Info."
    launch, finish = F.col(f"{i}Launch Time"), F.col(f"{i}Finish Time")
    return x.select(
        "log", F.col("Stage ID").cast("long").alias("stage_id"), F.col("Stage Attempt ID").alias("attempt"), F.col(f"{i}Task ID").alias("task_id"), F.col(f"{i}Index").alias("part_idx"), F.col(f"{i}Executor ID").alias("executor_id"), F.col(f"{i}Host").alias("host"), F.col(f"{i}Locality").alias("locality"),
        launch.alias("launch_ms"), finish.alias("finish_ms"), F.when(F.col("Task Metrics").isNotNull(), _at_least_0(f"{m}Executor Run Time")).alias("run_ms"),
        *[_at_least_0(f"{m}{c}").alias(a) for c, a in (("Executor CPU Time", "cpu_ns"), ("JVM GC Time", "gc_ms"), ("Executor Deserialize Time", "deser_ms"), ("Result Size", "result_size"), ("Disk Bytes Spilled", "disk_spill_bytes"), ("Memory Bytes Spilled", "memory_spill_bytes"), ("Shuffle Write Metrics.Shuffle Write Time", "shuffle_write_ns"), ("Shuffle Read Metrics.Fetch Wait Time", "fetch_wait_ms"), ("Shuffle Write Metrics.Shuffle Bytes Written", "shuffle_write_bytes"), ("Input Metrics.Bytes Read", "input_bytes"), ("Output Metrics.Bytes Written", "output_bytes"))],
        (_at_least_0(f"{m}Shuffle Read Metrics.Remote Bytes Read") + _at_least_0(f"{m}Shuffle Read Metrics.Local Bytes Read")).alias("shuffle_read_bytes"),
        F.coalesce(f"{i}Speculative", F.lit(False)).alias("speculative"), F.concat_ws(": ", "Task End Reason.Reason", "Task End Reason.Class Name").alias("reason"), (~F.coalesce("Task End Reason.Reason", F.lit("")).contains("Success")).alias("failed"),
        F.col("Task End Reason.Block Manager Address.Host").alias("src_host"), F.coalesce((launch > 0) & (finish >= launch) & (finish - launch <= LONGEST_MS), F.lit(False)).alias("valid"),
        *([F.col(f"{i}Accumulables").alias("accumulables"), _closed("line").alias("closed")] if rest else []),
    )


def executor_events(lines: DataFrame) -> DataFrame:
    """Executors that came and went; one that went takes the cores it came with, and is left out if it never came."""
    a = parse_events(lines, "ExecutorAdded").select("log", F.col("Executor ID").alias("executor_id"), F.col("Timestamp").alias("time_ms"), F.col("Executor Info.Total Cores").alias("cores"), F.lit(True).alias("added"))
    r = parse_events(lines, "ExecutorRemoved").select("log", F.col("Executor ID").alias("executor_id"), F.col("Timestamp").alias("time_ms"))
    gone = r.join(a.groupBy("log", "executor_id").agg(F.max("cores").alias("cores")), ["log", "executor_id"]).withColumn("added", F.lit(False))
    return a.unionByName(gone)


def attach_thrift_ids(executions: DataFrame, ids: DataFrame) -> DataFrame:
    """The k-th unclaimed statement id of a log goes to its k-th execution without one, both by time."""
    w = Window.partitionBy("log").orderBy("start_ms", "execution_id")
    open_ = executions.where("statement_id is null").withColumn("k", F.row_number().over(w))
    claim = ids.withColumn("k", F.row_number().over(Window.partitionBy("log").orderBy("time_ms", "id"))).select("log", "k", F.col("id").alias("statement_id"))
    return executions.where("statement_id is not null").unionByName(open_.drop("statement_id").join(claim, ["log", "k"], "left").drop("k"))
