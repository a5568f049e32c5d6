"""Executions of running applications as streams: events, state of each execution, and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from runlens.sources.event_logs import kind_of, lines_by_log, parse_kinds
from runlens.sources.folders import shared_folder
from runlens.streaming.snapshots import block_of, snapshot_upsert


def stream_events(spark: SparkSession, path: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    """(log, part, value) of log parts as they appear below a path. Parts are named as in `log_of`; whole files, files that are
    still being written and status files are left out, as a log of several forms would count twice and a stream cannot know which
    of them will come: a stream reads rolled logs, whose parts are closed when they appear. A batch is bounded by the bytes of its
    files, so many small logs need no more batches than one large one."""
    x = spark.readStream.schema("value string").option("maxBytesPerTrigger", bytes_per_batch).option("recursiveFileLookup", "true").text(path)
    return lines_by_log(x, rolled=True)


#: What the state of an execution comes from.
KINDS = ("SQLExecutionStart", "SQLExecutionEnd", "JobStart")
STATE = "log string, execution_id long, start_ms long, end_ms long, job_ids array<long>, status string"


def stream_execution_state(lines: DataFrame, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """Executions as they start, go on and end: log, execution_id, start_ms, end_ms, job_ids, status (running, ended, timed_out).

    A row each time something of an execution is seen: while its end is missing it is `running`, also with the jobs known so
    far. State holds the two times and the jobs of an execution that has not ended; an event-time timer lets one go as
    `timed_out` that has shown nothing for `keep_ms`, so state has a bound. Events of one that has ended or timed out
    begin a new row, which the snapshot's order ranks below the final one. For streams only; needs the RocksDB state store.
    """
    job = F.col("kind") == "JobStart"
    of = F.when(job, F.col("Properties")["spark.sql.execution.id"].try_cast("long")).otherwise(F.col("executionId"))
    x = parse_kinds(lines, KINDS, "executionId long, time long, `Job ID` long, `Submission Time` long, Properties map<string,string>")
    x = x.select("log", of.alias("execution_id"), F.timestamp_millis(F.when(job, F.col("Submission Time")).otherwise(F.col("time"))).alias("ts"), "kind", F.when(job, F.col("Job ID")).alias("job"))
    x = x.where("execution_id is not null or kind <> 'JobStart'").withWatermark("ts", late)

    class Executions(StatefulProcessor):  # within the function, so that it is sent to tasks whole
        def init(self, handle) -> None:
            self.handle = handle
            self.times = handle.getValueState("times", "start_ms long, end_ms long, seen_ms long")
            self.jobs = handle.getMapState("jobs", "job long", "seen boolean")

        def row(self, key, start, end, jobs, status):
            return Row(log=key[0], execution_id=key[1], start_ms=start, end_ms=end, job_ids=sorted(jobs), status=status)

        def known_jobs(self):
            return {k[0] for k in self.jobs.keys()}

        def handleInputRows(self, key, rows, timerValues):
            known = self.times.get()  # one that starts and ends within a batch costs this look and leaves no state
            start, end, seen = known or (None, None, 0)
            new = set()
            for r in rows:
                ms = int(r.ts.timestamp() * 1000 + 0.5)
                seen = max(seen, ms)
                if r.kind == "SQLExecutionStart":
                    start = ms if start is None else min(start, ms)
                elif r.kind == "SQLExecutionEnd":
                    end = ms if end is None else max(end, ms)
                else:
                    new.add(r.job)
            jobs = new | self.known_jobs() if known else new
            if start is not None and end is not None:
                yield self.row(key, start, end, jobs, "ended")
                if known:
                    self.forget()
                return
            for j in new:
                self.jobs.updateValue((j,), (True,))
            self.times.update((start, end, seen))
            if known:
                self.drop_timers()
            self.handle.registerTimer(max(seen + keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
            yield self.row(key, start, end, jobs, "running")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            start, end, _ = self.times.get() or (None, None, 0)
            yield self.row(key, start, end, self.known_jobs(), "timed_out")
            self.forget()

        def forget(self) -> None:
            self.times.clear()
            self.jobs.clear()
            self.drop_timers()

        def drop_timers(self) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)

        def close(self) -> None:
            pass

    return x.groupBy("log", "execution_id").transformWithState(Executions(), STATE, "Update", "EventTime")


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_executions(lines: DataFrame, to: str, checkpoint: str, late: str = "1 day", keep_ms: int = 86_400_000) -> None:
    """Brings the snapshot of executions at a path up to date with the log parts that are there now."""
    spark = lines.sparkSession
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        rank = F.when(F.col("status") == "ended", 2).when(F.col("status") == "timed_out", 1).otherwise(0)  # a final state goes before a running one, then the one with more jobs
        x = stream_execution_state(lines, late, keep_ms).withColumns({"rank": rank, "n_jobs": F.size("job_ids"), "block": block_of("log", F.expr("execution_id div 1000"))})
        write = snapshot_upsert(to, ["log", "execution_id", "block"], ["block"], ["rank", "n_jobs"])
        x.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])


SNAPSHOT = "execution_id long, start_ms long, end_ms long, job_ids array<long>, status string, rank int, n_jobs int, log string, block long"


def read_executions(spark: SparkSession, path: str) -> DataFrame:
    """(log, execution_id, start_ms, end_ms, job_ids, status) of the snapshot: one row an execution, as it was last seen."""
    return spark.read.schema(SNAPSHOT).parquet(path).drop("rank", "n_jobs", "block")


def run_to_end(lines: DataFrame) -> DataFrame:
    """The executions of logs that are already there, through the stream: lines become log parts, which it reads until none is left."""
    spark, at = lines.sparkSession, shared_folder(lines.sparkSession, "executions")
    kind = F.col("kind") if "kind" in lines.columns else kind_of(F.col("value"))
    own = lines.where(kind.isin(*KINDS)).select("log", "value")
    own.repartition("log").write.option("compression", "gzip").partitionBy("log").text(f"{at}/logs")
    run_executions(stream_events(spark, f"{at}/logs"), f"{at}/out", f"{at}/check")
    return read_executions(spark, f"{at}/out")
