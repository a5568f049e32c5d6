"""What rules need beyond task measurements: verdicts on fetches, memory, storms and clocks, and the joins that give them to contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.features import CLASSES
from runlens.operators.intervals import SQL
from runlens.operators.stages import STAGE, ratio

MINUTE = 60_000


def effective(n: Column) -> Column:
    """How many equal groups would be as concentrated as groups of these sizes: (sum n)^2 / sum n^2; an aggregate."""
    whole = F.sum(n)
    return ratio(whole.cast("double") * whole, F.sum(n * n).cast("double"))


def fetch_verdict(tasks: DataFrame, racks: DataFrame, least: int = 20, row: float = 0.5, block: float = 0.5, spread: float = 0.5) -> DataFrame:
    """Where an application's fetch failures come from: one source host, one pair of racks, or everywhere.

    racks: host, rack; a host that is not named is a rack of its own. SINGLE_HOST: a source has `row` of the failures; RACK: sources
    of one rack and readers of one rack have `block` of them; CONGESTION: the failures are spread as if over at least `spread` of
    the hosts that run the application's tasks; MIXED: none of these; NONE: fewer than `least` failures.
    """
    pairs = tasks.where("src_host is not null").groupBy("app_id", "src_host", "host").agg(F.count("*").alias("n"))
    rack = lambda c: racks.select(F.col("host").alias(c), F.col("rack").alias(f"{c}_rack"))
    pairs = pairs.join(rack("src_host"), "src_host", "left").join(rack("host"), "host", "left")
    pairs = pairs.withColumns({c: F.coalesce(c, c.removesuffix("_rack")) for c in ("src_host_rack", "host_rack")})
    rows = pairs.groupBy("app_id", "src_host").agg(F.sum("n").alias("n")).groupBy("app_id").agg(
        F.sum("n").alias("fetch_failures"), F.max_by("src_host", F.struct("n", "src_host")).alias("worst_source"), ratio(F.max("n"), F.sum("n")).alias("fetch_row_share"), effective(F.col("n")).alias("sources"))
    blocks = pairs.groupBy("app_id", "src_host_rack", "host_rack").agg(F.sum("n").alias("n")).groupBy("app_id").agg(ratio(F.max("n"), F.sum("n")).alias("fetch_rack_share"))
    hosts = tasks.groupBy("app_id").agg(F.count_distinct("host").alias("hosts"))
    x = rows.join(blocks, "app_id").join(hosts, "app_id")
    one, rack_, wide = F.col("fetch_row_share") >= row, F.col("fetch_rack_share") >= block, F.col("sources") >= spread * F.col("hosts")
    x = x.withColumn("fetch_diffuse", ~one & ~rack_ & wide)
    verdict = F.when(F.col("fetch_failures") < least, "NONE").when(one, "SINGLE_HOST").when(rack_, "RACK").when(wide, "CONGESTION").otherwise("MIXED")
    return x.withColumn("verdict", verdict)


def storm_profile(tasks: DataFrame, share: float = 0.1, least: int = 2, few: float = 2.0, width: int = MINUTE) -> DataFrame:
    """Launch buckets of many failures: attempts, failures by class, how many hosts they spread over, the application's first
    such bucket, and what kind of storm it is: NODE on few hosts, AUTH or RESOURCE by the larger part of its reasons, else MIXED."""
    of = F.lit("EXCEPTION")
    for name, pattern in reversed(CLASSES):
        of = F.when(F.col("reason").rlike(pattern), name).otherwise(of)
    x = tasks.select("app_id", F.expr(f"launch_ms div {width} * {width}").alias("bucket_ms"), "host", "failed", of.alias("class"))
    n = lambda *names: F.count_if(F.col("failed") & F.col("class").isin(*names))
    hosts = x.groupBy("app_id", "bucket_ms", "host").agg(F.count("*").alias("attempts"), n(*[c for c, _ in CLASSES], "EXCEPTION").alias("failed"), n("AUTH").alias("auth"), n("OOM", "EXECUTOR_LOST").alias("resource"))
    b = hosts.groupBy("app_id", "bucket_ms").agg(*[F.sum(c).alias(c) for c in ("attempts", "failed", "auth", "resource")], effective(F.col("failed")).alias("hosts"))
    b = b.where((F.col("failed") >= least) & (F.col("failed") >= share * F.col("attempts")))
    first = b.groupBy("app_id").agg(F.min("bucket_ms").alias("first_burst_ms"))
    kind = F.when(F.col("hosts") < few, "NODE").when(2 * F.col("auth") >= F.col("failed"), "AUTH").when(2 * F.col("resource") >= F.col("failed"), "RESOURCE").otherwise("MIXED")
    return b.join(first, "app_id").withColumn("kind", kind)


def memory_branches(light: DataFrame, tasks: DataFrame, execs: DataFrame, top: float = 0.5, wide: float = 0.5, together: float = 0.3, width: int = MINUTE) -> DataFrame:
    """Why an application spills: SINGLE_SQL where one execution has `top` of it, WATERLINE where `wide` of the buckets with tasks
    spill, CONCURRENCY where spill rises with the number of executions at work (their correlation over buckets), else MIXED."""
    total = light.groupBy("app_id").agg(F.count_if(F.col("spill_bytes") > 0).alias("affected"), ratio(F.max("spill_bytes"), F.sum("spill_bytes")).alias("top_share"))
    b = tasks.groupBy("app_id", F.expr(f"launch_ms div {width}").alias("b")).agg(F.count_distinct("execution_id").alias("x"), F.sum("disk_spill_bytes").alias("y"))
    s = lambda c: F.sum(F.expr(c).cast("decimal(38,0)")).cast("double")
    b = b.groupBy("app_id").agg(F.count("*").cast("double").alias("n"), ratio(F.count_if(F.col("y") > 0), F.count("*")).alias("bucket_share"), s("x").alias("sx"), s("y").alias("sy"), s("cast(x as decimal(19,0)) * cast(y as decimal(19,0))").alias("sxy"), s("x * x").alias("sxx"), s("cast(y as decimal(19,0)) * cast(y as decimal(19,0))").alias("syy"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    corr = F.when((vx > 0) & (vy > 0), F.round((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy)), 6)).otherwise(0.0)
    x = total.join(b, "app_id", "left").select("app_id", "affected", "top_share", F.coalesce("bucket_share", F.lit(0.0)).alias("bucket_share"), F.coalesce(corr, F.lit(0.0)).alias("concurrency_corr"))
    verdict = F.when(F.col("affected") == 0, "NONE").when(F.col("top_share") >= top, "SINGLE_SQL").when(F.col("bucket_share") >= wide, "WATERLINE").when(F.col("concurrency_corr") >= together, "CONCURRENCY").otherwise("MIXED")
    return x.withColumn("verdict", verdict)


def clock_offsets(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """(app_id, host, executors, offset_ms, negative): how far a host's clock seems to lie from the others'.

    An executor's first launch on a host follows its registration by some start-up time. The host's offset is the median of
    these times over its executors, less the application's median over all executors: half of the executors of a host
    must be wrong before the estimate moves by more than the spread of start-up times, which bounds its error.
    """
    added = events.where("added").groupBy("app_id", "executor_id").agg(F.min("time_ms").alias("added_ms"))
    first = tasks.groupBy("app_id", "host", "executor_id").agg(F.min("launch_ms").alias("first_ms"), F.count_if(F.col("finish_ms") < F.col("launch_ms")).alias("negative"))
    x = first.join(added, ["app_id", "executor_id"], "left").withColumn("d", F.col("first_ms") - F.col("added_ms"))
    half = lambda c: F.floor(F.round(F.percentile(c, F.lit(0.5)), 6) + 0.5).cast("long")
    whole = x.groupBy("app_id").agg(half("d").alias("usual"))
    y = x.groupBy("app_id", "host").agg(F.count("d").alias("executors"), half("d").alias("own"), F.sum("negative").alias("negative"))
    return y.join(whole, "app_id").select("app_id", "host", "executors", (F.col("own") - F.col("usual")).alias("offset_ms"), "negative")


STEPS = ("INPUT", "SHUFFLE", "SKEW", "PLAN", "QUEUE")


def template_causes(history: DataFrame, factor: float = 1.5, at_least_ms: int = 300_000, samples: int = 3, rounds: int = 14, grown: float = 1.2) -> DataFrame:
    """Runs of templates that are slower than the runs before, with one cause each and the share of the slowdown it stands for.

    history: template, run, duration_ms, input_bytes, read_bytes, skew_micros (skew in millionths), plan, wait_ms; a row an execution.
    A run's mean of each is held against the mean over its `rounds` runs before. The causes are looked at in order, and the
    first that fits counts: INPUT, SHUFFLE, SKEW grew by `grown`; the PLAN that most executions have is not that of the run
    before; QUEUE, waits grew by `grown`; else UNEXPLAINED. The share of a measure is its growth over the growth of the time, at most
    1; a changed plan stands for all that the measures before it leave; waits for their milliseconds.
    """
    mean = lambda c: F.floor((F.sum(c) * 2 + F.count(c)) / (F.count(c) * 2))
    names = {"duration_ms": "time", "input_bytes": "input", "read_bytes": "shuffle", "skew_micros": "skew", "wait_ms": "wait"}
    plans = history.groupBy("template", "run", "plan").agg(F.count("*").alias("k")).groupBy("template", "run").agg(F.max_by("plan", F.struct("k", "plan")).alias("plan"))
    per = history.groupBy("template", "run").agg(*[mean(c).cast("long").alias(n) for c, n in names.items()]).join(plans, ["template", "run"])
    w = Window.partitionBy("template").orderBy("run")
    before = w.rowsBetween(-rounds, -1)
    base = lambda n: F.floor((F.sum(n).over(before) * 2 + F.count(n).over(before)) / (F.count(n).over(before) * 2)).cast("long")
    x = per.withColumns({f"base_{n}": base(n) for n in names.values()} | {"seen": F.count("*").over(before), "last_plan": F.lag("plan").over(w)})
    x = x.where((F.col("seen") >= samples) & (F.col("time") >= F.greatest(F.col("base_time") * factor, F.col("base_time") + at_least_ms)))
    more = lambda n: F.col(n) >= F.greatest(F.col(f"base_{n}"), F.lit(1)) * grown
    slower = F.col("time") - F.col("base_time")
    growth = lambda n: F.least(ratio((F.col(n) - F.col(f"base_{n}")).cast("double") * F.greatest("base_time", F.lit(1)), F.greatest(F.col(f"base_{n}"), F.lit(1)).cast("double") * slower), F.lit(1.0))
    fits = {"INPUT": more("input"), "SHUFFLE": more("shuffle"), "SKEW": more("skew"), "PLAN": F.col("plan") != F.col("last_plan"), "QUEUE": more("wait")}
    part = {"INPUT": growth("input"), "SHUFFLE": growth("shuffle"), "SKEW": growth("skew"), "PLAN": F.lit(1.0), "QUEUE": F.least(ratio(F.col("wait") - F.col("base_wait"), slower), F.lit(1.0))}
    cause, share = F.lit("UNEXPLAINED"), F.lit(0.0)
    for step in reversed(STEPS):
        cause, share = F.when(fits[step], step).otherwise(cause), F.when(fits[step], part[step]).otherwise(share)
    return x.select("template", "run", "time", "base_time", "seen", (F.col("plan") != F.col("last_plan")).alias("plan_changed"), cause.alias("cause"), share.alias("share"))


# ---- contexts with all their inputs ----
def heap_ratios(heaps: DataFrame, memory: DataFrame) -> DataFrame:
    """(app_id, stage_id, heap_peak_ratio): the fullest heap of each stage. heaps: app_id, stage_id, peak_bytes; memory: app_id, memory_bytes."""
    x = heaps.groupBy("app_id", F.col("stage_id").cast("long").alias("stage_id")).agg(F.max("peak_bytes").alias("peak")).join(memory, "app_id")
    return x.select("app_id", "stage_id", ratio(F.col("peak"), F.col("memory_bytes")).alias("heap_peak_ratio"))


def stage_evidence(contexts: DataFrame, heap: DataFrame, flags: DataFrame, path: DataFrame) -> DataFrame:
    """Stage contexts with the fullest heap (heap_ratios), the execution's codegen_gap and the stage's share of the longest path."""
    x = contexts.join(heap, ["app_id", "stage_id"], "left").join(flags.select(*SQL, "codegen_gap"), SQL, "left")
    return x.join(path.select(*STAGE, F.col("share").alias("path_share")), STAGE, "left").withColumn("path_share", F.coalesce("path_share", F.lit(0.0)))


def execution_evidence(contexts: DataFrame, metrics: DataFrame, path: DataFrame, reads: DataFrame, baselines: DataFrame) -> DataFrame:
    """Execution contexts with plan metrics (sql_plan_metrics by app_id), the part of the longest path in stages that read shuffles
    (join_path_share; reads: stages with read_sum), and how its template's run stands (baselines: app_id, execution_id, p50_ms, ...)."""
    joins = path.join(reads.where("read_sum > 0").select(*STAGE), STAGE, "left_semi").groupBy(*SQL).agg(F.round(F.sum("share"), 6).alias("join_path_share"))
    x = contexts.join(metrics, SQL, "left").join(joins, SQL, "left").withColumn("join_path_share", F.coalesce("join_path_share", F.lit(0.0)))
    return x.join(baselines, SQL, "left")


def queue_evidence(bucket_cores: DataFrame, monopolies: DataFrame, systemic: DataFrame, heap_hours: DataFrame, small_files: DataFrame, drift: DataFrame, fetches: DataFrame, offsets: DataFrame, cores: int, share: float = 0.6, width: int = MINUTE) -> DataFrame:
    """One row an application with what Q-04, Q-07, Q-10, Q-11, Q-13, Q-18 and DQ-02 look at.

    monopolies: monopoly_windows; systemic: systemic_windows; heap_hours: app_id, heap_slope, heap_first_quartile; small_files: findings of S-05
    and S-06; drift: app_id, p50_ratio, regressed_share; fetches: fetch_verdict; offsets: clock_offsets.
    """
    app = "app_id"
    n = bucket_cores.where("core_ms > 0").groupBy(app, "b").agg(F.count("*").alias("active"), F.max("core_ms").alias("most"))
    held = n.where(F.col("most") >= share * cores * width).groupBy(app).agg(ratio(F.max("most"), F.lit(cores * width)).alias("monopoly_share"), F.max("active").alias("monopoly_active"))
    parts = [
        monopolies.groupBy(app).agg(F.max("minutes").alias("monopoly_minutes")), held,
        systemic.groupBy(app).agg(F.max("median_norm").alias("systemic_norm"), F.max("active").alias("systemic_active")),
        heap_hours.select(app, "heap_slope", "heap_first_quartile"), small_files.groupBy(app).agg(F.count_distinct("execution_id").alias("small_file_queries")),
        drift.select(app, "p50_ratio", "regressed_share"), fetches.select(app, "fetch_failures", "fetch_row_share", "fetch_rack_share", "fetch_diffuse"),
        offsets.groupBy(app).agg(F.max(F.abs("offset_ms")).alias("clock_skew_ms"), F.sum("negative").alias("negative_durations")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, app, "full")
    return out
