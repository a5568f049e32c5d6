"""Sweeps over task intervals: occupancy, buckets and contention. Intervals are half-open; times are milliseconds.

A sweep never has one application as its smallest unit: tasks are cut at bucket edges first, so that the running sums
are per (app, bucket) and a very large application is dealt over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.stages import mean_of, micros, ratio

SQL = ["app_id", "execution_id"]


def core_timeline(events: DataFrame) -> DataFrame:
    """Segments [start, end) of an application's cores from executor events: the running sum never falls below 0; the last segment is open (end null)."""
    net = events.groupBy("app_id", "time_ms").agg(F.sum(F.when(F.col("added"), F.col("cores")).otherwise(-F.col("cores"))).alias("d"))
    w = Window.partitionBy("app_id").orderBy("time_ms")
    s = net.withColumn("s", F.sum("d").over(w)).withColumn("low", F.min("s").over(w))
    return s.select("app_id", F.col("time_ms").alias("start_ms"), F.lead("time_ms").over(w).alias("end_ms"), (F.col("s") - F.least(F.col("low"), F.lit(0))).alias("cores"))


def peak_cores(events: DataFrame, configured: int) -> DataFrame:
    return core_timeline(events).groupBy("app_id").agg(F.greatest(F.max("cores"), F.lit(configured)).cast("long").alias("cores"))


def capacity_core_ms(execs: DataFrame, events: DataFrame, configured: int = 4, width: int = 3_600_000) -> DataFrame:
    """Cores integrated over each execution's window; `configured` cores where an application's log has no executor events.

    What was there up to a time is the sum of all buckets before it and a part of its own, so an execution meets only the
    segments of the two buckets in which it starts and ends, however many executors come and go in its application.
    """
    done = execs.where("end_ms > start_ms").select(*SQL, "start_ms", "end_ms")
    seg = core_timeline(events).join(done.groupBy("app_id").agg(F.max("end_ms").alias("last")), "app_id")
    seg = seg.select("app_id", F.col("start_ms").alias("a"), F.least("end_ms", "last").alias("z"), "cores").where("z > a")
    seg = seg.withColumn("b", F.explode(F.sequence(F.expr(f"a div {width}"), F.expr(f"(z - 1) div {width}"))))
    seg = seg.withColumns({"a": F.greatest("a", F.col("b") * width), "z": F.least("z", (F.col("b") + 1) * width)})
    w = Window.partitionBy("app_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = seg.groupBy("app_id", "b").agg(F.sum(F.col("cores") * (F.col("z") - F.col("a"))).alias("n"))
    before = sums.select("app_id", "b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"))
    ends = F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("end_ms").alias("t"), F.lit(1).alias("sign")))).alias("p")
    ends = done.select(*SQL, ends).select(*SQL, "p.*", F.expr(f"(p.t - 1) div {width}").alias("b"))
    part = F.greatest(F.least("z", "t") - F.col("a"), F.lit(0)) * F.col("cores")
    x = ends.join(before, ["app_id", "b"]).select(*SQL, (F.col("sign") * F.col("n")).alias("n"))
    x = x.unionByName(ends.join(seg, ["app_id", "b"]).select(*SQL, (F.col("sign") * part).alias("n"))).groupBy(*SQL).agg(F.sum("n").alias("n"))
    known = events.select("app_id", F.lit(True).alias("known")).distinct()
    flat = (F.col("end_ms") - F.col("start_ms")) * configured
    return done.join(x, SQL, "left").join(known, "app_id", "left").select(*SQL, F.when(F.col("known"), F.coalesce("n", F.lit(0))).otherwise(flat).alias("capacity_core_ms"))


def core_utilization(execs: DataFrame, events: DataFrame, tasks: DataFrame) -> DataFrame:
    run = tasks.groupBy(*SQL).agg(F.sum("run_ms").alias("task_ms"))
    c = capacity_core_ms(execs, events).join(run, SQL)
    return c.select(*SQL, "task_ms", "capacity_core_ms", ratio(F.col("task_ms"), F.col("capacity_core_ms")).alias("utilization"))


def _edges(tasks: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Net change of the number of running tasks at each time, by keys."""
    both = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))))
    x = tasks.where(F.col(end) > F.col(start)).select(*keys, both.alias("e")).select(*keys, "e.t", "e.d")
    return x.groupBy(*keys, "t").agg(F.sum("d").alias("d"))


def sql_max_concurrency(tasks: DataFrame, width: int = 60_000) -> DataFrame:
    """Most tasks of an execution at once: its sweep is dealt over buckets, and the largest of their maxima is the whole's."""
    w = Window.partitionBy(*SQL, "b").orderBy("t")
    return _edges(cut_tasks(tasks, width), [*SQL, "b"], "a", "z").withColumn("n", F.sum("d").over(w)).groupBy(*SQL).agg(F.max("n").alias("max_tasks"))


def sql_avg_concurrency(tasks: DataFrame, execs: DataFrame) -> DataFrame:
    """Mean simultaneous tasks over an execution's window: clipped overlaps over its length, no sweep needed."""
    e = execs.where("end_ms > start_ms").select(*SQL, "start_ms", "end_ms")
    part = F.greatest(F.least("finish_ms", "end_ms") - F.greatest("launch_ms", "start_ms"), F.lit(0))
    x = tasks.join(e, SQL).groupBy(*SQL).agg(F.sum(part).alias("busy"), F.first(F.col("end_ms") - F.col("start_ms")).alias("wall"))
    return x.select(*SQL, ratio(F.col("busy"), F.col("wall")).alias("avg_tasks"))


def cut_tasks(tasks: DataFrame, width: int) -> DataFrame:
    """Each task once for every bucket that it touches, with its part [a, z) there."""
    b = F.explode(F.sequence(F.expr(f"launch_ms div {width}"), F.expr(f"(finish_ms - 1) div {width}")))
    x = tasks.where("launch_ms > 0 and finish_ms > launch_ms").withColumn("b", b)
    return x.withColumns({"a": F.greatest("launch_ms", F.col("b") * width), "z": F.least("finish_ms", (F.col("b") + 1) * width)})


def occupancy_segments(tasks: DataFrame, cores: int, width: int = 60_000) -> DataFrame:
    """Busy cores of an application as segments within buckets, capped at its pool."""
    w = Window.partitionBy("app_id", "b").orderBy("t")
    x = _edges(cut_tasks(tasks, width), ["app_id", "b"], "a", "z")
    x = x.withColumn("n", F.sum("d").over(w)).withColumn("next", F.lead("t").over(w)).where("n > 0 and next is not null")
    return x.select("app_id", "b", F.col("t").alias("start_ms"), F.col("next").alias("end_ms"), F.least("n", F.lit(cores)).alias("busy"))


def sql_own_core_ms(tasks: DataFrame, cores: int, width: int = 60_000) -> DataFrame:
    """Core time that each execution holds, capped at the pool; its sweep is dealt over buckets."""
    w = Window.partitionBy(*SQL, "b").orderBy("t")
    x = _edges(cut_tasks(tasks, width), [*SQL, "b"], "a", "z").withColumn("n", F.sum("d").over(w)).withColumn("next", F.lead("t").over(w)).where("next is not null")
    return x.groupBy(*SQL).agg(F.sum(F.least("n", F.lit(cores)) * (F.col("next") - F.col("t"))).alias("own_core_ms"))


def queue_window(execs: DataFrame, tasks: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """From the first start to the last end of executions and tasks; where apps (app_id, start_ms, end_ms, each null if unknown) is
    given, an application's own start and end widen its window, and an application without executions has one too."""
    t = tasks.groupBy("app_id").agg(F.max("finish_ms").alias("last"))
    e = execs.groupBy("app_id").agg(F.min(F.when(F.col("start_ms") > 0, F.col("start_ms"))).alias("window_start"), F.max(F.greatest("end_ms", "start_ms")).alias("end"))
    if apps is None:
        return e.join(t, "app_id").select("app_id", "window_start", F.greatest("end", "last").alias("window_end"))
    own = apps.select("app_id", F.when(F.col("start_ms") > 0, F.col("start_ms")).alias("app_start"), F.when(F.col("end_ms") > 0, F.col("end_ms")).alias("app_end"))
    x = e.join(t, "app_id", "full").join(own, "app_id", "full")
    return x.select("app_id", F.least("app_start", "window_start").alias("window_start"), F.greatest("app_end", "end", "last").alias("window_end"))


def spine(window: DataFrame, width: int) -> DataFrame:
    """All buckets of each application's window, empty ones too, with the length of the window in them."""
    b = F.explode(F.sequence(F.expr(f"window_start div {width}"), F.expr(f"(window_end - 1) div {width}"))).alias("b")
    x = window.where("window_end > window_start").select("app_id", "window_start", "window_end", b)
    return x.select("app_id", "b", (F.least("window_end", (F.col("b") + 1) * width) - F.greatest("window_start", F.col("b") * width)).alias("span_ms"))


def bucket_utilization(tasks: DataFrame, execs: DataFrame, cores: int, width: int = 60_000, segments: DataFrame | None = None) -> DataFrame:
    """Busy core time of all buckets of each application's window. segments: those of occupancy_segments, where they are written already."""
    seg = occupancy_segments(tasks, cores, width) if segments is None else segments
    busy = seg.groupBy("app_id", "b").agg(F.sum(F.col("busy") * (F.col("end_ms") - F.col("start_ms"))).alias("busy_core_ms"))
    x = spine(queue_window(execs, tasks), width).join(busy, ["app_id", "b"], "left")
    used = F.coalesce("busy_core_ms", F.lit(0))
    return x.select("app_id", (F.col("b") * width).alias("bucket_ms"), used.alias("busy_core_ms"), ratio(used, F.col("span_ms") * cores).alias("utilization"))


def bucket_task_metrics(tasks: DataFrame, width: int = 60_000) -> DataFrame:
    """Per bucket each task's share of its times by overlap (rounded half up), and attempts counted where they were launched."""
    share = (F.col("z") - F.col("a")) / (F.col("finish_ms") - F.col("launch_ms"))
    part = lambda c: F.sum(F.floor(c * share + 0.5).cast("long"))
    here = F.col("a") == F.col("launch_ms")
    run = F.when(F.col("run_ms") > 0, F.col("run_ms")).otherwise(F.col("finish_ms") - F.col("launch_ms"))
    x = cut_tasks(tasks, width).groupBy("app_id", "b").agg(
        part(run).alias("run_ms"), part(F.col("cpu_ns")).alias("cpu_ns"), part(F.col("fetch_wait_ms")).alias("fetch_ms"), part(F.col("gc_ms")).alias("gc_ms"),
        F.count_if(here).alias("attempts"), F.count_if(here & F.col("failed")).alias("failed"), F.count_if(here & F.col("speculative")).alias("speculative"),
    )
    eff = F.least(F.lit(1.0), ratio(F.col("cpu_ns") / 1e6, F.col("run_ms")))
    return x.withColumns({"cpu_efficiency": eff, "bucket_ms": F.col("b") * width}).drop("b")


def bucket_peak_tasks(tasks: DataFrame, width: int = 60_000) -> DataFrame:
    w = Window.partitionBy("app_id", "b").orderBy("t")
    x = _edges(cut_tasks(tasks, width), ["app_id", "b"], "a", "z").withColumn("n", F.sum("d").over(w))
    return x.groupBy("app_id", (F.col("b") * width).alias("bucket_ms")).agg(F.max("n").alias("peak_tasks"))


def query_contention(tasks: DataFrame, execs: DataFrame, light: DataFrame, cores: int, width: int = 60_000, segments: DataFrame | None = None) -> DataFrame:
    """Pool utilisation in each execution's window, its own share of the busy time, and whether it is limited or inefficient.

    Whole buckets of a window join the buckets' sums; only its two edge buckets join segments and clip them. segments: those of
    occupancy_segments, where they are written already.
    """
    seg = occupancy_segments(tasks, cores, width) if segments is None else segments
    sums = seg.groupBy("app_id", "b").agg(F.sum(F.col("busy") * (F.col("end_ms") - F.col("start_ms"))).alias("busy"))
    done = execs.where("end_ms > start_ms").select(*SQL, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    x = done.withColumn("b", F.explode(F.sequence(F.expr(f"s div {width}"), F.expr(f"(e - 1) div {width}"))))
    whole = (F.col("b") * width >= F.col("s")) & ((F.col("b") + 1) * width <= F.col("e"))
    full = x.where(whole).join(sums, ["app_id", "b"]).select(*SQL, "busy")
    clip = F.greatest(F.least("e", "end_ms") - F.greatest("s", "start_ms"), F.lit(0)) * F.col("busy")
    edge = x.where(~whole).join(seg, ["app_id", "b"]).select(*SQL, clip.alias("busy"))
    pool = full.unionByName(edge).groupBy(*SQL).agg(F.sum("busy").alias("pool_core_ms"))
    y = done.join(pool, SQL, "left").join(sql_own_core_ms(tasks, cores), SQL, "left").join(light.select(*SQL, "fetch_ratio", "max_gc", "failed_attempts", "extra_attempts"), SQL, "left")
    pool_, own = F.coalesce("pool_core_ms", F.lit(0)), F.coalesce("own_core_ms", F.lit(0))
    y = y.withColumns({"pool_utilization": ratio(pool_, (F.col("e") - F.col("s")) * cores), "own_share": ratio(own, pool_), "own_core_ms": own})
    busy = F.col("pool_utilization") >= 0.85
    bad = (F.col("fetch_ratio") >= 0.2) | (F.col("max_gc") >= 0.1) | (F.col("failed_attempts") > 0) | (F.col("extra_attempts") > 0)
    return y.select(*SQL, "pool_utilization", "own_share", "own_core_ms", (busy & (F.col("own_share") <= 0.5) & (own > 0)).alias("limited"), (busy & F.coalesce(bad, F.lit(False))).alias("inefficient"))


def runs_of_buckets(buckets: DataFrame, condition: Column, width: int) -> DataFrame:
    """Consecutive buckets that meet the condition: start, buckets and minutes of each run."""
    w = Window.partitionBy("app_id").orderBy("bucket_ms")
    x = buckets.where(condition).withColumn("island", F.col("bucket_ms") - F.row_number().over(w) * width)
    return x.groupBy("app_id", "island").agg(F.min("bucket_ms").alias("start_ms"), F.count("*").alias("buckets"), (F.count("*") * width / 60_000).alias("minutes")).drop("island")


def longest_run_of_buckets(buckets: DataFrame, width: int = 60_000, idle: float = 0.2, overload: float = 0.95) -> DataFrame:
    i = runs_of_buckets(buckets, F.col("utilization") < idle, width).groupBy("app_id").agg(F.max("minutes").alias("idle_minutes"))
    o = runs_of_buckets(buckets, F.col("utilization") > overload, width).groupBy("app_id").agg(F.max("minutes").alias("overload_minutes"))
    apps = buckets.select("app_id").distinct()
    return apps.join(i, "app_id", "left").join(o, "app_id", "left").na.fill(0.0)


def latency_timeline(execs: DataFrame, tasks: DataFrame, cores: int, width: int = 300_000) -> DataFrame:
    """Per bucket of an application's window, empty ones too: completed executions that started in it, nearest-rank
    quantiles of their durations, utilisation, and the task times and attempts of the bucket."""
    d = execs.where("end_ms > start_ms").select("app_id", F.expr(f"start_ms div {width} * {width}").alias("bucket_ms"), (F.col("end_ms") - F.col("start_ms")).alias("d"))
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by d)").cast("long")
    d = d.groupBy("app_id", "bucket_ms").agg(F.count("*").alias("completed"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))
    x = bucket_utilization(tasks, execs, cores, width).join(d, ["app_id", "bucket_ms"], "left").join(bucket_task_metrics(tasks, width), ["app_id", "bucket_ms"], "left")
    return x.na.fill(0, ["completed", "run_ms", "cpu_ns", "fetch_ms", "gc_ms", "attempts", "failed", "speculative"])


def occupancy_rollup(tasks: DataFrame, execs: DataFrame, jobs: DataFrame, cores: int, widths: tuple[int, ...] = (60_000, 300_000, 900_000), base: int = 10_000) -> DataFrame:
    """Base buckets rolled up to wider ones: mean and maximum utilisation and the share of busy buckets; executions
    submitted (by start), completed and failed (by the last bucket they touch), active ones (each once a bucket that it
    touches; one without an end stays active to the end of the window), and bytes that the tasks launched there read.

    Everything is summed by base bucket first, so only these sums are dealt to the widths.
    """
    wide = F.explode(F.array(*[F.lit(w).cast("long") for w in widths])).alias("width_ms")
    here = lambda t: F.expr(f"{t} div width_ms * width_ms")
    key = ["app_id", "width_ms", "bucket_ms"]
    use = bucket_utilization(tasks, execs, cores, base).select("app_id", F.col("bucket_ms").alias("t"), "utilization", wide)
    use = use.groupBy("app_id", "width_ms", here("t").alias("bucket_ms")).agg(mean_of(micros("utilization")).alias("mean"), F.max("utilization").alias("peak"), ratio(F.count_if(F.col("utilization") >= 0.85), F.count("*")).alias("busy_ratio"))
    done = execs.where("end_ms > start_ms").join(jobs.groupBy(*SQL).agg(F.bool_or("failed").alias("failed")), SQL, "left")
    marks = {"submitted": F.lit(0), "completed": F.lit(0), "failed": F.lit(0), "bytes": F.lit(0)}
    row = lambda df, t, **c: df.select("app_id", F.expr(f"({t}) div {base} * {base}").alias("t"), *[x.cast("long").alias(k) for k, x in (marks | c).items()])
    x = row(execs, "start_ms", submitted=F.lit(1)).unionByName(row(done, "end_ms - 1", completed=F.lit(1), failed=F.coalesce("failed", F.lit(False)).cast("int")))
    x = x.unionByName(row(tasks, "launch_ms", bytes=F.col("input_bytes") + F.col("shuffle_read_bytes")))
    sums = lambda df, *by: df.groupBy("app_id", *by).agg(*[F.sum(k).alias(k) for k in marks])
    events = sums(sums(x, "t").select("*", wide), "width_ms", here("t").alias("bucket_ms"))
    e = execs.join(queue_window(execs, tasks), "app_id").select("app_id", "start_ms", F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("window_end")).alias("z"), wide).where("z > start_ms")
    active = e.select("app_id", "width_ms", F.explode(F.expr("sequence(start_ms div width_ms, (z - 1) div width_ms)")).alias("b")).groupBy("app_id", "width_ms", (F.col("b") * F.col("width_ms")).alias("bucket_ms")).agg(F.count("*").alias("active"))
    return use.join(events, key, "left").join(active, key, "left").na.fill(0, [*marks, "active"])
