"""Closed-form estimates for other partition and core counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.stages import half_up


def whatif_cores(metrics: DataFrame, cores: int, factors: tuple[float, ...] = (0.25, 0.5, 1.0, 1.5, 2.0, 4.0), gain: float = 0.05) -> DataFrame:
    """Estimated time of every execution for other core counts, and the count after which more gains less than `gain`.

    A stage takes its longest task, or its waves of mean tasks if that is longer; an execution takes the sum.
    """
    counts = sorted({max(1, int(cores * f + 0.5)) for f in factors})
    x = metrics.select("app_id", "execution_id", "run_max", "run_sum", "attempts", F.explode(F.array(*[F.lit(c) for c in counts])).alias("cores"))
    waves = F.ceil(F.col("attempts") / F.col("cores")) * F.col("run_sum") / F.col("attempts")
    x = x.groupBy("app_id", "execution_id", "cores").agg(F.sum(F.greatest(F.col("run_max"), half_up(waves))).alias("estimate_ms"))
    w = Window.partitionBy("app_id", "execution_id").orderBy("cores")
    x = x.withColumn("next", F.lead("estimate_ms").over(w))
    small = (F.col("estimate_ms") - F.col("next")) / F.col("estimate_ms") < gain
    knee = F.coalesce(F.min(F.when(small, F.col("cores"))).over(Window.partitionBy("app_id", "execution_id")), F.lit(counts[-1]))
    return x.select("app_id", "execution_id", "cores", "estimate_ms", knee.alias("knee_cores"))


def whatif_partitions(stats: DataFrame, cores: int, memory: int, factors: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """Best number of shuffle partitions of every stage with a shuffle, and which way the present one is off.

    T(p) = ceil(p / cores) * (overhead + bytes per task / rate + spill); a fifth of the median task is overhead, the
    rest gives the rate; what exceeds a task's memory is written and read once more. The bytes are those read or those
    written, whichever are more. Stages whose skew in time or in bytes read is 5 or more are limited by that, so they
    get no estimate.
    """
    now = F.col("n")
    s = stats.withColumns({"median": F.greatest("run_p50", F.lit(1)), "skew": F.greatest(*[F.when(F.col(f"{m}_p50") > 0, F.col(f"{m}_max") / F.col(f"{m}_p50")).otherwise(0.0) for m in ("run", "read")]), "bytes": F.greatest("read_sum", "write_sum")})
    options = F.array_distinct(F.concat(F.array(*[F.greatest(half_up(now * f), F.lit(1)) for f in factors]), F.array(*[F.lit(cores * k).cast("long") for k in (1, 2, 4)])))
    x = s.where("bytes > 0 and skew < 5").select("app_id", "execution_id", "stage_id", "n", "median", "bytes", F.posexplode(options).alias("place", "p"))
    rate = (F.col("bytes") / now) / (0.8 * F.col("median"))
    b = F.col("bytes") / F.col("p")
    cost = F.ceil(F.col("p") / cores) * (0.2 * F.col("median") + b / rate + 2 * F.greatest(b - memory, F.lit(0.0)) / rate)
    x = x.withColumn("ms", half_up(cost))
    best = x.groupBy("app_id", "execution_id", "stage_id", "n").agg(F.min_by(F.struct("p", "ms"), F.struct("ms", "place")).alias("best"), F.min(F.when(F.col("p") == now, F.col("ms"))).alias("now_ms"))
    way = F.when(F.col("best.p") > now, "FASTER_IF_INCREASED").when(F.col("best.p") < now, "FASTER_IF_DECREASED").otherwise("ALREADY_OPTIMAL")
    found = best.select("app_id", "execution_id", "stage_id", now.alias("partitions"), F.col("best.p").alias("best_partitions"), F.col("best.ms").alias("best_ms"), "now_ms", way.alias("direction"))
    rest = s.where("not (bytes > 0 and skew < 5)").select("app_id", "execution_id", "stage_id", now.alias("partitions"), F.lit(None).cast("long").alias("best_partitions"), F.lit(None).cast("long").alias("best_ms"), F.lit(None).cast("long").alias("now_ms"), F.when(F.col("skew") >= 5, "SKEW_LIMITED").otherwise("ALREADY_OPTIMAL").alias("direction"))
    return found.unionByName(rest)
