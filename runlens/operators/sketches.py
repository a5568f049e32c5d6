"""Distributions as mergeable sketches: kept a stage or a run, joined later without the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import template_hash
from runlens.operators.intervals import SQL
from runlens.operators.stages import METRICS, POINTS

#: Size of a sketch; a quantile's rank is off by at most 0.01 with a chance of 99 %.
K = 400


def metric_sketches(tasks: DataFrame, keys: list[str], metrics: dict[str, str] = METRICS, k: int = K) -> DataFrame:
    """A KLL sketch of each metric for each key, built before the shuffle in every task and merged after it; negatives count as 0."""
    return tasks.groupBy(*keys).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_bigint(F.greatest(F.col(c), F.lit(0)).cast("long"), F.lit(k)).alias(m) for m, c in metrics.items()])


def merged_sketches(sketches: DataFrame, keys: list[str], metrics: tuple[str, ...] = tuple(METRICS), k: int = K) -> DataFrame:
    """Sketches of coarser keys from stored ones, e.g. of applications from those of stages, or of months from those of runs."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_bigint(m, F.lit(k)).alias(m) for m in metrics])


def sketch_points(sketches: DataFrame, keys: list[str], metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """The quantiles of POINTS of each sketched metric: keys, n, <metric>_<point>; null for a sketch of nothing."""

    def point(m: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_bigint(m) > 0, F.kll_sketch_get_quantile_bigint(m, F.lit(q))).alias(m)

    return sketches.select(*keys, "n", *[point(m, q).alias(f"{m}_{name}") for m in metrics for name, q in POINTS.items()])


def rank_errors(points: DataFrame, tasks: DataFrame, keys: list[str], metrics: dict[str, str]) -> DataFrame:
    """(keys, n, worst): how far the rank of any point lies from where it should be, measured on all tasks. A point's rank is any
    share between those of the values below it and of those up to it."""
    x = tasks.join(points, keys)
    bad = []
    for m, c in metrics.items():
        v = F.greatest(F.col(c), F.lit(0))
        for name, q in POINTS.items():
            low, high = F.count_if(v < F.col(f"{m}_{name}")) / F.count("*"), F.count_if(v <= F.col(f"{m}_{name}")) / F.count("*")
            bad.append(F.greatest(low - q, q - high, F.lit(0.0)))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(*bad, F.lit(0.0)).alias("worst"))


def baseline_sketches(light: DataFrame, execs: DataFrame, run: Column, k: int = K) -> DataFrame:
    """(template, run, n, duration): the sketched times of each run of a template, to be kept with baseline_history. A baseline over
    any runs is then merged_sketches of them by template: its median is that of all their executions, not of their medians."""
    e = execs.select(*SQL, template_hash(F.col("description")).alias("template"), run.alias("run"))
    x = light.where("duration_ms > 0 and not running").join(e, SQL)
    return metric_sketches(x, ["template", "run"], {"duration": "duration_ms"}, k)
