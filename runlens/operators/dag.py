"""Longest paths over the stages of an execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _longest(stages: DataFrame, weight: Column, name: str) -> DataFrame:
    """Longest path by weight; parents outside the execution are left out.

    One row per stage of an execution is few, so a fold over its stages in the order of their ids does it: parents
    come before children.
    """
    node = F.struct("stage_id", weight.cast("long").alias("w"), "parent_ids")
    rows = stages.groupBy("app_id", "execution_id").agg(F.array_sort(F.collect_list(node)).alias("s"))
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))

    def step(m: Column, x: Column) -> Column:
        above = F.array_max(F.transform(x["parent_ids"], lambda p: F.coalesce(F.element_at(m, p), F.lit(0).cast("long"))))
        return F.map_concat(m, F.map_from_arrays(F.array(x["stage_id"]), F.array(x["w"] + F.coalesce(above, F.lit(0).cast("long")))))

    done = F.aggregate("s", empty, step, lambda m: F.array_max(F.map_values(m)))
    return rows.select("app_id", "execution_id", done.alias(name))


def _with_parents(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    t = tasks.groupBy("app_id", "execution_id", "stage_id").agg(F.max("run_ms").alias("longest"), F.sum("run_ms").alias("total"))
    return stages.select("app_id", "execution_id", "stage_id", "parent_ids").join(t, ["app_id", "execution_id", "stage_id"])


def critical_path_ms(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Longest path where a stage weighs as much as its longest task."""
    return _longest(_with_parents(stages, tasks), F.col("longest"), "critical_ms")


def longest_by_profile(profile: DataFrame) -> DataFrame:
    """critical_path_ms from the profiles of stages."""
    x = profile.where("n is not null and num_tasks is not null")
    return _longest(x.select("app_id", "execution_id", "stage_id", "parent_ids", F.col("run_max").alias("longest")), F.col("longest"), "critical_ms")


def ideal_time_ms(stages: DataFrame, tasks: DataFrame, cores: int) -> DataFrame:
    """Longest path where a stage weighs as much as its task time spread evenly over the cores."""
    return _longest(_with_parents(stages, tasks), F.expr(f"total div {cores}"), "ideal_ms")


def critical_path_stages(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """The stages on the longest path of each execution with their weight and share; of equal parents the smaller id."""
    return _on_path(_with_parents(stages, tasks))


def path_by_profile(profile: DataFrame) -> DataFrame:
    """critical_path_stages from the profiles of stages."""
    x = profile.where("n is not null and num_tasks is not null")
    return _on_path(x.select("app_id", "execution_id", "stage_id", "parent_ids", F.col("run_max").alias("longest")))


def _on_path(stages: DataFrame) -> DataFrame:
    node = F.struct("stage_id", F.col("longest").cast("long").alias("w"), "parent_ids")
    rows = stages.groupBy("app_id", "execution_id").agg(F.array_sort(F.collect_list(node)).alias("s"))
    zero, kind = F.lit(0).cast("long"), "map<bigint,struct<dist:bigint,before:bigint,w:bigint>>"

    def step(m: Column, x: Column) -> Column:
        known = F.filter(x["parent_ids"], lambda p: F.map_contains_key(m, p))
        best = F.array_max(F.transform(known, lambda p: F.struct(F.element_at(m, p)["dist"].alias("d"), (-p).alias("p"))))
        row = F.struct((x["w"] + F.coalesce(best["d"], zero)).alias("dist"), (-best["p"]).alias("before"), x["w"].alias("w"))
        return F.map_concat(m, F.map_from_arrays(F.array(x["stage_id"]), F.array(row))).cast(kind)

    x = rows.withColumn("m", F.aggregate("s", F.map_from_entries(F.array().cast("array<struct<key:bigint,value:struct<dist:bigint,before:bigint,w:bigint>>>")), step))
    last = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"]["dist"].alias("d"), (-e["key"]).alias("k"))))
    x = x.withColumns({"total": last["d"], "last": -last["k"]})
    walk = lambda a, _: F.when(a["at"].isNull(), a).otherwise(F.struct(F.element_at(F.col("m"), a["at"])["before"].alias("at"), F.concat(a["path"], F.array(a["at"])).alias("path")))
    path = F.aggregate("s", F.struct(F.col("last").alias("at"), F.array().cast("array<bigint>").alias("path")), walk, lambda a: a["path"])
    x = x.select("app_id", "execution_id", "m", "total", F.explode(path).alias("stage_id"))
    w = F.element_at("m", F.col("stage_id"))["w"]
    return x.select("app_id", "execution_id", "stage_id", w.alias("ms"), F.round(F.when(F.col("total") > 0, w / F.col("total")).otherwise(0.0), 6).alias("share"))


def path_deviation(execs: DataFrame, critical: DataFrame) -> DataFrame:
    from runlens.operators.stages import ratio

    wall = F.when(F.col("end_ms") > 0, F.col("end_ms") - F.col("start_ms")).otherwise(0)
    return execs.join(critical, ["app_id", "execution_id"]).select("app_id", "execution_id", ratio(wall - F.col("critical_ms"), F.col("critical_ms")).alias("deviation"))
