"""Ratios at a tie of the seventh digit: Spark and the SQL round them half up."""

import duckdb

from pyspark.sql import functions as F

from runlens.operators.stages import micros, ratio
from runlens.plans.queries import UTIL, _whole_ratio


def test_ratios_of_whole_numbers_round_half_up(spark):
    n = 240_000  # core milliseconds of a bucket of four cores
    got = spark.range(n + 1).withColumn("r", ratio(F.col("id"), F.lit(n))).select("id", micros("r").alias("m"))
    sql = dict(duckdb.sql(f"SELECT u, round({_whole_ratio('u', str(n))} * 1000000)::BIGINT FROM range({n + 1}) t(u)").fetchall())
    want = {u: (2_000_000 * u + n) // (2 * n) for u in range(n + 1)}
    assert sql == want and {r.id: r.m for r in got.collect()} == want
    assert _whole_ratio("coalesce(busy, 0)", "span * 4") in UTIL
