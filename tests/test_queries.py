"""Spark rows against DuckDB rows on the smallest tables, and operators against values worked out by hand."""

import random

import duckdb
import pytest

from runlens.functions import text
from runlens.operators import intervals
from runlens.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return repr(round(x, 5) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        return
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    rel = con.sql(SQL[name])
    assert got or name in ("partial_stages", "starvation_windows")  # these find nothing in the smallest tables
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["occupancy_rollup", "host_score", "sql_queue_context"])
def test_same_values_to_the_last_digit(spark, name):
    sf = SF.replace("0.001", "0.01")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[k]) for k in at) for r in rel.fetchall())


def test_sweep_against_brute_force(spark):
    rng = random.Random(3)
    tasks = []
    for k in range(60):
        a = rng.randint(1, 400_000)
        tasks.append(("a", k % 3, k, a, a + rng.randint(1, 200_000)))
    df = spark.createDataFrame(tasks, "app_id string, execution_id long, task_id long, launch_ms long, finish_ms long")
    got = sum(r["busy"] * (r["end_ms"] - r["start_ms"]) for r in intervals.occupancy_segments(df, 4).collect())
    edges = sorted({x for t in tasks for x in t[3:]})
    want = sum(min(4, sum(t[3] <= a and t[4] >= z for t in tasks)) * (z - a) for a, z in zip(edges, edges[1:]))
    assert got == want
    peak = max(r["max_tasks"] for r in intervals.sql_max_concurrency(df.withColumn("execution_id", df.execution_id * 0)).collect())
    assert peak == max(sum(t[3] <= x < t[4] for t in tasks) for x in edges)


def test_texts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("/*  a \n b */ select 1",), ("select '/* x */'",), ("/* */ select",), (None,)], "t string")
    assert [r[0] for r in df.select(text.statement_id(F.col("t"))).collect()] == ["a b", None, None, None]
    df = spark.createDataFrame([("64m",), ("x",), (None,), ("4g",)], "t string")
    assert [r[0] for r in df.select(text.size_bytes(F.col("t"), 7)).collect()] == [64 << 20, 7, 7, 4 << 30]
    df = spark.createDataFrame([("15m",), ("1h",), ("3600s",), ("5ms",), ("x",)], "t string")
    assert [r[0] for r in df.select(text.duration_ms(F.col("t"))).collect()] == [900_000, 3_600_000, 3_600_000, 60_000, None]


def test_core_timeline_never_negative(spark):
    events = [("a", 10, 2, False), ("a", 20, 4, True), ("a", 30, 4, False), ("a", 40, 2, True)]
    df = spark.createDataFrame(events, "app_id string, time_ms long, cores long, added boolean")
    assert [r["cores"] for r in intervals.core_timeline(df).orderBy("start_ms").collect()] == [0, 4, 0, 2]
