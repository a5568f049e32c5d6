"""Sweeps that are dealt over buckets, against values worked out over whole windows."""

import random

from runlens.operators import features, intervals


def tables(spark):
    """Two applications, one without executor events; executions and events at bucket edges, before the first and after the last event."""
    rng = random.Random(7)
    execs = [("a", 0, 1, 5), ("a", 1, 100, 200), ("a", 2, 50, 1_000), ("a", 3, 7, 7), ("a", 4, 300, 0), ("b", 0, 5, 105)]
    execs += [("a", 10 + k, s, s + rng.randint(1, 900)) for k in range(40) for s in [rng.randint(1, 2_000)]]
    events = [("a", f"e{k}", 10 + 37 * k, 1 + k % 3, True) for k in range(30)] + [("a", f"e{k}", 100 * (k + 1), 1 + k % 3, False) for k in range(20)]
    e = spark.createDataFrame(execs, "app_id string, execution_id long, start_ms long, end_ms long")
    x = spark.createDataFrame(events, "app_id string, executor_id string, time_ms long, cores long, added boolean")
    return execs, events, e, x


def test_capacity_over_buckets(spark):
    execs, events, e, x = tables(spark)
    segments = intervals.core_timeline(x).collect()
    want = {}
    for app, k, s, z in execs:
        if z > s:
            want[app, k] = 4 * (z - s) if app == "b" else sum(max(0, min(z, g["end_ms"] or 1 << 60) - max(s, g["start_ms"])) * g["cores"] for g in segments)
    for width in (100, 3_600_000):
        got = {(r["app_id"], r["execution_id"]): r["capacity_core_ms"] for r in intervals.capacity_core_ms(e, x, 4, width).collect()}
        assert got == want


def test_losses_over_buckets(spark):
    execs, events, e, x = tables(spark)
    want = sorted((n, k, t) for _, n, t, _, added in events if not added for app, k, s, z in execs if app == "a" and s <= t and (z > t or z <= 0))
    for width in (100, 3_600_000):
        rows = features.executor_loss_impact(x, e, width).collect()
        assert sorted((r["executor_id"], r["execution_id"], r["time_ms"]) for r in rows) == want


def test_concurrency_over_buckets(spark):
    rng = random.Random(5)
    tasks = [("a", k % 4, a, a + rng.randint(1, 500)) for k in range(120) for a in [rng.randint(1, 1_500)]] + [("a", 0, 100, 300), ("a", 0, 300, 400)]
    df = spark.createDataFrame(tasks, "app_id string, execution_id long, launch_ms long, finish_ms long")
    at = lambda k, t: sum(s <= t < z for _, e, s, z in tasks if e == k)
    most = {k: max(at(k, t) for t in range(2_001)) for k in range(4)}
    held = {k: sum(min(3, at(k, t)) for t in range(2_001)) for k in range(4)}
    for width in (100, 60_000):
        assert {r[1]: r[2] for r in intervals.sql_max_concurrency(df, width).select("app_id", "execution_id", "max_tasks").collect()} == most
        assert {r[1]: r[2] for r in intervals.sql_own_core_ms(df, 3, width).select("app_id", "execution_id", "own_core_ms").collect()} == held
