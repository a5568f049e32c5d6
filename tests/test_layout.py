"""How often the tasks are shuffled and swept: figures that grew with every look at them."""

import re

import pytest

from runlens.operators import intervals, profile, rules, stages
from runlens.plans.catalog import QUERIES
from runlens.plans.fixtures import view, written_views

SF = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|single|round)", df._jdf.queryExecution().executedPlan().toString()))


def test_groups_by_execution_need_no_shuffle_of_their_own(spark):
    assert shuffles(stages.task_distributions(view(spark, SF, "v_task"))) == 1  # that of the lines
    t = written_views(spark, SF, ["v_task"])[0]
    for df in (stages.task_distributions(t), intervals.sql_own_core_ms(t, 4), t.groupBy("app_id", "execution_id").count()):
        assert shuffles(df) == 0
    assert sorted(map(str, t.collect())) == sorted(map(str, view(spark, SF, "v_task").collect()))


@pytest.mark.parametrize("name, module, step", [
    ("apply_interactions", intervals, "query_contention"), ("write_queue_report", intervals, "query_contention"), ("contention_report", intervals, "occupancy_segments"),
    ("top_slow_queries", stages, "stage_metrics"), ("finding_evidence", profile, "stage_profile"), ("clusters_of_evidence", profile, "stage_profile"),
])
def test_a_shared_step_is_taken_once(spark, monkeypatch, name, module, step):
    calls, make = [], getattr(module, step)
    monkeypatch.setattr(module, step, lambda *a, **k: calls.append(step) or make(*a, **k))
    QUERIES[name](spark, SF)
    assert len(calls) == 1


def test_only_quantiles_that_are_looked_at(spark):
    v = written_views(spark, SF, ["v_task", "v_stage", "v_exec"])
    wanted = set().union(*map(rules.inputs, rules.STAGE_RULES))
    some, whole = profile.profiles(*v, 4, quantiles=wanted)["stage"], profile.profiles(*v, 4)["stage"]
    assert len([c for c in some.columns if re.search(r"_p\d\d$", c)]) < 6 < len([c for c in whole.columns if re.search(r"_p\d\d$", c)])
    found = lambda p: sorted(map(str, rules.evaluate_rules(profile.contexts_of(p, 4), rules.STAGE_RULES, rules.FIXTURE, stages.STAGE).collect()))
    assert found(some) == found(whole) != []


def test_hosts_without_a_name_and_tasks_without_an_execution(spark):
    row = "select 'a' app_id, {e} execution_id, 1L stage_id, {h} host, {r}L run_ms, 5L shuffle_write_bytes, 1L shuffle_write_ms, 2L disk_spill_bytes"
    t = spark.sql(" union all ".join(row.format(e=e, h=h, r=r) for e, h, r in (("7L", "'h'", 10), ("7L", "null", 20), ("8L", "'h'", 40), ("cast(null as long)", "'h'", 90))))
    p = spark.sql("select 'a' app_id, e execution_id, 1L stage_id, 2L n, m run_p50 from values (7L, 10L), (8L, 20L) as x(e, m)")
    got = {r["host"]: (r["tasks"], r["stages"], r["score"]) for r in profile.host_profile(t, p).collect()}
    assert got == {"h": (2, 1, 1.5), None: (1, 1, 2.0)}


@pytest.mark.parametrize("name", ["evaluate_sql_rules", "rollup_s_to_q", "clusters_of_evidence"])
def test_profiles_that_no_one_reads_are_not_made(spark, monkeypatch, name):
    made = []
    for step in ("host_profile", "bucket_profile"):
        monkeypatch.setattr(profile, step, lambda *a, step=step, **k: made.append(step))
    QUERIES[name](spark, SF)
    assert made == []
