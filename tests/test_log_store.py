"""Logs of many applications: how many files they are, how often they are opened and their lines decoded."""

import json
import re

import pytest
from pyspark.sql import functions as F

from runlens.plans import source_queries
from runlens.plans.fixtures import VIEWS, tasks_by_app, view, views_over
from runlens.sources import event_logs as L
from runlens.sources import folders, ingest, plans

SF = "/root/testdata/sf0.001"


def test_a_log_is_one_file_and_no_tasks_are_written_before(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(source_queries, "views_over", lambda s, d, tables: seen.append(tables) or views_over(s, d, tables))
    lines = source_queries._log_folders(spark, SF, str(tmp_path / "logs"))
    files = list((tmp_path / "logs").rglob("part-*"))
    assert len(files) == len({f.parent for f in files}) > 1
    assert seen and "v_task" not in seen[0]
    whole = source_queries.event_lines(spark, SF).select("log", "value")
    same = lambda df: sorted(map(tuple, df.select("log", "value").collect()))
    order = lambda rows: sorted((log, json.dumps({k: sorted(map(str, v)) if k == "accumUpdates" else v for k, v in json.loads(value).items()}, sort_keys=True)) for log, value in rows)
    assert order(same(L.read_event_logs(spark, str(tmp_path / "logs")))) == order(same(lines)) == order(same(whole))


def test_tasks_and_views_are_the_same_whatever_is_written(spark):
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(tasks_by_app(spark, SF, 5)) == rows(view(spark, SF, "v_task"))
    get = views_over(spark, SF, ("v_stage", "spans", "v_exec"))
    for name in set(VIEWS) - {"v_task"}:
        assert rows(get(name)) == rows(view(spark, SF, name))


INFO = {"Task ID": 1, "Launch Time": 5, "Finish Time": 9, "Accumulables": [{"ID": 3, "Update": "10"}, {"ID": 4, "Update": 7}]}
TASK = {"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Task Info": INFO}


def stored(spark, rows):
    x = spark.createDataFrame([(log, 1, value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))) for log, value in rows], "log string, part int, value string")
    return x.withColumn("kind", L.kind_of(F.col("value")))


def test_what_tasks_decode_is_whole_also_where_lines_are_broken(spark):
    whole = json.dumps(TASK, separators=(",", ":"))
    odd = [{**TASK, "Stage ID": "x"}, {**TASK, "Task Info": {**INFO, "Accumulables": "none"}}, {**TASK, "Task Info": {**INFO, "Accumulables": [{"ID": "x", "Update": 1}, {"ID": 3, "Update": [1]}]}}, whole + " x", whole[:-9], whole.replace(":5,", ":5x,"), "", "{}"]
    lines = stored(spark, [("good", TASK), ("good", TASK), ("good", {"Event": "SparkListenerJobEnd"}), ("tail", TASK), ("tail", '{"Event":"SparkListenerJo')] + [(f"odd-{k}", v) for k, row in enumerate(odd) for v in (TASK, row)]).cache()
    tasks = L.build_task_attempts(lines, rest=True).cache()
    partial = L.partial_logs(lines, tasks)
    assert {r.log for r in partial.collect()} == {"odd-0", "odd-3", "odd-4", "odd-5"}
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(tasks.drop("accumulables", "closed").select("log", "task_id")) == rows(L.build_task_attempts(lines).select("log", "task_id"))
    assert rows(L.bad_lines(lines, partial)) == rows(L.bad_lines(lines))
    assert rows(plans.accumulators(lines, tasks, partial)) == rows(plans.accumulators(lines))


def test_lines_of_tasks_are_decoded_once_by_an_ingest(spark, tmp_path, monkeypatch):
    kinds, parse = [], L.parse_events
    log = tmp_path / "logs" / "eventlog_v2_a"
    log.mkdir(parents=True)
    (log / "events_1_a").write_text("\n".join(json.dumps(x, separators=(",", ":")) for x in [{"Event": "SparkListenerApplicationStart", "App ID": "a", "Timestamp": 1}, TASK, TASK]))
    listed, make = [], L.list_logs
    monkeypatch.setattr(L, "list_logs", lambda *a: listed.append(make(*a)) or listed[-1])
    monkeypatch.setattr(L, "parse_events", lambda lines, kind, schema=None: kinds.append(kind) or parse(lines, kind, schema))
    before = {k: spark.conf.get(k) for k in (folders.LISTING, folders.OPENING, folders.TAKING)}
    assert [(r.log, r.lines) for r in ingest.ingest(spark, str(tmp_path / "logs"), str(tmp_path / "store")).collect()] == [("a", 3)]
    assert kinds.count("TaskEnd") == 1 and before == {k: spark.conf.get(k) for k in before}
    assert [(r.id, r.total) for r in plans.accumulators(ingest.table(spark, str(tmp_path / "store"), "lines")).orderBy("id").collect()] == [(3, 20), (4, 14)]
    with pytest.raises(RuntimeError), folders.small_files(spark):
        raise RuntimeError
    assert before == {k: spark.conf.get(k) for k in before}


def test_a_walk_of_a_plan_reads_its_text_once(spark):
    tree = '{"nodeName":"A \\"x\\"","simpleString":"\\"nodeName\\":\\"q\\" [1]","children":[{"nodeName":"","children":[],"metrics":[]}],"metadata":{},"metrics":[{"name":"r ] \\"","accumulatorId":1,"metricType":"sum"}]}'
    x = spark.createDataFrame([(tree,), ("",), (None,)], "tree string").select(plans.plan_walk("tree").alias("w"))
    assert len(re.findall("regexp_extract_all", x._jdf.queryExecution().optimizedPlan().toString())) == 1
    got = [None if r.w is None else [tuple(n) for n in r.w] for r in x.collect()]
    assert got == [[("", 2, "[]"), ('A \\"x\\"', 1, '[{"name":"r ] \\"","accumulatorId":1,"metricType":"sum"}]')], [], None]


def test_paths_of_lines_are_cut_once(spark, tmp_path):
    names = ["log=app-1/part-00003-x.txt", "log=app 2%/events_x", "log=c/events_7_c", "eventlog_v2_d/events_12_d", "eventlog_v2_d/other", "events_x", "e+f.inprogress", "g.lz4.inprogress"]
    for name in names:
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(name)
    raw = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path))
    log, part, rank = L.log_of(F.concat(F.lit(f"file:{tmp_path}/"), "value"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(L.lines_by_log(raw)) == rows(raw.select(log, part, "value"))
    rolled = L.lines_by_log(raw, rolled=True)
    assert rows(rolled) == rows(raw.where(rank.startswith("0")).select(log, part, "value")) and rolled.count() == 4
    plan = rolled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index") <= 8  # name and folder (two cuts), and three times the name in the condition on both
