"""Event lines made of the views: who reads one kind computes that kind alone."""

from pyspark.sql import functions as F

from runlens.plans import source_queries
from runlens.plans.source_queries import event_lines
from runlens.sources import event_logs as L

SF = "/root/testdata/sf0.001"


def test_a_kind_is_read_without_the_others(spark):
    lines = event_lines(spark, SF)
    assert lines.where(lines.kind != L.kind_of(lines.value)).count() == 0
    for kind, least in (("SQLExecutionEnd", 1), ("JobStart", 1), ("TaskEnd", 1)):
        one = L.parse_events(lines, kind)
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count(" Relation [") == 1 and "Window" not in plan
        assert one.count() >= least


def test_log_files_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "shared_folder", lambda spark, name: str(tmp_path / name))
    lines = event_lines(spark, SF)
    raw = lines.agg(F.sum(F.length("value"))).first()[0]
    source_queries._read_back(spark, SF)
    source_queries._folders(spark, lines, str(tmp_path / "folders"))
    for name in ("logs", "folders"):
        files = [f for f in (tmp_path / name).rglob("part-*") if f.is_file()]
        assert 0 < sum(f.stat().st_size for f in files) < raw / 5


def test_paths_are_cut_as_by_patterns(spark):
    paths = ["file:/a/b/log=app-1/part-00003-x.txt.gz", "s3://b//name", "name", "a/b/", "hdfs://n/eventlog_v2_app-1/events_12_app-1.zstd", "x/app.lz4.inprogress", ""]
    x = spark.createDataFrame([(p,) for p in paths], "f string").select(*[c.alias(n) for n, c in zip(("log", "part", "rank"), L.log_of(F.col("f")))])
    whole = 1 << 30
    assert [tuple(r) for r in x.collect()] == [("app-1", 3, "0 "), ("name", whole, "1 "), ("name", whole, "1 "), ("", whole, "1 "), ("app-1", 12, "0 "), ("app", whole, "2 lz4"), ("", whole, "1 ")]
    assert "regexp_extract(f" not in x._jdf.queryExecution().analyzed().toString()


def test_task_lines_are_not_shuffled(spark, tmp_path):
    lines = event_lines(spark, SF, source_queries._by_log).where("kind = 'TaskEnd'").select("log", "value")
    lines.write.option("compression", "gzip").partitionBy("log").text(str(tmp_path / "x"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(app_id" in plan and "hashpartitioning(log" not in plan  # rows are dealt, not their texts
    files = [p for p in (tmp_path / "x").rglob("part-*")]
    assert len(files) == len({p.parent for p in files})  # one a log
