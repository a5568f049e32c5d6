"""Applications, executions and jobs are made of the spans of stages: no task is written for them, and few columns are shuffled."""

import duckdb
import pytest

from runlens.plans import fixtures
from runlens.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", ["build_apps", "build_jobs", "build_executions", "executor_events", "plan_drift"])
def test_tasks_that_no_one_reads_are_not_written(spark, monkeypatch, name):
    written, write = [], fixtures.written
    monkeypatch.setattr(fixtures, "written", lambda df, name, by=(): written.append((name, df)) or write(df, name, by))
    QUERIES[name](spark, SF)
    assert [n for n, _ in written] == ["spans"]
    plan = written[0][1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "l_extendedprice" not in plan and "l_shipdate" not in plan


@pytest.mark.parametrize("name", ["build_apps", "build_jobs", "build_executions", "executor_events"])
def test_ties_of_tasks(spark, tmp_path, name):
    """Tasks that agree in all that their times depend on and differ elsewhere, whole copies, and large orders."""
    at = str(tmp_path / "lineitem.parquet")
    duckdb.sql(f"""COPY (SELECT * FROM '{SF}/lineitem.parquet'
      UNION ALL SELECT * EXCLUDE (k) REPLACE (l_extendedprice + k AS l_extendedprice, 'R' AS l_returnflag, (1 + k % 2)::int AS l_linenumber) FROM '{SF}/lineitem.parquet', range(5) t(k) WHERE l_orderkey % 7 = 0
      UNION ALL SELECT * REPLACE (50 AS l_orderkey) FROM '{SF}/lineitem.parquet' WHERE l_suppkey % 2 = 0) TO '{at}' (FORMAT parquet)""")
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{at}'")
    rel = con.sql(SQL[name])
    index = [rel.columns.index(c) for c in df.columns]
    assert rows(df, df.columns) == sorted(tuple(str(r[k]) for k in index) for r in rel.fetchall()) != []


def test_spans_of_few_columns_are_those_of_all(spark):
    sf = SF.replace("0.001", "0.01")
    of_all = fixtures._spans(fixtures.view(spark, sf, "v_task"))
    few = fixtures.views_over(spark, sf, ("spans",))("spans")
    assert rows(few, few.columns) == rows(of_all, few.columns) != []
