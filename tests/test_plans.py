"""Plan shape: filters reach the Parquet scan and only needed columns are read."""

import tempfile

from quire.operators import groups
from quire.sources import fixtures as fx


def test_filters_and_columns_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="quire-runs-") + "/runs"
    fx.runs(spark, "/root/testdata/sf0.001").write.parquet(path)
    runs = spark.read.parquet(path)
    q = groups.list_runs(runs, status="completed", track="1-URGENT", limit=5).select("id", "name")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,completed)" in plan and "EqualTo(track,1-URGENT)" in plan
    assert "TakeOrderedAndProject" in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][0]
    assert "env_vars" not in scan and "script" not in scan  # pruned columns
    g = groups.running_runs(runs, "s1", "s1").select("id")
    assert "EqualTo(status,running)" in g._jdf.queryExecution().executedPlan().toString()


def test_corpus_queries_move_no_text(spark):
    """Numbering a corpus is arithmetic on ids: the texts meet no exchange, no sort and no window."""
    from quire.plans.catalog import REGISTRY
    plan = REGISTRY["tokenize"].plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    lines = fx.mapping_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_name" in lines and "file" in lines.split("hashpartitioning(session_name")[1][:60]
