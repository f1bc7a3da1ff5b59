"""The plan check finds what it watches for."""

import os
import subprocess
import sys

import __spark_entry__ as entry

PLANTED = '''
import sys, tempfile
sys.path.insert(0, {root!r}); sys.path.insert(0, {root!r} + "/tools")
import check_plans
logs = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
spark = check_plans.session_with_log(logs)
def loop(s, folder):
    a, b = s.range(50).toDF("a"), s.range(40).toDF("b")
    return a.join(b, a.a < b.b)
def inner(s, folder):
    from introna.session import stored
    return stored(loop(s, folder)).groupBy("a").count()
builds = {{"loop": loop, "inner": inner, "clean": lambda s, f: s.range(9).groupBy("id").count()}}
for name, notes, count in check_plans.notes_for(spark, logs, builds, "x"):
    print("FOUND", name, ",".join(notes), count > 0)
'''


def test_planted_nested_loops_are_found():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", PLANTED.format(root=root)], capture_output=True, text=True, timeout=300, cwd="/tmp").stdout
    found = [line.split(" ")[1:] for line in out.splitlines() if line.startswith("FOUND")]
    assert found == [["loop", "BroadcastNestedLoopJoin", "True"], ["inner", "BroadcastNestedLoopJoin", "True"], ["clean", "", "True"]]


def test_shared_steps_are_read_from_store(spark):
    """What several steps of these queries read is joined from the line items once, before the plan that is returned."""
    for name in ("pool_junctions", "pooled_sj_table", "exon_coordinates", "cell_graphs", "cell_graph_members"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "l_orderkey" not in plan, name
