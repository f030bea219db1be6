"""The property graph goes through the lines once, and its audit through the edges once."""

import pytest

from flightline.operators import graph
from flightline.plans import registry


def line_scans(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line and "l_linenumber" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["property_graph_edges", "property_graph_audit"])
def test_lines_are_read_once(spark, sf, name):
    assert line_scans(registry.queries()[name](spark, sf)) == 1


def test_audit_counts_what_is_there_several_times(spark):
    schema = graph.GraphSchema({"a": {"size": "int"}, "b": {}}, {"OWNS": ("a", "b", {"n": "long"})})
    nodes = spark.createDataFrame([("a:1", "a", {"size": "3"}), ("a:2", "a", {"size": "?"}), ("b:1", "b", {}), ("b:1", "b", {}), ("c:1", "c", None)], "id string, type string, props map<string,string>")
    rows = [("OWNS", "a:1", "b:1", {"n": "1"})] * 3 + [("OWNS", "a:1", "b:9", {"n": "x", "m": "y"})] * 2 + [("OWNS", "b:1", "a:1", None), ("HAS", "a:9", "a:9", {}), ("OWNS", None, "b:1", {})]
    edges = spark.createDataFrame(rows, "type string, src string, dst string, props map<string,string>")
    found = {(r["problem"], r["type"]): r["n"] for r in graph.graph_audit(nodes, edges, schema).collect()}
    assert found == {
        ("duplicate_node", "b"): 1, ("undeclared_node", "c"): 1, ("unreadable_property", "a"): 1, ("undeclared_edge", "HAS"): 1, ("undeclared_property", "OWNS"): 2, ("unreadable_property", "OWNS"): 2, ("wrong_end", "OWNS"): 1,
        ("dangling", "HAS"): 2, ("dangling", "OWNS"): 3,
    }
