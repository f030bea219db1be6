"""Packing, the timeline, the corridor, and the property graph with its audit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightline.operators import graph, replays


@pytest.mark.parametrize("width", [1, 2, 3])
def test_codes_come_back_from_their_bytes(spark, width):
    top = 256**width - 1
    rows = spark.createDataFrame([(0, []), (1, [0]), (2, [top, 0, 1, 255, top // 2])], "id int, codes array<int>")
    found = rows.withColumn("bytes", replays.packed(F.col("codes"), width)).withColumn("again", replays.unpacked(F.col("bytes"), width)).collect()
    for r in found:
        assert r["again"] == r["codes"] and r["bytes"] == b"".join(int(c).to_bytes(width, "little") for c in r["codes"])


def test_runs_are_packed_in_order_however_rows_come(spark):
    rows = spark.range(2000).select((F.col("id") % 4).alias("run"), F.floor(F.col("id") / 4).alias("k"), (F.col("id") % 251).cast("int").alias("code")).repartition(7)
    got = replays.pack_runs("run", {"x": (rows, ["k"], 1), "y": (rows.where("run < 2"), ["k"], 2)}).collect()
    for r in got:
        expected = [(4 * k + r["run"]) % 251 for k in range(500)]
        assert list(r["x"]) == expected and r["n_x"] == 500
        assert r["y"] is None if r["run"] > 1 else list(r["y"][::2]) == expected and set(r["y"][1::2]) == {0}


def test_the_timeline_ends_with_a_stop(spark):
    runs = spark.createDataFrame([(1, "hold", -20.0, None), (2, "abort", 3.0, None), (3, None, None, 7.4), (4, None, None, None)], "run int, stop string, stop_at double, liftoff double")
    got = {}
    for r in replays.vehicle_events(runs, "run").orderBy("run", "t").collect():
        got.setdefault(r["run"], []).append((r["t"], r["what"]))
    start = [(-58.0, "lox_pressurised"), (-55.0, "lh2_pressurised"), (-30.0, "onboard_power")]
    assert got[1] == [*start, (-20.0, "held")] and got[2] == [*start, (0.0, "ignition"), (3.3, "shut_down")]
    assert [w for _, w in got[3]] == [*[w for _, w in start], "ignition", "boosters_lit", "liftoff", "greatest_pressure", "boosters_apart"] and len(got[4]) == len(got[3]) - 1
    moments = spark.createDataFrame([(1, -19.5), (1, -20.0), (1, 40.0), (3, 2.0)], "run int, t double")
    times = {}
    for r in replays.snapshot_grid(runs, moments, "run").collect():
        times.setdefault(r["run"], []).append(r["t"])
    assert all(len(v) == len(set(v)) for v in times.values()) and max(times[1]) == -10.0 and -19.5 in times[1] and 40.0 not in times[1]
    assert max(times[2]) == 10.0 and {float(k) for k in range(8)} <= set(times[2]) and max(times[3]) == 150.0 and len(times[4]) == len(set(np.arange(-55, 151, 5)) | set(range(8)))


def test_the_corridor_is_the_double_integral_of_the_acceleration(spark):
    got = {r["k"]: r for r in replays.corridor_profile(spark).collect()}
    t = -60 + np.arange(10_501) / 50
    x, y = np.array(replays.ACCELERATION).T
    path = np.cumsum(np.cumsum(np.where(t >= 7.1, np.interp(t, x, y), 0)))
    for k in (0, 3354, 3355, 5000, 9800, 10_500):
        assert got[k]["drift"] == pytest.approx(path[k] / path[9800], abs=1e-9)
        assert got[k]["corridor"] == pytest.approx(1 + 2.5 * (0.03 + 2.2 * path[k] / path[9800]), abs=1e-8)


def test_the_audit_of_a_graph_names_what_is_wrong(spark):
    schema = graph.GraphSchema({"a": {"size": "int"}, "b": {}}, {"LIKES": ("a", "b", {"since": "double"})})
    rows = spark.createDataFrame([(1, "5", 2, "1.5"), (2, "six", 3, None), (3, None, None, "x")], "k int, size string, other int, since string")
    nodes = graph.property_nodes(rows, "a", "k", {"size": F.col("size")}).unionByName(graph.property_nodes(rows, "b", "other"))
    edges = graph.property_edges(rows, "LIKES", ("a", "k"), ("b", "other"), {"since": F.col("since")})
    assert edges.count() == 2 and {(r["problem"], r["type"], r["n"]) for r in graph.graph_audit(nodes, edges, schema).collect()} == {("unreadable_property", "a", 1)}
    bad = edges.unionByName(graph.property_edges(rows, "LIKES", ("b", "k"), ("a", "k"), {"why": F.lit("no")})).unionByName(graph.property_edges(rows, "HATES", ("a", "k"), ("a", "k")))
    more = nodes.unionByName(graph.property_nodes(rows, "c", "k")).unionByName(nodes.where("type = 'b'"))
    got = {(r["problem"], r["type"]): r["n"] for r in graph.graph_audit(more, bad, schema).collect()}
    assert got == {("unreadable_property", "a"): 1, ("wrong_end", "LIKES"): 3, ("undeclared_property", "LIKES"): 3, ("undeclared_edge", "HATES"): 3, ("undeclared_node", "c"): 3, ("duplicate_node", "b"): 2, ("dangling", "LIKES"): 1}
    typed = {r["id"]: r["size"] for r in schema.typed(nodes, "a").collect()}
    assert typed == {"a:1": 5, "a:2": None, "a:3": None}
    assert {tuple(r) for r in schema.typed(edges, "LIKES").collect()} == {("a:1", "b:2", 1.5), ("a:2", "b:3", None)}
