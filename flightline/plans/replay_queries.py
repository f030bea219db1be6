"""What a display needs of replays, and the property graph of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightline.functions import timeseries as ts
from flightline.operators import decisions, graph, replays, reports, universe
from flightline.plans import agent_queries, feature_queries
from flightline.plans.book import Book, r6, table
from flightline.sources import scratch

BOOK = Book()
RUNS = f"""{agent_queries.DECIDED}{agent_queries.SUMMARY}, runs AS (
  SELECT user_id, CASE WHEN hold_at IS NOT NULL THEN 'hold' WHEN abort_at IS NOT NULL THEN 'abort' END AS stop, coalesce(hold_at, abort_at) AS stop_at, CASE WHEN user_id % 4 > 0 THEN 7.1 END AS liftoff FROM sm
), shown AS (SELECT *, CASE stop WHEN 'hold' THEN least(stop_at + 12, 150) WHEN 'abort' THEN least(stop_at + 8, 150) ELSE 150 END AS until FROM runs)"""


def runs(spark, sf_dir) -> DataFrame:
    """``user_id, stop, stop_at, liftoff`` of every run."""
    summary = reports.run_summary(agent_queries.calls(spark, sf_dir), ["user_id"])
    stop = F.when(F.col("hold_at").isNotNull(), "hold").when(F.col("abort_at").isNotNull(), "abort")
    return summary.select("user_id", stop.alias("stop"), F.coalesce("hold_at", "abort_at").alias("stop_at"), F.when(F.col("user_id") % 4 > 0, 7.1).alias("liftoff"))


@BOOK.enter(
    f"""WITH {RUNS}, ev AS (SELECT user_id, -58.0 AS t, 'lox_pressurised' AS what FROM shown UNION ALL SELECT user_id, -55.0, 'lh2_pressurised' FROM shown UNION ALL SELECT user_id, -30.0, 'onboard_power' FROM shown UNION ALL SELECT user_id, stop_at, 'held' FROM shown WHERE stop = 'hold'
UNION ALL SELECT user_id, 0.0, 'ignition' FROM shown WHERE stop IS DISTINCT FROM 'hold' UNION ALL SELECT user_id, stop_at + 0.3, 'shut_down' FROM shown WHERE stop = 'abort' UNION ALL SELECT user_id, 7.0, 'boosters_lit' FROM shown WHERE stop IS NULL
UNION ALL SELECT user_id, liftoff, 'liftoff' FROM shown WHERE stop IS NULL AND liftoff IS NOT NULL UNION ALL SELECT user_id, 60.0, 'greatest_pressure' FROM shown WHERE stop IS NULL UNION ALL SELECT user_id, 136.0, 'boosters_apart' FROM shown WHERE stop IS NULL)
SELECT user_id, round(t, 6) AS t, what FROM ev JOIN shown USING (user_id) WHERE t <= until"""
)
def vehicle_events(spark, sf_dir):
    """The timeline of each run, as far as it goes."""
    return replays.vehicle_events(runs(spark, sf_dir), "user_id").select("user_id", r6(F.col("t")).alias("t"), "what")


@BOOK.enter(f"WITH {RUNS}, g AS (SELECT user_id, (-55 + 5 * i)::DOUBLE AS t FROM runs, range(42) AS r(i) UNION SELECT user_id, i::DOUBLE FROM runs, range(8) AS r(i) UNION SELECT user_id, alert_at::DOUBLE FROM al) SELECT user_id, t FROM g JOIN shown USING (user_id) WHERE t <= until + 1e-9")
def snapshot_grid(spark, sf_dir):
    """The times at which each run's features are shown."""
    moments = agent_queries.alerts(spark, sf_dir).select("user_id", F.col("alert_at").alias("t"))
    return replays.snapshot_grid(runs(spark, sf_dir), moments, "user_id")


_KNOTS = ", ".join(str(k) for k in replays.ACCELERATION)
CORRIDOR = f"""kn(x, y) AS (VALUES {_KNOTS}), seg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM kn), grid AS (SELECT i AS k, -60.0::DOUBLE + i / 50.0::DOUBLE AS t FROM range(10501) AS r(i)
), acc AS (SELECT k, t, CASE WHEN t < 7.1 THEN 0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END AS a FROM grid LEFT JOIN seg ON t > x0 AND t <= x1), sp AS (SELECT k, t, sum(coalesce(a, 1.5) / 50) OVER (ORDER BY k) AS v FROM acc), pa AS (SELECT k, t, sum(v / 50) OVER (ORDER BY k) AS d FROM sp
), co AS (SELECT k, t, 1.0 + 2.5 * (0.03 + 2.2 * d / (SELECT d FROM pa WHERE k = 9800)) AS corridor FROM pa)"""


@BOOK.enter(
    f"""WITH {feature_queries.TELEMETRY}, {CORRIDOR}, m AS (SELECT run, f.t, TRAJ_DEV, corridor FROM filled f JOIN co ON co.k = CAST(round((f.t + 60) * 50, 0) AS BIGINT) WHERE f.t >= 7 AND f.t <= 150)
SELECT run, CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (TRAJ_DEV > corridor) AS BIGINT) AS outside, round(max(TRAJ_DEV / corridor), 6) AS worst FROM m GROUP BY run"""
)
def corridor_breaches(spark, sf_dir):
    """Samples in flight outside the corridor that the acceleration's double integral gives, and how far the worst is."""
    rows = feature_queries.telemetry(spark, sf_dir)
    held = rows.withColumn("dev", ts.Series(("run",), ("k",)).forward_fill(F.col("TRAJ_DEV"))).where("t >= 7 and t <= 150").withColumn("k", F.round((F.col("t") + 60) * 50).cast("long"))
    met = held.select("run", "k", "dev").join(F.broadcast(replays.corridor_profile(spark).select("k", "corridor")), "k")  # 10,501 rows
    return met.groupBy("run").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("dev") > F.col("corridor")).alias("outside"), r6(F.max(F.col("dev") / F.col("corridor"))).alias("worst"))


_LOW, _HIGH, _CODES = 0.0, 250.0, ", ".join(f"'{c}'" for c in decisions.CALLS)
_Q = f"CASE WHEN v IS NULL THEN 0 ELSE CAST(1 + round_even(least(greatest((v - {_LOW}) / {_HIGH - _LOW}, 0), 1) * 65534, 0) AS INT) END"
_LE = "printf('%02X%02X', q % 256, q // 256)"


@BOOK.enter(
    f"""WITH {agent_queries.DECIDED}, bi AS (SELECT user_id, k // 5 AS b, min(v) AS lo, max(v) AS hi, count(*) AS n FROM x GROUP BY 1, 2), en AS (SELECT user_id, b, 0 AS side, lo AS v FROM bi WHERE n = 5 UNION ALL SELECT user_id, b, 1, hi FROM bi WHERE n = 5
), te AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n_telemetry, string_agg({_LE}, '' ORDER BY side, b) AS telemetry FROM (SELECT *, {_Q} AS q FROM en) GROUP BY 1
), sc AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n_scores, string_agg(printf('%02X', CAST(round_even(round(p, 9) * 250, 0) AS INT)), '' ORDER BY k, mode) AS scores FROM dc GROUP BY 1
), ca AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n_calls, string_agg(printf('%02X', CAST(list_position([{_CODES}], call) - 1 AS INT)), '' ORDER BY k) AS calls FROM cl GROUP BY 1)
SELECT ca.user_id, n_telemetry, telemetry, n_scores, scores, n_calls, calls FROM ca JOIN sc USING (user_id) LEFT JOIN te USING (user_id)"""
)
def packed_runs(spark, sf_dir):
    """Each run in one row: envelopes as 16-bit levels, scores and calls as bytes (spelled in hex)."""
    found = pack(spark, sf_dir)
    return found.select("user_id", *[c for name in ("telemetry", "scores", "calls") for c in (f"n_{name}", F.hex(name).alias(name))])


def pack(spark, sf_dir) -> DataFrame:
    bins = ts.envelope(agent_queries.signals(spark, sf_dir), ["user_id"], F.col("k"), F.col("v"), 5)
    sides = bins.select("user_id", "bin", F.posexplode(F.array("low", "high")).alias("side", "v"))
    telemetry = sides.withColumn("code", universe.quantized_with_missing(F.col("v"), _LOW, _HIGH, 65535))
    scores = agent_queries.decided(spark, sf_dir).withColumn("code", universe.quantized(F.round("p", 9)))
    codes = F.array(*[F.lit(c) for c in decisions.CALLS])
    calls = agent_queries.calls(spark, sf_dir).withColumn("code", (F.array_position(codes, F.col("call")) - 1).cast("int"))
    return replays.pack_runs("user_id", {"calls": (calls, ["k"], 1), "scores": (scores, ["k", "mode"], 1), "telemetry": (telemetry, ["side", "bin"], 2)})


@BOOK.enter(f"WITH {agent_queries.DECIDED} SELECT user_id, CAST(k AS BIGINT) AS k, mode, CAST(round_even(round(p, 9) * 250, 0) AS INT) AS code FROM dc")
def unpacked_scores(spark, sf_dir):
    """The scores read back from the packed runs."""
    modes = F.array(*[F.lit(m) for m in sorted(agent_queries.THRESHOLDS)])
    first = agent_queries.signals(spark, sf_dir).groupBy("user_id").agg(F.min("k").alias("first"))
    rows = pack(spark, sf_dir).select("user_id", F.posexplode(replays.unpacked(F.col("scores"))).alias("i", "code")).join(first, "user_id")
    return rows.select("user_id", (F.floor(F.col("i") / 3) + F.col("first")).alias("k"), F.element_at(modes, (F.col("i") % 3 + 1).cast("int")).alias("mode"), "code")


@BOOK.enter(
    f"""WITH {agent_queries.LIMITS}, d AS (SELECT class, count(*) AS n, avg((alert_at IS NOT NULL)::INT) AS detection, avg((alert_at IS NOT NULL AND alert_at <= gate)::INT) AS in_time, quantile_cont(alert_at - manifest, 0.5) AS late FROM gated LEFT JOIN al USING (user_id, class) GROUP BY 1
), m AS (SELECT g.user_id, g.class, bool_or(coalesce(tripped_at >= manifest - 0.5 AND tripped_at <= gate, false)) AS hit FROM gated g LEFT JOIN lt ON lt.user_id = g.user_id GROUP BY 1, 2), l AS (SELECT class, avg(hit::INT) AS limits FROM m GROUP BY 1)
SELECT class, CAST(n AS BIGINT) AS n, round(detection, 6) AS agent_detection, round(in_time, 6) AS agent_in_time, round(late, 6) AS agent_latency, round(limits, 6) AS limit_detection FROM d JOIN l USING (class)"""
)
def performance_summary(spark, sf_dir):
    """Agent and fixed limits side by side, class by class."""
    x = agent_queries.kept_signals(spark, sf_dir)
    gated = agent_queries.truth(spark, sf_dir, x).withColumn("gate", agent_queries.gate())
    agent = decisions.evaluation(gated, agent_queries.alerts(spark, sf_dir, x), x.agg(F.countDistinct("user_id").alias("total")), ["user_id"])
    limits = decisions.limit_detection(gated, agent_queries.trips(spark, sf_dir, x), ["user_id"])
    found = reports.side_by_side(agent, limits)
    return found.select("class", "n", *[r6(F.col(c)).alias(c) for c in ("agent_detection", "agent_in_time", "agent_latency", "limit_detection")])


# The property graph of the tables: seven node types, twelve edge types -------------------------------
SCHEMA = graph.GraphSchema(
    {"region": {"name": "string"}, "nation": {"name": "string"}, "supplier": {"balance": "double"}, "customer": {"balance": "double", "segment": "string"}, "part": {"size": "int"}, "brand": {"parts": "long"}, "order": {"status": "string", "total": "double"}},
    {
        "NATION_OF": ("nation", "region", {}), "SUPPLIER_IN": ("supplier", "nation", {}), "CUSTOMER_IN": ("customer", "nation", {}), "PLACED_BY": ("order", "customer", {"priority": "string"}), "OF_BRAND": ("part", "brand", {}),
        "CONTAINS": ("order", "part", {"quantity": "double"}), "SUPPLIES": ("supplier", "part", {"lines": "long"}), "SHIPPED_BY": ("order", "supplier", {"lines": "long"}), "BUYS_BRAND": ("customer", "brand", {"lines": "long"}), "SELLS_TO": ("nation", "nation", {"lines": "long"}),
        "BUYS_FROM": ("customer", "supplier", {"lines": "long"}), "BRAND_IN": ("brand", "region", {"lines": "long"}),
    },
)


#: Lines that one task groups, about: its memory does not depend on how well they are packed when they move.
LINES = 250_000


def graph_nodes(spark, sf_dir) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    node, c = graph.property_nodes, F.col
    brands = t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    return graph.edges(
        node(t("region"), "region", "r_regionkey", {"name": c("r_name")}), node(t("nation"), "nation", "n_nationkey", {"name": c("n_name")}), node(t("supplier"), "supplier", "s_suppkey", {"balance": c("s_acctbal")}),
        node(t("customer"), "customer", "c_custkey", {"balance": c("c_acctbal"), "segment": c("c_mktsegment")}), node(t("part"), "part", "p_partkey", {"size": c("p_size")}), node(brands, "brand", "p_brand", {"parts": c("parts")}),
        node(t("orders"), "order", "o_orderkey", {"status": c("o_orderstatus"), "total": c("o_totalprice")}),
    )


def graph_edges(spark, sf_dir) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    edge, c = graph.property_edges, F.col
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    wide = lines.drop("l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
    wide = wide.join(t("part").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey")).join(t("nation").select(c("n_nationkey").alias("_n"), "n_regionkey"), c("c_nationkey") == c("_n"))
    # Six kinds of edges are counted from the joined lines, which are joined once.
    wide = scratch.stored(wide.select("l_orderkey", "l_partkey", "l_suppkey", "o_custkey", "p_brand", "s_nationkey", "c_nationkey", "n_regionkey"), "graph-lines")
    parts = -(-lines.count() // LINES) or 1
    dealt = lambda rows, *keys: rows.repartition(parts, *keys)
    counted = lambda rows, a, b: rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("lines"))
    # A run of one order or customer is one task's, so its ends are counted there; pairs of few values are counted before they move.
    pairs = lambda a, b: counted(dealt(wide.select(a, b), *((a,) if a in ("l_orderkey", "o_custkey") else (a, b))), a, b)
    few = lambda a, b: counted(wide, a, b)
    n = {"lines": c("lines")}
    return graph.edges(
        edge(t("nation"), "NATION_OF", ("nation", "n_nationkey"), ("region", "n_regionkey")), edge(t("supplier"), "SUPPLIER_IN", ("supplier", "s_suppkey"), ("nation", "s_nationkey")), edge(t("customer"), "CUSTOMER_IN", ("customer", "c_custkey"), ("nation", "c_nationkey")),
        edge(t("orders"), "PLACED_BY", ("order", "o_orderkey"), ("customer", "o_custkey"), {"priority": c("o_orderpriority")}), edge(t("part"), "OF_BRAND", ("part", "p_partkey"), ("brand", "p_brand")),
        edge(dealt(lines.drop("l_suppkey"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q")), "CONTAINS", ("order", "l_orderkey"), ("part", "l_partkey"), {"quantity": c("q")}),
        edge(pairs("l_suppkey", "l_partkey"), "SUPPLIES", ("supplier", "l_suppkey"), ("part", "l_partkey"), n), edge(pairs("l_orderkey", "l_suppkey"), "SHIPPED_BY", ("order", "l_orderkey"), ("supplier", "l_suppkey"), n),
        edge(pairs("o_custkey", "p_brand"), "BUYS_BRAND", ("customer", "o_custkey"), ("brand", "p_brand"), n), edge(few("s_nationkey", "c_nationkey"), "SELLS_TO", ("nation", "s_nationkey"), ("nation", "c_nationkey"), n),
        edge(pairs("o_custkey", "l_suppkey"), "BUYS_FROM", ("customer", "o_custkey"), ("supplier", "l_suppkey"), n), edge(few("p_brand", "n_regionkey"), "BRAND_IN", ("brand", "p_brand"), ("region", "n_regionkey"), n),
    )


_WIDE = "wide AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey)"
_PAIRS = {"SUPPLIES": "l_suppkey, l_partkey", "SHIPPED_BY": "l_orderkey, l_suppkey", "BUYS_BRAND": "o_custkey, p_brand", "SELLS_TO": "s_nationkey, c_nationkey", "BUYS_FROM": "o_custkey, l_suppkey", "BRAND_IN": "p_brand, n_regionkey"}


@BOOK.enter(
    "SELECT 'region' AS type, count(*) AS n, NULL::DOUBLE AS total, count(r_name) AS props FROM region UNION ALL SELECT 'nation', count(*), NULL, count(n_name) FROM nation UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2), count(s_acctbal) FROM supplier "
    "UNION ALL SELECT 'customer', count(*), round(sum(c_acctbal), 2), count(c_acctbal) + count(c_mktsegment) FROM customer UNION ALL SELECT 'part', count(*), sum(p_size), count(p_size) FROM part UNION ALL SELECT 'brand', count(DISTINCT p_brand), count(*), count(DISTINCT p_brand) FROM part "
    "UNION ALL SELECT 'order', count(*), round(sum(o_totalprice), 2), count(o_orderstatus) + count(o_totalprice) FROM orders"
)
def property_graph_nodes(spark, sf_dir):
    """Nodes of each type, how many properties they have, and the sum of a numeric one, read back by the schema."""
    nodes = graph_nodes(spark, sf_dir)
    number = {"supplier": "balance", "customer": "balance", "part": "size", "brand": "parts", "order": "total"}
    parts = [SCHEMA.typed(nodes, kind).select(F.lit(kind).alias("type"), (F.col(number[kind]) if kind in number else F.lit(None)).cast("double").alias("x")) for kind in SCHEMA.nodes]
    sums = graph.edges(*parts).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("total"))
    return sums.join(nodes.groupBy("type").agg(F.sum(F.size("props").cast("long")).alias("props")), "type").select("type", "n", "total", "props")


@BOOK.enter(
    f"WITH {_WIDE} SELECT 'NATION_OF' AS type, count(*) AS n, NULL::DOUBLE AS total FROM nation UNION ALL SELECT 'SUPPLIER_IN', count(*), NULL FROM supplier UNION ALL SELECT 'CUSTOMER_IN', count(*), NULL FROM customer UNION ALL SELECT 'PLACED_BY', count(*), NULL FROM orders UNION ALL SELECT 'OF_BRAND', count(*), NULL FROM part "
    "UNION ALL SELECT 'CONTAINS', count(*), sum(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey) "
    + " ".join(f"UNION ALL SELECT '{kind}', count(*), sum(n) FROM (SELECT count(*) AS n FROM wide GROUP BY {keys})" for kind, keys in _PAIRS.items())
)
def property_graph_edges(spark, sf_dir):
    """Edges of each type and the sum of their numeric property."""
    edges = graph_edges(spark, sf_dir)
    number = F.coalesce(F.col("props")["lines"], F.col("props")["quantity"]).cast("double")
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))


@BOOK.enter("SELECT 'dangling' AS problem, 'LIKES' AS type, count(*) AS n FROM customer UNION ALL SELECT 'duplicate_node', 'region', count(*) FROM region UNION ALL SELECT 'undeclared_edge', 'LIKES', count(*) FROM customer UNION ALL SELECT 'undeclared_property', 'LIKES', count(*) FROM customer")
def property_graph_audit(spark, sf_dir):
    """The audit finds what has been broken on purpose: every region twice, and an undeclared edge of every customer to a node that is not there."""
    nodes, edges = graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir)
    twice = nodes.unionByName(nodes.where("type = 'region'"))
    likes = graph.property_edges(table(spark, sf_dir, "customer").withColumn("no", -F.col("c_custkey") - 1), "LIKES", ("customer", "c_custkey"), ("part", "no"), {"why": F.lit("x")})
    return graph.graph_audit(twice, edges.unionByName(likes), SCHEMA)
