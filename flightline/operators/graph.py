"""A property graph as two tables: ``nodes(id, type)`` and ``edges(type, src, dst)``."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def edge(df: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str], distinct: bool = False) -> DataFrame:
    """One edge of ``kind`` for each row (or distinct pair) of keys; ``src`` and ``dst`` are (node type, column)."""
    pairs = df.select(F.col(src[1]).alias("s"), F.col(dst[1]).alias("d")).where("s is not null and d is not null")
    if distinct:
        pairs = pairs.distinct()  # on the keys, before they are spelled out
    return pairs.select(F.lit(kind).alias("type"), node_id(src[0], F.col("s")).alias("src"), node_id(dst[0], F.col("d")).alias("dst"))


def exploded(df: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """Edges from each row to every element of its array column ``dst[1]``."""
    return edge(df.withColumn("_dst", F.explode(dst[1])), kind, src, (dst[0], "_dst"))


def edges(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes_of(graph: DataFrame) -> DataFrame:
    ids = graph.select(F.col("src").alias("id")).unionByName(graph.select(F.col("dst").alias("id"))).distinct()
    return ids.withColumn("type", F.substring_index("id", ":", 1))


def type_counts(graph: DataFrame) -> DataFrame:
    """How many edges and nodes there are of each type: ``kind, type, n``."""
    of = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return of(graph, "edge").unionByName(of(nodes_of(graph), "node"))


def degrees(graph: DataFrame) -> DataFrame:
    ends = graph.select(F.col("src").alias("node")).unionByName(graph.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def touching(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids`` (column ``id``): two equi joins, not one with an OR."""
    out = graph.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    into = graph.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out.unionByName(into).distinct()


def dangling(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    ends = graph.select("*", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(nodes.select("id"), "id", "left_anti").select("type", "src", "dst").distinct()


# Nodes and edges with properties -----------------------------------------------------------------


def properties(values: dict[str, Column]) -> Column:
    """A map of what is there; a NULL is no property."""
    maps = [F.when(v.isNotNull(), F.create_map(F.lit(k), v.cast("string"))).otherwise(F.create_map().cast("map<string,string>")) for k, v in values.items()]
    return F.map_concat(*maps) if len(maps) > 1 else maps[0] if maps else F.create_map().cast("map<string,string>")


def property_nodes(df: DataFrame, kind: str, key: str, values: dict[str, Column] | None = None) -> DataFrame:
    """``id, type, props``: a node for each row with a key."""
    return df.where(F.col(key).isNotNull()).select(node_id(kind, F.col(key)).alias("id"), F.lit(kind).alias("type"), properties(values or {}).alias("props"))


def property_edges(df: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str], values: dict[str, Column] | None = None) -> DataFrame:
    """``type, src, dst, props``: an edge for each row with both keys."""
    met = df.where(F.col(src[1]).isNotNull() & F.col(dst[1]).isNotNull())
    return met.select(F.lit(kind).alias("type"), node_id(src[0], F.col(src[1])).alias("src"), node_id(dst[0], F.col(dst[1])).alias("dst"), properties(values or {}).alias("props"))


@dataclass(frozen=True)
class GraphSchema:
    """What may be in a graph: properties of each node type, and for each edge type its two ends and properties (name: type)."""

    nodes: dict[str, dict[str, str]]
    edges: dict[str, tuple[str, str, dict[str, str]]]

    def typed(self, rows: DataFrame, kind: str) -> DataFrame:
        """The nodes or edges of one type with their properties as columns."""
        values = self.nodes[kind] if kind in self.nodes else self.edges[kind][2]
        keys = [c for c in rows.columns if c not in ("type", "props")]
        return rows.where(F.col("type") == kind).select(*keys, *[F.col("props")[name].try_cast(of).alias(name) for name, of in values.items()])


def graph_audit(nodes: DataFrame, edges_: DataFrame, schema: GraphSchema) -> DataFrame:
    """``problem, type, n``: what is wrong with a graph, counted; nothing if nothing is.

    duplicate_node; undeclared_node and undeclared_edge (types); undeclared_property; unreadable_property (its
    value is none of its declared type); wrong_end (an end of another type); dangling (an end that is no node).
    Edges are gone through once: what they say (types of their ends, ends, properties) is counted first, and
    each different thing is judged once.
    """
    KINDS, END, PROPERTY = 0, 1, 2
    kind_of = lambda c: F.substring_index(c, ":", 1)
    pair = lambda key, value=F.lit(None): F.struct(key.alias("key"), value.cast("string").alias("value"))

    def counted(rows: DataFrame, ends: bool) -> DataFrame:
        """``type, _what, _key, _value, _n``: how often each pair is there of the types of ends, of ends (no value) and of properties."""
        pairs = F.map_entries(F.coalesce("props", F.create_map().cast("map<string,string>")))
        if ends:
            pairs = F.concat(F.array(pair(kind_of("src"), kind_of("dst")), pair(F.col("src")), pair(F.col("dst"))), pairs)
        place = F.col("_place") + F.lit(0 if ends else 3)
        each = rows.select("type", F.posexplode(pairs).alias("_place", "_pair")).select("type", F.when(place == 0, KINDS).when(place < 3, END).otherwise(PROPERTY).alias("_what"), F.col("_pair.key").alias("_key"), F.col("_pair.value").alias("_value"))
        return each.groupBy("type", "_what", "_key", "_value").agg(F.count(F.lit(1)).alias("_n"))

    def of_properties(declared: dict[str, dict[str, str]]) -> dict[str, Column]:
        place = F.concat_ws(".", "type", "_key")
        names: dict[str, list[str]] = {}
        for kind, values in declared.items():
            for name, of in values.items():
                names.setdefault(of, []).append(f"{kind}.{name}")
        bad = reduce(lambda a, b: a | b, [place.isin(own) & F.col("_value").try_cast(of).isNull() for of, own in names.items()], F.lit(False))
        is_property = F.col("_what") == PROPERTY
        return {"undeclared_property": is_property & ~place.isin([p for own in names.values() for p in own]), "unreadable_property": is_property & bad}

    def count(rows: DataFrame, problems: dict[str, Column]) -> DataFrame:
        sums = rows.groupBy("type").agg(*[F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(p) for p, c in problems.items()])
        each = F.array(*[F.struct(F.lit(p).alias("problem"), F.col(p).alias("n")) for p in problems])
        return sums.select("type", F.explode(each).alias("_p")).select("_p.problem", "type", "_p.n").where("n > 0")

    by_id = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first("type").alias("type"))
    met = counted(edges_, ends=True).join(by_id.select(F.col("id").alias("_key"), F.lit(END).alias("_what"), F.lit(True).alias("_there")), ["_key", "_what"], "left")
    is_kinds, known = F.col("_what") == KINDS, F.col("type").isin(list(schema.edges))
    right = F.concat("type", F.lit(" "), "_key", F.lit(" "), "_value").isin([f"{k} {s} {d}" for k, (s, d, _) in schema.edges.items()])
    return edges(
        count(by_id.where("_n > 1").withColumn("_n", F.lit(1)), {"duplicate_node": F.lit(True)}), count(nodes.select("type", F.lit(1).alias("_n")), {"undeclared_node": ~F.col("type").isin(list(schema.nodes))}), count(counted(nodes, ends=False), of_properties(schema.nodes)),
        count(met, {"undeclared_edge": is_kinds & ~known, "wrong_end": is_kinds & known & ~right, "dangling": (F.col("_what") == END) & F.col("_there").isNull(), **of_properties({kind: values for kind, (_, _, values) in schema.edges.items()})}),
    )
