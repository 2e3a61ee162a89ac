"""Union, deduplication, upsert and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EDGE_TYPES, NODE_TYPES, REQUIRED_PROPS, Graph


def _one(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    """One row for each key: the first or last by order. An aggregation, so it combines before the shuffle."""
    whole = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    pick = (F.max if last else F.min)(whole)
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(pick.alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in df.columns])


def dedupe_nodes(nodes: DataFrame, *, last: bool = True) -> DataFrame:
    return _one(nodes, ["id"], ["seq"], last)


def dedupe_edges(edges: DataFrame, *, last: bool = False) -> DataFrame:
    return _one(edges, ["src", "dst", "type"], ["seq"], last)


def merge_graphs(graphs: list[Graph], *, edge_policy: str = "first") -> Graph:
    """One graph of several layers in order: of nodes with an id the last one stays, of edges with (src, dst, type) the first (or last) one."""
    layer = lambda df, i: df.withColumn("layer", F.lit(i))
    nodes = reduce(DataFrame.unionByName, [layer(g.nodes, i) for i, g in enumerate(graphs)])
    edges = reduce(DataFrame.unionByName, [layer(g.edges, i) for i, g in enumerate(graphs)])
    return Graph(_one(nodes, ["id"], ["layer", "seq"], True).drop("layer"), _one(edges, ["src", "dst", "type"], ["layer", "seq"], edge_policy == "last").drop("layer"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those with their id."""
    return merge_graphs([Graph(old, old.sparkSession.createDataFrame([], "src string, dst string, type string, props string, seq long")), Graph(new, old.sparkSession.createDataFrame([], "src string, dst string, type string, props string, seq long"))]).nodes


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """old with new by (src, dst, type); new edges whose ends are unknown are dropped."""
    ids = nodes.select("id").distinct()
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*old.columns)
    both = old.withColumn("layer", F.lit(0)).unionByName(known.withColumn("layer", F.lit(1)))
    return _one(both, ["src", "dst", "type"], ["layer", "seq"], True).drop("layer")


def _issue(df: DataFrame, where, location, message: str, severity: str = "error") -> DataFrame:
    return df.where(where).select(location.alias("location"), F.lit(message).alias("message"), F.lit(severity).alias("severity"))


def validate_nodes(g: Graph) -> DataFrame:
    n, at = g.nodes, F.concat(F.lit("node:"), F.coalesce("id", F.lit("")))
    again = n.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("seq")))
    object_ = F.coalesce(F.get_json_object("props", "$").startswith("{"), F.lit(False))
    return reduce(DataFrame.union, [
        _issue(n, F.coalesce(F.trim("id"), F.lit("")) == "", at, "empty id"),
        _issue(n, F.coalesce(F.trim("name"), F.lit("")) == "", at, "blank name"),
        _issue(n, ~F.coalesce("type", F.lit("")).isin(NODE_TYPES), at, "unknown node type"),
        _issue(n, F.col("props").isNotNull() & ~object_, at, "props is no object"),
        _issue(again, F.col("k") > 1, at, "duplicate id"),
    ])


def validate_edges(g: Graph) -> DataFrame:
    e, at = g.edges, F.concat_ws("|", F.lit("edge"), F.coalesce("src", F.lit("")), F.coalesce("type", F.lit("")), F.coalesce("dst", F.lit("")))
    ids = g.nodes.select("id").distinct()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return reduce(DataFrame.union, [
        _issue(e, blank("src") | blank("dst"), at, "empty end"),
        _issue(e, F.col("src") == F.col("dst"), at, "self-loop", "warning"),
        _issue(e, ~F.coalesce("type", F.lit("")).isin(EDGE_TYPES), at, "unknown edge type"),
        _issue(e.where(~blank("src")).join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), F.lit(True), at, "dangling source"),
        _issue(e.where(~blank("dst")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), F.lit(True), at, "dangling target"),
    ])


def validate_semantics(g: Graph) -> DataFrame:
    """Warnings for properties that a node type must have."""
    at = F.concat(F.lit("node:"), "id")
    return reduce(DataFrame.union, [_issue(g.nodes, (F.col("type") == t) & ~F.coalesce(F.array_contains(F.json_object_keys("props"), p), F.lit(False)), at, f"missing property {p}", "warning") for t, p in REQUIRED_PROPS])


def validate_graph(g: Graph) -> DataFrame:
    """All issues: location, message, severity. A graph is valid if none is an error."""
    return validate_nodes(g).union(validate_edges(g)).union(validate_semantics(g))


def graph_verdict(g: Graph) -> DataFrame:
    """valid, errors, warnings: one row; a graph is valid if no issue is an error."""
    of = lambda kind: F.count(F.when(F.col("severity") == kind, 1))
    return validate_graph(g).agg((of("error") == 0).alias("valid"), of("error").alias("errors"), of("warning").alias("warnings"))
