"""Walks over a graph: frontier joins, one written table per step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LINEAGE_TYPES, Graph, cut
from .metrics import degree
from .views import induced_subgraph


def _typed(edges: DataFrame, edge_types) -> DataFrame:
    return edges.where(F.col("type").isin(list(edge_types))) if edge_types else edges


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _walk(steps: DataFrame, seeds: DataFrame, depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, depth) of all that seeds reach along steps (src, dst)."""
    at = [*keys, "id"]
    seen = cut(seeds.select(*at).distinct().withColumn("depth", F.lit(0)), "walk")
    front = seen
    for d in range(1, depth + 1):
        new = front.join(steps, front["id"] == steps["src"]).select(*keys, F.col("dst").alias("id")).distinct()
        front = cut(new.join(seen.select(*at), at, "left_anti").withColumn("depth", F.lit(d)), "walk")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbors(g: Graph, seeds: DataFrame, *, depth: int = 1, edge_types=None, restrict_edges: bool = False) -> tuple[Graph, DataFrame]:
    """The undirected k-hop neighbourhood of seeds (column id), and the depths. Edges are all those among the nodes found, or only the types walked."""
    found = _walk(cut(_both(_typed(g.edges, edge_types)).distinct(), "steps"), seeds, depth)
    sub = induced_subgraph(g, found)
    return (Graph(sub.nodes, _typed(sub.edges, edge_types)) if restrict_edges else sub), found


def lineage_bfs(g: Graph, seeds: DataFrame, depth: int = 2) -> tuple[Graph, DataFrame]:
    return neighbors(g, seeds, depth=depth, edge_types=LINEAGE_TYPES)


def callgraph_bfs(g: Graph, seeds: DataFrame, depth: int = 2) -> tuple[Graph, DataFrame]:
    return neighbors(g, seeds, depth=depth, edge_types=("calls",))


#: Ids of up to this number are sent to every task that reads edges, of more none.
SENT = 100_000


def _way(found: DataFrame) -> str:
    """How a written table of ids meets edges: its number of rows decides, as its file can be small for that."""
    return "broadcast" if found.count() <= SENT else "merge"


def _touching(rows: DataFrame, found: DataFrame, way: str, *ends: str) -> DataFrame:
    """The rows whose ends are all among the ids found; where these are few, the others never leave their task."""
    ids = found.select("id").distinct()
    return reduce(lambda df, end: df.join(ids.withColumnRenamed("id", end).hint(way), end, "left_semi"), ends, rows)


def graph_expand(g: Graph, seeds: DataFrame, *, depth: int = 1, edge_types=None) -> Graph:
    """Union of every seed's own neighbourhood: an edge counts if both ends lie in one seed's.

    Each step reads the edges again and keeps those at its front: neither all edges nor both their
    directions are ever written.
    """
    steps = _both(_typed(g.edges, edge_types))
    own = front = cut(seeds.select(F.col("id").alias("seed"), "id").distinct(), "own")
    for _ in range(depth):
        way = _way(front)
        near = _touching(steps, front, way, "src").distinct()
        new = near.join(front.withColumnRenamed("id", "src").hint(way), "src").select("seed", F.col("dst").alias("id")).distinct()
        front = cut(new.join(own, ["seed", "id"], "left_anti"), "own")
        if front.isEmpty():
            break
        own = own.unionByName(front)
    way = _way(own)
    inside = cut(_touching(g.edges, own, way, "src", "dst"), "inside")
    a, b = own.select("seed", F.col("id").alias("src")).hint(way), own.select("seed", F.col("id").alias("dst")).hint(way)
    inner = inside.join(a, "src").join(b, ["seed", "dst"]).select("src", "dst", "type").distinct()
    return Graph(_touching(g.nodes, own, way, "id").select(*g.nodes.columns), inside.join(inner, ["src", "dst", "type"], "left_semi").select(*g.edges.columns))


def impact(g: Graph, sources: DataFrame, *, max_depth: int = 5, direction: str = "down") -> DataFrame:
    """id, depth, path of what sources reach along edges (down) or against them (up); unknown nodes stop a walk. Of shortest paths, the smallest."""
    steps = g.edges.select("src", "dst") if direction == "down" else g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = cut(steps.distinct().join(g.nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), "steps")
    seen = cut(sources.select("id").distinct().select("id", F.lit(0).alias("depth"), F.array("id").alias("path")), "impact")
    front = seen
    for d in range(1, max_depth + 1):
        new = front.join(steps, front["id"] == steps["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = cut(new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "path"), "impact")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where(F.col("depth") > 0)


def impact_stats(g: Graph, reached: DataFrame) -> DataFrame:
    """Counts of impact() by type and by depth, and in all."""
    typed = reached.join(g.nodes.select("id", "type"), "id")
    return typed.groupingSets([["type"], ["depth"], []], "type", "depth").agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"))


def callgraph_focus(g: Graph, node_id: str, depth: int = 2) -> tuple[Graph, DataFrame]:
    """The calls around a node, depth steps either way, and id, in_degree, out_degree of its nodes within."""
    seed = g.nodes.where(F.col("id") == node_id).select("id")
    found = _walk(cut(_both(_typed(g.edges, ("calls",))).distinct(), "steps"), seed, depth)
    sub = induced_subgraph(g, found)
    sub = Graph(sub.nodes, _typed(sub.edges, ("calls",)))
    return sub, degree(sub)
