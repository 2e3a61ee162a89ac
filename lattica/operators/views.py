"""Filters of a graph: what a reader of one view gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EVENT_TYPES, LEVELS, LINEAGE_TYPES, SERVICE_EDGE_TYPES, Graph

EDGE_ORDER = ("seq", "src", "dst", "type")


def query_nodes(g: Graph, *, node_type: str | None = None, name_contains: str | None = None, limit: int = 50) -> DataFrame:
    """The first nodes in stored order of a type whose name contains a text, in any case."""
    out = g.nodes
    if node_type:
        out = out.where(F.col("type") == node_type)
    if name_contains:
        out = out.where(F.lower("name").contains(name_contains.lower()))
    return out.orderBy("seq", "id").limit(limit)


def induced_subgraph(g: Graph, ids: DataFrame) -> Graph:
    """The nodes of ids (column id) and the edges with both ends among them."""
    ids = ids.select("id").distinct()
    edges = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(g.nodes.join(ids, "id", "left_semi"), edges.select(*g.edges.columns))


def of_types(g: Graph, types) -> Graph:
    kept = g.nodes.where(F.col("type").isin(list(types)))
    return induced_subgraph(g, kept)


def get_graph(g: Graph, *, node_type: str | None = None, limit: int = 200, closed: bool = False) -> Graph:
    """Up to limit nodes and, apart from them, up to limit edges; closed: only edges among these nodes."""
    nodes = (g.nodes.where(F.col("type") == node_type) if node_type else g.nodes).orderBy("seq", "id").limit(limit)
    edges = induced_subgraph(g, nodes).edges if closed else g.edges
    return Graph(nodes, edges.orderBy(*EDGE_ORDER).limit(limit))


def graph_summary(g: Graph) -> Graph:
    return of_types(g, ("Repository", "Module"))


def callgraph_view(g: Graph) -> Graph:
    """Functions and APIs, and all calls; calls of components keep ends outside of the nodes."""
    return Graph(g.nodes.where(F.col("type").isin("Function", "API")), g.edges.where(F.col("type") == "calls"))


def _touched(g: Graph, edges: DataFrame) -> DataFrame:
    return g.nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_semi")


def lineage_view(g: Graph, edge_types=LINEAGE_TYPES) -> Graph:
    edges = g.edges.where(F.col("type").isin(list(edge_types)))
    return Graph(_touched(g, edges), edges)


def events_view(g: Graph) -> Graph:
    edges = g.edges.where(F.col("type").isin(list(EVENT_TYPES)))
    return Graph(_touched(g, edges).where(F.col("type").isin("Event", "Topic", "Component")), edges)


def services_view(g: Graph) -> Graph:
    inner = of_types(g, ("Service", "Cluster", "Database"))
    return Graph(inner.nodes, inner.edges.where(F.col("type").isin(list(SERVICE_EDGE_TYPES))))


def lod_filter(g: Graph, level: str) -> Graph:
    """The graph at a level of detail."""
    names = [n for n, _ in LEVELS]
    return of_types(g, [t for _, types in LEVELS[: names.index(level) + 1] for t in types])


def search_nodes(g: Graph, text: str, types=None, limit: int = 50) -> DataFrame:
    t = text.lower()
    hit = F.lower("name").contains(t) | F.lower("id").contains(t) | F.lower("type").contains(t)
    return g.nodes.where(hit & (F.col("type").isin(list(types)) if types else F.lit(True))).orderBy("seq", "id").limit(limit)


def fuzzy_search(g: Graph, text: str, limit: int = 10, threshold: float = 0.3) -> DataFrame:
    """Nodes whose name or id differs from text by up to threshold: edit distance over the longer length, 0 is equal."""
    t = F.lit(text.lower())
    off = lambda c: F.levenshtein(F.lower(c), t) / F.greatest(F.length(c), F.lit(len(text)), F.lit(1))
    return g.nodes.withColumn("score", F.round(F.least(off("name"), off("id")), 6)).where(F.col("score") <= threshold).orderBy("score", "id").limit(limit)


def filter_degree(g: Graph, degrees: DataFrame, *, least: int = 0, most: int | None = None, isolated: bool = True) -> DataFrame:
    """Nodes by the sum of their degrees."""
    n = F.coalesce(F.col("in_degree") + F.col("out_degree"), F.lit(0))
    out = g.nodes.join(degrees.select("id", "in_degree", "out_degree"), "id", "left").withColumn("degree", n)
    keep = (F.col("degree") >= least) & (F.col("degree") <= most if most is not None else F.lit(True)) & (F.lit(isolated) | (F.col("degree") > 0))
    return out.where(keep).select(*g.nodes.columns, "degree")


def node_types(g: Graph) -> DataFrame:
    return g.nodes.select("type").distinct().orderBy("type")


def edge_types(g: Graph) -> DataFrame:
    return g.edges.select("type").distinct().orderBy("type")


def node_detail(g: Graph, node_id: str, per_side: int = 20) -> DataFrame:
    """Up to per_side neighbours each way: direction, edge_type, peer, peer_type (Unknown if there is no such node)."""
    out = g.edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), F.col("type").alias("edge_type"), F.col("dst").alias("peer"), "seq")
    back = g.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), F.col("type").alias("edge_type"), F.col("src").alias("peer"), "seq")
    w = Window.partitionBy("direction").orderBy("seq", "peer", "edge_type")
    near = out.union(back).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_side)
    named = near.join(g.nodes.select(F.col("id").alias("peer"), F.col("type").alias("t")), "peer", "left")
    return named.select("direction", "edge_type", "peer", F.coalesce("t", F.lit("Unknown")).alias("peer_type"))


def node_props(g: Graph, node_id: str, limit: int = 30) -> DataFrame:
    """key and value of a node's properties, without those shown elsewhere."""
    props = F.from_json("props", "map<string,string>")
    return g.nodes.where(F.col("id") == node_id).select(F.explode(props).alias("key", "value")).where(~F.col("key").isin("id", "name", "label", "type")).orderBy("key").limit(limit)


def page_nodes(g: Graph, offset: int, limit: int, types=None) -> DataFrame:
    """A page of nodes, with has_more."""
    nodes = g.nodes.where(F.col("type").isin(list(types))) if types else g.nodes
    page = nodes.orderBy("seq", "id").offset(offset).limit(limit + 1)
    n = F.row_number().over(Window.orderBy("seq", "id"))  # of limit + 1 rows
    more = page.withColumn("n", n).withColumn("has_more", F.max("n").over(Window.partitionBy()) > limit)
    return more.where(F.col("n") <= limit).drop("n")


def visible_filter(g: Graph, hidden) -> Graph:
    return induced_subgraph(g, g.nodes.where(~F.col("type").isin(list(hidden))))


def remove_node(g: Graph, node_id: str) -> Graph:
    return Graph(g.nodes.where(F.col("id") != node_id), g.edges.where((F.col("src") != node_id) & (F.col("dst") != node_id)))


def expand_node(g: Graph, node_id: str, limit: int = 50) -> DataFrame:
    """Children of a node, with has_more."""
    child = g.edges.where((F.col("type") == "contains") & (F.col("src") == node_id)).select(F.col("dst").alias("id")).distinct()
    return page_nodes(Graph(g.nodes.join(child, "id", "left_semi"), g.edges), 0, limit)
