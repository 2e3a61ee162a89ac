"""Cycles and layers: strongly connected components by colouring, paths crossed by pointer doubling.

What lies along a path of nodes with one way in (or out) is crossed in a number of steps that grows
with the logarithm of its length; every step is one written table.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, cut


def _steps(g: Graph, edge_types) -> DataFrame:
    e = g.edges.where(F.col("type").isin(list(edge_types))) if edge_types else g.edges
    return e.select("src", "dst").distinct().where(F.col("src") != F.col("dst"))


def _without(edges: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def _jump(pointers: DataFrame) -> DataFrame:
    """Pointers (id, up, far, base, least) followed to the first node that has none, by doubling; open ones go round in a ring.

    A value of id is max(base, value of up + far), which holds along the way; least is the smallest id passed.
    """
    at = cut(pointers.withColumn("open", F.lit(True)), "pointers")
    n, span = at.count(), 1
    while span < 2 * n:
        over = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("base").alias("base2"), F.col("least").alias("least2"))
        far = F.col("far")
        at = cut(
            at.join(over, "up", "left").select(
                "id", F.coalesce("up2", "up").alias("up"), (far + F.coalesce("far2", F.lit(0))).alias("far"),
                F.greatest("base", F.coalesce(F.col("base2") + far, F.lit(0))).alias("base"), F.least("least", F.coalesce("least2", "least")).alias("least"), F.col("up2").isNotNull().alias("open"),
            ),
            "pointers",
        )
        span *= 2
        if at.where("open").isEmpty():
            break
    return at


def _single(edges: DataFrame, of: str, to: str) -> DataFrame:
    """Pointers of nodes that have one edge on the side of ``of``."""
    one = edges.groupBy(F.col(of).alias("id")).agg(F.count("*").alias("n"), F.min(to).alias("up")).where("n = 1")
    return one.select("id", "up", F.lit(1).cast("long").alias("far"), F.lit(0).cast("long").alias("base"), F.least("id", "up").alias("least"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that some cycle leads to and that lead to one."""
    left = cut(edges, "core")
    while True:
        ends = []
        for of, to in (("dst", "src"), ("src", "dst")):
            no_way = left.select(F.col(to).alias("id")).distinct().join(left.select(F.col(of).alias("id")).distinct(), "id", "left_anti")
            no_way = cut(no_way, "ends")
            if not no_way.isEmpty():  # what hangs on such an end by single edges goes with it
                hung = _jump(_single(left, of, to)).select("id", F.col("up").alias("end")).join(no_way.withColumnRenamed("id", "end"), "end", "left_semi").select("id")
                ends.append(no_way.union(hung))
        if not ends:
            return left
        gone = ends[0] if len(ends) == 1 else ends[0].union(ends[1])
        left = cut(_without(left, gone), "core")


def cyclic_core(g: Graph, *, edge_types=None) -> DataFrame:
    """Ids of nodes that lie on cycles or between them: what is left when nodes without edges in or out are peeled off."""
    left = _trimmed(_steps(g, edge_types))
    return left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, colour) of the nodes of edges: equal for nodes of a strongly connected component, single nodes have one of their own.

    Forward, every node takes the greatest id that leads to it; backward from the nodes that kept
    their own id, within its colour, a component is found. The others are coloured anew.
    """
    found, left = None, cut(edges, "scc-edges")
    while not left.isEmpty():
        ids = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        colour = cut(ids.withColumn("c", F.col("id")), "colours")
        while True:
            got = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("from"))
            nxt = cut(colour.join(got, "id", "left").select("id", F.greatest("c", F.coalesce("from", "c")).alias("c"), (F.coalesce("from", "c") > F.col("c")).alias("new")), "colours")
            colour = nxt.select("id", "c")
            if nxt.where("new").isEmpty():
                break
        own = cut(left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst"), "scc-edges")
        front = seen = cut(colour.where("id = c"), "found")
        while True:
            back = own.join(front.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = cut(back.join(seen.select("id"), "id", "left_anti"), "found")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        seen = cut(seen, "found")
        found = seen if found is None else found.unionByName(seen)
        left = _trimmed(_without(own, seen))
    return found.withColumnRenamed("c", "colour") if found is not None else edges.select(F.col("src").alias("id"), F.col("src").alias("colour")).limit(0)


def strong_components(g: Graph, *, edge_types=None) -> DataFrame:
    """id, component of all nodes that lie on cycles of two or more: the component is its smallest id.

    Ends are trimmed, then paths of nodes with one edge in and one out become single edges, so that
    long cycles are short ones for the colouring; such nodes follow what their path joins.
    """
    left = _trimmed(_steps(g, edge_types))
    ways = _single(left, "dst", "src").join(_single(left, "src", "dst").select("id", F.col("up").alias("next")), "id")
    ways = cut(ways, "ways")
    back = _jump(ways.drop("next"))
    on = _jump(ways.select("id", F.col("next").alias("up"), "far", "base", F.least("id", "next").alias("least")))
    ring = back.where("open").select("id", F.col("least").alias("component"))
    between = cut(back.where("not open").select("id", F.col("up").alias("a")).join(on.select("id", F.col("up").alias("b")), "id"), "between")
    short = _without(left, ways).union(between.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
    colour = cut(_coloured(short), "colours")
    both = between.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("x")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("y")), "b").where("x = y").select("id", F.col("x").alias("colour"))
    members = colour.unionByName(both)
    named = members.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return members.join(named, "colour").select("id", "component").unionByName(ring)


def condensed(g: Graph, *, edge_types=None) -> tuple[DataFrame, DataFrame]:
    """(id, component) of every node, single ones with their own id, and the distinct edges (src, dst) between components: no cycles are left."""
    own = cut(strong_components(g, edge_types=edge_types), "components")
    of = g.nodes.select("id").distinct().join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    e = _steps(g, edge_types)
    for end in ("src", "dst"):
        e = e.join(own.select(F.col("id").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    return of, e.where("src <> dst").select("src", "dst").distinct()


def detect_cycles(g: Graph, *, edge_types=("depends_on",), max_len: int | None = None) -> DataFrame:
    """length and path of every simple cycle, each once, from its smallest node; of those of up to max_len edges if it is given.

    Paths are grown within strongly connected components only. Their number is exponential where
    many cycles share nodes, by nature; what leads to, from or between cycles costs nothing.
    """
    own = cut(strong_components(g, edge_types=edge_types), "components")
    ends = lambda end: own.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    steps = cut(_steps(g, edge_types).join(ends("src"), "src").join(ends("dst"), "dst").where("c_src = c_dst").select("src", "dst"), "cycle-edges")
    paths = steps.where(F.col("dst") > F.col("src")).select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    found = None
    for n in count(2) if max_len is None else range(2, max_len + 1):
        nxt = cut(paths.join(steps, paths["at"] == steps["src"]).where((F.col("dst") >= F.col("start")) & ((F.col("dst") == F.col("start")) | ~F.array_contains("path", F.col("dst")))), "cycles")
        closed = nxt.where(F.col("dst") == F.col("start")).select(F.lit(n).alias("length"), "path")
        found = closed if found is None else found.union(closed)
        paths = nxt.where(F.col("dst") != F.col("start")).select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        if paths.isEmpty():
            break
    return found if found is not None else paths.select(F.lit(0).alias("length"), "path").limit(0)


def layering(g: Graph, *, edge_types=None, condense: bool = False) -> DataFrame:
    """id and layer: the longest path from a source. Nodes on or behind cycles share one layer after all others, or, if condensed, a component is one node.

    A node that all edges of known layers lead to has its layer. One whose open edges come from a
    single node is that node's layer and a distance, or what known layers ask of it; such nodes are
    followed to the first that has more, by doubling, and their edges become its edges. So paths and
    trees take one round, whatever their depth.
    """
    if condense:
        of, steps = condensed(g, edge_types=edge_types)
        of = cut(of, "components")
        left = cut(of.select(F.col("component").alias("id")).distinct(), "layer-ids")
    else:
        left, steps = cut(g.nodes.select("id").distinct(), "layer-ids"), _steps(g, edge_types)
    edges = cut(steps.withColumn("w", F.lit(1).cast("long")), "layer-edges")
    asked = left.select("id", F.lit(0).cast("long").alias("base")).limit(0)  # what known layers ask of a node
    known, deferred = [], []
    most = lambda df: df.groupBy("id").agg(F.max("base").alias("base"))
    while True:
        free = left.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").join(asked, "id", "left")
        free = cut(free.select("id", F.coalesce("base", F.lit(0)).alias("layer")), "layer")
        if not free.isEmpty():
            known.append(free)
            given = edges.join(free.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("layer") + F.col("w")).alias("base"))
            asked = cut(most(asked.unionByName(given)), "asked")
            left = cut(left.join(free, "id", "left_anti"), "layer-ids")
            edges = cut(edges.join(free.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "w"), "layer-edges")
        one = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("up"), F.min("w").alias("far")).where("n = 1").join(left, "id", "left_semi")
        pointers = one.join(asked, "id", "left").select("id", "up", "far", F.coalesce("base", F.lit(0)).alias("base"), F.col("id").alias("least"))
        held = cut(_jump(pointers).where("not open").select("id", "up", "far", "base"), "deferred")
        if held.isEmpty():
            if free.isEmpty():
                break
            continue
        deferred.append(held)
        left = cut(left.join(held, "id", "left_anti"), "layer-ids")
        rest = edges.join(held.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "w")
        over = rest.join(held.withColumnRenamed("id", "src"), "src", "left")
        given = over.where("up is not null").select(F.col("dst").alias("id"), (F.col("base") + F.col("w")).alias("base"))
        moved = over.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("far", F.lit(0))).alias("w"))
        new_asked, edges = cut(most(asked.unionByName(given)), "asked"), cut(moved.groupBy("src", "dst").agg(F.max("w").alias("w")), "layer-edges")
        asked = new_asked
    layers = known[0] if known else left.select("id", F.lit(0).cast("long").alias("layer")).limit(0)
    for k in known[1:]:
        layers = layers.unionByName(k)
    for held in reversed(deferred):
        layers = cut(layers, "layers")
        layers = layers.unionByName(held.join(layers.withColumnRenamed("id", "up"), "up").select("id", F.greatest("base", F.col("layer") + F.col("far")).alias("layer")))
    layers = cut(layers, "layers")
    if condense:
        return of.join(layers.withColumnRenamed("id", "component"), "component").select("id", F.col("layer").cast("int").alias("layer"))
    last = layers.agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("layer"))
    behind = g.nodes.select("id").distinct().join(layers, "id", "left_anti").join(F.broadcast(last), F.lit(True))  # one row
    return layers.unionByName(behind.select("id", "layer")).select("id", F.col("layer").cast("int").alias("layer"))
