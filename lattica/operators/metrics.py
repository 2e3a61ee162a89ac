"""Counts, degrees, PageRank, rankings and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, cut, forget, sweep


def type_counts(g: Graph) -> DataFrame:
    n = g.nodes.groupBy("type").count().select(F.lit("node").alias("kind"), "type", F.col("count").alias("n"))
    return n.union(g.edges.groupBy("type").count().select(F.lit("edge"), "type", "count"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by graph, kind and type, with a null type for each total; both inputs have graph_id."""
    both = nodes.select("graph_id", F.lit("node").alias("kind"), "type").union(edges.select("graph_id", F.lit("edge"), "type"))
    return both.rollup("graph_id", "kind", "type").agg(F.count("*").alias("n")).where(F.col("kind").isNotNull())


def degree(g: Graph) -> DataFrame:
    """id, in_degree, out_degree over distinct (src, dst) between known nodes."""
    ids = g.nodes.select("id").distinct()
    pairs = g.edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()
    return _degrees(ids, pairs)


def degree_raw(g: Graph) -> DataFrame:
    """The same over every edge row."""
    return _degrees(g.nodes.select("id").distinct(), g.edges)


def _degrees(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    # one aggregation for both directions
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    n = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return ids.join(n, "id", "left").select("id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


#: Nodes of a slice, and slices at most: the edges of a large graph are numbered a slice at a time, so that shuffle files of one slice only are on disk.
SLICE, SLICES = 1 << 20, 8


def _numbered(g: Graph) -> tuple[DataFrame, DataFrame, int]:
    """Written tables: the nodes' ids with a number each (id, k), and the distinct pairs (s, d) of the numbers of known nodes with an edge; how many nodes.

    Ids are shuffled with the edges twice, one end at a time; all that follows shuffles numbers.
    """
    ids = cut(g.nodes.select("id").distinct().withColumn("k", F.monotonically_increasing_id()), "ids")
    n = ids.count()
    slices = max(1, min(SLICES, -(-n // SLICE)))
    known = lambda end, k: ids.select(F.col("id").alias(end), F.col("k").alias(k))

    def sliced(edges: DataFrame, end: str, k: str, last) -> tuple[DataFrame, list[DataFrame]]:
        """Edges with the number of an end in place of its id, written slice by slice of that end; last: what follows in a slice."""
        out, own = [], lambda i: F.pmod(F.xxhash64(end), F.lit(slices)) == i
        for i in range(slices):
            some, of = (edges.where(own(i)), known(end, k).where(own(i))) if slices > 1 else (edges, known(end, k))
            out.append(cut(last(some.join(of.hint("merge"), end).drop(end)), "pairs"))
            sweep(ids.sparkSession)
        return reduce(DataFrame.union, out), out

    half, parts = sliced(g.edges.select("src", "dst"), "src", "s", lambda df: df.select("s", "dst"))
    # in the order of s their shuffles take little room
    pairs, _ = sliced(half, "dst", "d", lambda df: df.select("s", "d").repartition("s").distinct().sortWithinPartitions("s", "d"))
    forget(*parts)
    return ids, pairs, n


def _ranks(ids: DataFrame, pairs: DataFrame, n: int, alpha: float, iterations: int, tol: float | None, max_iter: int) -> DataFrame:
    """k, r: the last step alone stays on disk."""
    if not n:
        return ids.select("k", F.lit(0.0).alias("r"))
    out = pairs.groupBy(F.col("s").alias("k")).agg(F.count("*").alias("out"))
    ranks = cut(ids.select("k").join(out.hint("merge"), "k", "left").select("k", "out", F.lit(1.0 / n).alias("r")), "pr")
    for _ in range(iterations if tol is None else max_iter):
        lost = ranks.where(F.col("out").isNull()).agg(F.sum("r")).first()[0] or 0.0
        give = ranks.where(F.col("out").isNotNull()).select(F.col("k").alias("s"), (F.col("r") / F.col("out")).alias("share"))
        got = pairs.join(give.hint("merge"), "s").groupBy(F.col("d").alias("k")).agg(F.sum("share").alias("got"))
        new = ranks.join(got.hint("merge"), "k", "left").select("k", "out", (alpha * (F.coalesce("got", F.lit(0.0)) + lost / n) + (1 - alpha) / n).alias("r"), *([] if tol is None else [F.col("r").alias("was")]))
        new = cut(new, "pr")
        forget(ranks)
        sweep(ids.sparkSession)  # else shuffle files of all steps stay
        ranks = new
        if tol is not None and (ranks.agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0] or 0.0) < n * tol:
            break
    return ranks.select("k", "r")


def pagerank(g: Graph, *, alpha: float = 0.85, iterations: int = 20, tol: float | None = None, max_iter: int = 100) -> DataFrame:
    """id, pagerank (6 places) over distinct (src, dst); a fixed number of steps, or until the change is below tol a node."""
    ids, pairs, n = _numbered(g)
    ranks = _ranks(ids, pairs, n, alpha, iterations, tol, max_iter)
    return ids.join(ranks.hint("merge"), "k").select("id", F.round("r", 6).alias("pagerank"))


def metrics(g: Graph, *, alpha: float = 0.85, iterations: int = 20) -> DataFrame:
    """id, in_degree, out_degree, pagerank: degree() and pagerank() from one reading of the graph."""
    ids, pairs, n = _numbered(g)
    count = lambda end, name: pairs.groupBy(F.col(end).alias("k")).agg(F.count("*").alias(name)).hint("merge")
    degrees = cut(ids.join(count("d", "in_degree"), "k", "left").join(count("s", "out_degree"), "k", "left").na.fill(0, ["in_degree", "out_degree"]), "degrees")
    ranks = _ranks(ids, pairs, n, alpha, iterations, None, 0)
    return degrees.join(ranks.hint("merge"), "k").select("id", "in_degree", "out_degree", F.round("r", 6).alias("pagerank"))


def rank_functions(g: Graph, metrics: DataFrame, n: int = 40, types=("Function",)) -> DataFrame:
    """The n nodes with the largest pagerank * 1000 + 2 * in_degree + out_degree."""
    score = F.col("pagerank") * 1000 + F.col("in_degree") * 2 + F.col("out_degree")
    out = g.nodes.where(F.col("type").isin(list(types))).join(metrics, "id").withColumn("score", F.round(score, 6))
    return out.orderBy(F.desc("score"), "seq", "id").limit(n).select("id", "name", "score")


def sample_calls(g: Graph, metrics: DataFrame, per_callee: int = 3, n: int = 60, edge_type: str = "calls") -> DataFrame:
    """Up to n calls between known nodes, those of high-ranked callees first, per_callee each."""
    rank = metrics.select(F.col("id").alias("dst"), F.round(F.col("pagerank") * 1000 + F.col("in_degree"), 6).alias("score"))
    known = g.edges.where(F.col("type") == edge_type).join(g.nodes.select(F.col("id").alias("src")), "src", "left_semi").join(rank, "dst")
    w = Window.partitionBy("dst").orderBy("seq", "src")
    top = known.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_callee)
    return top.orderBy(F.desc("score"), "dst", "k").limit(n).select("src", "dst", "score", "k")


def rank_modules(g: Graph, n: int = 20) -> DataFrame:
    child = g.edges.where(F.col("type") == "contains").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("children"))
    out = g.nodes.where(F.col("type") == "Module").join(child, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return out.orderBy(F.desc("children"), "seq", "id").limit(n).select("id", "name", "children")


#: Rows of each section of a summary.
LIMITS = {"modules": 20, "services": 15, "apis": 30, "functions": 40, "call_samples": 60, "databases": 20, "events": 20}


def adaptive_limits(nodes: DataFrame, limits=LIMITS) -> DataFrame:
    """section, n_rows: fewer rows of each section the larger the graph is, at least 5."""
    n = nodes.agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 10_000, 0.4).when(F.col("n") > 4_000, 0.6).when(F.col("n") > 2_000, 0.8).otherwise(1.0)
    table = F.explode(F.map_from_arrays(F.array(*map(F.lit, limits)), F.array(*map(F.lit, limits.values()))))
    return n.select(table.alias("section", "base"), scale.alias("scale")).select("section", F.greatest(F.lit(5), F.floor(F.col("base") * F.col("scale") + 1e-9)).cast("long").alias("n_rows"))


def top_types(g: Graph, n: int = 8) -> DataFrame:
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "type")  # one row for each type
    return type_counts(g).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_nodes(g: Graph, by: str = "type", collapse: int = 50) -> DataFrame:
    """cluster_id, key, members, dominant_type, collapsed; by: a column of nodes."""
    n = g.nodes.where(F.col(by).isNotNull()).groupBy(by, "type").agg(F.count("*").alias("n")) if by != "type" else g.nodes.groupBy("type").agg(F.count("*").alias("n"))
    best = F.min_by("type", F.struct(-F.col("n"), F.col("type")))
    out = n.groupBy(F.col(by).alias("key")).agg(F.sum("n").alias("members"), best.alias("dominant_type"))
    return out.select(F.concat(F.lit(f"cluster::{by}::"), "key").alias("cluster_id"), "key", "members", "dominant_type", (F.col("members") > collapse).alias("collapsed"))


def cluster_quotient(g: Graph, by: str = "type") -> DataFrame:
    """Edges between clusters: src_cluster, dst_cluster, type, n; a cluster's proxy is named by the id that cluster_nodes() gives it."""
    of = g.nodes.where(F.col(by).isNotNull()).select("id", F.concat(F.lit(f"cluster-proxy::cluster::{by}::"), by).alias("c"))
    a, b = of.select(F.col("id").alias("src"), F.col("c").alias("src_cluster")), of.select(F.col("id").alias("dst"), F.col("c").alias("dst_cluster"))
    return g.edges.join(a, "src").join(b, "dst").where(F.col("src_cluster") != F.col("dst_cluster")).groupBy("src_cluster", "dst_cluster", "type").agg(F.count("*").alias("n"))


def event_pub_sub(g: Graph, most: int = 5) -> DataFrame:
    """For each Event or Topic, the first names of those that publish and consume it."""
    to = g.nodes.where(F.col("type").isin("Event", "Topic")).select(F.col("id").alias("dst"), F.col("name").alias("event"))
    role = F.when(F.col("type").isin("publishes", "produces"), "publisher").when(F.col("type").isin("consumes", "subscribes"), "subscriber")
    near = g.edges.withColumn("role", role).where(F.col("role").isNotNull()).join(to, "dst").join(g.nodes.select(F.col("id").alias("src"), F.col("name").alias("who")), "src")
    w = Window.partitionBy("dst", "role").orderBy("seq", "src")
    near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return near.groupBy("dst", "event").pivot("role", ["publisher", "subscriber"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "who"))), lambda x: x["who"]), ",")).select(F.col("dst").alias("id"), "event", F.coalesce("publisher", F.lit("")).alias("publishers"), F.coalesce("subscriber", F.lit("")).alias("subscribers"))
