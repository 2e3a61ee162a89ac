"""Vector search, and search joined with graph expansion for retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import confidence
from ..model import Graph, cut
from .traverse import graph_expand


def node_text(nodes: DataFrame) -> DataFrame:
    """id, document: what of a node is embedded."""
    p = lambda k: F.get_json_object("props", f"$.{k}")
    domain = F.when(p("domain").isNotNull(), F.concat(F.lit("domain: "), p("domain")))
    resp = F.array_join(F.slice(F.from_json(p("responsibilities"), "array<string>"), 1, 3), " ")
    return nodes.select("id", F.concat_ws(" ", "name", "type", p("description"), domain, resp, F.substring(p("docstring"), 1, 200), F.element_at(F.split(p("source_file"), "/"), -1)).alias("document"))


def _nearest(batches, limit: int):
    """Rows (part, kind, id, qid, v), in order of part and kind: the vectors (kind 0) of a part, then its queries."""
    part, ids, rows, x = None, [], [], None
    for pdf in batches:
        out: dict[str, list] = {"qid": [], "id": [], "distance": []}
        for key, kind, i, q, v in zip(pdf["part"], pdf["kind"], pdf["id"], pdf["qid"], pdf["v"], strict=True):
            if key != part:
                part, ids, rows, x = key, [], [], None
            if kind == 0:
                ids.append(i)
                rows.append(v)
                continue
            if x is None:
                x, rows = np.array(rows, "f8"), []
            if not len(ids):
                continue
            d = ((x - np.asarray(v, "f8")) ** 2).sum(axis=1)
            # ties with the last one stay, the id decides between them later
            near = np.flatnonzero(d <= np.partition(d, limit - 1)[limit - 1]) if limit < len(d) else np.arange(len(d))
            near = sorted(near.tolist(), key=lambda r: (d[r], ids[r]))[:limit]  # noqa: B023
            out["qid"] += [q] * len(near)
            out["id"] += [ids[r] for r in near]
            out["distance"] += [float(d[r]) for r in near]
        yield pd.DataFrame({k: pd.Series(v, dtype="f8" if k == "distance" else object) for k, v in out.items()})


def vector_search(vectors: DataFrame, queries: DataFrame, *, limit: int = 10, where: Column | None = None, block: int = 1 << 16) -> DataFrame:
    """qid, id, distance, rank: the nearest vectors (id, embedding) of each query (qid, embedding); ties to the smaller id.

    Vectors are dealt in blocks of a bounded number of rows, and queries stream past each block, so
    neither set is ever in one task; each block gives a query's best rows only. Null vectors take no
    part, and a query meets vectors of its own length.
    """
    v = (vectors.where(where) if where is not None else vectors).select("id", F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.col("v").isNotNull())
    q = queries.select("qid", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    blocks = max(1, -(-v.count() // block))
    kinds = v.schema["id"].dataType.simpleString(), q.schema["qid"].dataType.simpleString()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = v.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("b"), F.lit(0).alias("kind"), "id", F.lit("0").cast(kinds[1]).alias("qid"), "v")
    ask = q.select(every.alias("b"), F.lit(1).alias("kind"), F.lit("0").cast(kinds[0]).alias("id"), "qid", "v")
    part = F.concat_ws(":", "b", F.size("v"))
    dealt = own.unionByName(ask).select(part.alias("part"), "kind", "id", "qid", "v").repartition(min(max(blocks, 8), 1 << 16), "part").sortWithinPartitions("part", "kind")
    best = dealt.mapInPandas(lambda batches: _nearest(batches, limit), f"qid {kinds[1]}, id {kinds[0]}, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def embed_nodes(g: Graph, types=("Function", "Component", "API"), dims: int = 32) -> DataFrame:
    """id, node_type, document, embedding: nodes of some types, their text, and how often its words fall to each of dims places."""
    text = node_text(g.nodes.where(F.col("type").isin(list(types)))).join(g.nodes.select("id", F.col("type").alias("node_type")), "id")
    place = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(dims))
    word = text.select("id", F.explode(F.split(F.lower("document"), r"\W+")).alias("w")).where("w <> ''").select("id", place.cast("int").alias("d"))
    held = word.groupBy("id", "d").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0)).cast("double"))
    none = F.array_repeat(F.lit(0.0), dims)
    return text.join(held, "id", "left").select("id", "node_type", "document", F.coalesce(F.when(F.col("m").isNotNull(), at), none).alias("embedding"))


def vector_delete(vectors: DataFrame, graph_id: str) -> DataFrame:
    """vectors without those of a graph."""
    return vectors.where(~F.col("graph_id").eqNullSafe(F.lit(graph_id)))


def clean_metadata(props: Column) -> Column:
    """JSON properties as a map of text: nulls go, what is no text is written as JSON."""
    return F.map_filter(F.from_json(props, "map<string,string>"), lambda k, v: v.isNotNull())


def vector_count(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("graph_id").agg(F.count("*").alias("n"))


def rag_context(g: Graph, vectors: DataFrame, questions: DataFrame, *, search_limit: int = 5, expand_depth: int = 1, node_types=None, max_nodes: int = 15, max_edges: int = 20) -> DataFrame:
    """qid, confidence, sources, context: the prompt's context for each question, up to the model call."""
    where = F.col("node_type").isin(list(node_types)) if node_types else None
    hits = cut(vector_search(vectors, questions, limit=search_limit, where=where), "hits")
    sub = graph_expand(g, hits.select("id").distinct(), depth=expand_depth)
    touch = sub.edges.select(F.col("src").alias("id"), F.col("dst").alias("near")).union(sub.edges.select("dst", "src")).union(hits.select("id", F.col("id").alias("near"))).distinct()
    mine = hits.select("qid", "id").join(touch, "id").select("qid", F.col("near").alias("id")).union(hits.select("qid", "id")).distinct().join(sub.nodes, "id")
    kn = F.row_number().over(Window.partitionBy("qid").orderBy("seq", "id"))
    n = mine.withColumn("k", kn).where(F.col("k") <= max_nodes).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "type", "name").alias("t")))), lambda x: x["t"]), "\n").alias("node_text"), F.array_join(F.array_sort(F.collect_set(F.get_json_object("props", "$.source_file"))), ",").alias("sources"))
    es = mine.select("qid", F.col("id").alias("src")).join(sub.edges, "src").withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("seq", "src", "dst", "type"))).where(F.col("k") <= max_edges)
    e = es.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "src", "type", "dst").alias("t")))), lambda x: x["t"]), "\n").alias("edge_text"))
    best = hits.groupBy("qid").agg(F.min("distance").alias("d"))
    return best.join(n, "qid", "left").join(e, "qid", "left").select("qid", confidence(F.col("d")).alias("confidence"), F.coalesce("sources", F.lit("")).alias("sources"), F.concat_ws("\n", "node_text", "edge_text").alias("context"))
