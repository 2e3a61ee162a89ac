"""Stored graphs below a folder, and results kept by key.

Nodes and edges are Parquet partitioned by graph_id and version. A save writes a new version, then
commits its catalog row to the folder's log; the last row of a graph says which version it has. So
a reader sees a graph whole, before or after a save, and a save that is lost changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from ..operators.merge import _one
from .commits import Commits

CATALOG = "graph_id string, repo_name string, graph_type string, node_count long, edge_count long, git_commit string, created_at timestamp"
#: Versions of a graph that stay on disk: the newest, and those before it that readers may still hold.
KEEP = 2


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _rows(spark: SparkSession, root: str) -> DataFrame:
    """Every row of the catalog's log, in order n; deleted graphs end with one that says so."""
    schema = f"{CATALOG}, version string, deleted boolean"
    if not _exists(spark, f"{root}/log"):
        return spark.createDataFrame([], f"{schema}, n long")
    n = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long")
    return spark.read.schema(schema).json(f"{root}/log").withColumn("n", n)


def _current(spark: SparkSession, root: str) -> DataFrame:
    return _one(_rows(spark, root), ["graph_id"], ["n"], True).where(~F.col("deleted"))


def list_graphs(spark: SparkSession, root: str) -> DataFrame:
    """Catalog rows, newest first."""
    return _current(spark, root).orderBy(F.desc("created_at"), "graph_id").select(*[c.split()[0] for c in CATALOG.split(", ")])


def _commit(spark: SparkSession, root: str, row: dict) -> None:
    log = Commits(spark, root)
    while not log.commit((log.versions() or [0])[-1] + 1, row):
        pass  # another one took the number


def _drop_versions(spark: SparkSession, root: str, graph_id: str, keep: int) -> None:
    """Deletes the data of a graph's versions but the newest ones."""
    found = _rows(spark, root).where((F.col("graph_id") == graph_id) & ~F.col("deleted")).orderBy(F.desc("n")).select("version").collect()  # one row for each save of a graph
    for r in found[keep:]:
        for what in ("nodes", "edges"):
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{what}/*/version={r['version']}")
            fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
            for x in fs.globStatus(p) or []:
                fs.delete(x.getPath(), True)


def save_graph(g: Graph, root: str, graph_id: str, *, repo_name: str = "", graph_type: str = "code", git_commit: str = "", keep: int = KEEP) -> DataFrame:
    """Stores a graph in place of one with its id, which it may be read from, and its catalog row."""
    spark, version = g.nodes.sparkSession, uuid.uuid4().hex
    counts = []
    for what, df in (("nodes", g.nodes), ("edges", g.edges)):
        df.select("*", F.lit(graph_id).alias("graph_id"), F.lit(version).alias("version")).write.mode("append").partitionBy("graph_id", "version").parquet(f"{root}/{what}")
        counts.append(_stored(spark, root, what).where((F.col("graph_id") == graph_id) & (F.col("version") == version)).count())
    now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("t")).head()["t"]
    _commit(spark, root, {"graph_id": graph_id, "repo_name": repo_name, "graph_type": graph_type, "node_count": counts[0], "edge_count": counts[1], "git_commit": git_commit, "created_at": now, "version": version, "deleted": False})
    _drop_versions(spark, root, graph_id, keep)
    return list_graphs(spark, root)


def _stored(spark: SparkSession, root: str, what: str) -> DataFrame:
    schema = f"{NODE_SCHEMA if what == 'nodes' else EDGE_SCHEMA}, graph_id string, version string"
    return spark.read.schema(schema).parquet(f"{root}/{what}") if _exists(spark, f"{root}/{what}") else spark.createDataFrame([], schema)


def load_graph(spark: SparkSession, root: str, graph_id: str) -> Graph | None:
    """A stored graph, by partition pruning; None if there is none."""
    found = _current(spark, root).where(F.col("graph_id") == graph_id).select("version").head()
    if not found:
        return None
    read = lambda what: _stored(spark, root, what).where((F.col("graph_id") == graph_id) & (F.col("version") == found["version"])).drop("graph_id", "version")
    return Graph(read("nodes"), read("edges"))


def latest_graphs(spark: SparkSession, root: str, n: int = 5) -> DataFrame:
    """The n newest catalog rows."""
    return list_graphs(spark, root).limit(n)


def _all_of(spark: SparkSession, root: str, hits: DataFrame) -> Graph:
    """Nodes and edges of the catalog rows hits (graph_id, version, and more): one scan each, whose partitions the hits prune."""
    read = lambda what: _stored(spark, root, what).join(hits, ["graph_id", "version"]).drop("version")
    return Graph(read("nodes"), read("edges"))


def load_and_merge(spark: SparkSession, root: str, graph_ids: list[str]) -> Graph:
    """Stored graphs as one, in order: of nodes with an id, and of edges with src, dst and type, the last one stays. Unknown ids are passed over."""
    order = spark.createDataFrame([(g, i) for g, i in {g: i for i, g in enumerate(graph_ids)}.items()], "graph_id string, layer int")
    g = _all_of(spark, root, _current(spark, root).select("graph_id", "version").join(order, "graph_id"))
    return Graph(_one(g.nodes.drop("graph_id"), ["id"], ["layer", "seq"], True).drop("layer"), _one(g.edges.drop("graph_id"), ["src", "dst", "type"], ["layer", "seq"], True).drop("layer"))


def delete_graph(spark: SparkSession, root: str, graph_id: str) -> None:
    """The graph's catalog row goes, then its data."""
    if _current(spark, root).where(F.col("graph_id") == graph_id).isEmpty():
        return
    _commit(spark, root, {"graph_id": graph_id, "deleted": True})
    _drop_versions(spark, root, graph_id, 0)


def search_graphs_by_repo(spark: SparkSession, root: str, text: str) -> DataFrame:
    """Catalog rows whose repository has the text in its name, in any case."""
    return list_graphs(spark, root).where(F.lower("repo_name").contains(text.lower()))


def load_by_repo(spark: SparkSession, root: str, text: str) -> Graph:
    """All graphs that search_graphs_by_repo finds, with a column graph_id."""
    hits = _current(spark, root).where(F.lower("repo_name").contains(text.lower()))
    return _all_of(spark, root, hits.select("graph_id", "version"))


def export_json(g: Graph, metrics: DataFrame | None = None, *, graph_id: str = "", repo_name: str = "", git_commit: str = "") -> DataFrame:
    """Lines of JSON: one meta line (what the graph is, and its counts by type), one for each node (with its metrics) and edge: kind, json. Write with df.write.text."""
    nodes = g.nodes.join(metrics, "id", "left") if metrics is not None else g.nodes
    counts = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    of = lambda what: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("type", "n")))))  # noqa: E731  one entry for each type
    total = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    meta = counts(g.nodes, "node").union(counts(g.edges, "edge")).where("type is not null").agg(
        F.to_json(F.struct(F.lit(graph_id).alias("graph_id"), F.lit(repo_name).alias("repo_name"), F.lit(git_commit).alias("git_commit"), total("node").alias("node_count"), total("edge").alias("edge_count"), of("node").alias("node_type_counts"), of("edge").alias("edge_type_counts"))).alias("json")
    ).select(F.lit("meta").alias("kind"), "json")
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))
    return meta.union(line(nodes, "node")).union(line(g.edges, "edge"))


def import_json(lines: DataFrame) -> Graph:
    """The graph of export_json's lines."""
    read = lambda kind, schema: lines.where(F.col("kind") == kind).select(F.from_json("json", schema).alias("r")).select("r.*")
    return Graph(read("node", NODE_SCHEMA), read("edge", EDGE_SCHEMA))


# results: a bucketed table that is only appended to; of a key's rows the last one counts

KEYS = ["repo", "commit_sha", "analyzer"]
RESULTS = "repo string, commit_sha string, analyzer string, result string"
BUCKETS = 64


def create_results(spark: SparkSession, name: str, path: str, *, buckets: int = BUCKETS) -> None:
    """An empty table of results at path, bucketed by its keys."""
    _append(spark.createDataFrame([], f"{RESULTS}, put long, gone boolean"), name, path, buckets)


def _append(rows: DataFrame, name: str, path: str, buckets: int) -> None:
    rows.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path).mode("append").format("parquet").saveAsTable(name)


def _spec(spark: SparkSession, name: str) -> tuple[str, int]:
    """Where a table of results is, and its number of buckets."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}  # one row for each property
    return said["Location"], int(said["Num Buckets"])


def stored_results(spark: SparkSession, name: str) -> DataFrame:
    """The results that hold: of each key the last one put, unless it was invalidated since. No shuffle: a key's rows are in one bucket."""
    last = F.max(F.struct("put", F.col("result").alias("value"), "gone")).alias("r")
    return spark.table(name).groupBy(*KEYS).agg(last).where(~F.col("r.gone")).select(*KEYS, F.col("r.value").alias("result"))


def _turn(spark: SparkSession, name: str) -> int:
    return (spark.table(name).agg(F.max("put")).head()[0] or 0) + 1


def put_results(spark: SparkSession, name: str, new: DataFrame) -> None:
    """Stores results, which replace those of their keys; an empty sha is not kept. One writer at a time."""
    rows = new.where(F.coalesce("commit_sha", F.lit("")) != "").select(*KEYS, "result", F.lit(_turn(spark, name)).cast("long").alias("put"), F.lit(False).alias("gone"))
    _append(rows, name, *_spec(spark, name))


def reuse_results(spark: SparkSession, name: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored results of the wanted keys, and the keys still to compute; an empty sha is never a hit. Only what is wanted is shuffled."""
    asked = wanted.select(*KEYS).distinct()
    hits = stored_results(spark, name).join(asked.hint("shuffle_hash"), KEYS, "left_semi")
    return hits, wanted.join(hits.select(*KEYS), KEYS, "left_anti")


def invalidate_results(spark: SparkSession, name: str, repo: str) -> None:
    """Stored results of a repository hold no more."""
    keys = stored_results(spark, name).where(F.col("repo") == repo).select(*KEYS, F.lit(None).cast("string").alias("result"), F.lit(_turn(spark, name)).cast("long").alias("put"), F.lit(True).alias("gone"))
    _append(keys, name, *_spec(spark, name))


def result_stats(spark: SparkSession, name: str) -> DataFrame:
    """analyzer, repos, results of what is stored."""
    return stored_results(spark, name).groupBy("analyzer").agg(F.countDistinct("repo").alias("repos"), F.count("*").alias("results"))


def list_results(spark: SparkSession, name: str) -> DataFrame:
    """repo, commits, analyzers (sorted), results of each repository that has any."""
    return stored_results(spark, name).groupBy("repo").agg(F.countDistinct("commit_sha").alias("commits"), F.array_sort(F.collect_set("analyzer")).alias("analyzers"), F.count("*").alias("results"))
