"""Dependencies between services, their infrastructure and data, and what a repository holds at a glance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import token_estimate
from ..model import Graph
from .derive import env_to_database
from .metrics import type_counts
from .symbols import type_annotation_match

#: Component types that count as services, constructors, methods that read and write.
SERVICE_TYPES = "service engine manager processor handler executor orchestrator coordinator".split()
CONSTRUCTORS = "__init__ __new__ constructor init setUp".split()
READS = "find find_one find_all get get_or_404 filter filter_by all first one scalar execute fetchall fetchone read load query".split()
WRITES = "save add create insert update delete remove bulk_create bulk_update upsert commit write store put".split()
#: Resource types by what they stand for.
RESOURCES = {
    "Cluster": "aws_eks_cluster aws_ecs_cluster google_container_cluster azurerm_kubernetes_cluster digitalocean_kubernetes_cluster azurerm_container_app_environment",
    "Service": "aws_ecs_service aws_lambda_function google_cloud_run_service azurerm_container_group kubernetes_deployment kubernetes_service helm_release",
    "Database": "aws_db_instance aws_rds_cluster aws_dynamodb_table aws_elasticache_cluster aws_elasticache_replication_group google_sql_database_instance google_bigtable_instance "
    "google_firestore_database azurerm_sql_server azurerm_cosmosdb_account azurerm_redis_cache digitalocean_database_cluster mongodbatlas_cluster",
}
_HEAD = r'resource\s+"([^"]+)"\s+"([^"]+)"\s*\{'


def service_deps_ctor(functions: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (src, dst): components whose constructors (owner id, name, parameters) name another component (id, name, seq)."""
    made = functions.where(F.col("name").isin(CONSTRUCTORS) & F.col("owner").isNotNull())
    return type_annotation_match(made.select(F.col("owner").alias("src"), F.col("parameters").alias("annotation")), components)


def service_deps_import(imports: DataFrame, components: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (src, dst) of components (id, path, module) in files (path) that import a module (target), without the known pairs."""
    src = components.select(F.col("id").alias("src"), "path")
    dst = components.select(F.col("id").alias("dst"), F.col("module").alias("target"))
    pairs = imports.select("path", "target").distinct().join(src, "path").join(dst, "target").select("src", "dst").where(F.col("src") != F.col("dst")).distinct()
    return pairs.join(known.select("src", "dst"), ["src", "dst"], "left_anti")


def _lifted(calls: DataFrame, functions: DataFrame, components: DataFrame) -> DataFrame:
    """Calls (src, dst) of functions (id, component, is_api) between components (id, component_type), the called one a service."""
    kind = components.select(F.col("id").alias("component"), F.col("component_type").isin(SERVICE_TYPES).alias("service"))
    f = functions.join(kind, "component", "left").select("id", "component", "is_api", F.coalesce("service", F.lit(False)).alias("service"))
    a = f.select(F.col("id").alias("src"), F.col("component").alias("ca"), "is_api", F.col("service").alias("sa"))
    b = f.where("service").select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    return calls.select("src", "dst").distinct().join(a, "src").join(b, "dst").where(~F.col("ca").eqNullSafe(F.col("cb")))


def api_calls(calls: DataFrame, functions: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (src, dst): API functions and the service components that they call."""
    return _lifted(calls, functions, components).where("is_api").select("src", F.col("cb").alias("dst")).distinct()


def service_calls(calls: DataFrame, functions: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (src, dst): service components whose other functions call a service component."""
    return _lifted(calls, functions, components).where(~F.col("is_api") & F.col("sa")).select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()


def static_lineage(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst, type: the first reading or writing call (src, receiver, callee, seq) that a function makes on each entity (id, name)."""
    keys = F.array("receiver", F.initcap(F.replace("receiver", F.lit("_"), F.lit(""))))
    verb = F.lower("callee")
    op = F.when(verb.isin(READS), "reads").when(verb.isin(WRITES), "writes")
    k = calls.select("src", "seq", op.alias("type"), F.posexplode(keys).alias("pos", "name")).where(F.col("type").isNotNull())
    names = entities.groupBy("name").agg(F.max("id").alias("dst"))
    hit = k.join(names, "name").groupBy("src", "seq", "type").agg(F.min_by("dst", "pos").alias("dst"))
    return hit.groupBy("src", "dst").agg(F.min_by("type", "seq").alias("type"))


def scan_terraform(files: DataFrame) -> DataFrame:
    """path, resource, logical, kind, name, cluster, refs of the known resource blocks of files (path, content).

    A block ends at the first line that starts with its closing brace, at the latest before the next
    block. cluster and refs are keys resource.logical, not display names, so no cluster appears twice.
    """
    block = F.explode(F.split("content", f"(?={_HEAD})")).alias("b")
    kind = F.create_map(*[F.lit(v) for k, rs in RESOURCES.items() for r in rs.split() for v in (r, k)])
    x = files.select("path", block).where(F.col("b").rlike("^" + _HEAD))
    part = lambda i: F.regexp_extract("b", "^" + _HEAD, i)
    whole = F.regexp_extract("b", r"(?s)^(.*?)\n\}", 1)
    x = x.select("path", part(1).alias("resource"), part(2).alias("logical"), F.when(whole == "", F.col("b")).otherwise(whole).alias("body")).withColumn("kind", kind[F.col("resource")]).where(F.col("kind").isNotNull())
    name = F.regexp_extract("body", r'(?m)^\s*(?:name|identifier|function_name)\s*=\s*"([^"]+)"', 1)
    cluster = F.regexp_extract("body", r"(?m)^\s*cluster\s*=\s*(\w+\.\w+)", 1)
    refs = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([a-z]+_\w+\.\w+)\.\w+"), 1))
    return x.select("path", "resource", "logical", "kind", F.when(name == "", F.col("logical")).otherwise(name).alias("name"), F.nullif(cluster, F.lit("")).alias("cluster"), refs.alias("refs"))


#: Kinds of Kubernetes objects that are services, and that are clusters; parts of image names that are databases.
K8S_SERVICES = ("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob", "Service")
K8S_CLUSTERS = ("Namespace", "ClusterRole", "ClusterRoleBinding")
DATABASE_IMAGES = ("postgres", "mysql", "mariadb", "mongodb", "mongo", "redis", "elasticsearch", "cassandra", "cockroachdb", "mssql", "oracle", "sqlite")


def _found(df: DataFrame, source: int, type_: str, name, path: str, *props) -> DataFrame:
    """type, name, props of what a source says, with its rank."""
    return df.select(F.lit(type_).alias("type"), name.alias("name"), F.struct(F.lit(source).alias("source"), F.col(path).alias("path"), F.to_json(F.struct(*props, F.col(path).alias("source_file"))).alias("props")).alias("said"))


def _from_docker(rows: DataFrame) -> DataFrame:
    image = F.element_at(F.split(F.split("value", ":")[0], "/"), -1)
    boxes = _found(rows.where("kind = 'image'"), 0, "Component", image, "path", F.col("value").alias("image"), F.lit("container").alias("role"))
    env = rows.where("kind = 'env'").select("path", F.col("value").alias("name"))
    return boxes.union(_found(env.join(env_to_database(env.select("name").distinct()), "name"), 0, "Database", F.col("database"), "path"))


def _from_kubernetes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges by type and name of both ends."""
    named = rows.where(F.coalesce("name", F.lit("")) != "").withColumn("space", F.coalesce(F.nullif("namespace", F.lit("")), F.lit("default")))
    own = named.where(F.col("kind").isin(*K8S_SERVICES))
    low, box = F.lower("image"), F.element_at(F.split(F.split("image", ":")[0], "/"), -1)
    hint = F.coalesce(*[F.when(low.contains(h), F.lit(h.capitalize())) for h in DATABASE_IMAGES])
    images = own.where(F.coalesce("image", F.lit("")) != "").withColumn("database", hint)
    env = own.where("env is not null").withColumnRenamed("name", "service").withColumnRenamed("env", "name")
    asks = env.join(env_to_database(env.select("name").distinct()), "name").select("path", F.col("service").alias("name"), "database")
    nodes = reduce(DataFrame.union, [
        _found(own, 1, "Service", F.col("name"), "path", "kind", F.col("space").alias("namespace")),
        _found(own, 1, "Cluster", F.col("space"), "path", F.lit("k8s_namespace").alias("type")),
        _found(named.where(F.col("kind").isin(*K8S_CLUSTERS)), 1, "Cluster", F.col("name"), "path", "kind"),
        _found(images.where("database is null"), 1, "Component", box, "path", "image", F.lit("container").alias("role")),
        _found(images.where("database is not null"), 1, "Database", F.col("database"), "path", "image"),
        _found(asks, 1, "Database", F.col("database"), "path"),
    ])
    uses = images.where("database is not null").select("name", "database").union(asks.select("name", "database"))
    edge = lambda df, to, kind, type_: df.select(F.concat(F.lit("Service::"), "name").alias("src"), F.concat(F.lit(f"{kind}::"), to).alias("dst"), F.lit(type_).alias("type"))
    return nodes, edge(own, F.col("space"), "Cluster", "deployed_on").union(edge(uses, F.col("database"), "Database", "uses"))


def _from_terraform(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = resources.withColumn("id", F.concat("kind", F.lit("::"), "name")).withColumn("key", F.concat("resource", F.lit("."), "logical"))
    said = F.struct(F.lit(2).alias("source"), F.concat_ws(" ", "path", "logical").alias("path"), F.to_json(F.struct("resource", "path")).alias("props"))
    target = r.select(F.col("key").alias("ref"), F.col("id").alias("dst"), F.col("kind").alias("of")).distinct()
    own = r.where("kind = 'Service'")
    on = own.select("id", F.col("cluster").alias("ref"), F.lit("Cluster").alias("of"), F.lit("deployed_on").alias("type"))
    uses = own.select("id", F.explode("refs").alias("ref"), F.lit("Database").alias("of"), F.lit("uses").alias("type"))
    return r.select(F.col("kind").alias("type"), "name", said.alias("said")), on.union(uses).join(target, ["ref", "of"]).select(F.col("id").alias("src"), "dst", "type")


def infra_graph(terraform: DataFrame | None = None, docker: DataFrame | None = None, kubernetes: DataFrame | None = None) -> Graph:
    """Service, Component (containers), Cluster and Database nodes, one for each type and name, of any of the sources.

    terraform: rows of scan_terraform(); docker: rows of scan_dockerfiles(); kubernetes: path, kind,
    name, namespace, image, env, a row for each object, image and variable. What is said of a name
    by Dockerfiles wins, then by Kubernetes, then by Terraform, and within a source by the first
    path. Services are deployed on clusters, those of Kubernetes on their namespace, and use databases.
    """
    nodes, edges = [], []
    if docker is not None:
        nodes.append(_from_docker(docker))
    for source, read in ((kubernetes, _from_kubernetes), (terraform, _from_terraform)):
        if source is not None:
            n, e = read(source)
            nodes.append(n)
            edges.append(e)
    n = reduce(DataFrame.union, nodes).where("name is not null and name <> ''").groupBy("type", "name").agg(F.min("said").alias("said"))
    n = n.select(F.concat("type", F.lit("::"), "name").alias("id"), "type", "name", F.col("said.props").alias("props"), F.lit(0).cast("long").alias("seq"))
    none = n.select(F.col("id").alias("src"), F.col("id").alias("dst"), "type").limit(0)
    e = reduce(DataFrame.union, edges, none).distinct()
    return Graph(n, e.select("src", "dst", "type", F.lit("{}").alias("props"), F.lit(0).cast("long").alias("seq")))


def repo_tree(modules: DataFrame, files: DataFrame, max_depth: int = 3, most: int = 8) -> DataFrame:
    """path, parent, depth, file_count, position: the first modules (path) below each parent, with the files (path) that lie in them."""
    up = F.regexp_replace("path", "/?[^/]*$", "")
    m = modules.select("path").distinct().withColumn("depth", F.size(F.split("path", "/")) - 1).where(F.col("depth") < max_depth).withColumn("parent", up)
    k = F.row_number().over(Window.partitionBy("parent").orderBy("path"))
    held = files.groupBy(up.alias("path")).agg(F.count("*").alias("file_count"))
    return m.withColumn("position", k).where(F.col("position") <= most).join(held, "path", "left").select("path", "parent", "depth", F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"), "position")


def count_summary(g: Graph, most_tokens: int = 8000) -> DataFrame:
    """text, tokens, truncated: the counts of a graph's types as lines; one row."""
    line = F.concat("kind", F.lit(" "), "type", F.lit(": "), F.col("n").cast("string"))
    text = type_counts(g).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return text.select("text", token_estimate(F.col("text")).cast("long").alias("tokens")).withColumn("truncated", F.col("tokens") > most_tokens)


def infer_services(g: Graph) -> DataFrame:
    """Top modules (path without a slash) as services, in graphs that have no service."""
    none = g.nodes.where("type = 'Service'").limit(1).agg(F.count("*").alias("c")).where("c = 0").select(F.lit(1).alias("one"))
    top = g.nodes.where("type = 'Module'").where(~F.coalesce(F.get_json_object("props", "$.path"), F.col("name")).contains("/"))
    return top.join(F.broadcast(none), F.lit(1) == F.col("one")).select(F.concat(F.lit("Service::"), "name").alias("id"), F.lit("Service").alias("type"), "name", F.lit('{"confidence":0.5}').alias("props"), "seq")


def extract_languages(files: DataFrame) -> DataFrame:
    """The distinct languages in order, or unknown; one row."""
    found = F.array_sort(F.collect_set("language"))
    return files.agg(F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("unknown").alias("languages"))
