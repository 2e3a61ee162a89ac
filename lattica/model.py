"""The property graph as two DataFrames, its vocabularies and ids.

nodes: id, type, name, props (JSON object as text), seq; edges: src, dst, type, props, seq.
seq is arrival order: rows of a DataFrame have none of their own, so first and last always mean seq.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, type string, name string, props string, seq long"
EDGE_SCHEMA = "src string, dst string, type string, props string, seq long"

#: Node types that validation knows.
NODE_TYPES = (
    "Repository Module File Class Function Component Service API DataObject Table Event Topic Pipeline "
    "Cluster Database Layer Flow BusinessFlow Domain BoundedContext DomainEntity"
).split()
#: Edge types that validation knows.
EDGE_TYPES = (
    "contains defines calls depends_on implements reads writes produces consumes publishes subscribes deployed_on "
    "uses routes_to triggers belongs_to flow_step transforms part_of imports extends"
).split()
#: Edge types of lineage, of events, of services.
LINEAGE_TYPES = ("depends_on", "reads", "writes", "produces", "consumes")
EVENT_TYPES = ("publishes", "routes_to", "consumes", "produces", "subscribes")
SERVICE_EDGE_TYPES = ("deployed_on", "uses", "depends_on")
#: Properties that nodes of a type must have.
REQUIRED_PROPS = (("Layer", "layer_index"), ("BusinessFlow", "trigger"), ("DomainEntity", "entity_type"))
#: Node types that each level of detail adds to those before it.
LEVELS = (
    ("repository", ("Repository",)),
    ("module", ("Module",)),
    ("file", ("File",)),
    ("class", ("Class", "Component")),
    ("function", ("Function", "API", "Service", "Database", "Event", "Topic", "Pipeline", "Cluster", "DataObject", "Table")),
)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is made only where both are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table in the folder that the session shares, so that loops don't grow their plans and lost executors don't undo them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made from them is written itself."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Asks the driver to collect garbage: Spark lets shuffle files of finished steps go only then."""
    spark.sparkContext._jvm.System.gc()


def node_id(kind: Column, path: Column, name: Column) -> Column:
    """``type:path:name``, deterministic; slashes at the path's ends go, odd characters of the name become _."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.concat_ws(":", kind, clean, F.regexp_replace(name, r"[^\w.\-]", "_"))


def parse_node_id(id_: Column) -> Column:
    """struct(type, path, name), or null unless the id has exactly three parts."""
    p = F.split(id_, ":")
    return F.when(F.size(p) == 3, F.struct(p[0].alias("type"), p[1].alias("path"), p[2].alias("name")))


def edge_key(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat_ws("|", src, kind, dst)
