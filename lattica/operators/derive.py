"""Relationships derived from files, symbols and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flow_name, slugify, stem
from ..model import Graph
from .names import name_contains_match

#: Endings of class names that make a component.
COMPONENT_SUFFIXES = (
    "Service Engine Manager Coordinator Orchestrator Repository Store Cache Registry Dao Handler Processor Executor Runner Worker "
    "Parser Builder Factory Generator Analyzer Detector Scanner Validator Resolver Client Gateway Router Broker Dispatcher Adapter "
    "Transformer Converter Middleware Controller Scheduler Loader Provider Publisher Subscriber Listener Emitter Reader Writer Pipeline"
).split()
#: Parts of decorators of API functions.
API_DECORATORS = (
    "route .get .post .put .delete .patch router.get router.post router.put router.delete app.get app.post app.put app.delete "
    "getmapping postmapping putmapping deletemapping requestmapping Get Post Put Delete Patch Controller api_view action"
).split()
#: Stems of files that hold API functions.
API_STEMS = "api routes router views endpoints controllers handlers".split()
#: Leading verbs of functions, by what they do to data.
VERBS = {
    "reads": "get find load fetch query read list search retrieve select lookup".split(),
    "writes": "save create insert update write put delete remove upsert store persist flush".split(),
    "produces": "publish emit send produce dispatch enqueue fire raise broadcast".split(),
    "consumes": "consume subscribe receive handle process listen on_message dequeue".split(),
}
#: Parts of names that place a class in a layer, in order.
LAYERS = (
    ("PresentationLayer", "controller router view viewset handler endpoint resource blueprint api rest graphql grpc http".split()),
    ("BusinessLayer", "service manager engine orchestrator coordinator usecase interactor command query saga workflow processor executor".split()),
    ("DataLayer", "repository repo dao store cache storage database db client gateway adapter mapper".split()),
    ("DomainLayer", "model entity aggregate valueobject vo domain schema dto".split()),
)
#: Parts of names of infrastructure.
DOMAIN_SKIPPED = "repository repo dao store cache storage controller router view handler endpoint config configuration settings util utils helper mixin middleware serializer validator test mock stub fixture".split()
#: Parts of names of domain classes, by kind.
DOMAIN_KINDS = (
    ("value_object", "any", "vo valueobject value_object dto record address money email phone amount price quantity range period coordinate location".split()),
    ("domain_event", "end", "event message notification command query request response payload envelope".split()),
    ("domain_service", "end", "service manager engine calculator processor orchestrator coordinator factory builder".split()),
)
#: Endings of names of services, of APIs.
ROLE_SUFFIXES = "Service Engine Manager Coordinator Orchestrator Gateway Facade UseCase".split()
ROLE_API = "Controller Router View ViewSet Endpoint Resource Blueprint".split()
#: Libraries of message brokers.
BROKERS = (
    ("kafka", "kafka confluent_kafka aiokafka faust faust_streaming".split()),
    ("rabbitmq", "pika aio_pika kombu amqp celery".split()),
    ("eventbus", "blinker pyee eventemitter django.dispatch django.db.models.signals django.core.signals".split()),
)
_Q = r"""["']([^"']{1,120})["']"""
#: The calls that name a topic, by broker and direction.
TOPIC_PATTERNS = {
    ("kafka", "publish"): [rf"\.send\s*\(\s*{_Q}", rf"\.produce\s*\(\s*{_Q}", rf"\.send_and_wait\s*\(\s*{_Q}"],
    ("kafka", "consume"): [rf"KafkaConsumer\s*\(\s*{_Q}", rf"AIOKafkaConsumer\s*\(\s*{_Q}", rf"\.subscribe\s*\(\s*\[\s*{_Q}", rf"app\.topic\s*\(\s*{_Q}", rf"@app\.agent\s*\(\s*{_Q}", rf"faust\.topic\s*\(\s*{_Q}"],
    ("rabbitmq", "publish"): [rf"basic_publish\s*\([^)]{{0,300}}routing_key\s*=\s*{_Q}", rf"\.publish\s*\([^)]{{0,300}}routing_key\s*=\s*{_Q}", rf"\.publish\s*\([^,)]+,\s*{_Q}"],
    ("rabbitmq", "consume"): [rf"basic_consume\s*\([^)]{{0,300}}queue\s*=\s*{_Q}", rf"queue_declare\s*\([^)]{{0,300}}queue\s*=\s*{_Q}", rf"\bQueue\s*\(\s*{_Q}", rf"exchange_declare\s*\([^)]{{0,300}}exchange\s*=\s*{_Q}"],
    ("eventbus", "publish"): [rf"\.{m}\s*\(\s*{_Q}" for m in ("emit", "publish", "dispatch", "trigger", "fire", "send")] + [rf"signal\s*\(\s*{_Q}"],
    ("eventbus", "consume"): [rf"\.{m}\s*\(\s*{_Q}" for m in ("subscribe", "on", "listen", "add_listener", "connect")] + [rf"on_event\s*\(\s*{_Q}"],
}
#: Names of environment variables that point to a database. They match anywhere in a name.
ENV_PATTERNS = (
    ("PostgreSQL", "DATABASE_URL|POSTGRES_|PG_|DB_URL"), ("MySQL", "MYSQL_|MARIADB_"), ("MongoDB", "MONGO_URI|MONGODB_URL|MONGO_URL"),
    ("Redis", "REDIS_URL|REDIS_HOST|CACHE_URL"), ("Elasticsearch", "ELASTICSEARCH_URL|ES_HOST|ELASTIC_"),
    ("Cassandra", "CASSANDRA_HOST|CASSANDRA_URL"), ("RabbitMQ", "RABBITMQ_URL|AMQP_URL"), ("Kafka", "KAFKA_BROKERS|KAFKA_BOOTSTRAP"),
)
#: Base classes of database models.
ORM_BASES = "Base Model BaseModel DeclarativeBase db.Model Document EmbeddedDocument SQLModel".split()


def derive_structure(files: DataFrame, repo: str = "repo") -> Graph:
    """Repository, Module and File nodes of a files table (path, language), with contains edges."""
    from ..sources.files import module_group
    from ..functions.scalars import base_name, parent_path

    m = module_group(files)
    root = files.limit(1).select(F.lit(f"Repository::{repo}").alias("id"), F.lit("Repository").alias("type"), F.lit(repo).alias("name"), F.lit("{}").alias("props"), F.lit(0).cast("long").alias("seq"))
    mid = lambda c: F.concat(F.lit("Module:"), c, F.lit(":"))
    modules = m.select(mid(F.col("path")).alias("id"), F.lit("Module"), "name", F.to_json(F.struct("file_count", "primary_language")), F.lit(1).cast("long"))
    f = files.select(F.concat(F.lit("File:"), "path", F.lit(":")).alias("id"), F.lit("File"), base_name(F.col("path")), F.to_json(F.struct("language")), F.lit(2).cast("long"))
    e1 = m.select(F.lit(f"Repository::{repo}").alias("src"), mid(F.col("path")).alias("dst"), F.lit("contains").alias("type"), F.lit("{}").alias("props"), F.lit(0).cast("long").alias("seq"))
    e2 = files.select(mid(parent_path(F.col("path"))), F.concat(F.lit("File:"), "path", F.lit(":")), F.lit("contains"), F.lit("{}"), F.lit(1).cast("long"))
    return Graph(root.union(modules).union(f), e1.union(e2))


def component_type(name: Column, methods: Column, min_methods: int = 2, extra=()) -> Column:
    """The longest known ending of a name that is longer than it, in lower case; generic for a class with min_methods methods; else null."""
    out = None
    for s in sorted({*COMPONENT_SUFFIXES, *extra}, key=lambda x: (-len(x), x)):
        hit = name.endswith(s) & (F.length(name) > len(s))
        out = F.when(hit, s.lower()) if out is None else out.when(hit, s.lower())
    return out.when(methods >= min_methods, "generic")


def detect_components(classes: DataFrame) -> DataFrame:
    """Rows of classes (name, method_count) that are components, with component_type."""
    return classes.withColumn("component_type", component_type(F.col("name"), F.col("method_count"))).where(F.col("component_type").isNotNull())


def is_api_function(decorators: Column, path: Column) -> Column:
    hit = F.exists(decorators, lambda d: F.lit(False) if not API_DECORATORS else _any(F.lower(d), [x.lower() for x in API_DECORATORS]))
    return F.coalesce(hit, F.lit(False)) | F.lower(stem(path)).isin(API_STEMS)


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def lineage_verb(name: Column) -> Column:
    """The relation that a function's leading verb, up to the first underscore, stands for."""
    verb, out = F.lower(F.split(name, "_")[0]), None
    for kind, verbs in VERBS.items():
        out = F.when(verb.isin(verbs), kind) if out is None else out.when(verb.isin(verbs), kind)
    return out


def heuristic_lineage(functions: DataFrame, stores: DataFrame, fallback: int = 2) -> DataFrame:
    """src, dst, type of functions (id, name) whose verb reads or writes and whose name holds a store's (id, name, seq); else the first stores."""
    f = functions.select("id", "name", lineage_verb(F.col("name")).alias("type")).where(F.col("type").isNotNull())
    held = name_contains_match(f.select("id", "name"), stores.select(F.col("id").alias("dst"), "name"), "dst")
    hit = held.join(f.select("id", "type"), "id").select(F.col("id").alias("src"), "dst", "type").distinct()
    first = stores.orderBy("seq", "id").limit(fallback).select(F.col("id").alias("dst"))
    rest = f.join(hit.select(F.col("src").alias("id")), "id", "left_anti").join(F.broadcast(first), F.lit(True)).select(F.col("id").alias("src"), "dst", "type")
    return hit.union(rest)


def infer_layer(name: Column) -> Column:
    out, low = None, F.lower(name)
    for layer, hints in LAYERS:
        hit = low.rlike("|".join(hints))
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out


def infer_layers(nodes: DataFrame) -> Graph:
    """Layer nodes, and belongs_to edges of nodes whose names hint at one."""
    x = nodes.withColumn("layer", infer_layer(F.col("name"))).where(F.col("layer").isNotNull())
    index = F.create_map(*[F.lit(v) for i, (n, _) in enumerate(LAYERS) for v in (n, i)])
    layers = x.select("layer").distinct().select(F.concat(F.lit("Layer::"), "layer").alias("id"), F.lit("Layer").alias("type"), F.col("layer").alias("name"), F.to_json(F.struct(index[F.col("layer")].alias("layer_index"))).alias("props"), index[F.col("layer")].cast("long").alias("seq"))
    edges = x.select(F.col("id").alias("src"), F.concat(F.lit("Layer::"), "layer").alias("dst"), F.lit("belongs_to").alias("type"), F.lit('{"confidence":0.6}').alias("props"), "seq")
    return Graph(layers, edges)


def infer_flows(apis: DataFrame, calls: DataFrame, most: int = 20, steps: int = 5) -> DataFrame:
    """flow, slug, step_index, node: a flow for each of the first APIs (id, name, seq), itself first, then the functions that it calls (src, dst, seq)."""
    from pyspark.sql import Window

    a = apis.orderBy("seq", "id").limit(most).select("id", flow_name(F.col("name")).alias("flow"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("seq", "dst"))
    called = a.join(calls.select(F.col("src").alias("id"), "dst", "seq"), "id").withColumn("k", k).where(F.col("k") <= steps)
    return a.select("flow", F.lit(1).alias("step_index"), F.col("id").alias("node")).union(called.select("flow", F.col("k") + 1, "dst")).select("flow", slugify(F.col("flow")).alias("slug"), "step_index", "node")


def infer_entity_type(name: Column) -> Column:
    """What a class is in its domain; null for infrastructure and names that are not in camel case."""
    low = F.lower(name)
    out = F.when(low.rlike(f"^({'|'.join(DOMAIN_SKIPPED)})|({'|'.join(DOMAIN_SKIPPED)})$") | ~name.rlike("^[A-Z][a-zA-Z0-9]+$"), F.lit(None).cast("string"))
    for kind, where, hints in DOMAIN_KINDS:
        h = "|".join(hints)
        out = out.when(low.rlike(h if where == "any" else f"^({h})|({h})$"), kind)
    return out.otherwise("entity")


def classify_role(name: Column) -> Column:
    return F.when(name.rlike(f"({'|'.join(ROLE_API)})$"), "api").when(name.rlike(f"({'|'.join(ROLE_SUFFIXES)})$"), "service").otherwise("component")


def domain_group(nodes: DataFrame, domain: Column) -> Graph:
    """A Domain node for each label, with contains edges to its members."""
    x = nodes.withColumn("d", domain).where(F.col("d").isNotNull())
    d = x.groupBy("d").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).select(F.concat(F.lit("Domain::"), "d").alias("id"), F.lit("Domain").alias("type"), F.col("d").alias("name"), F.to_json(F.struct(F.col("n").alias("member_count"))).alias("props"), "seq")
    return Graph(d, x.select(F.concat(F.lit("Domain::"), "d").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"), F.lit("{}").alias("props"), "seq"))


def detect_broker(imports: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """path, broker: by a file's first import (path, module, line) of a broker's library or below it; without one, eventbus if one of its classes (path, name) is called so."""
    table = F.create_map(*[F.lit(v) for b, libs in BROKERS for x in libs for v in (x, b)])
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: table[F.array_join(F.slice(parts, 1, n), ".")])
    found = imports.withColumn("b", F.get(F.filter(prefixes, lambda x: x.isNotNull()), F.lit(0))).where(F.col("b").isNotNull()).groupBy("path").agg(F.min_by("b", "line").alias("broker"))
    if classes is None:
        return found
    hinted = classes.where(F.lower("name").rlike("eventbus|eventemitter|event_bus")).select("path").distinct().join(found, "path", "left_anti")
    return found.union(hinted.select("path", F.lit("eventbus")))


def _topic(direction: str):
    return lambda t: F.struct(F.lit(direction).alias("direction"), t.alias("topic"))


def extract_topics(files: DataFrame) -> DataFrame:
    """Distinct path, direction, topic of files (path, content, broker)."""
    found = [F.when(F.col("broker") == b, F.transform(F.regexp_extract_all("content", F.lit(f"(?is){p}"), 1), _topic(d))) for (b, d), ps in TOPIC_PATTERNS.items() for p in ps]
    none = F.array().cast("array<struct<direction:string,topic:string>>")
    return files.select("path", F.explode(F.concat(*[F.coalesce(x, none) for x in found])).alias("t")).select("path", "t.direction", "t.topic").distinct()


def event_graph(topics: DataFrame, components: DataFrame) -> Graph:
    """Event and Topic nodes of topics (path, direction, topic, broker), and edges of the components (id, path) of their files."""
    e, t = F.concat(F.lit("Event::"), "topic"), F.concat(F.lit("Topic:"), "broker", F.lit(":"), "topic")
    x = topics.join(components.select("path", F.col("id").alias("component")), "path", "left")
    nodes = topics.select(e.alias("id"), F.lit("Event").alias("type"), F.col("topic").alias("name"), F.lit("{}").alias("props"), F.lit(0).cast("long").alias("seq")).union(topics.select(t, F.lit("Topic"), "topic", F.to_json(F.struct("broker")), F.lit(1).cast("long"))).distinct()
    row = lambda a, b, kind: (a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), F.lit("{}").alias("props"), F.lit(0).cast("long").alias("seq"))
    known = x.where(F.col("component").isNotNull())
    edges = topics.select(*row(e, t, "routes_to")).union(known.where(F.col("direction") == "publish").select(*row(F.col("component"), e, "publishes"))).union(known.where(F.col("direction") == "consume").select(*row(F.col("component"), t, "consumes")))
    return Graph(nodes, edges.distinct())


def env_to_database(names: DataFrame) -> DataFrame:
    """name and every database that it hints at; names: (name)."""
    hits = F.array(*[F.when(F.upper("name").rlike(p), d) for d, p in ENV_PATTERNS])
    return names.select("name", F.explode(F.filter(hits, lambda d: d.isNotNull())).alias("database")).distinct()


def scan_dockerfiles(files: DataFrame) -> DataFrame:
    """path, kind (image or env), value of Dockerfiles (path, content)."""
    images = files.select("path", F.lit("image").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(r"(?im)^FROM\s+(\S+)"), 1)).alias("value")).where(F.lower("value") != "scratch")
    env = files.select("path", F.lit("env").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(r"(?im)^(?:ENV|ARG)\s+(\w+)"), 1)).alias("value"))
    return images.union(env).distinct()


K8S = "path string, kind string, name string, namespace string, image string, env string"


def scan_k8s(files: DataFrame) -> DataFrame:
    """A row for each object, container image and variable of Kubernetes manifests (path, content)."""

    def run(batches):
        import yaml

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    docs = list(yaml.safe_load_all(content or ""))
                except yaml.YAMLError:
                    continue
                for d in docs:
                    if not isinstance(d, dict) or "kind" not in d:
                        continue
                    part = lambda x, key, kind=dict: v if isinstance(v := x.get(key), kind) else kind()  # noqa: E731  what is no mapping, or no list, is passed over
                    text = lambda x: None if x is None else str(x)
                    meta, own = part(d, "metadata"), part(d, "spec")
                    spec = part(part(own, "template"), "spec")
                    head = (path, text(d["kind"]), text(meta.get("name")), text(meta.get("namespace")))
                    rows.append((*head, None, None))
                    # of templates, their init containers, and of plain pods
                    for c in [*part(spec, "containers", list), *part(spec, "initContainers", list), *part(own, "containers", list)]:
                        if isinstance(c, dict):
                            rows.append((*head, text(c.get("image")), None))
                            rows += [(*head, None, text(v.get("name"))) for v in part(c, "env", list) if isinstance(v, dict)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in K8S.split(", ")])

    return files.where(F.col("content").contains("kind:")).select("path", "content").mapInPandas(run, K8S)


def data_entities(classes: DataFrame) -> DataFrame:
    """Classes (path, name, base_classes, decorators) that hold data, with entity_kind: table for database models, schema for dataclasses."""
    orm = F.arrays_overlap("base_classes", F.array(*map(F.lit, ORM_BASES)))
    data = F.exists("decorators", lambda d: d.contains("dataclass"))
    return classes.withColumn("entity_kind", F.when(orm, "table").when(data, "schema")).where(F.col("entity_kind").isNotNull())


def ingest_relations(answers: DataFrame, least: float = 0.5) -> DataFrame:
    """src, dst, type, confidence of the relations in a table of JSON answers (doc): {"relations": [{from, to, type, confidence}]}; unsure ones are left out."""
    schema = "relations array<struct<`from`:string,`to`:string,type:string,confidence:double>>"
    r = answers.select(F.explode(F.from_json("doc", schema)["relations"]).alias("r"))
    c = F.least(F.greatest(F.coalesce("r.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return r.select(F.col("r.from").alias("src"), F.col("r.to").alias("dst"), "r.type", c.alias("confidence")).where((F.col("confidence") >= least) & F.col("src").isNotNull() & F.col("dst").isNotNull())


def validate_keys(answers: DataFrame, required: list[str], items: str, item_keys: list[str]) -> DataFrame:
    """id, message: what is wrong with JSON answers (id, doc): missing keys, list items without keys, confidence out of 0..1."""
    keys = F.json_object_keys("doc")
    missing = F.filter(F.array(*map(F.lit, required)), lambda k: ~F.coalesce(F.array_contains(keys, k), F.lit(False)))
    listed = F.from_json(F.get_json_object("doc", f"$.{items}"), "array<string>")
    bad = F.filter(F.transform(listed, lambda x: F.concat_ws(",", F.filter(F.array(*map(F.lit, item_keys)), lambda k: ~F.coalesce(F.array_contains(F.json_object_keys(x), k), F.lit(False))))), lambda s: s != "")
    conf = F.get_json_object("doc", "$.overall_confidence").cast("double")
    a = answers.select("id", F.explode(missing).alias("k")).select("id", F.concat(F.lit("missing key "), "k").alias("message"))
    b = answers.select("id", F.explode(bad).alias("k")).select("id", F.concat(F.lit("item lacks "), "k"))
    c = answers.where((conf < 0) | (conf > 1)).select("id", F.lit("confidence out of range"))
    return a.union(b).union(c)
