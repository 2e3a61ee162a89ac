"""Components of source files: their classes and functions, what calls what, and who takes part in messaging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, node_id
from .derive import detect_components

#: Parts of class names, method names and parts of decorators that make a producer or consumer of messages.
PRODUCER_NAMES = "producer publisher sender emitter broadcaster dispatcher notifier".split()
CONSUMER_NAMES = "consumer subscriber listener handler receiver worker processor".split()
PUBLISH_METHODS = "send produce send_and_wait basic_publish publish emit dispatch trigger fire broadcast put put_nowait send_message".split()
CONSUME_METHODS = "subscribe basic_consume basic_get on listen add_listener add_event_listener connect register register_handler".split()
CONSUMER_DECORATORS = "subscribe consumer listen on_event agent shared_task task signal.connect".split()


def component_graph(classes: DataFrame, functions: DataFrame) -> Graph:
    """Component, Class and Function nodes of classes (path, name, seq) and functions (path, name, owner, seq), with implements and contains edges.

    A class is a component by its name or number of methods. Methods of other classes make no node;
    functions outside of classes belong to the component of their file, if it has exactly one.
    """
    methods = functions.where(F.col("owner").isNotNull())
    count = methods.groupBy("path", F.col("owner").alias("name")).agg(F.count("*").alias("method_count"))
    c = classes.select("path", "name", "seq").join(count, ["path", "name"], "left").withColumn("method_count", F.coalesce("method_count", F.lit(0)))
    comp = detect_components(c)
    of = lambda kind, name: node_id(F.lit(kind), F.col("path"), name)
    row = lambda df, kind, name, shown, props: df.select(of(kind, name).alias("id"), F.lit(kind).alias("type"), shown.alias("name"), props.alias("props"), "seq")
    full = F.concat_ws(".", "owner", "name")
    own = methods.join(comp.select("path", F.col("name").alias("owner")), ["path", "owner"], "left_semi").select("path", "name", "owner", "seq")
    free = functions.where(F.col("owner").isNull()).select("path", "name", "owner", "seq")
    nodes = row(c, "Class", F.col("name"), F.col("name"), F.to_json(F.struct("method_count")))
    nodes = nodes.union(row(comp, "Component", F.col("name"), F.col("name"), F.to_json(F.struct("component_type", "method_count"))))
    nodes = nodes.union(row(own.unionByName(free), "Function", full, F.col("name"), F.to_json(F.struct(F.coalesce("owner", F.lit("")).alias("parent_class")))))
    single = comp.groupBy("path").agg(F.count("*").alias("n"), F.first("name").alias("only")).where("n = 1")
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), F.lit("{}").alias("props"), "seq")
    edges = edge(comp, of("Component", F.col("name")), of("Class", F.col("name")), "implements")
    edges = edges.union(edge(own, of("Component", F.col("owner")), of("Function", full), "contains"))
    edges = edges.union(edge(free.join(single.select("path", "only"), "path"), of("Component", F.col("only")), of("Function", F.col("name")), "contains"))
    return Graph(nodes, edges)


def _holders(g: Graph, outer: str, inner: str, a: str, b: str) -> DataFrame:
    named = lambda t, c: g.nodes.where(F.col("type") == t).select(F.col("id").alias(c))
    held = g.edges.where(F.col("type") == "contains").select(F.col("src").alias(b), F.col("dst").alias(a))
    return held.join(named(outer, b), b, "left_semi").join(named(inner, a), a, "left_semi").select(a, b).distinct()


def file_to_module(g: Graph) -> DataFrame:
    """file, module of contains edges."""
    return _holders(g, "Module", "File", "file", "module")


def func_to_component(g: Graph) -> DataFrame:
    """function, component of contains edges."""
    return _holders(g, "Component", "Function", "function", "component")


def comp_by_file(components: DataFrame, by: str = "path") -> DataFrame:
    """<by>, components: the ids of the components (id, path, module) of each file or module, in order."""
    return components.groupBy(by).agg(F.array_sort(F.collect_list("id")).alias("components"))


def flatten_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions (path, name, owner) and calls (path, caller, callee) of files (path, functions, classes).

    functions: array of struct(name, calls); classes: array of struct(name, methods), methods like functions.
    """
    free = files.select("path", F.lit(None).cast("string").alias("owner"), F.explode("functions").alias("f"))
    own = files.select("path", F.explode("classes").alias("c")).select("path", F.col("c.name").alias("owner"), F.explode("c.methods").alias("f"))
    both = free.union(own).select("path", "f.name", "owner", "f.calls")
    return both.drop("calls"), both.select("path", F.concat_ws(".", "owner", "name").alias("caller"), F.explode("calls").alias("callee"))


def resolve_caller(parsed: DataFrame, functions: DataFrame) -> DataFrame:
    """path, owner, name, dst: which function (id, name, owner, seq) a parsed one (path, owner, name) is.

    In order: the last one of that class and name, the only one of the name, the first one of the
    name and class, the first one of the name.
    """
    none = F.coalesce("owner", F.lit(""))
    exact = functions.where(F.col("owner").isNotNull()).groupBy("owner", "name").agg(F.max_by("id", "seq").alias("exact"))
    alike = functions.groupBy("name", none.alias("o")).agg(F.min_by("id", "seq").alias("alike"))
    named = functions.groupBy("name").agg(F.min_by("id", "seq").alias("first"), F.count("*").alias("n"))
    x = parsed.select("path", "owner", "name").distinct().join(exact, ["owner", "name"], "left").join(named, "name", "left")
    x = x.withColumn("o", none).join(alike, ["name", "o"], "left")
    return x.select("path", "owner", "name", F.coalesce("exact", F.when(F.col("n") == 1, F.col("first")), "alike", "first").alias("dst")).where(F.col("dst").isNotNull())


def _parts(text, hints):
    return F.coalesce(F.lower(text).rlike("|".join(h.replace(".", r"\.") for h in hints)), F.lit(False))


def _role(components: DataFrame, calls: DataFrame, names, methods, marked: DataFrame | None) -> DataFrame:
    last = F.lower(F.element_at(F.split("callee", r"\."), -1))
    hits = calls.where(last.isin(list(methods)))
    does = hits.where(F.col("owner").isNotNull()).select("path", F.col("owner").alias("name"))
    does = (does if marked is None else does.unionByName(marked)).distinct().withColumn("does", F.lit(True))
    c = components.select("id", "path", "name").join(does, ["path", "name"], "left")
    c = c.withColumn("is", _parts(F.col("name"), names) | F.coalesce("does", F.lit(False)))
    w = Window.partitionBy("path")
    c = c.withColumn("n", F.count("*").over(w)).withColumn("any", F.max("is").over(w))
    loose = hits.where(F.col("owner").isNull()).select("path").distinct().withColumn("loose", F.lit(True))
    alone = ~F.col("any") & (F.col("n") == 1) & F.coalesce("loose", F.lit(False))
    return c.join(loose, "path", "left").where(F.col("is") | alone).select("path", "id").distinct()


def find_producers(components: DataFrame, calls: DataFrame) -> DataFrame:
    """path, id of components (id, path, name) that publish: by name, or by a call (path, owner, callee) in one of their methods.

    A file's only component also counts if a function outside of classes (owner null) publishes.
    """
    return _role(components, calls, PRODUCER_NAMES, PUBLISH_METHODS, None)


def find_consumers(components: DataFrame, calls: DataFrame, decorators: DataFrame) -> DataFrame:
    """path, id of components that consume: as find_producers(), or by a decorator (path, owner, decorator) of one of their methods."""
    marked = decorators.where(_parts(F.col("decorator"), CONSUMER_DECORATORS) & F.col("owner").isNotNull()).select("path", F.col("owner").alias("name"))
    return _role(components, calls, CONSUMER_NAMES, CONSUME_METHODS, marked)


def db_tables(g: Graph, per_database: int = 20) -> DataFrame:
    """id, name, tables: databases and the first tables whose property database, or db, names them, or else has their id.

    A graph with tables and no database gets one for each name that its tables give, default without one.
    """
    ref = F.coalesce(F.get_json_object("props", "$.database"), F.get_json_object("props", "$.db"))
    t = g.nodes.where("type = 'Table'").select(F.col("name").alias("table"), F.col("id").alias("tid"), "seq", ref.alias("ref"))
    dbs = g.nodes.where("type = 'Database'").select("id", "name")
    first = F.row_number().over(Window.partitionBy("ref").orderBy("seq", "tid"))
    top = t.withColumn("ref", F.nullif("ref", F.lit(""))).withColumn("k", first).where(F.col("k") <= per_database)
    listed = top.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "table"))), lambda x: x["table"]).alias("tables"))
    by_name, by_id = listed.select(F.col("ref").alias("name"), F.col("tables").alias("a")), listed.select(F.col("ref").alias("id"), F.col("tables").alias("b"))
    real = dbs.join(by_name, "name", "left").join(by_id, "id", "left").select("id", "name", F.coalesce("a", "b", F.array().cast("array<string>")).alias("tables"))
    none = dbs.limit(1).agg(F.count("*").alias("c")).where("c = 0").select(F.lit(1).alias("one"))  # one row at most
    name = F.coalesce("ref", F.lit("default"))
    made = listed.join(F.broadcast(none), F.lit(1) == F.col("one")).select(F.concat(F.lit("synthetic:"), name).alias("id"), name.alias("name"), "tables")
    return real.union(made)
