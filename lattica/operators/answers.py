"""Answers of a language model, JSON documents as VARIANT, read into a graph and checked by rules.

All sections of all answers are read in one scan into items: one row for each entry of a list, kept
as VARIANT. What becomes of an item is decided by joins on names within its graph.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import slugify
from ..model import EDGE_SCHEMA, NODE_SCHEMA, cut
from .names import partial_name_resolve

#: The lists that answers may hold.
SECTIONS = ("layers", "assignments", "services", "dependencies", "flows", "lineage", "data_flows", "bounded_contexts", "entities", "relationships", "relations")
#: How sure a model must be, at least, of what a list holds; entries that say nothing count as 0.5 (flows as 0.6).
LEAST = {"assignments": 0.6, "dependencies": 0.5, "lineage": 0.5, "data_flows": 0.5, "transforms": 0.5, "bounded_contexts": 0.4, "entities": 0.4, "relationships": 0.5, "relations": 0.5}
#: Edge types of flows of data and of relationships; other relationships are depends_on.
FLOW_EDGES = {"read": "reads", "write": "writes", "transform": "transforms", "produce": "produces", "consume": "consumes"}
RELATION_EDGES = {"contains": "part_of", "references": "depends_on", "inherits": "implements", "implements": "implements", "associated_with": "depends_on"}
#: Fixed value: steps of a flow, at least.
STEPS = 2


class Ingested(NamedTuple):
    """nodes and edges, each with its graph; unknown: graph, section, name of ends that were looked for and not found."""

    nodes: DataFrame
    edges: DataFrame
    unknown: DataFrame


def _get(path: str, kind: str = "string", of: str = "item") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def _text(path: str, of: str = "item") -> Column:
    return F.btrim(F.coalesce(_get(path, "string", of), F.lit("")))


def _sure(path: str = "$.confidence", default: float = 0.5, of: str = "item") -> Column:
    """A confidence, clamped to 0..1."""
    return F.least(F.greatest(F.coalesce(_get(path, "double", of), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def _object(of: str = "item") -> Column:
    return F.schema_of_variant(F.col(of)).startswith("OBJECT")


def answer_items(answers: DataFrame) -> DataFrame:
    """graph, answer, section, position, item: the objects in the lists of answers (graph, answer, doc); what is no JSON gives none."""
    read = answers.select("graph", "answer", F.try_parse_json("doc").alias("v")).where("v is not null")
    lists = F.array(*[F.struct(F.lit(s).alias("section"), F.try_variant_get("v", f"$.{s}", "array<variant>").alias("list")) for s in SECTIONS])
    each = read.select("graph", "answer", F.explode(lists).alias("s")).select("graph", "answer", "s.section", F.posexplode("s.list").alias("position", "item"))
    return each.where(_object())


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def ingest_model_output(answers: DataFrame, known: DataFrame) -> Ingested:
    """The nodes and edges of answers (graph, answer, doc), with ends from known ones (graph, name, id, kind, seq).

    kind is function, data, service or any other. Layers become nodes, and what is assigned to them
    belongs to them; services, flows of two steps or more, bounded contexts and entities are nodes,
    their lists of dependencies, steps, triggers and relationships edges; lineage reads, writes and
    transforms data, whose names are resolved by partial_name_resolve() and made where unknown;
    plain relations join known or new nodes by id. Unsure entries are left out, a node's last entry
    and an edge's first one stay. Names are looked up within a graph, new ones within an answer.
    """
    items = cut(answer_items(answers), "answer-items")
    of = lambda section: items.where(F.col("section") == section)
    sure = lambda df, section: df.where(F.col("confidence") >= LEAST[section])
    base = ["graph", "answer", "section", "position"]
    by_name = known.groupBy("graph", "name").agg(F.min_by("id", "seq").alias("id"))
    functions = known.where("kind = 'function'").groupBy("graph", "name").agg(F.min_by("id", "seq").alias("id"))
    props = lambda *cols: F.to_json(F.struct(*cols))

    def named(df: DataFrame, table: DataFrame, name: str, to: str, *on: str) -> DataFrame:
        """df with the id of a name as <to>, null if it is unknown. Tables of names grow with answers, so none is sent whole to the driver, however small its file."""
        return df.join(table.select(*on, F.col("name").alias(name), F.col("id").alias(to)).hint("merge"), [*on, name], "left")

    # what answers name themselves
    layers = of("layers").select(*base, _text("$.name").alias("name"), F.coalesce(_get("$.layer_index", "int"), F.lit(99)).alias("layer_index"), _text("$.description").alias("description")).where("name <> ''")
    layers = layers.withColumn("id", F.concat(F.lit("layer:"), slugify(F.col("name"))))
    services = of("services").select(*base, _text("$.name").alias("name"), _sure().alias("confidence"), _text("$.responsibility").alias("responsibility")).where("name <> ''")
    had = known.where("kind = 'service'").select("graph", F.lower("name").alias("low"), F.lit(True).alias("had")).distinct()
    services = services.withColumn("low", F.lower("name")).join(had.hint("merge"), ["graph", "low"], "left").withColumn("id", F.concat(F.lit("service:"), F.replace("low", F.lit(" "), F.lit("_"))))
    flows = of("flows").select(*base, "item", _text("$.name").alias("name"), _text("$.trigger").alias("trigger"), _sure(default=0.6).alias("confidence"), _get("$.steps", "array<variant>").alias("steps"))
    flows = flows.where((F.col("name") != "") & (F.size("steps") >= STEPS)).withColumn("id", F.concat(F.lit("flow:"), slugify(F.col("name"))))
    contexts = sure(of("bounded_contexts").select(*base, _text("$.name").alias("name"), _sure().alias("confidence"), _text("$.description").alias("description")).where("name <> ''"), "bounded_contexts")
    contexts = contexts.withColumn("id", F.concat(F.lit("domain_context:"), slugify(F.col("name"))))
    entities = sure(of("entities").select(*base, _text("$.name").alias("name"), _sure().alias("confidence"), F.coalesce(_get("$.entity_type"), F.lit("entity")).alias("entity_type"), _text("$.bounded_context").alias("context"), _text("$.source_class").alias("source")).where("name <> ''"), "entities")
    entities = entities.withColumn("id", F.concat(F.lit("domain_entity:"), slugify(F.col("name"))))
    own = lambda df: df.groupBy("graph", "answer", "name").agg(F.max_by("id", "position").alias("id"))

    # lists of edges: each row has its two ends' names, which the table of a scope knows; one of them may be an id already
    def listed(df: DataFrame, kind: str | None = None, a: str | Column | None = None, b: str | Column | None = None) -> DataFrame:
        """Edges of a kind, or of df's own kinds; a, b: the scopes that know the names of their ends, none if the id is given."""
        had = lambda c, type_="string": F.col(c) if c in df.columns else F.lit(None).cast(type_)
        scope = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return df.select(*base, had("src").alias("src"), had("dst").alias("dst"), (F.lit(kind) if kind else F.col("type")).alias("type"), "confidence", had("step_index", "int").alias("step_index"), "a", "b", scope(a).alias("of_a"), scope(b).alias("of_b"))

    assigned = sure(of("assignments").select(*base, _text("$.node_name").alias("a"), _text("$.layer").alias("b"), _sure().alias("confidence")), "assignments")
    depends = sure(of("dependencies").select(*base, _text("$.from_service").alias("a"), _text("$.to_service").alias("b"), _sure().alias("confidence")), "dependencies")
    step = flows.select(*base, "id", "confidence", F.posexplode("steps").alias("k", "item")).where(_object()).select(*base, F.col("id").alias("src"), F.lit("").alias("a"), _text("$.function_name").alias("b"), "confidence", F.coalesce(_get("$.step_index", "int"), F.lit(0)).alias("step_index"))
    trigger = flows.select(*base, "id", F.explode(_get("$.triggers", "array<string>")).alias("b")).select(*base, F.col("id").alias("src"), F.lit("").alias("a"), F.btrim("b").alias("b"), F.lit(1.0).alias("confidence"))
    part = entities.where("context <> ''").select(*base, F.col("id").alias("src"), F.lit("").alias("a"), F.col("context").alias("b"), "confidence")
    source = entities.where("source <> ''").select(*base, F.col("source").alias("a"), F.lit("").alias("b"), F.col("id").alias("dst"), "confidence")
    relate = sure(of("relationships").select(*base, _text("$.from_entity").alias("a"), _text("$.to_entity").alias("b"), _sure().alias("confidence"), F.coalesce(_map(RELATION_EDGES)[_text("$.relation_type")], F.lit("depends_on")).alias("type")), "relationships")

    # lineage: one end is a function, the others are data, known or made
    line = sure(of("lineage").select(*base, "item", _text("$.function_name").alias("f"), _sure().alias("confidence")), "lineage")
    line = cut(named(line, functions, "f", "src", "graph"), "lineage")
    sound = line.where("src is not null")
    touch = lambda kind: sound.select(*base, "src", F.lit(None).cast("string").alias("x"), F.posexplode(_get(f"$.{kind}", "array<string>")).alias("k", "y"), F.lit(kind).alias("type"), "confidence", F.lit(0 if kind == "reads" else 1).alias("turn"))
    turned = sound.select(*base, F.posexplode(_get("$.transforms", "array<variant>")).alias("k", "item")).where(_object())
    turned = sure(turned.select(*base, F.lit(None).cast("string").alias("src"), _text("$.from_entity").alias("x"), "k", _text("$.to_entity").alias("y"), F.lit("transforms").alias("type"), _sure().alias("confidence"), F.lit(2).alias("turn")), "transforms").where("x <> '' and y <> ''")
    moved = sure(of("data_flows").select(*base, _text("$.source").alias("x"), _text("$.target").alias("y"), _map(FLOW_EDGES)[F.lower(_text("$.flow_type"))].alias("type"), _sure().alias("confidence")), "data_flows").where("x <> '' and y <> '' and type is not null")
    moved = moved.select(*base, F.lit(None).cast("string").alias("src"), "x", F.lit(0).alias("k"), "y", "type", "confidence", F.lit(3).alias("turn"))
    data = cut(reduce(DataFrame.unionByName, [touch("reads"), touch("writes"), turned, moved]), "data-ends")
    # in a flow a function's name goes first; names are resolved in the order in which an answer gives them
    ends = data.select(*base, "turn", "k", "type", "src", F.posexplode(F.array("x", "y")).alias("end", "name")).where("name is not null")
    ends = cut(named(ends, functions.withColumn("turn", F.lit(3)), "name", "function", "graph", "turn"), "data-turns")
    place = cut(ends.where("function is null").groupBy("graph", "answer", "name").agg(F.min(_place()).alias("seq")), "data-names")
    store = known.where("kind = 'data'").select("graph", "name", "id", "seq").join(place.select("graph", "answer").distinct().hint("merge"), "graph")
    found = cut(partial_name_resolve(place, store, by=("graph", "answer")), "data-ids")
    by_end = found.select("graph", "answer", "name", "id").distinct()
    in_flow = ends.where("function is not null").select("graph", "answer", "name", F.col("function").alias("id"), F.lit(0).alias("late")).distinct().unionByName(by_end.withColumn("late", F.lit(1)))
    in_flow = in_flow.groupBy("graph", "answer", "name").agg(F.min_by("id", "late").alias("id"))
    lineage = data.withColumnsRenamed({"x": "a", "y": "b"})
    where = F.when(F.col("turn") == 3, "in_flow").otherwise("data")

    seq = F.col("position").cast("long")
    node = lambda df, kind, *more: df.select("graph", "id", F.lit(kind).alias("type"), "name", props(*more).alias("props"), seq.alias("seq"), "answer")
    made = found.where("minted").select("graph", "answer", "id", F.lit("DataObject").alias("type"), "name", F.lit('{"source":"ai_inferred"}').alias("props"), F.lit(0).cast("long").alias("seq"))
    nodes = reduce(DataFrame.unionByName, [
        node(layers, "Layer", "layer_index", "description"),
        node(services, "Service", "confidence", "responsibility", F.when(F.col("had"), "ai_enriched").otherwise("ai_detected").alias("source")),
        node(flows, "Flow", "trigger", "confidence", F.size("steps").alias("steps_count")),
        node(contexts, "DomainEntity", F.lit("bounded_context").alias("entity_type"), "confidence", "description"),
        node(entities, "DomainEntity", "entity_type", "confidence", F.col("context").alias("bounded_context")),
        made,
    ])
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    nodes = cut(nodes.groupBy("graph", "id").agg(F.max(F.struct("answer", "seq", "type", "name", "props")).alias("r")).select("graph", "id", "r.type", "r.name", "r.props", "r.seq").select("graph", *names), "answer-nodes")
    # plain relations go by id
    plain = sure(of("relations").select(*base, _text("$.from").alias("a"), _text("$.to").alias("b"), _text("$.type").alias("type"), _sure(default=0.0).alias("confidence")), "relations").where("type <> ''")
    ids = known.select("graph", "id").unionByName(nodes.select("graph", "id")).distinct().withColumn("name", F.col("id"))

    # all ends are looked up in one table of names: those of a graph, and those that an answer gives
    of_graph = {"any": by_name, "function": functions, "id": ids}
    of_answer = {"layer": own(layers), "service": own(services), "flow": own(flows), "context": own(contexts), "entity": own(entities), "data": by_end, "in_flow": in_flow}
    scoped = [df.select("graph", (F.lit("") if s in of_graph else F.col("answer").cast("string")).alias("at"), F.lit(s).alias("scope"), "name", "id") for s, df in (of_graph | of_answer).items()]
    names = cut(reduce(DataFrame.unionByName, scoped), "answer-names")
    edges = reduce(DataFrame.unionByName, [
        listed(assigned, "belongs_to", "any", "layer"),
        listed(depends, "depends_on", "service", "service"),
        listed(step, "flow_step", None, "function"),
        listed(trigger, "triggers", None, "flow"),
        listed(part, "part_of", None, "context"),
        listed(source, "belongs_to", "any", None),
        listed(relate, None, "entity", "entity"),
        listed(lineage, None, where, where),
        listed(plain, None, "id", "id"),
    ])
    for end, to in (("a", "src"), ("b", "dst")):
        at = F.when(F.col(f"of_{end}").isin(*of_graph), F.lit("")).otherwise(F.col("answer").cast("string"))
        edges = named(edges.withColumn("at", at), names.withColumnRenamed("scope", f"of_{end}"), end, "found", "graph", "at", f"of_{end}").withColumn(to, F.coalesce(to, "found")).drop("at", "found", f"of_{end}")
    edges = cut(edges.select("graph", "answer", "section", "position", "src", "dst", "type", props("confidence", "step_index").alias("props"), "a", "b"), "answer-edges")
    lost = lambda end, name: edges.where(F.col(end).isNull()).select("graph", "section", F.col(name).alias("name"))
    unknown = lost("src", "a").union(lost("dst", "b")).union(line.where("src is null").select("graph", "section", "f")).where("name <> ''").distinct()
    first = F.min(F.struct("answer", "section", "position", "props")).alias("r")
    kept = edges.where("src is not null and dst is not null and src <> dst").groupBy("graph", "src", "dst", "type").agg(first)
    names = [c.split()[0] for c in EDGE_SCHEMA.split(", ")]
    kept = kept.select("graph", "src", "dst", "type", "r.props", F.col("r.position").cast("long").alias("seq")).select("graph", *names)
    return Ingested(nodes, kept, unknown)


def _place() -> Column:
    """A number that orders names as an answer gives them: lineage before flows of data, position, kind of list, place in it, end."""
    late = F.when(F.col("section") == "lineage", 0).otherwise(1).cast("long")
    return (((late * F.lit(1 << 20) + F.col("position")) * 4 + F.col("turn")) * F.lit(1 << 20) + F.col("k")) * 2 + F.col("end")


#: The kinds of entities that a domain model may name.
ENTITY_TYPES = ("aggregate_root", "entity", "value_object", "domain_service", "domain_event")
#: What answers to each template must hold. A check is (template, path, check, argument):
#: list - the path is a list, else the answer is not valid; optional - a list, if it is there;
#: keys - its entries are objects with these keys; least - so many entries; steps - its entries' lists of steps have so many;
#: any - an entry says something under one of these keys; among - a key's values are among these, or among those of another list's key.
RULES = (
    ("architecture", "layers", "list", None),
    ("architecture", "assignments", "list", None),
    ("architecture", "layers", "least", 1),
    ("architecture", "layers", "keys", ("name", "layer_index")),
    ("architecture", "assignments", "keys", ("node_name", "layer", "confidence")),
    ("architecture", "assignments", "among", ("layer", "layers", "name")),
    ("service_detection", "services", "list", None),
    ("service_detection", "services", "keys", ("name", "responsibility")),
    ("service_detection", "dependencies", "optional", ("from_service", "to_service")),
    ("business_flow", "flows", "list", None),
    ("business_flow", "flows", "keys", ("name",)),
    ("business_flow", "flows", "steps", STEPS),
    ("data_lineage", "lineage", "list", None),
    ("data_lineage", "lineage", "keys", ("function_name", "confidence")),
    ("data_lineage", "lineage", "any", ("reads", "writes", "transforms")),
    ("data_lineage", "data_flows", "optional", ("source", "target", "flow_type")),
    ("domain_model", "entities", "list", None),
    ("domain_model", "entities", "least", 1),
    ("domain_model", "entities", "keys", ("name", "entity_type")),
    ("domain_model", "entities", "among", ("entity_type", ENTITY_TYPES)),
    ("domain_model", "entities", "among", ("bounded_context", "bounded_contexts", "name")),
    ("domain_model", "bounded_contexts", "optional", ("name",)),
    ("domain_model", "relationships", "optional", ("from_entity", "to_entity", "relation_type")),
)
STEP_KEYS = ("step_index", "function_name")
_ISSUES = "array<struct<place:string,message:string>>"


def _issue(place: Column, message) -> Column:
    return F.struct(place.alias("place"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def _one_if(wrong: Column, place: Column, message) -> Column:
    return F.when(wrong, F.array(_issue(place, message))).otherwise(F.array().cast(_ISSUES))


def _list(path: str, of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), f"$.{path}", "array<variant>")


def _at(path: str, i: Column) -> Column:
    return F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))


def _is_object(x: Column) -> Column:
    return F.schema_of_variant(x).startswith("OBJECT")


def _lacks(x: Column, keys) -> Column:
    """The keys that an object does not have, in order; one of a null value is there."""
    missing = F.array(*[F.when(F.try_variant_get(x, f"$.{k}", "variant").isNull(), F.lit(k)) for k in keys])
    return F.array_join(F.filter(missing, lambda k: k.isNotNull()), ",")


def _entries(items: Column, say) -> Column:
    """Issues of a list's entries; say(entry, place) is one issue or null."""
    said = F.filter(F.transform(F.coalesce(items, F.array().cast("array<variant>")), say), lambda x: x.isNotNull())
    return F.coalesce(said, F.array().cast(_ISSUES))


def _keys(items: Column, path: str, keys) -> Column:
    return _entries(items, lambda x, i: F.when(~_is_object(x), _issue(_at(path, i), "is no object")).when(_lacks(x, keys) != "", _issue(_at(path, i), F.concat(F.lit("lacks "), _lacks(x, keys)))))


def _compiled(path: str, check: str, argument) -> Column:
    """A rule as a list of issues, over the answer v."""
    items, there = _list(path), F.try_variant_get("v", f"$.{path}", "variant")
    if check == "list":
        return F.when(there.isNull(), F.array(_issue(F.lit(path), "is missing"))).when(items.isNull(), F.array(_issue(F.lit(path), "is no list"))).otherwise(F.array().cast(_ISSUES))
    if check == "least":
        return _one_if(F.size(items) < argument, F.lit(path), f"has fewer than {argument} entries")
    if check in ("keys", "optional"):
        return _keys(items, path, argument)
    if check == "any":
        empty = lambda x, k: F.coalesce(F.size(F.try_variant_get(x, f"$.{k}", "array<variant>")), F.lit(0)) == 0
        return _entries(items, lambda x, i: F.when(_is_object(x) & reduce(lambda a, b: a & b, [empty(x, k) for k in argument]), _issue(_at(path, i), "says nothing")))
    if check == "steps":
        steps = lambda x: F.try_variant_get(x, "$.steps", "array<variant>")
        has = lambda x: F.try_variant_get(x, "$.steps", "variant").isNotNull()
        few = lambda x, i: F.when(_is_object(x) & has(x) & steps(x).isNull(), _issue(_at(path, i), "steps are no list")).when(_is_object(x) & (F.coalesce(F.size(steps(x)), F.lit(0)) < argument), _issue(_at(path, i), f"has fewer than {argument} steps"))
        enough = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.size(steps(x)) >= argument)
        inside = F.flatten(F.transform(enough, lambda x, i: _keys(steps(x), f"{path}.steps", STEP_KEYS)))
        return F.concat(_entries(items, few), inside, _one_if(F.size(enough) == 0, F.lit(path), f"none has {argument} steps"))
    if len(argument) == 2:
        key, values = argument[0], F.array(*map(F.lit, argument[1]))
        wrong = lambda x: ~F.coalesce(F.array_contains(values, F.try_variant_get(x, f"$.{key}", "string")), F.lit(False))
    else:
        key, other, name = argument
        values = F.transform(F.coalesce(_list(other), F.array().cast("array<variant>")), lambda x: F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit("")))
        said = lambda x: F.try_variant_get(x, f"$.{key}", "string")
        # what is not said is no reference, and an optional list that is not there is none to refer to
        wrong = lambda x: (F.coalesce(said(x), F.lit("")) != "") & ~F.array_contains(values, said(x)) & (_list(other).isNotNull() & (F.size(_list(other)) > 0) | F.lit(other == "layers"))
    return _entries(items, lambda x, i: F.when(_is_object(x) & wrong(x), _issue(_at(path, i), F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.lit(""))))))


def validate_response(answers: DataFrame, rules=RULES) -> DataFrame:
    """answer, template, valid, confidence, issues (severity, place, message) of answers (answer, template, doc) to the templates of rules.

    The rules become one projection over the parsed answer. An answer that is no JSON object, or
    lacks a list that it must have, is not valid, and nothing else is said of it. All else are
    warnings. The overall confidence is clamped to 0..1, and 0 if it is missing or no number.
    """
    v = answers.select("answer", "template", F.try_parse_json("doc").alias("v"))
    object_ = F.coalesce(_is_object(F.col("v")), F.lit(False))
    none = F.array().cast(_ISSUES)
    of = lambda checks, want: F.concat(none, *[F.when(F.col("template") == t, _compiled(path, check, arg)).otherwise(none) for t, path, check, arg in rules if (check == "list") == want])
    errors = F.when(~object_, F.array(_issue(F.lit(""), "is no JSON object"))).otherwise(of(rules, True))
    said, number = F.try_variant_get("v", "$.overall_confidence", "variant"), F.try_variant_get("v", "$.overall_confidence", "double")
    sure = F.concat(_one_if(said.isNotNull() & number.isNull(), F.lit("overall_confidence"), "is no number"), _one_if((number < 0) | (number > 1), F.lit("overall_confidence"), "is not in 0..1"))
    found = v.select("answer", "template", F.coalesce(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("confidence"), errors.alias("errors"), F.concat(of(rules, False), sure).alias("warnings"))
    bad = F.size("errors") > 0
    label = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("severity"), x["place"].alias("place"), x["message"].alias("message")))
    return found.select("answer", "template", (~bad).alias("valid"), F.when(bad, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"), F.when(bad, label("errors", "error")).otherwise(label("warnings", "warning")).alias("issues"))
