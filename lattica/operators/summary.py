"""Summaries of graphs for a prompt: ranked lines of every section, cut at a budget, one text for each graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import LIMITS

#: Titles of the sections, in order; the header has none.
TITLES = ("", "Directory Structure", "Modules", "Services", "API Endpoints", "Key Functions (ranked by importance)", "Call Graph Sample", "Databases & Tables", "Events & Topics")
#: Levels and entries of the directory tree, calls of one callee, tables of a database, names at an event, characters of a token.
DEPTH, CHILDREN, PER_CALLEE, TABLES, NAMES, TOKEN = 3, 8, 3, 10, 5, 4


def _prop(key: str) -> Column:
    return F.coalesce(F.get_json_object("props", f"$.{key}"), F.lit(""))


def _top(df: DataFrame, section: str, limits: DataFrame, *order) -> DataFrame:
    """The first rows of each graph, with their rank k; the literal bound lets Spark cut before the shuffle."""
    ranked = df.withColumn("k", F.row_number().over(Window.partitionBy("graph").orderBy(*order))).where(F.col("k") <= LIMITS[section])
    return ranked.join(limits.select("graph", F.col(section).alias("most")), "graph").where(F.col("k") <= F.col("most")).drop("most")


def _lines(df: DataFrame, section: int, line: Column, sub: int = 0) -> DataFrame:
    return df.select("graph", F.lit(section).alias("section"), F.col("k").cast("long").alias("k"), F.lit(sub).alias("sub"), line.alias("line"))


def _first_names(df: DataFrame, keys: list[str], most: int, *order) -> DataFrame:
    """names and their number in all of each key: the first ones in order, as a list."""
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("of", n).where(F.col("place") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "who"))), lambda x: x["who"])
    return ranked.groupBy(*keys).agg(names.alias("names"), F.max("of").alias("of"))


def limits_of(nodes: DataFrame, limits=LIMITS) -> DataFrame:
    """graph, n, and the rows of each section: fewer the larger the graph is, at least 5."""
    n = F.col("n")
    scale = F.when(n > 10_000, 0.4).when(n > 4_000, 0.6).when(n > 2_000, 0.8).otherwise(1.0)
    return nodes.groupBy("graph").agg(F.count("*").alias("n")).select("graph", "n", *[F.greatest(F.lit(5), F.floor(base * scale + 1e-9)).cast("int").alias(s) for s, base in limits.items()])


def _header(nodes: DataFrame, edges: DataFrame, limits: DataFrame) -> DataFrame:
    repo = nodes.where("type = 'Repository'").groupBy("graph").agg(F.min_by(F.struct("name", _prop("git_commit").alias("commit")), "seq").alias("r"))
    spoken = nodes.where("type in ('File', 'Module')").withColumn("language", _prop("language")).where("language <> ''").groupBy("graph").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    files = nodes.where("type = 'File'").groupBy("graph").agg(F.count("*").alias("files"))
    drawn = edges.groupBy("graph").agg(F.count("*").alias("edges"))
    all_ = limits.select("graph", "n").join(repo, "graph", "left").join(spoken, "graph", "left").join(files, "graph", "left").join(drawn, "graph", "left")
    name, commit = F.coalesce("r.name", F.lit("unknown")), F.coalesce("r.commit", F.lit(""))
    said = F.coalesce(F.array_join("languages", ", "), F.lit("unknown"))
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    lines = F.array(F.concat(F.lit("# Repository: "), name), F.concat(F.lit("Languages: "), said, F.lit(" | Files: "), text("files"), F.lit(" | Nodes: "), text("n"), F.lit(" | Edges: "), text("edges")), F.when(commit != "", F.concat(F.lit("Git commit: "), F.substring(commit, 1, 12))))
    return _lines(all_.select("graph", F.posexplode(lines).alias("k", "line")).where("line is not null"), 0, F.col("line"))


def _tree(modules: DataFrame) -> DataFrame:
    """The first modules below each directory, level by level, below those that are listed."""
    path = F.coalesce(F.nullif(_prop("path"), F.lit("")), "name").alias("path")
    m = modules.select("graph", "name", path, "seq").groupBy("graph", "path").agg(F.min_by("name", F.struct("seq", "name")).alias("name"))
    m = m.withColumn("depth", F.size(F.split("path", "/")) - 1).where(F.col("depth") < DEPTH).withColumn("up", F.regexp_replace("path", "/?[^/]*$", ""))
    known = m.select("graph", F.col("path").alias("up"), F.lit(True).alias("listed"))
    m = m.join(known, ["graph", "up"], "left").withColumn("root", F.col("listed").isNull())  # its parent is no module
    k = F.row_number().over(Window.partitionBy("graph", "root", F.when(~F.col("root"), F.col("up"))).orderBy("path"))
    first = m.withColumn("place", k).where(F.col("place") <= CHILDREN)
    level = first.where("root").select("graph", "path", "name", F.lit(0).alias("indent"))
    shown = [level]
    for i in range(1, DEPTH):
        level = first.where("not root").join(level.select("graph", F.col("path").alias("up")), ["graph", "up"]).select("graph", "path", "name", F.lit(i).alias("indent"))
        shown.append(level)
    shown = reduce(DataFrame.unionByName, shown)
    return shown.withColumn("k", F.row_number().over(Window.partitionBy("graph").orderBy("path")))  # CHILDREN ** DEPTH rows at most


def repo_summary(nodes: DataFrame, edges: DataFrame, metrics: DataFrame | None = None, *, budget: int = 8000) -> DataFrame:
    """graph, text, tokens, truncated: the summary of each graph of nodes and edges, which have a column graph.

    metrics: graph, id, in_degree, out_degree, pagerank; without it degrees over distinct pairs of
    nodes, and no rank. Sections take their first rows by importance, fewer in large graphs; a text
    holds the lines that fit into the budget of tokens, tokens is what all lines would take, and
    truncated says that it is more.
    """
    limits = limits_of(nodes)
    of = lambda *types: nodes.where(F.col("type").isin(*types))
    ends = lambda end, *more: nodes.select("graph", F.col("id").alias(end), *more)
    join = lambda df, other, *on, how="inner": df.join(other, ["graph", *on], how)
    if metrics is None:
        pairs = join(join(edges.select("graph", "src", "dst").distinct(), ends("src"), "src"), ends("dst"), "dst")
        ins, outs = pairs.groupBy("graph", F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")), pairs.groupBy("graph", F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        metrics = join(join(nodes.select("graph", "id"), ins, "id", how="left"), outs, "id", how="left").select("graph", "id", zero("in_degree"), zero("out_degree"), F.lit(0.0).alias("pagerank"))
    text = lambda c: F.col(c).cast("string")
    parts = [_header(nodes, edges, limits)]
    parts.append(_lines(_tree(of("Module")), 1, F.concat(F.expr("repeat('  ', indent)"), F.lit("- "), "name")))

    holds = join(edges.where("type = 'contains'").select("graph", F.col("src").alias("id"), "dst"), ends("dst", "type"), "dst").groupBy("graph", "id").agg(F.count("*").alias("held"), F.count(F.when(F.col("type") == "File", 1)).alias("files"))
    modules = join(of("Module"), holds, "id", how="left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("files", F.coalesce("files", F.lit(0)))
    language = F.coalesce(F.nullif(_prop("language"), F.lit("")), F.nullif(_prop("primary_language"), F.lit("")), F.lit("unknown"))
    path = F.coalesce(F.nullif(_prop("path"), F.lit("")), "name")
    parts.append(_lines(_top(modules, "modules", limits, F.desc("held"), "seq", "id"), 2, F.concat(F.lit("- "), "name", F.lit(" ("), language, F.lit(") — "), text("held"), F.lit(" nodes, "), text("files"), F.lit(" files | path: "), path)))

    services = _top(of("Service"), "services", limits, "seq", "id")
    port, about = _prop("port"), _prop("description")
    parts.append(_lines(services, 3, F.concat(F.lit("- "), "name", F.when(port != "", F.concat(F.lit(" :"), port)).otherwise(""), F.when(about != "", F.concat(F.lit(" — "), about)).otherwise(""))))

    apis = _top(of("API"), "apis", limits, "seq", "id")
    method = F.when(_prop("method") != "", F.concat(F.lit("["), _prop("method"), F.lit("] "))).otherwise("")
    parts.append(_lines(apis, 4, F.concat(F.lit("- "), method, path, F.lit(" → "), "name", F.lit(" (module: "), _prop("module"), F.lit(")"))))
    parts.append(_lines(apis.where(about != ""), 4, F.concat(F.lit("  "), about), 1))

    score = F.round(F.col("pagerank") * 1000 + F.col("in_degree") * 2 + F.col("out_degree"), 6)
    functions = _top(join(of("Function"), metrics, "id").withColumn("score", score), "functions", limits, F.desc("score"), "seq", "id")
    parts.append(_lines(functions, 5, F.concat(F.lit("- "), "name", F.lit("("), _prop("signature"), F.lit(") [module: "), _prop("module"), F.lit(", in: "), text("in_degree"), F.lit(", out: "), text("out_degree"), F.lit(", pagerank: "), F.format_string("%.5f", F.col("pagerank").cast("double")), F.lit("]"))))

    label = F.when(_prop("module") != "", F.concat(_prop("module"), F.lit("."), "name")).otherwise(F.col("name"))
    rank = metrics.select("graph", F.col("id").alias("dst"), F.round(F.col("pagerank") * 1000 + F.col("in_degree"), 6).alias("score"))
    calls = join(join(join(edges.where("type = 'calls'"), ends("src", label.alias("a")), "src"), ends("dst", label.alias("b")), "dst"), rank, "dst")
    calls = calls.withColumn("place", F.row_number().over(Window.partitionBy("graph", "dst").orderBy("seq", "src"))).where(F.col("place") <= PER_CALLEE)
    parts.append(_lines(_top(calls, "call_samples", limits, F.desc("score"), "dst", "place"), 6, F.concat(F.lit("- "), "a", F.lit(" → "), "b")))

    tables = of("Table").select("graph", "seq", "id", F.col("name").alias("who"), F.coalesce(F.nullif(_prop("database"), F.lit("")), F.nullif(_prop("db"), F.lit("")), F.lit("default")).alias("base"))
    stores = of("Database").select("graph", "id", "name", "seq", F.coalesce(F.nullif(_prop("db_type"), F.lit("")), F.lit("unknown")).alias("kind"))
    made = tables.join(stores.select("graph").distinct(), "graph", "left_anti").groupBy("graph", F.col("base").alias("name")).agg(F.min("seq").alias("seq")).select("graph", F.col("name").alias("id"), "name", "seq", F.lit("unknown").alias("kind"))
    stores = _top(stores.unionByName(made), "databases", limits, "seq", "id")
    by = stores.select("graph", F.col("id").alias("store"), F.explode(F.array_distinct(F.array("id", "name"))).alias("base"))
    held = _first_names(join(tables, by, "base").select("graph", "store", "seq", "id", "who").distinct(), ["graph", "store"], TABLES, "seq", "id")
    stores = join(stores, held.withColumnRenamed("store", "id"), "id", how="left")
    more = F.when(F.col("of") > TABLES, F.concat(F.lit(" ... (+"), (F.col("of") - TABLES).cast("string"), F.lit(" more)"))).otherwise("")
    parts.append(_lines(stores, 7, F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")"), F.when(F.col("of").isNotNull(), F.concat(F.lit(": "), F.array_join("names", ", "), more)).otherwise(""))))

    events = _top(of("Event", "Topic"), "events", limits, "seq", "id")
    parts.append(_lines(events, 8, F.concat(F.lit("- "), "name", F.when(_prop("event_type") != "", F.concat(F.lit(" ("), _prop("event_type"), F.lit(")"))).otherwise(""))))
    for sub, (role, types) in enumerate((("publishers", ("publishes", "produces")), ("subscribers", ("consumes", "subscribes"))), 1):
        near = join(join(edges.where(F.col("type").isin(*types)), events.select("graph", F.col("id").alias("dst"), "k"), "dst"), ends("src", F.col("name").alias("who")), "src")
        parts.append(_lines(_first_names(near, ["graph", "k"], NAMES, "seq", "src"), 8, F.concat(F.lit(f"  {role}: "), F.array_join("names", ", ")), sub))

    lines = reduce(DataFrame.unionByName, parts)
    titles = F.element_at(F.array(*[F.lit(f"\n## {t}") for t in TITLES]), F.col("section") + 1)
    heads = lines.where("section > 0").select("graph", "section").distinct().withColumn("k", F.lit(-1).cast("long")).withColumn("sub", F.lit(0)).withColumn("line", titles)
    lines = lines.unionByName(heads.select(*lines.columns))
    # a few hundred lines a graph, by the limits
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("graph").orderBy("section", "k", "sub").rowsBetween(Window.unboundedPreceding, 0)) - 1
    kept = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("section", "k", "sub", "line", "upto"))), lambda x: F.floor(x["upto"] / TOKEN) <= budget), lambda x: x["line"])
    whole = lines.withColumn("upto", upto).groupBy("graph").agg(F.array_join(kept, "\n").alias("text"), F.max("upto").alias("n"))
    tokens = F.greatest(F.lit(1), F.floor(F.col("n") / TOKEN)).cast("long")
    return whole.select("graph", "text", tokens.alias("tokens"), (tokens > budget).alias("truncated"))
