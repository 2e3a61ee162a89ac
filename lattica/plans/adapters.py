"""Graphs and file tables made from business tables, and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions hold nations, nations customers and suppliers; customers produce orders, orders use parts, parts depend on suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, kind, type_, key, name, props, base: df.select(_id(kind, key).alias("id"), F.lit(type_).alias("type"), name.alias("name"), props.alias("props"), (F.col(key).cast("long") + base).alias("seq"))
    json = lambda k, c: F.concat(F.lit(f'{{"{k}":'), F.col(c).cast("string"), F.lit("}"))
    nodes = [
        node(t("region"), "region", "Repository", "r_regionkey", F.col("r_name"), F.lit("{}"), 0),
        node(t("nation"), "nation", "Module", "n_nationkey", F.col("n_name"), json("region", "n_regionkey"), 1000),
        node(t("customer"), "customer", "Component", "c_custkey", F.col("c_name"), json("nation", "c_nationkey"), 10**9),
        node(t("supplier"), "supplier", "Service", "s_suppkey", F.col("s_name"), json("nation", "s_nationkey"), 2 * 10**9),
        node(t("part"), "part", "Table", "p_partkey", F.col("p_name"), json("size", "p_size"), 3 * 10**9),
        node(t("orders"), "order", "Event", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('"}')), 4 * 10**9),
    ]
    edge = lambda df, a, ak, b, bk, type_, base: df.select(_id(a, ak).alias("src"), _id(b, bk).alias("dst"), F.lit(type_).alias("type"), F.lit("{}").alias("props"), (F.col(ak).cast("long") + base).alias("seq"))
    line = t("lineitem")
    edges = [
        edge(t("nation"), "region", "n_regionkey", "nation", "n_nationkey", "contains", 0),
        edge(t("customer"), "nation", "c_nationkey", "customer", "c_custkey", "contains", 10**9),
        edge(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "contains", 2 * 10**9),
        edge(t("orders"), "customer", "o_custkey", "order", "o_orderkey", "produces", 3 * 10**9),
        edge(line.select("l_orderkey", "l_partkey").distinct(), "order", "l_orderkey", "part", "l_partkey", "uses", 4 * 10**9),
        edge(line.select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", "depends_on", 5 * 10**9),
    ]
    return Graph(reduce(DataFrame.union, nodes), reduce(DataFrame.union, edges))


STAR = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Repository' AS type, r_name AS name, '{}' AS props, r_regionkey::BIGINT AS seq FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Module', n_name, '{"region":' || n_regionkey || '}', n_nationkey::BIGINT + 1000 FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Component', c_name, '{"nation":' || c_nationkey || '}', c_custkey + 1000000000 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Service', s_name, '{"nation":' || s_nationkey || '}', s_suppkey + 2000000000 FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Table', p_name, '{"size":' || p_size || '}', p_partkey + 3000000000 FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Event', 'order ' || o_orderkey, '{"status":"' || o_orderstatus || '"}', o_orderkey + 4000000000 FROM orders
), edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS type, '{}' AS props, n_regionkey::BIGINT AS seq FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', '{}', c_nationkey::BIGINT + 1000000000 FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', '{}', s_nationkey::BIGINT + 2000000000 FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'produces', '{}', o_custkey + 3000000000 FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses', '{}', l_orderkey + 4000000000 FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'depends_on', '{}', l_partkey + 5000000000 FROM lineitem
)"""


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, each depending on the two nations that its customers buy most from; it has cycles."""
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    money = sold.where(F.col("c_nationkey") != F.col("s_nationkey")).groupBy("c_nationkey", "s_nationkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,4)")).alias("revenue"))
    best = money.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("revenue"), "s_nationkey"))).where(F.col("k") <= 2)
    nodes = t("nation").select(_id("nation", "n_nationkey").alias("id"), F.lit("Module").alias("type"), F.col("n_name").alias("name"), F.lit("{}").alias("props"), F.col("n_nationkey").cast("long").alias("seq"))
    edges = best.select(_id("nation", "c_nationkey").alias("src"), _id("nation", "s_nationkey").alias("dst"), F.lit("depends_on").alias("type"), F.lit("{}").alias("props"), (F.col("c_nationkey").cast("long") * 10 + F.col("k")).alias("seq"))
    return Graph(nodes, edges)


TRADE = """
money AS (
  SELECT c_nationkey, s_nationkey, sum((l_extendedprice * (1 - l_discount))::DECIMAL(20,4)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY revenue DESC, s_nationkey) AS k FROM money QUALIFY k <= 2
), nodes AS (SELECT 'nation:' || n_nationkey AS id, 'Module' AS type, n_name AS name, '{}' AS props, n_nationkey::BIGINT AS seq FROM nation
), edges AS (SELECT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst, 'depends_on' AS type, '{}' AS props, c_nationkey::BIGINT * 10 + k AS seq FROM best)"""


def event_graph_t(spark: SparkSession, sf_dir: str) -> Graph:
    """Users publish event types; a type calls the one that follows it in a user's time."""
    e = table(spark, sf_dir, "events")
    users = e.groupBy("user_id").agg(F.min("event_id").alias("s")).select(_id("user", "user_id").alias("id"), F.lit("Component").alias("type"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), F.lit("{}").alias("props"), F.col("s").alias("seq"))
    kinds = e.groupBy("event_type").agg(F.min("event_id").alias("s")).select(F.concat(F.lit("type:"), "event_type"), F.lit("Event"), "event_type", F.lit("{}"), "s")
    pub = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("s")).select(_id("user", "user_id").alias("src"), F.concat(F.lit("type:"), "event_type").alias("dst"), F.lit("publishes").alias("type"), F.lit("{}").alias("props"), F.col("s").alias("seq"))
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = e.withColumn("n", nxt).where(F.col("n").isNotNull()).groupBy("event_type", "n").agg(F.min("event_id").alias("s")).select(F.concat(F.lit("type:"), "event_type"), F.concat(F.lit("type:"), "n"), F.lit("calls"), F.lit("{}"), "s")
    return Graph(users.union(kinds), pub.union(calls))


EVENTS = """
nxt AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
nodes AS (
  SELECT 'user:' || user_id AS id, 'Component' AS type, 'user ' || user_id AS name, '{}' AS props, min(event_id) AS seq FROM events GROUP BY user_id
  UNION ALL SELECT 'type:' || event_type, 'Event', event_type, '{}', min(event_id) FROM events GROUP BY event_type
), edges AS (
  SELECT 'user:' || user_id AS src, 'type:' || event_type AS dst, 'publishes' AS type, '{}' AS props, min(event_id) AS seq FROM events GROUP BY user_id, event_type
  UNION ALL SELECT 'type:' || event_type, 'type:' || n, 'calls', '{}', min(event_id) FROM nxt WHERE n IS NOT NULL GROUP BY event_type, n
)"""


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path source/doc_id.lang, content."""
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("text").alias("content"), "doc_id")


DOC_LANGUAGES = {".en": "english", ".de": "german", ".fr": "french", ".es": "spanish"}
FILES = "files AS (SELECT source || '/' || doc_id || '.' || lang AS path, text AS content, doc_id, source, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS language FROM documents)"


def link_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages, and the links that their markup holds."""
    p = table(spark, sf_dir, "pages")
    nodes = p.select("url", F.lit("File").alias("type"), F.col("url").alias("name"), F.lit("{}").alias("props"), F.col("page_id").alias("seq")).withColumnRenamed("url", "id")
    links = p.select("url", "page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("dst"))
    return Graph(nodes, links.select(F.col("url").alias("src"), "dst", F.lit("imports").alias("type"), F.lit("{}").alias("props"), F.col("page_id").alias("seq")))


LINKS = """
nodes AS (SELECT url AS id, 'File' AS type, url AS name, '{}' AS props, page_id AS seq FROM pages),
edges AS (SELECT url AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst, 'imports' AS type, '{}' AS props, page_id AS seq FROM pages)"""


def conv_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations, each leading to the next."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    key = lambda t: F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit("."), t.cast("string"))
    nodes = c.select(key(F.col("turn")).alias("id"), F.lit("Function").alias("type"), F.col("role").alias("name"), F.lit("{}").alias("props"), F.col("turn").alias("seq"))
    nxt = c.withColumn("n", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("n").isNotNull())
    return Graph(nodes, nxt.select(key(F.col("turn")).alias("src"), key(F.col("n")).alias("dst"), F.lit("flow_step").alias("type"), F.lit("{}").alias("props"), F.col("turn").alias("seq")))


CONV = """
c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL),
cn AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c),
nodes AS (SELECT 'turn:' || conv_id || '.' || turn AS id, 'Function' AS type, role AS name, '{}' AS props, turn AS seq FROM c),
edges AS (SELECT 'turn:' || conv_id || '.' || turn AS src, 'turn:' || conv_id || '.' || n AS dst, 'flow_step' AS type, '{}' AS props, turn AS seq FROM cn WHERE n IS NOT NULL)"""


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each supplier, with a class, imports and calls of the suppliers that share its parts' numbers."""
    t = lambda n: table(spark, sf_dir, n)
    near = t("lineitem").select("l_suppkey", (F.col("l_partkey") % 97 + 1).alias("other")).distinct().where(F.col("l_suppkey") != F.col("other")).join(t("supplier").select(F.col("s_suppkey").alias("other")), "other", "left_semi")
    mod = lambda c: F.concat(F.lit("pkg"), (c % 10).cast("string"), F.lit(".mod"), c.cast("string"))
    of = near.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("other")).alias("others"))
    x = t("supplier").select(F.col("s_suppkey").alias("k")).join(of.withColumnRenamed("l_suppkey", "k"), "k", "left").withColumn("others", F.coalesce("others", F.array().cast("array<bigint>")))
    imports = F.array_join(F.transform("others", lambda o: F.concat(F.lit("from "), mod(o), F.lit(" import Supplier"), o.cast("string"), F.lit("Service\n"))), "")
    body = F.array_join(F.transform("others", lambda o: F.concat(F.lit("        supplier_"), o.cast("string"), F.lit(".run_"), o.cast("string"), F.lit("(order)\n"))), "")
    k = F.col("k").cast("string")
    code = F.concat(imports, F.lit("\nclass Supplier"), k, F.lit("Service:\n    def run_"), k, F.lit("(self, order):\n"), body, F.lit("        return order\n"))
    return x.select(F.concat(F.replace(mod(F.col("k")), F.lit("."), F.lit("/")), F.lit("/main.py")).alias("path"), F.lit("python").alias("language"), code.alias("content"), F.col("k"))


CODE = """
near AS (
  SELECT DISTINCT l_suppkey AS k, l_partkey % 97 + 1 AS o FROM lineitem WHERE l_suppkey <> l_partkey % 97 + 1 AND l_partkey % 97 + 1 IN (SELECT s_suppkey FROM supplier)
)"""
