"""Queries over code made from the test tables: components, callers, messaging, stores and streams, and the same in SQL."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import NODE_SCHEMA, Graph
from ..operators import answers as N
from ..operators import components as C
from ..operators import derive as D
from ..operators import merge as M
from ..operators import metrics as X
from ..operators import services as P
from ..operators import summary as Z
from ..operators import traverse as T
from ..operators import vectors as V
from ..sources import files as FS
from ..sources import store as R
from ..streaming import upkeep as U
from . import adapters as A
from .adapters import EVENTS, FILES, LINKS, STAR, table
from .queries import _both, _BOTH, _root, query


def _code(spark, d):
    """Classes and functions of a file for each supplier: k % 3 of them name a component, k % 4 give methods, k % 2 a loose function."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("seq"), F.concat(F.lit("m"), (k % 40).cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("C"), k.cast("string"), F.when(k % 3 == 0, "Service").when(k % 3 == 1, "Producer").otherwise("")).alias("cls"))
    methods = s.where("seq % 4 > 0").select("seq", "path", F.col("cls").alias("owner"), F.explode(F.sequence(F.lit(1), (F.col("seq") % 4).cast("int"))).alias("i")).select("path", F.concat(F.lit("run_"), F.col("i").cast("string")).alias("name"), "owner", "seq")
    loose = s.where("seq % 2 = 0").select("path", F.concat(F.lit("help_"), F.col("seq").cast("string")).alias("name"), F.lit(None).cast("string").alias("owner"), "seq")
    return s.select("path", F.col("cls").alias("name"), "seq"), methods.union(loose)


_CODE = """s AS (SELECT s_suppkey AS k, 'm' || s_suppkey % 40 || '.py' AS path, 'C' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN 'Service' WHEN 1 THEN 'Producer' ELSE '' END AS cls FROM supplier),
comp AS (SELECT * FROM s WHERE k % 3 = 0 OR k % 4 >= 2), one AS (SELECT path, any_value(cls) AS cls FROM comp GROUP BY path HAVING count(*) = 1),
meth AS (SELECT path, cls, unnest(range(1, k % 4 + 1)) AS i FROM comp)"""


def _components(spark, d):
    return C.component_graph(*_code(spark, d))


@query(f"WITH {_CODE}, n AS (SELECT 'Class:' || path || ':' || cls AS id, 'Class' AS type, cls AS name FROM s UNION ALL SELECT 'Component:' || path || ':' || cls, 'Component', cls FROM comp UNION ALL SELECT 'Function:' || path || ':' || cls || '.run_' || i, 'Function', 'run_' || i FROM meth UNION ALL SELECT 'Function:' || path || ':help_' || k, 'Function', 'help_' || k FROM s WHERE k % 2 = 0), e AS (SELECT 'Component:' || path || ':' || cls AS src, 'implements' AS type, 'Class:' || path || ':' || cls AS dst FROM comp UNION ALL SELECT 'Component:' || path || ':' || cls, 'contains', 'Function:' || path || ':' || cls || '.run_' || i FROM meth UNION ALL SELECT 'Component:' || path || ':' || one.cls, 'contains', 'Function:' || path || ':help_' || k FROM s JOIN one USING (path) WHERE k % 2 = 0)" + _BOTH)
def component_graph(spark, d):
    return _both(_components(spark, d))


@query(f"WITH {_CODE} SELECT 'Function:' || path || ':' || cls || '.run_' || i AS function, 'Component:' || path || ':' || cls AS component FROM meth UNION ALL SELECT 'Function:' || path || ':help_' || k, 'Component:' || path || ':' || one.cls FROM s JOIN one USING (path) WHERE k % 2 = 0")
def func_to_component(spark, d):
    return C.func_to_component(_components(spark, d))


@query("WITH " + FILES + " SELECT 'File:' || path || ':' AS file, 'Module:' || source || ':' AS module FROM files WHERE language IS NOT NULL")
def file_to_module(spark, d):
    return C.file_to_module(D.derive_structure(FS.scan_files(A.doc_files(spark, d), known=A.DOC_LANGUAGES)))


@query("WITH " + FILES + ", f AS (SELECT * FROM files WHERE language IS NOT NULL), n AS (SELECT 'Repository::repo' AS id, 'Repository' AS type, 'repo' AS name UNION ALL SELECT DISTINCT 'Module:' || source || ':', 'Module', source FROM f UNION ALL SELECT 'File:' || path || ':', 'File', doc_id || path[length(path) - 2:] FROM f), e AS (SELECT DISTINCT 'Repository::repo' AS src, 'contains' AS type, 'Module:' || source || ':' AS dst FROM f UNION ALL SELECT 'Module:' || source || ':', 'contains', 'File:' || path || ':' FROM f)" + _BOTH)
def derive_structure(spark, d):
    return _both(D.derive_structure(FS.scan_files(A.doc_files(spark, d), known=A.DOC_LANGUAGES)))


@query(f"WITH {_CODE} SELECT path, string_agg('Component:' || path || ':' || cls, ',' ORDER BY 'Component:' || path || ':' || cls) AS components FROM comp GROUP BY path")
def comp_by_file(spark, d):
    c = _components(spark, d).nodes.where("type = 'Component'").select("id", F.split("id", ":")[1].alias("path"))
    return C.comp_by_file(c).select("path", F.array_join("components", ",").alias("components"))


@query("SELECT 'm' || s_suppkey AS path, unnest(['free', 'C' || s_suppkey || '.own', 'C' || s_suppkey || '.own']) AS caller, unnest(['a' || s_nationkey, 'b' || s_nationkey, 'c']) AS callee FROM supplier")
def flatten_symbols(spark, d):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    fn = lambda name, *calls: F.struct(name.alias("name"), F.array(*calls).alias("calls"))
    own = F.array(F.struct(F.concat(F.lit("C"), k).alias("name"), F.array(fn(F.lit("own"), F.concat(F.lit("b"), n), F.lit("c"))).alias("methods")))
    f = table(spark, d, "supplier").select(F.concat(F.lit("m"), k).alias("path"), F.array(fn(F.lit("free"), F.concat(F.lit("a"), n))).alias("functions"), own.alias("classes"))
    return C.flatten_symbols(f)[1]


@query("WITH f AS (SELECT 'f' || s_suppkey AS id, 'run_' || s_suppkey % 41 AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'C' || s_suppkey % 5 END AS owner, s_suppkey AS seq FROM supplier), p AS (SELECT DISTINCT 'run_' || o_custkey % 45 AS name, CASE WHEN o_custkey % 4 > 0 THEN 'C' || o_custkey % 6 END AS owner FROM orders), x AS (SELECT p.*, arg_max(id, seq) FILTER (WHERE f.owner = p.owner) AS exact, count(id) AS n, arg_min(id, seq) AS first, arg_min(id, seq) FILTER (WHERE coalesce(f.owner, '') = coalesce(p.owner, '')) AS alike FROM p JOIN f USING (name) GROUP BY p.name, p.owner) SELECT 'm' AS path, owner, name, coalesce(exact, CASE WHEN n = 1 THEN first END, alike, first) AS dst FROM x")
def resolve_caller(spark, d):
    k, o = F.col("s_suppkey"), F.col("o_custkey")
    f = table(spark, d, "supplier").select(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.concat(F.lit("run_"), (k % 41).cast("string")).alias("name"), F.when(k % 3 > 0, F.concat(F.lit("C"), (k % 5).cast("string"))).alias("owner"), k.alias("seq"))
    p = table(spark, d, "orders").select(F.lit("m").alias("path"), F.when(o % 4 > 0, F.concat(F.lit("C"), (o % 6).cast("string"))).alias("owner"), F.concat(F.lit("run_"), (o % 45).cast("string")).alias("name"))
    return C.resolve_caller(p, f)


def _messaging(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("m"), F.when(k % 4 == 0, k).otherwise(k % 30).cast("string")).alias("path"), F.concat(F.lit("A"), k.cast("string"), F.when(k % 7 == 0, "Publisher").when(k % 7 == 1, "Listener").otherwise("")).alias("name"))
    calls = c.where("k % 2 = 0").select("path", F.when(F.col("k") % 8 > 0, F.col("name")).alias("owner"), F.when(F.col("k") % 6 == 0, "bus.Emit").when(F.col("k") % 6 == 2, "bus.subscribe").otherwise("save").alias("callee"))
    marks = c.where("k % 11 = 0").select("path", F.col("name").alias("owner"), F.lit("App.Task(x)").alias("decorator"))
    return c.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"), "path", "name"), calls, marks


_MSG = """c AS (SELECT c_custkey AS k, 'm' || CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE c_custkey % 30 END AS path, 'A' || c_custkey || CASE c_custkey % 7 WHEN 0 THEN 'Publisher' WHEN 1 THEN 'Listener' ELSE '' END AS name FROM customer),
h AS (SELECT *, {own} AS hit, {loose} AS loose FROM c), w AS (SELECT *, count(*) OVER (PARTITION BY path) AS n, max(hit) OVER (PARTITION BY path) AS any_hit, max(loose) OVER (PARTITION BY path) AS free FROM h)
SELECT path, 'c' || k AS id FROM w WHERE hit OR (NOT any_hit AND n = 1 AND free)"""


@query("WITH " + _MSG.format(own="k % 7 = 0 OR (k % 6 = 0 AND k % 8 > 0)", loose="k % 6 = 0 AND k % 8 = 0"))
def find_producers(spark, d):
    c, calls, _ = _messaging(spark, d)
    return C.find_producers(c, calls)


@query("WITH " + _MSG.format(own="k % 7 = 1 OR k % 11 = 0 OR (k % 6 = 2 AND k % 8 > 0)", loose="k % 6 = 2 AND k % 8 = 0"))
def find_consumers(spark, d):
    return C.find_consumers(*_messaging(spark, d))


def _databases(spark, d, real=True):
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    k = F.col("p_partkey")
    ref = F.when(k % 3 == 0, F.concat(F.lit('{"database":"db'), (k % 25).cast("string"), F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('{"db":"nation:'), (k % 25).cast("string"), F.lit('"}'))).otherwise("{}")
    tables = p.select(F.concat(F.lit("part:"), k.cast("string")).alias("id"), F.lit("Table").alias("type"), F.concat(F.lit("t"), k.cast("string")).alias("name"), ref.alias("props"), k.cast("long").alias("seq"))
    dbs = n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Database").alias("type"), F.concat(F.lit("db"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("{}").alias("props"), F.col("n_nationkey").cast("long").alias("seq"))
    return Graph(tables.union(dbs.where(F.col("seq") % 2 == 0)) if real else tables, spark.createDataFrame([], "src string, dst string, type string, props string, seq long"))


_DBS = "t AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'db' || p_partkey % 25 WHEN 1 THEN 'nation:' || p_partkey % 25 END AS ref FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY k) AS i FROM t), l AS (SELECT ref, string_agg('t' || k, ',' ORDER BY k) AS tables FROM r WHERE i <= 20 GROUP BY ref)"


@query(f"WITH {_DBS} SELECT 'nation:' || n_nationkey AS id, 'db' || n_nationkey AS name, coalesce(a.tables, b.tables, '') AS tables FROM nation LEFT JOIN l a ON a.ref = 'db' || n_nationkey LEFT JOIN l b ON b.ref = 'nation:' || n_nationkey WHERE n_nationkey % 2 = 0")
def db_tables(spark, d):
    return C.db_tables(_databases(spark, d)).withColumn("tables", F.array_join("tables", ","))


@query(f"WITH {_DBS} SELECT 'synthetic:' || coalesce(ref, 'default') AS id, coalesce(ref, 'default') AS name, tables FROM l")
def db_tables_synthetic(spark, d):
    return C.db_tables(_databases(spark, d, real=False)).withColumn("tables", F.array_join("tables", ","))


@query(f"WITH {EVENTS}, seed AS (SELECT dst AS id FROM edges WHERE type = 'calls' AND dst = 'type:click'), c AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'calls'), b AS (SELECT src, dst FROM c UNION SELECT dst, src FROM c), n1 AS (SELECT id FROM nodes WHERE id = 'type:click' UNION SELECT dst FROM b WHERE src = 'type:click'), f AS (SELECT id FROM n1 UNION SELECT dst FROM b WHERE src IN (SELECT id FROM n1)) SELECT f.id, (SELECT count(*) FROM c WHERE c.dst = f.id AND c.src IN (SELECT id FROM f)) AS in_degree, (SELECT count(*) FROM c WHERE c.src = f.id AND c.dst IN (SELECT id FROM f)) AS out_degree FROM f WHERE EXISTS (SELECT 1 FROM nodes WHERE id = 'type:click')")
def callgraph_focus(spark, d):
    return T.callgraph_focus(A.event_graph_t(spark, d), "type:click")[1]


@query("SELECT 'd' || doc_id % 3 || '/' || CASE doc_id % 4 WHEN 0 THEN 'dist' WHEN 1 THEN '.hidden' ELSE 'src' END || '/f' || doc_id || ext AS path, lang AS language, octet_length(encode(coalesce(text, '')))::BIGINT AS size_bytes FROM (SELECT doc_id, text, ['.PY', '.mdx', '.min.js', '.zz', '.kt'][doc_id % 5 + 1] AS ext, ['python', 'markdown', 'javascript', NULL, 'kotlin'][doc_id % 5 + 1] AS lang FROM documents) WHERE doc_id % 4 > 0 AND lang IS NOT NULL")
def scan_files_v2(spark, d):
    k = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, (".PY", ".mdx", ".min.js", ".zz", ".kt"))), (k % 5 + 1).cast("int"))
    folder = F.when(k % 4 == 0, "dist").when(k % 4 == 1, ".hidden").otherwise("src")
    path = F.concat(F.lit("d"), (k % 3).cast("string"), F.lit("/"), folder, F.lit("/f"), k.cast("string"), ext)
    return FS.scan_files_v2(table(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content")))


@query("SELECT count(*) AS total_files, sum(octet_length(encode(text)))::BIGINT AS total_size FROM documents WHERE lang IN ('en', 'de') AND text IS NOT NULL")
def scan_totals(spark, d):
    f = table(spark, d, "documents").where("lang in ('en', 'de') and text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return FS.scan_totals(FS.scan_files_v2(f))


@query("SELECT s_suppkey AS id, 'supplier-' || s_suppkey || '-x' AS repo, CASE s_suppkey % 4 WHEN 0 THEN '{\"k\": \"}\", \"n\": ' || s_suppkey || '}' WHEN 1 THEN '{\"n\": {\"m\": ' || s_suppkey || '}}' WHEN 2 THEN '{\"n\": [' || s_suppkey || ']}' END AS object FROM supplier")
def json_object(spark, d):
    k = F.col("s_suppkey")
    t = k.cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit('As asked: {"k": "}", "n": '), t, F.lit("} and then {more}"))).when(k % 4 == 1, F.concat(F.lit(' {"n": {"m": '), t, F.lit("}} "))).when(k % 4 == 2, F.concat(F.lit('```json\n{"n": ['), t, F.lit("]}\n``` {no}"))).otherwise(F.lit("nothing { here"))
    return table(spark, d, "supplier").select(k.alias("id"), S.repo_id(F.concat(F.lit("Supplier#"), t, F.lit(" X"))).alias("repo"), S.json_object(said).alias("object"))


@query("SELECT 'e' || n_nationkey AS id, unnest(['a', 'c']) AS key, unnest([n_nationkey::VARCHAR, n_name]) AS value FROM nation")
def clean_metadata(spark, d):
    props = F.concat(F.lit('{"a":'), F.col("n_nationkey").cast("string"), F.lit(',"b":null,"c":"'), "n_name", F.lit('"}'))
    return table(spark, d, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("id"), F.explode(V.clean_metadata(props)).alias("key", "value"))


@query(f"WITH {STAR}, t AS (SELECT id, type AS node_type, name || ' ' || type AS document FROM nodes WHERE type IN ('Service', 'Repository')), w AS (SELECT id, unnest(regexp_split_to_array(lower(document), '\\W+')) AS w FROM t), p AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 32 AS d, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL), g AS (SELECT id, d FROM t, range(32) r(d)), v AS (SELECT g.id, string_agg(coalesce(n, 0)::INT::VARCHAR, ',' ORDER BY g.d) AS embedding FROM g LEFT JOIN p USING (id, d) GROUP BY g.id) SELECT * FROM t JOIN v USING (id)")
def embed_nodes(spark, d):
    e = V.embed_nodes(A.star_graph(spark, d), types=("Service", "Repository"))
    return e.withColumn("embedding", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ","))


@query("SELECT vec_id AS id, 'g' || label AS graph_id FROM embeddings WHERE label <> 3")
def vector_delete(spark, d):
    return V.vector_delete(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("graph_id")), "g3")


# stored graphs and results


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type = 'Module'), e AS (SELECT * FROM edges WHERE type = 'contains' AND src LIKE 'region:%'){_BOTH}")
def save_and_load_graph(spark, d):
    """Two graphs are stored, one of them again from what is stored of it, and one goes."""
    g, root = A.star_graph(spark, d), _root(spark)
    small = Graph(g.nodes.where("type = 'Module'"), g.edges.where("type = 'contains' and src like 'region:%'"))
    R.save_graph(small, root, "one", repo_name="Nations")
    R.save_graph(Graph(g.nodes.where("type = 'Service'"), g.edges.where("type = 'uses'")), root, "two")
    R.save_graph(R.load_graph(spark, root, "one"), root, "one", repo_name="Nations")
    R.delete_graph(spark, root, "two")
    return _both(R.load_graph(spark, root, "one"))


def _regions(spark, d):
    """A stored graph for each of four regions: its nations, and edges from the region to them; one is stored again without edges, one is deleted."""
    root, n = _root(spark), table(spark, d, "nation")
    nodes = n.select(F.col("n_name").alias("id"), F.lit("Module").alias("type"), F.col("n_name").alias("name"), F.lit("{}").alias("props"), F.col("n_nationkey").cast("long").alias("seq"), "n_regionkey")
    edges = n.select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("src"), F.col("n_name").alias("dst"), F.lit("contains").alias("type"), F.lit("{}").alias("props"), F.col("n_nationkey").cast("long").alias("seq"), "n_regionkey")
    for r in table(spark, d, "region").where("r_regionkey <> 2").orderBy("r_regionkey").collect():  # five rows
        own = F.col("n_regionkey") == r["r_regionkey"]
        g = Graph(nodes.where(own).drop("n_regionkey"), edges.where(own).drop("n_regionkey"))
        R.save_graph(g, root, f"g{r['r_regionkey']}", repo_name=r["r_name"])
        if r["r_regionkey"] == 1:
            R.save_graph(Graph(g.nodes, g.edges.limit(0)), root, "g1", repo_name=r["r_name"])
    R.delete_graph(spark, root, "g4")
    return root


@query("SELECT 'g' || r_regionkey AS graph_id, r_name AS repo_name, count(n_nationkey) AS node_count, CASE WHEN r_regionkey <> 1 THEN count(n_nationkey) ELSE 0 END AS edge_count FROM region JOIN nation ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'a') AND r_regionkey NOT IN (2, 4) GROUP BY r_regionkey, r_name")
def list_graphs(spark, d):
    """Those of the stored graphs whose repository has an a."""
    return R.search_graphs_by_repo(spark, _regions(spark, d), "A").select("graph_id", "repo_name", "node_count", "edge_count")


@query("WITH h AS (SELECT 'g' || n_regionkey AS graph_id, n_regionkey, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(r_name), 'a') AND r_regionkey NOT IN (2, 4)) SELECT graph_id, 'node' AS kind, n_name AS a, 'Module' AS type, n_name AS b FROM h UNION ALL SELECT graph_id, 'edge', 'region:' || n_regionkey, 'contains', n_name FROM h WHERE n_regionkey <> 1")
def load_by_repo(spark, d):
    """All of those graphs, in one scan of nodes and one of edges."""
    g = R.load_by_repo(spark, _regions(spark, d), "A")
    return g.nodes.select("graph_id", F.lit("node").alias("kind"), F.col("id").alias("a"), "type", F.col("name").alias("b")).union(g.edges.select("graph_id", F.lit("edge"), "src", "type", "dst"))


@query("SELECT 'g' || r_regionkey AS graph_id, CASE r_regionkey WHEN 3 THEN 1 ELSE 2 END::INT AS position FROM region WHERE r_regionkey IN (1, 3)")
def latest_graphs(spark, d):
    """The two graphs that were saved last."""
    found = R.latest_graphs(spark, _regions(spark, d), 2)
    return found.select("graph_id", F.row_number().over(Window.orderBy(F.desc("created_at"))).alias("position"))


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type IN ('Service', 'Module')), e AS (SELECT * FROM edges WHERE type IN ('depends_on', 'uses')), c AS (SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges FROM n), t AS (SELECT string_agg('\"' || type || '\":' || k, ',' ORDER BY type) AS t FROM (SELECT type, count(*) AS k FROM n GROUP BY type)) SELECT 'node' AS kind, id AS a, type, name AS b FROM n UNION ALL SELECT 'edge', src, type, dst FROM e UNION ALL SELECT 'meta', 'star', nodes || '/' || edges, '{{' || t || '}}' FROM c, t")
def export_json(spark, d):
    """Lines of JSON, written, read again: what is said of the graph, its nodes and edges."""
    g, root = A.star_graph(spark, d), _root(spark)
    R.export_json(Graph(g.nodes.where("type in ('Service', 'Module')"), g.edges.where("type in ('depends_on', 'uses')")), graph_id="star").write.partitionBy("kind").text(root)
    lines = spark.read.text(root).select("kind", F.col("value").alias("json"))
    said = F.from_json("json", "graph_id string, node_count long, edge_count long, node_type_counts map<string,long>").alias("m")
    meta = lines.where("kind = 'meta'").select(said).select(F.lit("meta").alias("kind"), F.col("m.graph_id").alias("a"), F.concat_ws("/", "m.node_count", "m.edge_count").alias("type"), F.to_json("m.node_type_counts").alias("b"))
    return _both(R.import_json(lines)).union(meta)


@query("WITH old AS (SELECT 'r' || o_custkey % 50 AS repo, 'c' || o_custkey % 7 AS commit_sha, 'a' || o_custkey % 2 AS analyzer FROM orders GROUP BY ALL), kept AS (SELECT * FROM old WHERE repo <> 'r7'), want AS (SELECT DISTINCT 'r' || c_custkey % 60 AS repo, CASE WHEN c_custkey % 5 > 0 THEN 'c' || c_custkey % 7 ELSE '' END AS commit_sha, 'a1' AS analyzer FROM customer) SELECT w.*, k.repo IS NOT NULL AS stored FROM want w LEFT JOIN kept k USING (repo, commit_sha, analyzer)")
def reuse_results(spark, d):
    o, c = F.col("o_custkey"), F.col("c_custkey")
    old = table(spark, d, "orders").select(F.concat(F.lit("r"), (o % 50).cast("string")).alias("repo"), F.concat(F.lit("c"), (o % 7).cast("string")).alias("commit_sha"), F.concat(F.lit("a"), (o % 2).cast("string")).alias("analyzer"), F.lit("x").alias("result")).distinct()
    name = f"results_{_root(spark)[-32:]}"
    R.create_results(spark, name, _root(spark), buckets=8)
    R.put_results(spark, name, old.withColumn("result", F.lit("old")))
    R.put_results(spark, name, old.unionByName(old.limit(1).withColumn("commit_sha", F.lit(""))))
    R.invalidate_results(spark, name, "r7")
    want = table(spark, d, "customer").select(F.concat(F.lit("r"), (c % 60).cast("string")).alias("repo"), F.when(c % 5 > 0, F.concat(F.lit("c"), (c % 7).cast("string"))).otherwise("").alias("commit_sha"), F.lit("a1").alias("analyzer")).distinct()
    hits, misses = R.reuse_results(spark, name, want)
    return hits.select(*R.KEYS, (F.col("result") == "x").alias("stored")).union(misses.withColumn("stored", F.lit(False)))


@query("WITH s AS (SELECT DISTINCT 'r' || o_custkey % 50 AS repo, o_custkey % 7 AS sha, 'a' || o_custkey % 2 AS analyzer FROM orders WHERE o_custkey % 50 <> 7) SELECT analyzer, count(DISTINCT repo) AS repos, count(*) AS results FROM s GROUP BY analyzer")
def result_stats(spark, d):
    """Results are put in two turns, the second one replaces half of them, and those of a repository go."""
    o = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.concat(F.lit("r"), (o % 50).cast("string")).alias("repo"), F.concat(F.lit("c"), (o % 7).cast("string")).alias("commit_sha"), F.concat(F.lit("a"), (o % 2).cast("string")).alias("analyzer"), F.lit("x").alias("result")).distinct()
    root = _root(spark)
    name = f"results_{root[-32:]}"
    R.create_results(spark, name, root, buckets=8)
    R.put_results(spark, name, rows)
    R.put_results(spark, name, rows.where("analyzer = 'a1'"))
    R.invalidate_results(spark, name, "r7")
    return R.result_stats(spark, name)


# streams, run over what is there


@query("SELECT 'customer:' || o_custkey AS id, coalesce(arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 2 = 1), arg_max(o_orderstatus, o_orderkey)) AS name FROM orders GROUP BY o_custkey")
def stream_graph_upsert(spark, d):
    """Orders arrive as nodes of their customers: even ones by one query, then odd ones by another, then the first one is started again. Of a query's rows the last one stays, and the later query's."""
    root = _root(spark)
    rows = table(spark, d, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"), F.lit("Component").alias("type"), F.col("o_orderstatus").alias("name"), F.lit("{}").alias("props"), F.col("o_orderkey").cast("long").alias("seq"))
    for k in (0, 1):
        rows.where(F.col("seq") % 2 == k).write.parquet(f"{root}/in-{k}")
    for k in (0, 1, 0):
        stream = spark.readStream.schema(NODE_SCHEMA).parquet(f"{root}/in-{k}")
        U.stream_graph_upsert(stream, f"{root}/table", f"{root}/checkpoint-{k}", slots=16).awaitTermination()
    return U.latest(spark, f"{root}/table", NODE_SCHEMA).select("id", "name")


_SCANS = "WITH f AS (SELECT 'd' || doc_id AS path, doc_id AS k FROM documents)"


@query(_SCANS + " SELECT path, 'new' AS change FROM f WHERE k % 3 > 0 OR k % 7 > 0 UNION ALL SELECT path, 'changed' FROM f WHERE k % 3 > 0 AND k % 7 > 0 AND k % 5 = 0 UNION ALL SELECT path, 'deleted' FROM f WHERE k % 3 > 0 AND k % 7 = 0")
def stream_incremental_scan(spark, d):
    """Documents are listed twice as files: at first without a third of them and a fifth as it was before, then without a seventh."""
    root, k = _root(spark), F.col("doc_id")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), k.cast("string")).alias("path"), sha.alias("sha256"))
    scans = (docs.where(k % 3 > 0).withColumn("sha256", F.when(k % 5 > 0, F.col("sha256")).otherwise("old")), docs.where(k % 7 > 0))
    schema = "path string, sha256 string, seen timestamp"
    for n, scan in enumerate(scans):
        scan.select("path", "sha256", F.lit(f"2024-01-0{n + 1} 00:00:00").cast("timestamp").alias("seen")).write.parquet(f"{root}/in/{n}")
        files = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        U.to_table(U.stream_incremental_scan(files, patience_ms=3_600_000), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("path", "change")


# derivation


@query("SELECT 'k' || p_partkey AS name, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'table' ELSE 'schema' END AS entity_kind FROM part WHERE p_partkey % 4 < 3")
def data_entities(spark, d):
    k = F.col("p_partkey")
    bases = F.when(k % 4 == 0, F.array(F.lit("db.Model"))).when(k % 4 == 1, F.array(F.lit("X"), F.lit("Document"))).otherwise(F.array(F.lit("X")))
    marks = F.when(k % 4 == 2, F.array(F.lit("dataclass(frozen=True)"))).otherwise(F.array().cast("array<string>"))
    return D.data_entities(table(spark, d, "part").select(F.lit("p").alias("path"), F.concat(F.lit("k"), k.cast("string")).alias("name"), bases.alias("base_classes"), marks.alias("decorators"))).select("name", "entity_kind")


@query("SELECT 'f' || p_partkey AS id, p_partkey % 3 = 0 OR p_partkey % 4 = 0 AS is_api FROM part")
def is_api_function(spark, d):
    k = F.col("p_partkey")
    marks = F.when(k % 3 == 0, F.array(F.lit("App.Get('/x')"))).otherwise(F.array(F.lit("cached")))
    path = F.when(k % 4 == 0, "a/Views.py").otherwise("a/other.py")
    return table(spark, d, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("id"), D.is_api_function(marks, path).alias("is_api"))


@query("SELECT 'node:n' || s_suppkey AS location, CASE s_suppkey % 4 WHEN 0 THEN 'missing property layer_index' WHEN 1 THEN 'missing property trigger' ELSE 'missing property entity_type' END AS message FROM supplier WHERE s_suppkey % 4 < 3 AND s_suppkey % 2 = 0 OR s_suppkey % 4 = 1 AND s_suppkey % 3 = 0")
def validate_semantics(spark, d):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("Layer", "BusinessFlow", "DomainEntity", "Module"))), (k % 4 + 1).cast("int"))
    props = F.when((k % 4 == 1) & (k % 3 > 0), '{"trigger":"x"}').otherwise('{"other":1}')
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("n"), k.cast("string")).alias("id"), kind.alias("type"), F.lit("x").alias("name"), props.alias("props"), k.cast("long").alias("seq"))
    return M.validate_semantics(Graph(nodes, None)).select("location", "message")


@query("SELECT DISTINCT 'node' AS kind, 'Event::t_' || lang AS a, 'Event' AS type, 't_' || lang AS b FROM documents UNION ALL SELECT DISTINCT 'node', 'Topic:kafka:t_' || lang, 'Topic', 't_' || lang FROM documents UNION ALL SELECT DISTINCT 'edge', 'Event::t_' || lang, 'routes_to', 'Topic:kafka:t_' || lang FROM documents UNION ALL SELECT DISTINCT 'edge', 'Component:' || source || '/p.py', 'publishes', 'Event::t_' || lang FROM documents")
def event_graph(spark, d):
    f = table(spark, d, "documents").select(F.concat("source", F.lit("/p.py")).alias("path"), F.concat(F.lit("p.send('t_"), "lang", F.lit("', m)")).alias("content"), F.lit("kafka").alias("broker")).distinct()
    topics = D.extract_topics(f).withColumn("broker", F.lit("kafka"))
    return _both(D.event_graph(topics, f.select("path", F.concat(F.lit("Component:"), "path").alias("id")).distinct()))


def _last_rank(steps: int, tol: str) -> str:
    """SQL after nodes and edges: the ranks of the first step whose change is below tol a node."""
    out = "n AS (SELECT count(*)::DOUBLE AS n FROM nodes), p AS (SELECT DISTINCT src, dst FROM edges), o AS (SELECT src, count(*) AS o FROM p GROUP BY src), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r, 9.0::DOUBLE AS off FROM nodes, n)"
    for i in range(1, steps + 1):
        got = f"SELECT dst AS id, sum(r / o) AS got FROM p JOIN o USING (src) JOIN r{i - 1} q ON q.id = p.src GROUP BY dst"
        lost = f"SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)"
        out += f", s{i} AS (SELECT x.id, x.r AS was, 0.85 * (coalesce(got, 0) + lost / n) + 0.15 / n AS r FROM r{i - 1} x LEFT JOIN ({got}) g USING (id), ({lost}) l, n), r{i} AS MATERIALIZED (SELECT id, r, sum(abs(r - was)) OVER () AS off FROM s{i})"
    every = " UNION ALL ".join(f"SELECT {i} AS i, * FROM r{i}" for i in range(1, steps + 1))
    return out + f", e AS ({every}) SELECT id, round(r, 6) AS pagerank FROM e WHERE i = (SELECT min(i) FROM e, n WHERE off < n * {tol})"


@query("WITH " + A.TRADE + ", " + _last_rank(30, "1e-4"))
def pagerank_to_tolerance(spark, d):
    return X.pagerank(A.trade_graph(spark, d), tol=1e-4)


@query(f"WITH {STAR}, n AS (SELECT id, type, CASE WHEN type = 'Module' THEN lower(name) ELSE name END AS name FROM nodes WHERE type IN ('Module', 'Repository')), e AS (SELECT src, type, dst FROM edges WHERE src LIKE 'region:%'){_BOTH}")
def load_and_merge(spark, d):
    """A graph and a later version of its modules, stored apart and loaded as one."""
    g, root = A.star_graph(spark, d), _root(spark)
    edges = g.edges.where("src like 'region:%'")
    R.save_graph(Graph(g.nodes.where("type in ('Module', 'Repository')"), edges), root, "first")
    R.save_graph(Graph(g.nodes.where("type = 'Module'").withColumn("name", F.lower("name")), edges.limit(0)), root, "second")
    return _both(R.load_and_merge(spark, root, ["first", "no such", "second"]))


@query(f"WITH {STAR}, x AS (SELECT type, json_extract_string(props, '$.nation') AS module FROM nodes WHERE type IN ('Component', 'Service')), c AS (SELECT module, type, count(*) AS n FROM x GROUP BY ALL) SELECT 'cluster::module::' || module AS cluster_id, module AS key, sum(n)::BIGINT AS members, arg_min(type, (-n, type)) AS dominant_type, sum(n) > 50 AS collapsed FROM c GROUP BY module")
def cluster_by_module(spark, d):
    g = A.star_graph(spark, d)
    nodes = g.nodes.where("type in ('Component', 'Service')").withColumn("module", F.get_json_object("props", "$.nation"))
    return X.cluster_nodes(Graph(nodes, g.edges), by="module")


@query(f"WITH {LINKS}, i AS (SELECT count(*) - count(DISTINCT id) AS n FROM nodes), w AS (SELECT count(*) FILTER (WHERE src = dst) AS loops, count(*) FILTER (WHERE dst NOT IN (SELECT id FROM nodes)) AS loose FROM edges) SELECT n + loose = 0 AS valid, (n + loose)::BIGINT AS errors, loops AS warnings FROM i, w")
def graph_verdict(spark, d):
    return M.graph_verdict(A.link_graph(spark, d))


# answers of a model


def _filled(k, text: str):
    """A document in which <k>, <j> stand for a number and its rest by 7."""
    t = F.replace(F.lit(text), F.lit("<k>"), k.cast("string"))
    return F.replace(t, F.lit("<j>"), (k % 7).cast("string"))


_ANSWERS = (
    '{"layers":[{"name":"L<k>","layer_index":1},{"name":" "},7],"assignments":[{"node_name":"f<k>","layer":"L<k>","confidence":0.9},{"node_name":"f<k>","layer":"L<k>","confidence":0.5},{"node_name":"nobody","layer":"L<k>","confidence":0.8}]}',
    '{"services":[{"name":"Svc <k>","confidence":0.2},{"name":"B<k>"}],"dependencies":[{"from_service":"Svc <k>","to_service":"B<k>","confidence":"0.7"},{"from_service":"B<k>","to_service":"B<k>"},{"from_service":"B<k>","to_service":"Svc <k>","confidence":0.4}]}',
    '{"flows":[{"name":"Flow<k>","steps":[{"function_name":"f<k>","step_index":1},{"function_name":"gone","step_index":2}],"triggers":["Next<k>"]},{"name":"Next<k>","steps":[{},{}]},{"name":"Short","steps":[{}]}]}',
    '{"lineage":[{"function_name":"f<k>","reads":["Table <j>","new<k>"],"writes":["NEW<k> copy"],"confidence":0.8},{"function_name":"f<k>","reads":["x"],"confidence":0.3}],"data_flows":[{"source":"f<k>","target":"table <j>","flow_type":"WRITE","confidence":0.6}]}',
    '{"bounded_contexts":[{"name":"Ctx","confidence":0.45}],"entities":[{"name":"Order<k>","entity_type":"aggregate_root","bounded_context":"Ctx","source_class":"f<k>","confidence":0.9},{"name":"Item<k>","confidence":0.4,"bounded_context":"None"},{"name":"Bad","confidence":0.3}],"relationships":[{"from_entity":"Order<k>","to_entity":"Item<k>","relation_type":"contains"},{"from_entity":"Order<k>","to_entity":"Lost","confidence":0.9}]}',
    '{"relations":[{"from":"fn:<k>","to":"tbl:<j>","type":"uses","confidence":0.7},{"from":"fn:<k>","to":"?","type":"uses","confidence":0.9},{"from":"fn:<k>","to":"tbl:0","type":"x","confidence":0.2}]}',
)


def _answers(spark, d):
    """Answers about ten graphs, of six shapes in turn, every twelfth cut off; and the functions and tables that are known."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    doc = F.element_at(F.array(*[_filled(k, a) for a in _ANSWERS]), (k % 6 + 1).cast("int"))
    graph = F.concat(F.lit("g"), (k % 10).cast("string")).alias("graph")
    answers = p.select(graph, k.alias("answer"), F.when(k % 12 == 11, F.substring(doc, 1, 40)).otherwise(doc).alias("doc"))
    f = p.select(graph, F.concat(F.lit("f"), k.cast("string")).alias("name"), F.concat(F.lit("fn:"), k.cast("string")).alias("id"), F.lit("function").alias("kind"), k.cast("long").alias("seq"))
    j = (k % 7).cast("string")
    t = p.select(graph, F.concat(F.lit("Table "), j).alias("name"), F.concat(F.lit("tbl:"), j).alias("id"), F.lit("data").alias("kind"), (k % 7).cast("long").alias("seq")).distinct()
    return answers, f.unionByName(t)


_SAID = """WITH k AS (SELECT p_partkey AS k, p_partkey % 6 AS shape, p_partkey % 7 AS j, 'g' || p_partkey % 10 AS graph FROM part WHERE p_partkey % 12 <> 11)"""


@query(_SAID + """, n AS (
  SELECT graph, 'layer:l' || k AS id, 'Layer' AS type, 'L' || k AS name FROM k WHERE shape = 0
  UNION ALL SELECT graph, unnest(['service:svc_', 'service:b']) || k, 'Service', unnest(['Svc ', 'B']) || k FROM k WHERE shape = 1
  UNION ALL SELECT graph, unnest(['flow:flow', 'flow:next']) || k, 'Flow', unnest(['Flow', 'Next']) || k FROM k WHERE shape = 2
  UNION ALL SELECT graph, 'data_object:new' || k, 'DataObject', 'new' || k FROM k WHERE shape = 3
  UNION ALL SELECT DISTINCT graph, 'domain_context:ctx', 'DomainEntity', 'Ctx' FROM k WHERE shape = 4
  UNION ALL SELECT graph, unnest(['domain_entity:order', 'domain_entity:item']) || k, 'DomainEntity', unnest(['Order', 'Item']) || k FROM k WHERE shape = 4
), e AS (
  SELECT graph, 'fn:' || k AS src, 'belongs_to' AS type, 'layer:l' || k AS dst FROM k WHERE shape = 0
  UNION ALL SELECT graph, 'service:svc_' || k, 'depends_on', 'service:b' || k FROM k WHERE shape = 1
  UNION ALL SELECT graph, 'flow:flow' || k, unnest(['flow_step', 'triggers']), unnest(['fn:', 'flow:next']) || k FROM k WHERE shape = 2
  UNION ALL SELECT graph, 'fn:' || k, unnest(['reads', 'reads', 'writes', 'writes']), unnest(['tbl:' || j, 'data_object:new' || k, 'data_object:new' || k, 'tbl:' || j]) FROM k WHERE shape = 3
  UNION ALL SELECT graph, 'domain_entity:order' || k, 'part_of', unnest(['domain_context:ctx', 'domain_entity:item' || k]) FROM k WHERE shape = 4
  UNION ALL SELECT graph, 'fn:' || k, 'belongs_to', 'domain_entity:order' || k FROM k WHERE shape = 4
  UNION ALL SELECT graph, 'fn:' || k, 'uses', 'tbl:' || j FROM k WHERE shape = 5 AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 7 = j AND 'g' || p_partkey % 10 = graph)
), u AS (
  SELECT DISTINCT graph, unnest(CASE shape WHEN 0 THEN ['assignments'] WHEN 2 THEN ['flows'] WHEN 4 THEN ['relationships', 'entities'] WHEN 5 THEN ['relations'] END) AS section,
    unnest(CASE shape WHEN 0 THEN ['nobody'] WHEN 2 THEN ['gone'] WHEN 4 THEN ['Lost', 'None'] WHEN 5 THEN ['?'] END) AS name FROM k WHERE shape IN (0, 2, 4, 5)
) SELECT graph, 'node' AS kind, id AS a, type, name AS b FROM n UNION ALL SELECT graph, 'edge', src, type, dst FROM e UNION ALL SELECT graph, 'unknown', '', section, name FROM u""")
def ingest_model_output(spark, d):
    """Nodes, edges and unknown ends of answers of six shapes."""
    got = N.ingest_model_output(*_answers(spark, d))
    n = got.nodes.select("graph", F.lit("node").alias("kind"), F.col("id").alias("a"), "type", F.col("name").alias("b"))
    return n.union(got.edges.select("graph", F.lit("edge"), "src", "type", "dst")).union(got.unknown.select("graph", F.lit("unknown"), F.lit(""), "section", "name"))


_CHECKED = (
    ("architecture", '{"layers":[{"name":"L<k>","layer_index":1},{"name":"M"}],"assignments":[{"node_name":"f","layer":"L<k>","confidence":1},{"node_name":"f","layer":"X<k>","confidence":1},5],"overall_confidence":1.5}'),
    ("architecture", '{"layers":[],"assignments":{},"overall_confidence":0.5}'),
    ("service_detection", '{"services":[{"name":"a","responsibility":"b"}],"dependencies":[{"from_service":"a"}],"overall_confidence":"high"}'),
    ("business_flow", '{"flows":[{"name":"f<k>","steps":[{"step_index":1,"function_name":"x"},{"step_index":2}]},{"name":"g","steps":[{}]},{"steps":7}],"overall_confidence":0.25}'),
    ("data_lineage", '{"lineage":[{"function_name":"f<k>","confidence":1,"reads":["t"]},{"function_name":"g","reads":[]}],"data_flows":[{"source":"a","target":"b"}],"overall_confidence":-2}'),
    ("domain_model", '{"entities":[{"name":"A","entity_type":"entity","bounded_context":"C<k>"},{"name":"B","entity_type":"thing","bounded_context":"D<k>"}],"bounded_contexts":[{"name":"C<k>"},{}],"relationships":[{"from_entity":"A","to_entity":"B"}]}'),
    ("domain_model", '{"entities":[],"overall_confidence":0.75'),
)


@query("""WITH k AS (SELECT p_partkey AS k, p_partkey % 7 AS s FROM part), i AS (
  SELECT k, unnest(['warning', 'warning', 'warning', 'warning']) AS severity, unnest(['layers[1]', 'assignments[2]', 'assignments[1]', 'overall_confidence']) AS place, unnest(['lacks layer_index', 'is no object', 'unknown layer: X' || k, 'is not in 0..1']) AS message FROM k WHERE s = 0
  UNION ALL SELECT k, 'error', 'assignments', 'is no list' FROM k WHERE s = 1
  UNION ALL SELECT k, 'warning', unnest(['dependencies[0]', 'overall_confidence']), unnest(['lacks to_service', 'is no number']) FROM k WHERE s = 2
  UNION ALL SELECT k, 'warning', unnest(['flows[2]', 'flows[1]', 'flows[2]', 'flows.steps[1]']), unnest(['lacks name', 'has fewer than 2 steps', 'steps are no list', 'lacks function_name']) FROM k WHERE s = 3
  UNION ALL SELECT k, 'warning', unnest(['lineage[1]', 'lineage[1]', 'data_flows[0]', 'overall_confidence']), unnest(['lacks confidence', 'says nothing', 'lacks flow_type', 'is not in 0..1']) FROM k WHERE s = 4
  UNION ALL SELECT k, 'warning', unnest(['entities[1]', 'entities[1]', 'bounded_contexts[1]', 'relationships[0]']), unnest(['unknown entity_type: thing', 'unknown bounded_context: D' || k, 'lacks name', 'lacks relation_type']) FROM k WHERE s = 5
  UNION ALL SELECT k, 'error', '', 'is no JSON object' FROM k WHERE s = 6
) SELECT k AS answer, s NOT IN (1, 6) AS valid, [1.0, 0, 0, 0.25, 0, 0, 0][s + 1]::DOUBLE AS confidence, severity, place, message FROM k JOIN i USING (k)""")
def validate_response(spark, d):
    """Answers to the five templates, sound ones in part, with all that is wrong with them."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*values), (k % 7 + 1).cast("int"))
    answers = p.select(k.alias("answer"), pick([F.lit(t) for t, _ in _CHECKED]).alias("template"), pick([_filled(k, doc) for _, doc in _CHECKED]).alias("doc"))
    return N.validate_response(answers).select("answer", "valid", "confidence", F.explode("issues").alias("i")).select("answer", "valid", "confidence", "i.*")


# summaries


def _shops(spark, d):
    """A graph for each region: nations are modules, customers files, suppliers services and API endpoints, parts functions and tables."""
    t = lambda n: table(spark, d, n)
    text = lambda c: F.col(c).cast("string")
    nation = t("nation").select("n_nationkey", "n_name", F.concat(F.lit("g"), text("n_regionkey")).alias("graph"))
    at = lambda df, key: df.join(nation.select(F.col("n_nationkey").alias(key), "graph"), key)
    node = lambda df, kind, type_, key, name, props, base: df.select("graph", F.concat(F.lit(kind), text(key)).alias("id"), F.lit(type_).alias("type"), name.alias("name"), props.alias("props"), (F.col(key).cast("long") + base).alias("seq"))
    fill = lambda pattern, *cols: F.format_string(pattern, *cols)
    region, customers, suppliers = t("region").withColumn("graph", F.concat(F.lit("g"), text("r_regionkey"))), at(t("customer"), "c_nationkey"), at(t("supplier"), "s_nationkey")
    parts = t("part").withColumn("graph", F.concat(F.lit("g"), (F.col("p_partkey") % 5).cast("string")))
    s, k = F.col("s_suppkey"), F.col("p_partkey")
    nodes = [
        node(region, "repo:", "Repository", "r_regionkey", F.col("r_name"), F.when(F.col("r_regionkey") == 0, '{"git_commit":"abcdef0123456789"}').otherwise("{}"), 0),
        node(nation, "mod:", "Module", "n_nationkey", F.col("n_name"), fill('{"path":"src/%s","language":"l%d"}', "n_name", F.col("n_nationkey") % 3), 1000),
        node(customers, "file:", "File", "c_custkey", F.col("c_name"), fill('{"language":"x%d"}', F.col("c_custkey") % 4), 0),
        node(suppliers.where(s % 2 == 0), "sup:", "Service", "s_suppkey", F.col("s_name"), F.when(s % 4 == 0, fill('{"port":%d,"description":"d%d"}', s, s)).otherwise("{}"), 0),
        node(suppliers.where(s % 2 == 1), "sup:", "API", "s_suppkey", F.col("s_name"), fill('{"method":"GET","path":"/s%d","module":"m"%s}', s, F.when(s % 3 == 0, ',"description":"about"').otherwise("")), 0),
        node(parts, "fn:", "Function", "p_partkey", F.concat(F.lit("f"), text("p_partkey")), fill('{"module":"m%d","signature":"a, b"}', k % 7), 0),
        node(parts.where(k % 41 == 0), "tab:", "Table", "p_partkey", F.concat(F.lit("t"), text("p_partkey")), fill('{"database":"DB%d"}', k % 5), 0),
        node(region.where("r_regionkey <> 4"), "db:", "Database", "r_regionkey", F.concat(F.lit("DB"), text("r_regionkey")), F.lit('{"db_type":"x"}'), 0),
        node(nation, "ev:", "Event", "n_nationkey", F.concat(F.lit("ev"), text("n_nationkey")), F.when(F.col("n_nationkey") % 2 == 0, '{"event_type":"t"}').otherwise("{}"), 0),
    ]
    edge = lambda df, a, ak, b, bk, type_: df.select("graph", F.concat(F.lit(a), ak.cast("string")).alias("src"), F.concat(F.lit(b), bk.cast("string")).alias("dst"), F.lit(type_).alias("type"), F.lit("{}").alias("props"), ak.cast("long").alias("seq"))
    c = F.col("c_custkey")
    edges = [
        edge(customers, "mod:", F.col("c_nationkey"), "file:", c, "contains"),
        edge(parts.where((k >= 50) & (k % 50 > 0)), "fn:", k, "fn:", k % 50, "calls"),
        edge(customers.where(c % 10 == 0), "file:", c, "ev:", F.col("c_nationkey"), "publishes"),
        edge(suppliers, "sup:", s, "ev:", F.col("s_nationkey"), "subscribes"),
    ]
    both = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    return both(nodes), both(edges)


@query("""WITH cu AS (SELECT c_custkey AS k, c_name AS name, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey
), su AS (SELECT s_suppkey AS k, s_name AS name, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey
), fn AS (SELECT p_partkey AS k, p_partkey % 5 AS r, p_partkey >= 50 AND p_partkey % 50 > 0 AS calls, p_partkey % 50 AS j FROM part
), deg AS (SELECT k, r, (SELECT count(*) FROM fn f WHERE f.calls AND f.j = fn.k) AS i, calls::INT AS o FROM fn
), cnt AS (
  SELECT r_regionkey AS r, r_name, 1 + 2 * (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM cu WHERE r = r_regionkey) + (SELECT count(*) FROM su WHERE r = r_regionkey)
    + (SELECT count(*) + count(*) FILTER (WHERE k % 41 = 0) FROM fn WHERE r = r_regionkey) + (r_regionkey <> 4)::INT AS n,
    (SELECT count(*) + count(*) FILTER (WHERE k % 10 = 0) FROM cu WHERE r = r_regionkey) + (SELECT count(*) FROM su WHERE r = r_regionkey) + (SELECT count(*) FILTER (WHERE calls) FROM fn WHERE r = r_regionkey) AS e FROM region
), lim AS (SELECT *, CASE WHEN n > 10000 THEN 0.4 WHEN n > 4000 THEN 0.6 WHEN n > 2000 THEN 0.8 ELSE 1.0 END::DOUBLE AS s FROM cnt
), sp AS (SELECT r, string_agg(DISTINCT l, ', ' ORDER BY l) AS said FROM (SELECT r, 'x' || k % 4 AS l FROM cu UNION ALL SELECT n_regionkey, 'l' || n_nationkey % 3 FROM nation) GROUP BY r
), md AS (SELECT n_regionkey AS r, n_nationkey AS n, n_name, (SELECT count(*) FROM cu WHERE cu.n = n_nationkey) AS held FROM nation
), ca AS (
  SELECT f.r, f.k, f.j, row_number() OVER (PARTITION BY f.r, f.j ORDER BY f.k, 'fn:' || f.k) AS place, d.i FROM fn f JOIN deg d ON d.k = f.j WHERE f.calls
), tb AS (SELECT r, 't' || k AS t, k, row_number() OVER (PARTITION BY r ORDER BY k) AS place, count(*) OVER (PARTITION BY r) AS every FROM fn WHERE k % 41 = 0
), pu AS (SELECT n, string_agg(name, ', ' ORDER BY k) AS who FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY k) AS place FROM cu WHERE k % 10 = 0) WHERE place <= 5 GROUP BY n
), sb AS (SELECT n, string_agg(name, ', ' ORDER BY k) AS who FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY k) AS place FROM su) WHERE place <= 5 GROUP BY n
), ev AS (SELECT n_regionkey AS r, n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation
), l AS (
  SELECT r, 0 AS section, 0 AS k, 0 AS sub, '# Repository: ' || r_name AS line FROM cnt
  UNION ALL SELECT r, 0, 1, 0, 'Languages: ' || said || ' | Files: ' || (SELECT count(*) FROM cu WHERE cu.r = cnt.r) || ' | Nodes: ' || n || ' | Edges: ' || e FROM cnt JOIN sp USING (r)
  UNION ALL SELECT r, 0, 2, 0, 'Git commit: abcdef012345' FROM cnt WHERE r = 0
  UNION ALL SELECT r, 1, row_number() OVER (PARTITION BY r ORDER BY n_name), 0, '- ' || n_name FROM md
  UNION ALL SELECT r, 2, row_number() OVER (PARTITION BY r ORDER BY held DESC, n), 0, '- ' || n_name || ' (l' || n % 3 || ') — ' || held || ' nodes, ' || held || ' files | path: src/' || n_name FROM md
  UNION ALL SELECT r, 3, row_number() OVER (PARTITION BY r ORDER BY k), 0, '- ' || name || CASE WHEN k % 4 = 0 THEN ' :' || k || ' — d' || k ELSE '' END FROM su WHERE k % 2 = 0
  UNION ALL SELECT r, 4, row_number() OVER (PARTITION BY r ORDER BY k), 0, '- [GET] /s' || k || ' → ' || name || ' (module: m)' FROM su WHERE k % 2 = 1
  UNION ALL SELECT * FROM (SELECT r, 4, row_number() OVER (PARTITION BY r ORDER BY k) AS p, 1, CASE WHEN k % 3 = 0 THEN '  about' END AS a FROM su WHERE k % 2 = 1) WHERE a IS NOT NULL
  UNION ALL SELECT r, 5, row_number() OVER (PARTITION BY r ORDER BY 2 * i + o DESC, k), 0, '- f' || k || '(a, b) [module: m' || k % 7 || ', in: ' || i || ', out: ' || o || ', pagerank: 0.00000]' FROM deg
  UNION ALL SELECT r, 6, row_number() OVER (PARTITION BY r ORDER BY i DESC, 'fn:' || j, place), 0, '- m' || k % 7 || '.f' || k || ' → m' || j % 7 || '.f' || j FROM ca WHERE place <= 3
  UNION ALL SELECT c.r, 7, 1, 0, '- DB' || c.r || CASE WHEN c.r = 4 THEN ' (unknown)' ELSE ' (x)' END || coalesce(': ' || (SELECT string_agg(t, ', ' ORDER BY k) FROM tb WHERE tb.r = c.r AND place <= 10)
    || CASE WHEN (SELECT max(every) FROM tb WHERE tb.r = c.r) > 10 THEN ' ... (+' || ((SELECT max(every) FROM tb WHERE tb.r = c.r) - 10) || ' more)' ELSE '' END, '') FROM cnt c WHERE c.r <> 4 OR EXISTS (SELECT 1 FROM tb WHERE tb.r = 4)
  UNION ALL SELECT r, 8, k, 0, '- ev' || n || CASE WHEN n % 2 = 0 THEN ' (t)' ELSE '' END FROM ev
  UNION ALL SELECT r, 8, k, 1, '  publishers: ' || who FROM ev JOIN pu USING (n) UNION ALL SELECT r, 8, k, 2, '  subscribers: ' || who FROM ev JOIN sb USING (n)
), top AS (SELECT l.* FROM l JOIN lim USING (r) WHERE section < 2 OR l.k <= greatest(5, floor([20, 15, 30, 40, 60, 20, 20][section - 1] * s + 1e-9))
), heads AS (SELECT DISTINCT r, section, -1 AS k, 0 AS sub, chr(10) || '## ' || ['Directory Structure', 'Modules', 'Services', 'API Endpoints', 'Key Functions (ranked by importance)', 'Call Graph Sample', 'Databases & Tables', 'Events & Topics'][section] AS line FROM top WHERE section > 0
), run AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY r ORDER BY section, k, sub) - 1 AS upto FROM (SELECT * FROM top UNION ALL SELECT * FROM heads)
) SELECT 'g' || r AS graph, string_agg(line, chr(10) ORDER BY section, k, sub) FILTER (WHERE upto // 4 <= 1500) AS text, max(upto)::BIGINT // 4 AS tokens, max(upto) // 4 > 1500 AS truncated FROM run GROUP BY r""")
def repo_summary(spark, d):
    """Summaries of five graphs, at a budget that cuts them."""
    return Z.repo_summary(*_shops(spark, d), budget=1500)


_INFRA = """WITH dk AS (SELECT DISTINCT p_partkey % 20 AS j, p_partkey % 2 = 0 AS redis FROM part WHERE p_partkey % 3 = 0), kb AS (SELECT c_custkey AS c, 'svc' || c_custkey % 40 AS name, CASE WHEN c_custkey % 4 = 0 THEN 'default' ELSE 'ns' || c_custkey % 4 END AS space, c_custkey % 3 AS kind FROM customer
), n AS (
  SELECT 'Component' AS type, 'img' || j AS name, 'reg.io/img' || j || ':1' AS image FROM dk
  UNION SELECT 'Database', 'Redis', NULL FROM dk WHERE redis
  UNION SELECT 'Service', name, NULL FROM kb WHERE kind = 0 UNION SELECT 'Cluster', space, NULL FROM kb WHERE kind = 0 UNION SELECT 'Cluster', name, NULL FROM kb WHERE kind = 1
  UNION SELECT 'Component', 'img' || c % 30, 'shop/img' || c % 30 || ':2' FROM kb WHERE kind = 0 AND c % 2 = 1 AND c % 30 NOT IN (SELECT j FROM dk)
  UNION SELECT 'Database', 'Postgres', 'db/Postgres:15' FROM kb WHERE kind = 0 AND c % 2 = 0 UNION SELECT 'Database', 'MySQL', NULL FROM kb WHERE kind = 0 AND c % 5 = 0
  UNION SELECT unnest(['Cluster', 'Service', 'Database']), unnest(['cluster-', 'svc-', 'd']) || s_suppkey, NULL FROM supplier
), e AS (
  SELECT 'Service::' || name AS src, 'deployed_on' AS type, 'Cluster::' || space AS dst FROM kb WHERE kind = 0
  UNION SELECT 'Service::' || name, 'uses', 'Database::Postgres' FROM kb WHERE kind = 0 AND c % 2 = 0 UNION SELECT 'Service::' || name, 'uses', 'Database::MySQL' FROM kb WHERE kind = 0 AND c % 5 = 0
  UNION SELECT 'Service::svc-' || s_suppkey, 'deployed_on', 'Cluster::cluster-' || s_suppkey FROM supplier
  UNION SELECT 'Service::svc-' || s_suppkey, 'uses', 'Database::d' || s_suppkey % 10 FROM supplier WHERE s_suppkey % 10 IN (SELECT s_suppkey FROM supplier)
) SELECT 'node' AS kind, type || '::' || name AS a, type, coalesce(image, '') AS b FROM n UNION ALL SELECT 'edge', src, type, dst FROM e"""


@query(_INFRA)
def infra_union(spark, d):
    """Infrastructure as Dockerfiles, Kubernetes objects and Terraform tell it, with the image that is said first of a name."""
    from .queries import _terraform

    k, c = F.col("p_partkey"), F.col("c_custkey")
    text = F.concat(F.lit("FROM reg.io/img"), (k % 20).cast("string"), F.lit(":1 AS b\nFROM scratch\n"), F.when(k % 2 == 0, "ENV REDIS_URL x\n").otherwise("ARG PLAIN\n"))
    docker = D.scan_dockerfiles(table(spark, d, "part").where(k % 3 == 0).select(F.concat(F.lit("d"), k.cast("string")).alias("path"), text.alias("content")))
    head = [F.concat(F.lit("k"), c.cast("string")).alias("path"), F.element_at(F.array(F.lit("Deployment"), F.lit("Namespace"), F.lit("ConfigMap")), (c % 3 + 1).cast("int")).alias("kind"), F.concat(F.lit("svc"), (c % 40).cast("string")).alias("name"), F.when(c % 4 > 0, F.concat(F.lit("ns"), (c % 4).cast("string"))).alias("namespace")]
    image = F.when(c % 2 == 0, "db/Postgres:15").otherwise(F.concat(F.lit("shop/img"), (c % 30).cast("string"), F.lit(":2")))
    kubernetes = table(spark, d, "customer").select(*head, image.alias("image"), F.when(c % 5 == 0, "MYSQL_HOST").alias("env"))
    g = P.infra_graph(_terraform(spark, d), docker, kubernetes)
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), "type", F.coalesce(F.get_json_object("props", "$.image"), F.lit("")).alias("b"))
    return n.union(g.edges.select(F.lit("edge"), "src", "type", "dst"))


@query("""WITH cu AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer WHERE c_custkey % 10 = 0
), su AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier
), p AS (SELECT n, string_agg(name, ',' ORDER BY k) AS who FROM cu WHERE place <= 5 GROUP BY n), s AS (SELECT n, string_agg(name, ',' ORDER BY k) AS who FROM su WHERE place <= 5 GROUP BY n)
SELECT 'ev:' || n AS id, 'ev' || n AS event, coalesce(p.who, '') AS publishers, coalesce(s.who, '') AS subscribers FROM p FULL JOIN s USING (n)""")
def event_publishers_and_subscribers(spark, d):
    return X.event_pub_sub(Graph(*_shops(spark, d)))


@query(f"WITH {STAR}, m AS (SELECT id, json_extract_string(props, '$.nation') AS c FROM nodes WHERE type IN ('Component', 'Service')), f AS (SELECT DISTINCT 'customer:' || o_custkey AS src, 'supplier:' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT 'cluster-proxy::cluster::module::' || a.c AS src_cluster, 'cluster-proxy::cluster::module::' || b.c AS dst_cluster, 'uses' AS type, count(*) AS n FROM f JOIN m a ON src = a.id JOIN m b ON dst = b.id WHERE a.c <> b.c GROUP BY a.c, b.c")
def module_quotient(spark, d):
    """What customers of nations use of suppliers of other nations, by nation."""
    g = A.star_graph(spark, d)
    nodes = g.nodes.where("type in ('Component', 'Service')").withColumn("module", F.get_json_object("props", "$.nation"))
    bought = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    edges = bought.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("uses").alias("type"), F.lit("{}").alias("props"), F.lit(0).cast("long").alias("seq")).distinct()
    return X.cluster_quotient(Graph(nodes, edges), by="module")


@query("SELECT 'm' || s_suppkey AS path, CASE WHEN s_suppkey % 4 = 0 THEN 'kafka' ELSE 'eventbus' END AS broker FROM supplier WHERE s_suppkey % 4 < 2")
def detect_broker_by_name(spark, d):
    """A fourth of the files import a broker's library, all of those and another fourth have a class that names a bus."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("m"), k.cast("string")).alias("path")
    s = table(spark, d, "supplier")
    imports = s.select(path, F.when(k % 4 == 0, "kafka.errors").otherwise("os.path").alias("module"), F.lit(1).alias("line"))
    return D.detect_broker(imports, s.select(path, F.when(k % 4 < 2, "MyEventBus").otherwise("Bus").alias("name")))
