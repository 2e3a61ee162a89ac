"""The library's queries over the test tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import Graph, cut, edge_key, node_id, parse_node_id, shared_dir
from ..operators import derive as D
from ..operators import components as C
from ..operators import cycles as K
from ..operators import merge as M
from ..operators import metrics as X
from ..operators import names as N
from ..operators import services as P
from ..operators import symbols as Y
from ..operators import traverse as T
from ..operators import vectors as V
from ..operators import views as W
from ..sources import files as FS
from ..streaming import upkeep as U
from . import adapters as A
from .adapters import CODE, CONV, EVENTS, FILES, LINKS, STAR, TRADE, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _both(g: Graph):
    """Nodes and edges of a result in one table."""
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type"), F.col("name").alias("b"))
    return n.union(g.edges.select(F.lit("edge"), "src", "type", "dst"))


_BOTH = " SELECT 'node' AS kind, id AS a, type, name AS b FROM n UNION ALL SELECT 'edge', src, type, dst FROM e"
_IN = "src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)"
star, trade, events = A.star_graph, A.trade_graph, A.event_graph_t


# views


@query(f"WITH {STAR} SELECT * FROM nodes WHERE type = 'Table' AND contains(lower(name), 'a') ORDER BY seq, id LIMIT 50")
def query_nodes(spark, d):
    return W.query_nodes(star(spark, d), node_type="Table", name_contains="A")


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type = 'Component' ORDER BY seq, id LIMIT 200), e AS (SELECT * FROM edges ORDER BY seq, src, dst, type LIMIT 200){_BOTH}")
def get_graph(spark, d):
    return _both(W.get_graph(star(spark, d), node_type="Component"))


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type IN ('Repository', 'Module')), e AS (SELECT * FROM edges WHERE {_IN}){_BOTH}")
def graph_summary(spark, d):
    return _both(W.graph_summary(star(spark, d)))


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type IN ('Service', 'Table')), e AS (SELECT * FROM edges WHERE {_IN}){_BOTH}")
def induced_subgraph(spark, d):
    g = star(spark, d)
    return _both(W.induced_subgraph(g, g.nodes.where(F.col("type").isin("Service", "Table"))))


@query(f"WITH {EVENTS}, n AS (SELECT * FROM nodes WHERE type IN ('Function', 'API')), e AS (SELECT * FROM edges WHERE type = 'calls'){_BOTH}")
def callgraph_view(spark, d):
    return _both(W.callgraph_view(events(spark, d)))


@query(f"WITH {STAR}, e AS MATERIALIZED (SELECT src, type, dst FROM edges WHERE type IN ('depends_on', 'reads', 'writes', 'produces', 'consumes')), t AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS MATERIALIZED (SELECT id, type, name FROM nodes WHERE id IN (SELECT id FROM t)){_BOTH}")
def lineage_view(spark, d):
    return _both(W.lineage_view(star(spark, d)))


@query(f"WITH {EVENTS}, e AS (SELECT * FROM edges WHERE type IN ('publishes', 'routes_to', 'consumes', 'produces', 'subscribes')), n AS (SELECT * FROM nodes WHERE type IN ('Event', 'Topic', 'Component') AND id IN (SELECT src FROM e UNION SELECT dst FROM e)){_BOTH}")
def events_view(spark, d):
    return _both(W.events_view(events(spark, d)))


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type IN ('Service', 'Cluster', 'Database')), e AS (SELECT * FROM edges WHERE {_IN} AND type IN ('deployed_on', 'uses', 'depends_on')){_BOTH}")
def services_view(spark, d):
    return _both(W.services_view(star(spark, d)))


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type IN ('Repository', 'Module', 'File', 'Class', 'Component')), e AS (SELECT * FROM edges WHERE {_IN}){_BOTH}")
def lod_filter(spark, d):
    return _both(W.lod_filter(star(spark, d), "class"))


@query(f"WITH {STAR} SELECT * FROM nodes WHERE contains(lower(name), 'er') OR contains(lower(id), 'er') OR contains(lower(type), 'er') ORDER BY seq, id LIMIT 50")
def search_nodes(spark, d):
    return W.search_nodes(star(spark, d), "er")


@query(f"WITH {STAR}, s AS (SELECT *, round(least(levenshtein(lower(name), 'customer#00012') / greatest(length(name), 14, 1), levenshtein(lower(id), 'customer#00012') / greatest(length(id), 14, 1)), 6) AS score FROM nodes) SELECT * FROM s WHERE score <= 0.3 ORDER BY score, id LIMIT 10")
def fuzzy_search(spark, d):
    return W.fuzzy_search(star(spark, d), "Customer#00012")


_DEG = """, pr AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
deg AS (SELECT id, (SELECT count(*) FROM pr WHERE pr.dst = n.id) AS in_degree, (SELECT count(*) FROM pr WHERE pr.src = n.id) AS out_degree FROM nodes n)"""


@query(f"WITH {STAR}{_DEG} SELECT nodes.*, in_degree + out_degree AS degree FROM nodes JOIN deg USING (id) WHERE in_degree + out_degree BETWEEN 3 AND 40")
def filter_degree(spark, d):
    g = star(spark, d)
    return W.filter_degree(g, X.degree(g), least=3, most=40, isolated=False)


@query(f"WITH {STAR} SELECT DISTINCT 'node' AS kind, type FROM nodes UNION ALL SELECT DISTINCT 'edge', type FROM edges")
def type_lists(spark, d):
    g = star(spark, d)
    return W.node_types(g).select(F.lit("node").alias("kind"), "type").union(W.edge_types(g).select(F.lit("edge"), "type"))


@query(f"WITH {STAR}, x AS (SELECT 'out' AS direction, type AS edge_type, dst AS peer, seq FROM edges WHERE src = 'nation:3' UNION ALL SELECT 'in', type, src, seq FROM edges WHERE dst = 'nation:3'), k AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY seq, peer, edge_type) AS k FROM x) SELECT direction, edge_type, peer, coalesce(type, 'Unknown') AS peer_type FROM k LEFT JOIN nodes ON peer = id WHERE k <= 20")
def node_detail(spark, d):
    return W.node_detail(star(spark, d), "nation:3")


@query(f"WITH {STAR} SELECT *, true AS has_more FROM nodes ORDER BY seq, id LIMIT 40 OFFSET 20")
def page_nodes(spark, d):
    return W.page_nodes(star(spark, d), 20, 40)


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE type NOT IN ('Event', 'Table')), e AS (SELECT * FROM edges WHERE {_IN}){_BOTH}")
def visible_filter(spark, d):
    return _both(W.visible_filter(star(spark, d), ["Event", "Table"]))


@query(f"WITH {STAR}, n AS (SELECT * FROM nodes WHERE id <> 'nation:3'), e AS (SELECT * FROM edges WHERE src <> 'nation:3' AND dst <> 'nation:3'){_BOTH}")
def remove_node(spark, d):
    return _both(W.remove_node(star(spark, d), "nation:3"))


@query(f"WITH {STAR} SELECT n.*, false AS has_more FROM nodes n WHERE id IN (SELECT dst FROM edges WHERE type = 'contains' AND src = 'region:1')")
def expand_node(spark, d):
    return W.expand_node(star(spark, d), "region:1")


# metrics


@query(f"WITH {STAR} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL")
def type_counts(spark, d):
    return X.type_counts(star(spark, d))


@query(f"WITH {STAR}, b AS (SELECT 'star' AS graph_id, 'node' AS kind, type FROM nodes UNION ALL SELECT 'star', 'edge', type FROM edges) SELECT graph_id, kind, type, count(*) AS n FROM b GROUP BY ROLLUP (graph_id, kind, type) HAVING kind IS NOT NULL")
def graph_stats(spark, d):
    g = star(spark, d)
    return X.graph_stats(g.nodes.withColumn("graph_id", F.lit("star")), g.edges.withColumn("graph_id", F.lit("star")))


@query(f"WITH {STAR}{_DEG} SELECT * FROM deg")
def degree(spark, d):
    return X.degree(star(spark, d))


@query(f"WITH {LINKS} SELECT id, (SELECT count(*) FROM edges WHERE dst = n.id) AS in_degree, (SELECT count(*) FROM edges WHERE src = n.id) AS out_degree FROM (SELECT DISTINCT id FROM nodes) n")
def degree_raw(spark, d):
    return X.degree_raw(A.link_graph(spark, d))


def _pagerank_sql(steps: int) -> str:
    out = "n AS (SELECT count(*)::DOUBLE AS n FROM nodes), p AS (SELECT DISTINCT src, dst FROM edges), o AS (SELECT src, count(*) AS o FROM p GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, n)"
    for i in range(1, steps + 1):
        out += f""", r{i} AS (SELECT id, 0.85 * (coalesce((SELECT sum(r / o) FROM p JOIN o USING (src) JOIN r{i - 1} q ON q.id = p.src WHERE p.dst = x.id), 0)
          + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)) / (SELECT n FROM n)) + 0.15 / (SELECT n FROM n) AS r FROM r{i - 1} x)"""
    return out + f" SELECT id, round(r, 6) AS pagerank FROM r{steps}"


@query(f"WITH {TRADE}, {_pagerank_sql(5)}")
def pagerank(spark, d):
    return X.pagerank(trade(spark, d), iterations=5)


def _metrics(g: Graph, steps: int = 5):
    return X.metrics(g, iterations=steps)


@query(f"WITH {STAR}{_DEG}, {_pagerank_sql(5).replace(' SELECT id, round(r, 6) AS pagerank FROM r5', '')} SELECT id, name, round(round(r, 6) * 1000 + in_degree * 2 + out_degree, 6) AS score FROM nodes JOIN deg USING (id) JOIN r5 USING (id) WHERE type IN ('Service', 'Table') ORDER BY score DESC, seq, id LIMIT 40")
def rank_functions(spark, d):
    g = star(spark, d)
    return X.rank_functions(g, _metrics(g), types=("Service", "Table"))


@query(f"WITH {EVENTS}{_DEG}, {_pagerank_sql(3).replace(' SELECT id, round(r, 6) AS pagerank FROM r3', '')}, k AS (SELECT src, dst, round(round(r, 6) * 1000 + in_degree, 6) AS score, row_number() OVER (PARTITION BY dst ORDER BY seq, src) AS k FROM edges JOIN deg ON deg.id = dst JOIN r3 ON r3.id = dst WHERE type = 'calls') SELECT src, dst, score, k FROM k WHERE k <= 3 ORDER BY score DESC, dst, k LIMIT 60")
def sample_calls(spark, d):
    g = events(spark, d)
    return X.sample_calls(g, _metrics(g, 3))


@query(f"WITH {STAR} SELECT id, name, (SELECT count(*) FROM edges e WHERE e.type = 'contains' AND src = n.id) AS children FROM nodes n WHERE type = 'Module' ORDER BY children DESC, seq, id LIMIT 20")
def rank_modules(spark, d):
    return X.rank_modules(star(spark, d))


@query(f"WITH {STAR}, s AS (SELECT CASE WHEN count(*) > 10000 THEN 0.4 WHEN count(*) > 4000 THEN 0.6 WHEN count(*) > 2000 THEN 0.8 ELSE 1.0 END AS s FROM nodes), b AS (SELECT unnest(['modules', 'services', 'apis', 'functions', 'call_samples', 'databases', 'events']) AS section, unnest([20, 15, 30, 40, 60, 20, 20]) AS n) SELECT section, greatest(5, floor(n * s))::BIGINT AS n_rows FROM b, s")
def adaptive_limits(spark, d):
    return X.adaptive_limits(star(spark, d).nodes)


@query(f"WITH {STAR}, t AS (SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, type) AS rank FROM t QUALIFY rank <= 8")
def top_types(spark, d):
    return X.top_types(star(spark, d))


@query(f"WITH {STAR} SELECT 'cluster::type::' || type AS cluster_id, type AS key, count(*) AS members, type AS dominant_type, count(*) > 50 AS collapsed FROM nodes GROUP BY type")
def cluster_nodes(spark, d):
    return X.cluster_nodes(star(spark, d))


@query(f"WITH {STAR} SELECT 'cluster-proxy::cluster::type::' || a.type AS src_cluster, 'cluster-proxy::cluster::type::' || b.type AS dst_cluster, e.type, count(*) AS n FROM edges e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.type <> b.type GROUP BY ALL")
def cluster_quotient(spark, d):
    return X.cluster_quotient(star(spark, d))


@query(f"WITH {EVENTS}, k AS (SELECT dst, n.name AS event, s.name AS who, row_number() OVER (PARTITION BY dst ORDER BY e.seq, src) AS k FROM edges e JOIN nodes n ON dst = n.id JOIN nodes s ON src = s.id WHERE e.type = 'publishes') SELECT dst AS id, event, string_agg(who, ',' ORDER BY k) AS publishers, '' AS subscribers FROM k WHERE k <= 5 GROUP BY ALL")
def event_pub_sub(spark, d):
    return X.event_pub_sub(events(spark, d))


# walks

_WALK = ", w(id, depth) AS (SELECT '{s}', 0 UNION SELECT b.dst, depth + 1 FROM w JOIN (SELECT src, dst FROM edges {w} UNION SELECT dst, src FROM edges {w}) b ON b.src = w.id WHERE depth < {k}), found AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"


@query("WITH RECURSIVE " + STAR + _WALK.format(s="nation:3", k=2, w="") + ", n AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM found)), e AS (SELECT * FROM edges WHERE " + _IN + ")" + _BOTH)
def neighbors(spark, d):
    return _both(T.neighbors(star(spark, d), _seed(spark, "nation:3"), depth=2)[0])


@query("WITH RECURSIVE " + STAR + _WALK.format(s="part:7", k=2, w="WHERE type IN ('depends_on', 'produces')") + " SELECT id, depth FROM found")
def lineage_bfs(spark, d):
    return T.lineage_bfs(star(spark, d), _seed(spark, "part:7"))[1]


@query("WITH RECURSIVE " + EVENTS + _WALK.format(s="type:click", k=2, w="WHERE type = 'calls'") + " SELECT id, depth FROM found")
def callgraph_bfs(spark, d):
    return T.callgraph_bfs(events(spark, d), _seed(spark, "type:click"))[1]


@query("WITH RECURSIVE " + TRADE + ", w(id, depth) AS (SELECT unnest(['nation:1', 'nation:2']), 0 UNION SELECT b.dst, depth + 1 FROM w JOIN (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) b ON b.src = w.id WHERE depth < 1) SELECT id, min(depth) AS depth FROM w GROUP BY id")
def subgraph_multi(spark, d):
    return T.neighbors(trade(spark, d), _seed(spark, "nation:1", "nation:2"), depth=1)[1]


@query("WITH " + TRADE + ", s AS (SELECT unnest(['nation:1', 'nation:2', 'nation:3']) AS seed), b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), own AS (SELECT seed, seed AS id FROM s UNION SELECT seed, dst FROM s JOIN b ON src = seed), n AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM own)), e AS (SELECT * FROM edges x WHERE EXISTS (SELECT 1 FROM own a JOIN own c ON a.seed = c.seed WHERE a.id = x.src AND c.id = x.dst))" + _BOTH)
def graph_expand(spark, d):
    return _both(T.graph_expand(trade(spark, d), _seed(spark, "nation:1", "nation:2", "nation:3")))


_IMPACT = ", w(id, depth, path) AS (SELECT s, 0, [s] FROM (SELECT unnest({s}) AS s) UNION ALL SELECT {b}, depth + 1, list_append(path, {b}) FROM w JOIN edges ON {a} = w.id WHERE depth < {k} AND NOT list_contains(path, {b})), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, path) AS q FROM w) SELECT id, depth, array_to_string(path, '>') AS path FROM r WHERE q = 1 AND depth > 0"


@query("WITH RECURSIVE " + TRADE + _IMPACT.format(a="src", b="dst", k=5, s=["nation:0"]))
def impact(spark, d):
    return T.impact(trade(spark, d), _seed(spark, "nation:0")).withColumn("path", F.array_join("path", ">"))


@query("WITH RECURSIVE " + TRADE + _IMPACT.format(a="dst", b="src", k=2, s=["nation:0", "nation:8", "nation:9", "nation:23"]))
def impact_upstream(spark, d):
    return T.impact(trade(spark, d), _seed(spark, "nation:0", "nation:8", "nation:9", "nation:23"), max_depth=2, direction="up").withColumn("path", F.array_join("path", ">"))


@query(f"WITH {STAR}, r AS (SELECT dst AS id, 1 AS depth FROM edges WHERE src = 'region:1' UNION SELECT b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'region:1' UNION SELECT c.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.src = 'region:1'), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), t AS (SELECT m.*, type FROM m JOIN nodes USING (id)) SELECT type, depth, count(*) AS n, max(depth) AS max_depth FROM t GROUP BY GROUPING SETS ((type), (depth), ())")
def impact_stats(spark, d):
    g = star(spark, d)
    return T.impact_stats(g, T.impact(g, _seed(spark, "region:1"), max_depth=3))


@query("WITH RECURSIVE " + TRADE + ", c(start, tip, path) AS (SELECT src, dst, [src, dst] FROM edges WHERE dst > src UNION ALL SELECT start, dst, list_append(path, dst) FROM c JOIN edges ON src = tip WHERE tip <> start AND (dst = start OR (dst > start AND NOT list_contains(path, dst)))) SELECT len(path) - 1 AS length, array_to_string(list_slice(path, 1, len(path) - 1), '>') AS path FROM c WHERE tip = start")
def detect_cycles(spark, d):
    return K.detect_cycles(trade(spark, d)).withColumn("path", F.array_join("path", ">"))


@query("WITH RECURSIVE " + EVENTS + ", s AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'calls' AND src <> dst), reach AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM reach r JOIN s ON r.dst = s.src), ring AS (SELECT src AS id FROM reach WHERE src = dst) SELECT DISTINCT s.src AS id FROM s WHERE s.src IN (SELECT id FROM ring) OR (s.src IN (SELECT r.dst FROM reach r JOIN ring ON r.src = ring.id) AND s.src IN (SELECT r.src FROM reach r JOIN ring ON r.dst = ring.id))")
def cyclic_core(spark, d):
    return K.cyclic_core(events(spark, d), edge_types=("calls",))


@query(f"WITH {STAR} SELECT id, CASE type WHEN 'Repository' THEN 0 WHEN 'Module' THEN CASE WHEN EXISTS (SELECT 1 FROM edges WHERE dst = n.id) THEN 1 ELSE 0 END END AS layer FROM nodes n WHERE type IN ('Repository', 'Module')")
def layering(spark, d):
    return K.layering(W.graph_summary(star(spark, d)))


@query(f"WITH {CONV} SELECT id, (row_number() OVER (PARTITION BY split_part(id, '.', 1) ORDER BY seq) - 1)::INT AS layer FROM nodes")
def layering_turns(spark, d):
    return K.layering(A.conv_flow(spark, d))


# merge and validation


@query(f"WITH {STAR}, m AS (SELECT id, type, upper(name) AS name, props, seq FROM nodes WHERE type = 'Module') SELECT id, type, name, props, seq FROM nodes WHERE type <> 'Module' UNION ALL SELECT * FROM m")
def merge_graphs(spark, d):
    g = star(spark, d)
    late = Graph(g.nodes.where("type = 'Module'").withColumn("name", F.upper("name")), g.edges.where("type = 'contains'"))
    return M.merge_graphs([g, late]).nodes


@query(f"WITH {LINKS} SELECT src, dst, type, any_value(props) AS props, min(seq) AS seq FROM edges GROUP BY src, dst, type")
def dedupe_edges(spark, d):
    return M.dedupe_edges(A.link_graph(spark, d).edges)


@query(f"WITH {LINKS} SELECT id, type, name, props, max(seq) AS seq FROM nodes GROUP BY ALL")
def dedupe_nodes(spark, d):
    return M.dedupe_nodes(A.link_graph(spark, d).nodes)


@query(f"WITH {STAR} SELECT id, type, CASE WHEN type = 'Service' THEN name || ' v2' ELSE name END AS name, props, seq FROM nodes")
def upsert_nodes(spark, d):
    n = star(spark, d).nodes
    return M.upsert_nodes(n, n.where("type = 'Service'").withColumn("name", F.concat("name", F.lit(" v2"))))


@query(f"WITH {STAR} SELECT src, dst, type, CASE WHEN type = 'contains' THEN '{{\"v\":2}}' ELSE props END AS props, seq FROM edges")
def upsert_edges(spark, d):
    g = star(spark, d)
    new = g.edges.where("type = 'contains'").withColumn("props", F.lit('{"v":2}'))
    lost = new.withColumn("src", F.lit("nowhere:1"))
    return M.upsert_edges(g.edges, new.union(lost), g.nodes)


@query(f"WITH {LINKS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM nodes) SELECT 'node:' || id AS location, 'duplicate id' AS message, 'error' AS severity FROM k WHERE k > 1 UNION ALL SELECT 'edge|' || src || '|imports|' || dst, 'dangling target', 'error' FROM edges WHERE dst NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'edge|' || src || '|imports|' || dst, 'self-loop', 'warning' FROM edges WHERE src = dst")
def validate_graph(spark, d):
    return M.validate_graph(A.link_graph(spark, d))


# files


@query("WITH " + FILES + " SELECT path, language, strlen(content)::BIGINT AS size_bytes, len(string_split(content, chr(10)))::BIGINT AS line_count, sha256(content) AS sha256 FROM files")
def scan_files(spark, d):
    return FS.scan_files(A.doc_files(spark, d), known=A.DOC_LANGUAGES)


def _scanned(spark, d):
    return FS.scan_files(A.doc_files(spark, d), known=A.DOC_LANGUAGES)


@query("WITH " + FILES + " SELECT language, count(*) AS n_files FROM files GROUP BY language")
def language_stats(spark, d):
    return FS.language_stats(_scanned(spark, d))


@query("WITH " + FILES + " SELECT language FROM files GROUP BY language ORDER BY count(*) DESC, min(path) LIMIT 1")
def primary_language(spark, d):
    return FS.primary_language(_scanned(spark, d))


@query("WITH " + FILES + ", l AS (SELECT source, language, count(*) AS n, min(path) AS f FROM files GROUP BY ALL) SELECT source AS path, source AS name, 1 AS depth, sum(n)::BIGINT AS file_count, arg_min(language, (-n, f)) AS primary_language FROM l GROUP BY source")
def module_group(spark, d):
    return FS.module_group(_scanned(spark, d))


@query("SELECT DISTINCT source AS path, 1 AS depth FROM documents")
def collect_directories(spark, d):
    return FS.collect_directories(A.doc_files(spark, d))


@query("WITH " + FILES + " SELECT path FROM files WHERE source = 'src0' ORDER BY path LIMIT 50")
def scan_directory(spark, d):
    return FS.scan_directory(A.doc_files(spark, d), "src0").select("path")


@query("WITH " + FILES + " SELECT path, 'changed' AS what FROM files WHERE doc_id % 2 = 1 UNION ALL SELECT 'gone/' || doc_id, 'deleted' FROM files WHERE doc_id % 10 = 0")
def incremental_scan(spark, d):
    f = _scanned(spark, d).join(A.doc_files(spark, d).select("path", "doc_id"), "path")
    old = FS.build_state(f.where("doc_id % 2 = 0")).union(f.where("doc_id % 10 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")), "sha256"))
    changed, gone = FS.incremental_scan(f.drop("doc_id"), old)
    return changed.select("path", F.lit("changed").alias("what")).union(gone.select("path", F.lit("deleted")))


@query("SELECT 'c' || c_custkey AS repo, c_custkey % 3 <> 0 AS updated, CASE c_custkey % 3 WHEN 0 THEN 'no_change' WHEN 1 THEN 'git_sha_changed' ELSE 'no_prior_graph' END AS reason FROM customer")
def change_decision(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo"), F.col("c_custkey").alias("k"))
    state = c.select("repo", F.col("k").cast("string").alias("sha"), F.lit(None).cast("timestamp").alias("mtime"))
    known = c.where("k % 3 <> 2").select("repo", F.when(F.col("k") % 3 == 0, F.col("k")).otherwise(F.col("k") + 1).cast("string").alias("sha"), F.lit(None).cast("timestamp").alias("created_at"))
    return FS.change_decision(state, known)


@query("SELECT 'c' || o_custkey AS repo, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' GROUP BY o_custkey")
def commits_since(spark, d):
    commits = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo"), F.col("o_orderdate").alias("ts"))
    return FS.commits_since(commits, commits.select("repo").distinct().withColumn("ts", F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))))


@query("WITH " + FILES + " SELECT path, 1 AS start_line, len(string_split(content, chr(10)))::INT AS end_line, content AS code FROM files")
def chunk_file(spark, d):
    return FS.chunk_file(A.doc_files(spark, d))


@query("WITH " + FILES + ", l AS (SELECT path, string_split(content, chr(10)) AS l FROM files), s AS (SELECT path, l, unnest(range(0, len(l), 10)) AS a FROM l) SELECT path, (a + 1)::INT AS start_line, least(a + 10, len(l))::INT AS end_line, array_to_string(l[a + 1 : a + 10], chr(10)) AS code FROM s")
def chunk_lines(spark, d):
    return FS.chunk_lines(A.doc_files(spark, d), 10)


@query("WITH RECURSIVE " + FILES + ", l AS (SELECT path, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT path, string_split(coalesce(content, ''), chr(10)) AS s FROM files)), w(path, i, start, n, size) AS (SELECT path, 1::BIGINT, 1::BIGINT, 1, strlen(line) + 1 FROM l WHERE i = 1 UNION ALL SELECT l.path, l.i, CASE WHEN w.size >= 2000 OR w.n >= 20 THEN l.i ELSE w.start END, CASE WHEN w.size >= 2000 OR w.n >= 20 THEN 1 ELSE w.n + 1 END, CASE WHEN w.size >= 2000 OR w.n >= 20 THEN 0 ELSE w.size END + strlen(line) + 1 FROM w JOIN l ON l.path = w.path AND l.i = w.i + 1) SELECT path, start::INT AS start_line, max(i)::INT AS end_line, string_agg(line, chr(10) ORDER BY i) AS code FROM w JOIN l USING (path, i) GROUP BY path, start")
def chunk_stream(spark, d):
    return FS.chunk_stream(A.doc_files(spark, d), max_bytes=2000, max_lines=20)


@query("WITH " + FILES + " SELECT source AS path, arg_min(path, path) AS first FROM files GROUP BY source")
def detect_module_roots(spark, d):
    f = A.doc_files(spark, d)
    first = f.groupBy(S.parent_path(F.col("path")).alias("dir")).agg(F.min("path").alias("first"))
    marked = f.select("path").union(first.select(F.concat("dir", F.lit("/go.mod"))))
    return FS.detect_module_roots(marked).join(first, F.col("dir") == F.col("path")).select("path", "first")


# derivation


@query("WITH " + CODE + " SELECT 'pkg' || s_suppkey % 10 || '/mod' || s_suppkey || '/main.py' AS path, 'class' AS kind, 'Supplier' || s_suppkey || 'Service' AS name FROM supplier UNION ALL SELECT 'pkg' || k % 10 || '/mod' || k || '/main.py', 'import', 'pkg' || o % 10 || '.mod' || o FROM near")
def extract_symbols(spark, d):
    return Y.extract_symbols(A.code_corpus(spark, d)).select("path", "kind", "name")


_MOD = "'pkg' || {0} % 10 || '/mod' || {0}"


@query("WITH " + CODE + f" SELECT {_MOD.format('k')} AS src, {_MOD.format('o')} AS dst FROM near")
def module_deps(spark, d):
    code = A.code_corpus(spark, d)
    s = Y.extract_symbols(code).where("kind = 'import'").select("path", "language", F.col("name").alias("module"))
    return Y.module_deps(s, code.select(S.parent_path(F.col("path")).alias("path")))


@query("WITH " + CODE + " SELECT 'Supplier' || k || 'Service.run_' || k AS owner, 'run_' || o AS name, 'supplier_' || o AS receiver FROM near")
def extract_members(spark, d):
    return Y.extract_members(A.code_corpus(spark, d)).where("kind = 'call'").select("owner", "name", "receiver")


@query("WITH " + CODE + " SELECT 'run_' || k AS src, 'run_' || o AS dst FROM near")
def resolve_calls(spark, d):
    m = cut(Y.extract_members(A.code_corpus(spark, d)), "members")  # parsed once, read for functions and for calls
    f = m.where("kind = 'function'").select(F.concat_ws(".", "owner", "name").alias("id"), "name", "owner", F.xxhash64("owner").alias("seq"))
    r = Y.resolve_calls(m.where("kind = 'call'").select(F.col("owner").alias("caller"), "receiver", F.col("name").alias("callee")), f)
    return r.select(F.element_at(F.split("src", r"\."), -1).alias("src"), F.element_at(F.split("dst", r"\."), -1).alias("dst"))


@query("WITH " + CODE + " SELECT 'Supplier' || s_suppkey || 'Service' AS name, 'service' AS component_type FROM supplier")
def detect_components(spark, d):
    m = Y.extract_members(A.code_corpus(spark, d))
    n = m.where("kind = 'function'").groupBy(F.col("owner").alias("name")).agg(F.count("*").alias("method_count"))
    return D.detect_components(n).select("name", "component_type")


@query("SELECT 'supplier:' || s_suppkey AS src, 'nation:' || CASE WHEN s_suppkey % 3 = 1 THEN s_nationkey ELSE least(s_nationkey, (s_nationkey + 1) % 25) END AS dst FROM supplier WHERE s_suppkey % 3 > 0")
def type_annotation_match(spark, d):
    """A third of the annotations hold a name in a longer word only, a third name two nations, of which the first one known counts."""
    k, one, two = F.col("s_suppkey") % 3, F.col("s_nationkey").cast("string"), ((F.col("s_nationkey") + 1) % 25).cast("string")
    said = F.when(k == 0, F.concat(F.lit("N"), one, F.lit("x[N]"))).when(k == 1, F.concat(F.lit("Optional[N"), one, F.lit("]"))).otherwise(F.concat(F.lit("N"), one, F.lit(" | dict[str, N"), two, F.lit("]")))
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"), said.alias("annotation"))
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("seq"))
    return Y.type_annotation_match(s, n)


@query("WITH f AS (SELECT 'f' || c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN 'zz' ELSE lower(n_name) || 's_list' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'reads' WHEN 1 THEN 'writes' END AS type FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2), hit AS (SELECT f.id AS src, 'nation:' || n_nationkey AS dst, type FROM f JOIN nation ON contains(f.name, lower(n_name))) SELECT * FROM hit UNION ALL SELECT id, 'nation:' || k, type FROM f, (SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 2) WHERE id NOT IN (SELECT src FROM hit)")
def heuristic_lineage(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    verb = F.element_at(F.array(F.lit("get"), F.lit("save"), F.lit("count")), (F.col("c_custkey") % 3 + 1).cast("int"))
    name = F.when(F.col("c_custkey") % 10 == 9, "zz").otherwise(F.concat(F.lower("n_name"), F.lit("s_list")))
    f = c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("id"), F.concat_ws("_", verb, name).alias("name"))
    return D.heuristic_lineage(f, n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("seq")))


@query("WITH x AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' ' || n_name WHEN 1 THEN substr(n_name, 2, 4) WHEN 2 THEN lower(n_name) || ' table' ELSE 'zz ' || s_suppkey END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT DISTINCT name, lower(trim(name)) AS key FROM x), m AS (SELECT name, min(n_nationkey) FILTER (WHERE lower(n_name) = key) AS equal, min(n_nationkey) FILTER (WHERE contains(lower(n_name), key) OR contains(key, lower(n_name))) AS near FROM k, nation GROUP BY name), r AS (SELECT name, key, coalesce(equal, near) AS n FROM m JOIN k USING (name)), o AS (SELECT r.name, min(f.key) AS first FROM r JOIN r f ON f.n IS NULL AND starts_with(r.key, f.key) WHERE r.n IS NULL GROUP BY r.name) SELECT r.name, coalesce('nation:' || n, 'data_object:' || replace(first, ' ', '_')) AS id, n IS NULL AND first = key AS minted FROM r LEFT JOIN o USING (name)")
def partial_name_resolve(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.col("s_suppkey") % 4
    name = F.when(kind == 0, F.concat(F.lit(" "), "n_name")).when(kind == 1, F.substring("n_name", 2, 4)).when(kind == 2, F.concat(F.lower("n_name"), F.lit(" table"))).otherwise(F.concat(F.lit("zz "), F.col("s_suppkey").cast("string")))
    return N.partial_name_resolve(s.select(name.alias("name"), F.col("s_suppkey").alias("seq")), n.select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("seq")))


_CLASS = "CASE p_partkey % 5 WHEN 0 THEN 'PartController' WHEN 1 THEN 'PartService' WHEN 2 THEN 'PartRepo' WHEN 3 THEN 'PartEntity' ELSE 'Part' END || CASE WHEN p_partkey % 7 = 0 THEN 'Event' ELSE '' END"


def _classes(spark, d):
    base = F.element_at(F.array(*map(F.lit, ("PartController", "PartService", "PartRepo", "PartEntity", "Part"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(base, F.when(F.col("p_partkey") % 7 == 0, "Event").otherwise("")).alias("name"), F.col("p_partkey").alias("seq"))


@query("SELECT 'part:' || p_partkey AS src, 'Layer::' || CASE p_partkey % 5 WHEN 0 THEN 'PresentationLayer' WHEN 1 THEN 'BusinessLayer' WHEN 2 THEN 'DataLayer' WHEN 3 THEN 'DomainLayer' END AS dst FROM part WHERE p_partkey % 5 < 4")
def infer_layers(spark, d):
    return D.infer_layers(_classes(spark, d)).edges.select("src", "dst")


@query(f"WITH c AS (SELECT p_partkey, lower({_CLASS}) AS n FROM part) SELECT 'part:' || p_partkey AS id, CASE WHEN regexp_matches(n, '(repo|controller)$') THEN NULL WHEN contains(n, 'vo') THEN 'value_object' WHEN regexp_matches(n, 'event$') THEN 'domain_event' WHEN regexp_matches(n, 'service$') THEN 'domain_service' ELSE 'entity' END AS kind FROM c")
def infer_domain_entities(spark, d):
    return _classes(spark, d).select("id", D.infer_entity_type(F.col("name")).alias("kind"))


@query(f"SELECT 'part:' || p_partkey AS id, CASE WHEN regexp_matches({_CLASS}, 'Controller$') THEN 'api' WHEN regexp_matches({_CLASS}, 'Service$') THEN 'service' ELSE 'component' END AS role FROM part")
def classify_roles(spark, d):
    return _classes(spark, d).select("id", D.classify_role(F.col("name")).alias("role"))


@query(f"SELECT {_CLASS} AS d, count(*) AS n FROM part GROUP BY ALL")
def domain_group(spark, d):
    c = _classes(spark, d)
    return D.domain_group(c, F.col("name")).nodes.select(F.col("name").alias("d"), F.get_json_object("props", "$.member_count").cast("long").alias("n"))


@query(f"WITH {EVENTS}, a AS (SELECT id, upper(name[1]) || lower(substr(name, 2)) || 'Flow' AS flow, lower(name) || '_flow' AS slug FROM nodes WHERE type = 'Event' ORDER BY seq, id LIMIT 20), c AS (SELECT flow, slug, dst, row_number() OVER (PARTITION BY src ORDER BY seq, dst) AS k FROM a JOIN edges ON src = a.id WHERE edges.type = 'calls') SELECT flow, slug, 1::INT AS step_index, id AS node FROM a UNION ALL SELECT flow, slug, (k + 1)::INT, dst FROM c WHERE k <= 5")
def infer_flows(spark, d):
    g = events(spark, d)
    return D.infer_flows(g.nodes.where("type = 'Event'"), g.edges.where("type = 'calls'"))


@query("SELECT DISTINCT source || '/producer.py' AS path, 'publish' AS direction, 'topic_' || lang AS topic FROM documents")
def extract_topics(spark, d):
    f = table(spark, d, "documents").select(F.concat("source", F.lit("/producer.py")).alias("path"), F.concat(F.lit("producer.send('topic_"), "lang", F.lit("', message)")).alias("content"), F.lit("kafka").alias("broker"))
    return D.extract_topics(f)


@query("SELECT DISTINCT source || '/m' AS path, CASE lang WHEN 'en' THEN 'kafka' WHEN 'de' THEN 'rabbitmq' ELSE 'eventbus' END AS broker FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def detect_broker(spark, d):
    lib = F.when(F.col("lang") == "en", "kafka.errors").when(F.col("lang") == "de", "pika").otherwise("django.dispatch.receiver")
    return D.detect_broker(table(spark, d, "documents").select(F.concat("source", F.lit("/m")).alias("path"), lib.alias("module"), F.col("doc_id").alias("line")))


@query("SELECT name, database FROM (SELECT DISTINCT c_mktsegment || '_REDIS_HOST' AS name, 'Redis' AS database FROM customer UNION SELECT DISTINCT c_mktsegment || '_POSTGRES_HOST', unnest(['PostgreSQL', 'Elasticsearch']) FROM customer)")
def env_to_database(spark, d):
    seg = table(spark, d, "customer").select("c_mktsegment")
    names = seg.select(F.explode(F.array(F.concat("c_mktsegment", F.lit("_REDIS_HOST")), F.concat("c_mktsegment", F.lit("_POSTGRES_HOST")))).alias("name"))
    return D.env_to_database(names)


@query("SELECT 'd' || p_partkey AS path, 'image' AS kind, 'img:' || p_size AS value FROM part UNION ALL SELECT 'd' || p_partkey, 'env', 'REDIS_HOST' FROM part")
def scan_dockerfiles(spark, d):
    f = table(spark, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("FROM img:"), F.col("p_size").cast("string"), F.lit("\nENV REDIS_HOST=x\nFROM scratch\n")).alias("content"))
    return D.scan_dockerfiles(f)


@query("SELECT 'k' || s_suppkey AS path, 'Deployment' AS kind, 'app' || s_suppkey AS name, 'redis:' || s_nationkey AS image FROM supplier")
def scan_k8s(spark, d):
    s = F.col("s_suppkey").cast("string")
    doc = F.concat(F.lit("kind: Deployment\nmetadata:\n  name: app"), s, F.lit("\nspec:\n  template:\n    spec:\n      containers:\n        - image: redis:"), F.col("s_nationkey").cast("string"), F.lit("\n"))
    return D.scan_k8s(table(spark, d, "supplier").select(F.concat(F.lit("k"), s).alias("path"), doc.alias("content"))).where("image is not null").select("path", "kind", "name", "image")


@query("SELECT 'nation:' || s_nationkey AS src, 'supplier:' || s_suppkey AS dst, 'depends_on' AS type, least(s_suppkey % 10 / 8.0, 1.0)::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 10 >= 4")
def ingest_relations(spark, d):
    doc = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("from"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("to"), F.lit("depends_on").alias("type"), (F.col("s_suppkey") % 10 / 8.0).alias("confidence"))).alias("relations")))
    return D.ingest_relations(table(spark, d, "supplier").select(doc.alias("doc")))


@query("SELECT s_suppkey AS id, 'missing key layers' AS message FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'item lacks layer_index' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'confidence out of range' FROM supplier WHERE s_suppkey % 3 = 0")
def validate_keys(spark, d):
    k = F.col("s_suppkey")
    doc = F.concat(F.lit('{"overall_confidence":'), F.when(k % 3 == 0, "1.5").otherwise("0.5"), F.when(k % 2 == 0, "").otherwise(',"layers":[{"name":"x"}]'), F.lit("}"))
    return D.validate_keys(table(spark, d, "supplier").select(k.alias("id"), doc.alias("doc")), ["layers"], "layers", ["name", "layer_index"])


@query("SELECT doc_id, 'Module:' || source || ':' || regexp_replace(lang || '#' || doc_id, '[^\\w.\\-]', '_', 'g') AS id, lang || '_' || doc_id AS last, source || '|imports|' || lang AS key FROM documents")
def node_ids(spark, d):
    i = node_id(F.lit("Module"), F.concat(F.lit("/"), "source", F.lit("/")), F.concat("lang", F.lit("#"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", i.alias("id"), parse_node_id(i)["name"].alias("last"), edge_key(F.col("source"), F.col("lang"), F.lit("imports")).alias("key"))


# services and infrastructure


def _lifted(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    near = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 97 + 1).alias("o")).distinct().where("k <> o")
    calls = near.select(F.concat(F.lit("f:"), F.col("k").cast("string")).alias("src"), F.concat(F.lit("f:"), F.col("o").cast("string")).alias("dst"))
    f = s.select(F.concat(F.lit("f:"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("c:"), (F.col("k") % 10).cast("string")).alias("component"), (F.col("k") % 7 == 0).alias("is_api"))
    c = s.select((F.col("k") % 10).alias("m")).distinct().select(F.concat(F.lit("c:"), F.col("m").cast("string")).alias("id"), F.when(F.col("m") < 5, "engine").otherwise("model").alias("component_type"))
    return calls, f, c


@query("WITH " + CODE + " SELECT DISTINCT 'f:' || k AS src, 'c:' || o % 10 AS dst FROM near WHERE k % 7 = 0 AND o % 10 < 5 AND k % 10 <> o % 10")
def api_calls(spark, d):
    return P.api_calls(*_lifted(spark, d))


@query("WITH " + CODE + " SELECT DISTINCT 'c:' || k % 10 AS src, 'c:' || o % 10 AS dst FROM near WHERE k % 7 <> 0 AND k % 10 < 5 AND o % 10 < 5 AND k % 10 <> o % 10")
def service_calls(spark, d):
    return P.service_calls(*_lifted(spark, d))


@query("SELECT DISTINCT 'c:' || s_suppkey AS src, 'n:' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 2 = 0")
def service_deps_ctor(spark, d):
    name = F.when(F.col("s_suppkey") % 2 == 0, "__init__").otherwise("run")
    f = table(spark, d, "supplier").select(F.concat(F.lit("c:"), F.col("s_suppkey").cast("string")).alias("owner"), name.alias("name"), F.concat(F.lit("self, x: Optional[N"), F.col("s_nationkey").cast("string"), F.lit("]")).alias("parameters"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("seq"))
    return P.service_deps_ctor(f, n)


@query("WITH " + CODE + " SELECT 'c:' || k AS src, 'c:' || o AS dst FROM near WHERE o % 5 <> 0")
def service_deps_import(spark, d):
    code = A.code_corpus(spark, d)
    imports = Y.extract_symbols(code).where("kind = 'import'").select("path", "language", F.col("name").alias("module"))
    c = code.select(F.concat(F.lit("c:"), F.col("k").cast("string")).alias("id"), "path", S.parent_path(F.col("path")).alias("module"))
    s = table(spark, d, "lineitem").select(F.concat(F.lit("c:"), F.col("l_suppkey").cast("string")).alias("src"), (F.col("l_partkey") % 97 + 1).alias("o")).distinct().where("o % 5 = 0")
    return P.service_deps_import(Y.resolve_imports(imports, c.select(F.col("module").alias("path"))), c, s.select("src", F.concat(F.lit("c:"), F.col("o").cast("string")).alias("dst")))


@query("SELECT 'f' || c_custkey AS src, 'e:' || c_mktsegment AS dst, CASE WHEN c_custkey % 3 = 0 THEN 'reads' ELSE 'writes' END AS type FROM customer")
def static_lineage(spark, d):
    c = table(spark, d, "customer")
    first = F.element_at(F.array(F.lit("find"), F.lit("save"), F.lit("other")), (F.col("c_custkey") % 3 + 1).cast("int"))
    calls = c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("src"), F.lower("c_mktsegment").alias("receiver"), F.posexplode(F.array(first, F.lit("Delete"))).alias("seq", "callee"))
    return P.static_lineage(calls, c.select(F.concat(F.lit("e:"), "c_mktsegment").alias("id"), F.initcap(F.lower("c_mktsegment")).alias("name")).distinct())


def _terraform(spark, d):
    k, m = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 10).cast("string")
    cluster = F.concat(F.lit('resource "aws_ecs_cluster" "c'), k, F.lit('" {\n  name = "cluster-'), k, F.lit('"\n}\n'))
    service = F.concat(F.lit('resource "aws_ecs_service" "s'), k, F.lit('" {\n  name = "svc-'), k, F.lit('"\n  cluster = aws_ecs_cluster.c'), k, F.lit(".id\n  env = aws_db_instance.d"), m, F.lit(".address\n}\n"))
    base = F.concat(F.lit('resource "aws_db_instance" "d'), k, F.lit('" {\n  engine = "x"\n}\nresource "other_thing" "o" {\n}\n'))
    return P.scan_terraform(table(spark, d, "supplier").select(F.concat(F.lit("m"), k, F.lit(".tf")).alias("path"), F.concat(cluster, service, base).alias("content")))


@query("SELECT 'm' || s_suppkey || '.tf' AS path, unnest(['Cluster', 'Service', 'Database']) AS kind, unnest(['cluster-', 'svc-', 'd']) || s_suppkey AS name FROM supplier")
def scan_terraform(spark, d):
    return _terraform(spark, d).select("path", "kind", "name")


@query("WITH n AS (SELECT unnest(['Cluster::cluster-', 'Service::svc-', 'Database::d']) || s_suppkey AS id, unnest(['Cluster', 'Service', 'Database']) AS type, unnest(['cluster-', 'svc-', 'd']) || s_suppkey AS name FROM supplier), e AS (SELECT 'Service::svc-' || s_suppkey AS src, 'deployed_on' AS type, 'Cluster::cluster-' || s_suppkey AS dst FROM supplier UNION ALL SELECT 'Service::svc-' || s_suppkey, 'uses', 'Database::d' || s_suppkey % 10 FROM supplier WHERE s_suppkey % 10 IN (SELECT s_suppkey FROM supplier))" + _BOTH)
def infra_graph(spark, d):
    return _both(P.infra_graph(_terraform(spark, d)))


@query("WITH p AS (SELECT DISTINCT 'pkg' || s_suppkey % 10 AS path, '' AS parent, 0 AS depth, 0::BIGINT AS file_count FROM supplier UNION ALL SELECT 'pkg' || s_suppkey % 10 || '/mod' || s_suppkey, 'pkg' || s_suppkey % 10, 1, 1 FROM supplier) SELECT *, row_number() OVER (PARTITION BY parent ORDER BY path) AS position FROM p QUALIFY position <= 8")
def repo_tree(spark, d):
    f = A.code_corpus(spark, d).select("path")
    own = f.select(S.parent_path(F.col("path")).alias("path"))
    return P.repo_tree(own.union(own.select(S.parent_path(F.col("path")))), f)


@query(f"WITH {STAR}, t AS (SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL), l AS (SELECT kind || ' ' || type || ': ' || n AS line FROM t), x AS (SELECT string_agg(line, chr(10) ORDER BY line) AS text FROM l) SELECT text, greatest(1, length(text) // 4)::BIGINT AS tokens, length(text) // 4 > 8000 AS truncated FROM x")
def count_summary(spark, d):
    return P.count_summary(star(spark, d))


@query("SELECT 'Service::' || n_name AS id, n_name AS name FROM nation")
def infer_services(spark, d):
    return P.infer_services(trade(spark, d)).select("id", "name")


@query("WITH " + FILES + " SELECT string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM files")
def extract_languages(spark, d):
    return P.extract_languages(_scanned(spark, d))


# vectors

_DIST = "list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE)))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("t"), F.col("label").cast("string")).alias("node_type"))


@query(f"WITH p AS (SELECT q.vec_id AS qid, a.vec_id AS id, {_DIST} AS dist FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND a.label IN (1, 2)) SELECT qid, id, round(dist, 6) AS distance, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM p QUALIFY rank <= 10")
def vector_search(spark, d):
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    return V.vector_search(v, q, where=F.col("node_type").isin("t1", "t2")).withColumn("distance", F.round("distance", 6))


@query("SELECT 'g' || label AS graph_id, count(*) AS n FROM embeddings GROUP BY label")
def vector_count(spark, d):
    return V.vector_count(_vectors(spark, d).select(F.concat(F.lit("g"), F.substring("node_type", 2, 9)).alias("graph_id")))


@query(f"WITH p AS (SELECT q.vec_id AS qid, min({_DIST}) AS dist FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND a.vec_id % 100 <> 0 GROUP BY q.vec_id) SELECT qid, round(greatest(0, 1 - dist / 2), 2) AS confidence FROM p")
def confidence(spark, d):
    v = _vectors(spark, d)
    hit = V.vector_search(v.where("id % 100 <> 0"), v.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding"), limit=1)
    return hit.select("qid", S.confidence(F.col("distance")).alias("confidence"))


@query(f"WITH {STAR} SELECT id, name || ' ' || type AS document FROM nodes")
def node_text(spark, d):
    return V.node_text(star(spark, d).nodes)


@query()
def rag_context(spark, d):
    g = star(spark, d)
    v = _vectors(spark, d).withColumn("id", F.concat(F.lit("part:"), F.col("id").cast("string")))
    q = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return V.rag_context(g, v, q)


# streams, run over what is there


def _root(spark):
    """A folder of a query's own in the folder that the session shares."""
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def _arriving(spark, root, schema):
    """A stream of what is written to folders below root, in turn."""
    return spark.readStream.schema(schema).parquet(f"{root}/in/*")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_type_counts(spark, d):
    """Events arrive in two parts; the counts of the last batch are those of all."""
    root, e = _root(spark), table(spark, d, "events").select("event_id", "event_type")
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).write.parquet(f"{root}/in/{k}")
        U.counts_to_table(U.stream_type_counts(_arriving(spark, root, e.schema), "event_type"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return U.newest_counts(spark, f"{root}/out").select("event_type", "n")


_LATE = "WITH e AS (SELECT ts, event_type, event_id % 2 = 0 AND ts < '2024-01-16' AS early FROM events), w AS (SELECT max(ts) FILTER (WHERE early) - INTERVAL 3 DAY AS first, max(ts) - INTERVAL 3 DAY AS last FROM e)"


@query(_LATE + " SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM e, w WHERE (early OR date_trunc('day', ts) + INTERVAL 1 DAY > first) AND date_trunc('day', ts) + INTERVAL 1 DAY <= last GROUP BY ALL")
def stream_window_counts(spark, d):
    """Half of the first half of the events arrive, then the others, of which those of closed days come too late; counts of closed days."""
    root, e = _root(spark), table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    early = F.expr("event_id % 2 = 0 and ts < timestamp'2024-01-16'")
    for k, part in enumerate((e.where(early), e.where(~early))):
        part.write.parquet(f"{root}/in/{k}")
        U.to_table(U.stream_type_counts(_arriving(spark, root, e.schema), "event_type", time="ts", late="3 days", window="1 day"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT 'user:' || user_id AS src, 'kind:' || event_type AS dst, 'triggers' AS type FROM events")
def stream_edges_first(spark, d):
    """Events arrive as edges from users to kinds, in two parts; each edge passes once."""
    root, e = _root(spark), table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("kind:"), "event_type").alias("dst"), F.lit("triggers").alias("type"))
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).write.parquet(f"{root}/in/{k}")
        U.to_table(U.stream_edges_first(_arriving(spark, root, e.schema), time="ts", late="60 days"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("src", "dst", "type")


def entry(spark, sf_dir):
    """Two hops around a nation: nodes and edges."""
    return neighbors(spark, sf_dir)


from . import code_queries  # noqa: E402, F401  registers its queries
