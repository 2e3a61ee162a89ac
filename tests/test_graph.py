import datetime as dt
import os
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from lattica.operators import components as C
from lattica.operators import cycles as K
from lattica.operators import derive as D
from lattica.operators import merge as M
from lattica.operators import metrics as X
from lattica.operators import names as N
from lattica.operators import services as P
from lattica.operators import symbols as Y
from lattica.operators import traverse as T
from lattica.operators import answers as Q
from lattica.operators import summary as Z
from lattica.operators import vectors as V
from lattica.operators import views as W
from lattica.sources import files as FS
from lattica.sources import store
from lattica.sources.commits import Commits
from lattica.streaming import upkeep as U


def graph(spark, nodes, edges):
    return Graph(spark.createDataFrame([(i, "Function", i, "{}", k) for k, i in enumerate(nodes)], NODE_SCHEMA).coalesce(1), spark.createDataFrame([(a, b, t, "{}", k) for k, (a, b, t) in enumerate(edges)], EDGE_SCHEMA).coalesce(1))


@pytest.fixture
def few(spark):
    """One partition a shuffle: for what takes many small steps."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_degrees(spark):
    g = graph(spark, "ab", [("a", "b", "calls"), ("a", "b", "uses"), ("a", "zz", "calls")])
    assert rows(X.degree(g)) == [("a", 0, 1), ("b", 1, 0)]
    assert rows(X.degree_raw(g)) == [("a", 0, 3), ("b", 2, 0)]


def test_neighbors_and_impact(spark):
    g = graph(spark, "abcd", [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("a", "c", "uses")])
    sub, _ = T.neighbors(g, spark.createDataFrame([("b",)], "id string"))
    assert [r[0] for r in rows(sub.nodes)] == ["a", "b", "c"]
    assert len(rows(sub.edges)) == 3
    got = {r["id"]: (r["depth"], r["path"]) for r in T.impact(g, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "c", "d"])}
    none, found = T.neighbors(g, spark.createDataFrame([("x",)], "id string"), depth=0)
    assert rows(none.nodes) == [] and rows(found) == [("x", 0)]


def test_cycles_and_layers(spark):
    g = graph(spark, "abcd", [("a", "b", "depends_on"), ("b", "c", "depends_on"), ("c", "a", "depends_on"), ("c", "d", "depends_on"), ("d", "d", "depends_on")])
    assert rows(K.detect_cycles(g)) == [(3, ["a", "b", "c"])]
    assert [r[0] for r in rows(K.cyclic_core(g))] == ["a", "b", "c"]
    dag = graph(spark, "abcd", [("a", "b", "x"), ("b", "c", "x"), ("a", "c", "x")])
    assert dict(rows(K.layering(dag))) == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert dict(rows(K.layering(g))) == {"a": 0, "b": 0, "c": 0, "d": 0}


def test_pagerank_sums_to_one(spark):
    g = graph(spark, "abc", [("a", "b", "x"), ("b", "c", "x")])
    assert X.pagerank(g, iterations=15).agg(F.sum("pagerank")).first()[0] == pytest.approx(1, abs=1e-5)
    assert X.pagerank(graph(spark, [], [])).count() == 0


def test_merge_and_validate(spark):
    one, two = graph(spark, "x", [("a", "b", "calls")]), graph(spark, "x", [("a", "b", "calls")])
    two = Graph(two.nodes.withColumn("props", F.lit('{"v":2}')), two.edges.withColumn("props", F.lit('{"v":2}')))
    m = M.merge_graphs([one, two])
    assert m.nodes.first()["props"] == '{"v":2}' and m.edges.first()["props"] == "{}"
    assert M.merge_graphs([one, two], edge_policy="last").edges.first()["props"] == '{"v":2}'
    again = M.merge_graphs([m, m])
    assert rows(again.nodes) == rows(m.nodes) and rows(again.edges) == rows(m.edges)
    bad = graph(spark, ["a", "a"], [("a", "a", "calls"), ("a", "zz", "calls"), ("a", "a", "foo")])
    bad = Graph(bad.nodes.union(spark.createDataFrame([("", "Odd", " ", "1", 9)], NODE_SCHEMA)), bad.edges)
    messages = {r["message"] for r in M.validate_graph(bad).collect()}
    assert {"self-loop", "dangling target", "unknown edge type", "duplicate id", "empty id", "blank name", "unknown node type", "props is no object"} <= messages


def test_limits(spark):
    for n, want in ((2000, 40), (2001, 32), (4001, 24), (10001, 16)):
        got = {r[0]: r[1] for r in X.adaptive_limits(spark.range(n)).collect()}
        assert got["functions"] == want


def test_scalars(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first()[0]
    L = F.lit
    assert one(S.slugify(L("OrderItem"))) == "order_item"
    assert [one(S.to_pascal(L(x))) for x in ("user_service", "userService", "self", "User")] == ["UserService", "Userservice", "", "User"]
    assert one(S.flow_name(L("create_order_handler"))) == "CreateOrderFlow"
    assert one(S.simplify_signature(L("self, user_id: int, name: str = ''"))) == "user_id, name"
    assert one(S.token_estimate(L("abc"))) == 1 and one(S.token_estimate(L("x" * 4000))) == 1000
    assert [one(S.confidence(L(d))) for d in (0.0, 0.3, 3.0)] == [1.0, 0.85, 0.0] and one(S.confidence(L(None).cast("double"))) == 0.0
    assert one(D.lineage_verb(L("get_user"))) == "reads" and one(D.lineage_verb(L("save_user"))) == "writes" and one(D.lineage_verb(L("getUser"))) is None
    assert [one(D.infer_layer(L(x))) for x in ("UserController", "UserService", "UserRepo", "OrderEntity")] == ["PresentationLayer", "BusinessLayer", "DataLayer", "DomainLayer"]
    assert [one(D.component_type(L(n), L(m))) for n, m in (("Service", 0), ("UserService", 0), ("Foo", 2), ("Foo", 1))] == [None, "service", "generic", None]
    assert one(S.json_object(L('so: {"a": 1} ok'))) == '{"a": 1}'


def test_import_candidates(spark):
    one = lambda lang, m, p="x/y/f.py": spark.range(1).select(Y.import_candidates(F.lit(lang), F.lit(m), F.lit(p)).alias("v")).first()[0]
    assert one("python", "a.b.c") == ["a/b/c", "a/b", "a"]
    assert one("go", "fmt") == [] and one("go", "h/x/y") == ["h/x/y", "x/y", "y"]
    assert one("java", "java.util.List") == []
    assert one("java", "com.ex.Foo") == ["com/ex/Foo", "com/ex", "com", "ex/foo", "foo"]
    assert one("typescript", "./user", "src/auth.ts") == ["src/user", "src"]
    assert one("python", ".m") == ["x/y/m", "x/y"]


def test_symbols_and_calls(spark):
    src = "import os\n@deco\nclass UserService(Base):\n    def run(self, a: int):\n        repo.save(a)\n        helper()\n\ndef helper():\n    pass\n"
    f = spark.createDataFrame([("m/a.py", "python", src)], "path string, language string, content string")
    assert [(r["kind"], r["name"]) for r in Y.extract_symbols(f).orderBy("line").collect()] == [("import", "os"), ("class", "UserService"), ("func", "helper")]
    m = Y.extract_members(f).collect()
    assert ("class", "UserService", "deco") in {(r["kind"], r["name"], r["decorators"]) for r in m}
    fn = spark.createDataFrame([("UserService.run", "run", "UserService", 1), ("helper", "helper", None, 2), ("Repo.save", "save", "Repo", 3)], "id string, name string, owner string, seq long")
    calls = Y.extract_members(f).where("kind = 'call'").select(F.col("owner").alias("caller"), "receiver", F.col("name").alias("callee"))
    assert rows(Y.resolve_calls(calls, fn)) == [("UserService.run", "Repo.save"), ("UserService.run", "helper")]


def test_topics_env_and_chunks(spark):
    f = spark.createDataFrame([("p", "producer.send('orders', m)\nKafkaConsumer(\"bills\")", "kafka")], "path string, content string, broker string")
    assert rows(D.extract_topics(f)) == [("p", "consume", "bills"), ("p", "publish", "orders")]
    env = spark.createDataFrame([("REDIS_HOST",), ("DB_URL",), ("POSTGRES_HOST",)], "name string")
    assert rows(D.env_to_database(env)) == [("DB_URL", "PostgreSQL"), ("POSTGRES_HOST", "Elasticsearch"), ("POSTGRES_HOST", "PostgreSQL"), ("REDIS_HOST", "Redis")]
    t = spark.createDataFrame([("p", "a\nbb\nccc")], "path string, content string")
    assert [tuple(r)[1:] for r in FS.chunk_stream(t, max_bytes=5).collect()] == [(1, 2, "a\nbb"), (3, 3, "ccc")]
    assert [tuple(r)[1:] for r in FS.chunk_lines(t, 2).collect()] == [(1, 2, "a\nbb"), (3, 3, "ccc")]


def test_views_edge_cases(spark):
    e = graph(spark, [], [])
    assert W.get_graph(e).nodes.count() == 0 and X.degree(e).count() == 0 and K.layering(e).count() == 0
    g = graph(spark, "abc", [("a", "b", "contains")])
    assert W.query_nodes(g, limit=0).count() == 0 and W.query_nodes(g, limit=99).count() == 3
    assert [r["has_more"] for r in W.page_nodes(g, 0, 2).collect()] == [True, True]
    assert rows(W.node_detail(g, "b")) == [("in", "contains", "a", "Function")]


def test_store(spark, tmp_path):
    root = str(tmp_path / "graphs")
    g = graph(spark, "ab", [("a", "b", "calls")])
    store.save_graph(g, root, "g1", repo_name="Shop")
    store.save_graph(g, root, "g2", repo_name="Bank")
    assert store.list_graphs(spark, root).count() == 2 and store.search_graphs_by_repo(spark, root, "sho").first()["graph_id"] == "g1"
    assert rows(store.load_graph(spark, root, "g1").edges) == rows(g.edges)
    store.delete_graph(spark, root, "g1")
    assert store.load_graph(spark, root, "g1") is None and store.list_graphs(spark, root).count() == 1
    assert rows(store.import_json(store.export_json(g)).nodes) == rows(g.nodes)


def test_stream_upsert(spark, tmp_path):
    from lattica.streaming import upkeep as U

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    graph(spark, "ab", []).nodes.write.parquet(src)
    run = lambda: U.stream_graph_upsert(spark.readStream.schema(NODE_SCHEMA).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("a", "Function", "new", "{}", 9)], NODE_SCHEMA).write.mode("append").parquet(src)
    run()
    assert {r["id"]: r["name"] for r in U.latest(spark, out).collect()} == {"a": "new", "b": "b"}


def test_terraform(spark):
    text = 'resource "aws_ecs_cluster" "a" {\n  name = "Big"\n}\nresource "aws_lambda_function" "f" {\n  cluster = aws_ecs_cluster.a.id\n  db = aws_db_instance.d.url\n}\nvariable "x" {\n  name = "no"\n}\nresource "aws_db_instance" "d" {}\n'
    r = P.scan_terraform(spark.createDataFrame([("m.tf", text), ("n.tf", None), ("o.tf", "")], "path string, content string"))
    assert rows(r.select("kind", "name")) == [("Cluster", "Big"), ("Database", "d"), ("Service", "f")]
    assert rows(P.infra_graph(r).edges.select("src", "dst", "type")) == [("Service::f", "Cluster::Big", "deployed_on"), ("Service::f", "Database::d", "uses")]


def test_static_lineage_takes_the_first_operation(spark):
    calls = spark.createDataFrame([("f", "user_store", "GET", 2), ("f", "user_store", "save", 1), ("f", "Plan", "noop", 3), ("g", None, "save", 1)], "src string, receiver string, callee string, seq int")
    entities = spark.createDataFrame([("e1", "Userstore"), ("e2", "Plan")], "id string, name string")
    assert rows(P.static_lineage(calls, entities)) == [("f", "e1", "writes")]


def test_service_and_api_calls(spark):
    calls = spark.createDataFrame([("f", "g"), ("g", "h"), ("h", "g"), ("f", "f")], "src string, dst string")
    functions = spark.createDataFrame([("f", None, True), ("g", "A", False), ("h", "B", False)], "id string, component string, is_api boolean")
    components = spark.createDataFrame([("A", "service"), ("B", "manager")], "id string, component_type string")
    assert rows(P.api_calls(calls, functions, components)) == [("f", "A")]
    assert rows(P.service_calls(calls, functions, components)) == [("A", "B"), ("B", "A")]


def test_k8s_containers_of_pods_and_init_containers(spark):
    deployment = "kind: Deployment\nmetadata:\n  name: app\nspec:\n  template:\n    spec:\n      initContainers:\n        - image: wait:1\n      containers:\n        - image: redis:7\n          env:\n            - name: A\n"
    pod = "kind: Pod\nmetadata:\n  name: one\nspec:\n  containers:\n    - image: job:2\n"
    got = D.scan_k8s(spark.createDataFrame([("k", f"{deployment}---\n{pod}")], "path string, content string"))
    assert rows(got.select("name", "image", "env").where("image is not null or env is not null")) == [("app", "redis:7", None), ("app", "wait:1", None), ("app", None, "A"), ("one", "job:2", None)]


def test_a_graph_can_be_saved_over_itself(spark, tmp_path):
    root = str(tmp_path / "g")
    store.save_graph(graph(spark, "abc", [("a", "b", "calls")]), root, "g1", repo_name="One")
    first = store.load_graph(spark, root, "g1")
    store.save_graph(Graph(first.nodes.where("id <> 'c'"), first.edges), root, "g1", repo_name="One")
    again = store.load_graph(spark, root, "g1")
    assert [r["id"] for r in again.nodes.orderBy("id").collect()] == ["a", "b"] and again.edges.count() == 1
    assert [(r["graph_id"], r["node_count"]) for r in store.list_graphs(spark, root).collect()] == [("g1", 2)]


def test_names_hold_one_another(spark):
    f = spark.createDataFrame([("f1", "get_users_list"), ("f2", "save_x"), ("f3", "compute"), ("f4", "find_db")], "id string, name string")
    m = spark.createDataFrame([("m1", "User", 1), ("m2", "orders", 2), ("m3", "db", 3), ("m4", " ", 4)], "id string, name string, seq long")
    assert rows(D.heuristic_lineage(f, m)) == [("f1", "m1", "reads"), ("f2", "m1", "writes"), ("f2", "m2", "writes"), ("f4", "m3", "reads")]
    known = spark.createDataFrame([("Users table", "u", 1), ("Orders", "o", 2), ("users", "v", 3)], "name string, id string, seq long")
    asked = spark.createDataFrame([(" USERS ",), ("user",), ("all orders",), ("new one",), ("  ",), (None,)], "name string")
    assert rows(N.partial_name_resolve(asked, known)) == [(" USERS ", "v", False), ("all orders", "o", False), ("new one", "data_object:new_one", True), ("user", "u", False)]


def test_json_objects_in_answers(spark):
    said = ['x {"a": 1} then {b}', '{"a": {"b": "}"}} tail }', "no", None, '```json\n{"q": [1]}\n``` {z}', '{"a":1}', '{"a": "\\"}"} }', "{bad}"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(S.json_object(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": {"b": "}"}}', None, None, '{"q": [1]}', '{"a":1}', '{"a": "\\"}"}', None]


def test_long_cycles_are_found(spark):
    ring = [chr(97 + i) for i in range(14)]
    g = graph(spark, ring + ["x", "y"], [(a, b, "depends_on") for a, b in zip(ring, ring[1:] + ring[:1])] + [("x", "a", "depends_on"), ("c", "y", "depends_on"), ("b", "a", "depends_on")])
    assert sorted((r["length"], "".join(r["path"])) for r in K.detect_cycles(g).collect()) == [(2, "ab"), (14, "".join(ring))]


def test_component_layer(spark):
    classes = spark.createDataFrame([("p.py", "UserService", 1), ("p.py", "Plain", 2), ("q.py", "Two", 3), ("q.py", "OtherStore", 4)], "path string, name string, seq long")
    functions = spark.createDataFrame([("p.py", "get", "UserService", 1), ("p.py", "x", "Plain", 2), ("p.py", "main", None, 3), ("q.py", "a", "Two", 4), ("q.py", "b", "Two", 5), ("q.py", "loose", None, 6)], "path string, name string, owner string, seq long")
    g = C.component_graph(classes, functions)
    assert sorted(r["name"] for r in g.nodes.where("type = 'Component'").collect()) == ["OtherStore", "Two", "UserService"]
    assert sorted(r["name"] for r in g.nodes.where("type = 'Function'").collect()) == ["a", "b", "get", "loose", "main"]
    held = {(r["component"].split(":")[-1], r["function"].split(":")[-1]) for r in C.func_to_component(g).collect()}
    assert held == {("UserService", "UserService.get"), ("UserService", "main"), ("Two", "Two.a"), ("Two", "Two.b")}


def test_callers(spark):
    f = spark.createDataFrame([("f1", "run", "A", 1), ("f2", "run", "A", 2), ("f3", "run", "B", 3), ("f4", "only", None, 4), ("f5", "run", None, 5)], "id string, name string, owner string, seq long")
    p = spark.createDataFrame([("m", "A", "run"), ("m", "Z", "only"), ("m", None, "run"), ("m", "Z", "run"), ("m", None, "none")], "path string, owner string, name string")
    assert rows(C.resolve_caller(p, f).select("owner", "name", "dst")) == [("A", "run", "f2"), ("Z", "only", "f4"), ("Z", "run", "f1"), (None, "run", "f5")]


def test_vector_search_brute_force(spark):
    import random

    r = random.Random(3)
    vs = [(10**17 + i, [r.choice((0.0, 1.0, 2.5)) for _ in range(4)]) for i in range(150)] + [(1, None), (2, [1.0])]
    v = spark.createDataFrame(vs, "id long, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 1.0]), ("b", [2.5] * 4)], "qid string, embedding array<float>")
    for block in (16, 1 << 16):
        got = {}
        for x in V.vector_search(v, q, limit=7, block=block).collect():
            got.setdefault(x["qid"], []).append((x["rank"], x["distance"], x["id"]))
        for k, w in q.collect():
            want = sorted((sum((a - b) ** 2 for a, b in zip(w, e)), i) for i, e in vs if e and len(e) == 4)[:7]
            assert [(d, i) for _, d, i in sorted(got[k])] == want
    assert V.vector_search(v.limit(0), q).count() == 0


def test_stream_upserts_rewrite_their_slots_only(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    put = lambda k, some: spark.createDataFrame([(i, "Function", n, "{}", s) for i, n, s in some], NODE_SCHEMA).coalesce(1).write.parquet(f"{src}/{k}")
    run = lambda: U.stream_graph_upsert(spark.readStream.schema(NODE_SCHEMA).option("recursiveFileLookup", True).parquet(str(src)), out, str(tmp_path / "cp"), slots=4).awaitTermination()
    put(0, [(f"n{i}", "first", i) for i in range(40)])
    run()
    for k in range(1, 5):
        put(k, [("n1", f"at {k}", 100 + k), (f"m{k}", "new", k)])
        run()
    got = {x["id"]: x["name"] for x in U.latest(spark, out).collect()}
    assert got == {f"n{i}": "first" for i in range(40)} | {"n1": "at 4"} | {f"m{k}": "new" for k in range(1, 5)}
    log = Commits(spark, out)
    assert len(log.versions()) == 5 and log.head()[0] == 5 and len(set(log.head()[1]["slots"].values()) - set(log.read(1)["slots"].values())) <= 4


def _change(spark, path, some):
    spark.createDataFrame([(i, "Function", n, "{}", k) for k, (i, n) in enumerate(some)], NODE_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_two_queries_keep_one_table(spark, tmp_path):
    out = str(tmp_path / "out")
    run = lambda k: U.stream_graph_upsert(spark.readStream.schema(NODE_SCHEMA).parquet(str(tmp_path / f"in{k}")), out, str(tmp_path / f"cp{k}"), slots=4).awaitTermination()
    names = lambda version=None: {r["id"]: r["name"] for r in U.latest(spark, out, version=version).collect()}
    assert names() == {}
    _change(spark, tmp_path / "in0", [(c, "zero") for c in "abcde"])
    run(0)
    _change(spark, tmp_path / "in1", [("x", "one"), ("a", "one")])
    run(1)
    assert names() == dict.fromkeys("bcde", "zero") | dict.fromkeys("ax", "one")
    run(0)  # nothing new
    _change(spark, tmp_path / "in0", [("a", "again")])
    run(0)
    assert names()["a"] == "again" and len(names()) == 6 and names(1) == dict.fromkeys("abcde", "zero")


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    log = Commits(spark, str(tmp_path / "out"))
    new = spark.createDataFrame([("a", "Function", "a", "{}", 1)], NODE_SCHEMA).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    put = lambda epoch, query="q": U._put(log, new, query, epoch, NODE_SCHEMA, ("id",), 4)
    put(0)
    head = log.head()
    put(0)
    assert log.head() == head
    put(0, "other")
    put(1)
    assert log.head()[1]["epochs"] == {"q": 1, "other": 0} and log.head()[0] == 3
    assert not log.commit(3, {})  # the number is taken
    with pytest.raises(ValueError):
        U._put(log, new, "q", 2, NODE_SCHEMA, ("id",), 8)


def test_a_writer_that_loses_the_race_or_is_lost(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    log = Commits(spark, out)
    rows_ = lambda i: spark.createDataFrame([(i, "Function", i, "{}", 1)], NODE_SCHEMA).withColumn("slot", F.lit(0))
    plain, raced = log.commit, []

    def commit(version, manifest):
        if not raced:  # another writer commits first
            raced.append(1)
            U._put(Commits(spark, out), rows_("other"), "p", 0, NODE_SCHEMA, ("id",), 1)
        return plain(version, manifest)

    monkeypatch.setattr(log, "commit", commit)
    U._put(log, rows_("a"), "q", 0, NODE_SCHEMA, ("id",), 1)
    assert {r["id"] for r in U.latest(spark, out).collect()} == {"a", "other"}

    def lost(version, manifest):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(log, "commit", lost)
    with pytest.raises(RuntimeError):
        U._put(log, rows_("b"), "q", 1, NODE_SCHEMA, ("id",), 1)
    assert {r["id"] for r in U.latest(spark, out).collect()} == {"a", "other"}
    held = lambda: len(os.listdir(f"{out}/data"))
    before = held()
    log.drop_unfinished(lambda m: m["slots"].values(), hours=-1)
    assert held() == before - 1
    monkeypatch.undo()
    U._put(log, rows_("b"), "q", 1, NODE_SCHEMA, ("id",), 1)
    assert {r["id"] for r in U.latest(spark, out).collect()} == {"a", "b", "other"}
    log.expire(1, lambda m: m["slots"].values())
    assert log.versions() == [3] and U.latest(spark, out).count() == 3


def test_keyed_scan_over_restarts(spark, tmp_path):
    def scan(n, day, some):
        spark.createDataFrame([(p, s, dt.datetime(2024, 1, day)) for p, s in some], "path string, sha256 string, seen timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        files = spark.readStream.schema("path string, sha256 string, seen timestamp").parquet(str(tmp_path / "in/*"))
        U.to_table(U.stream_incremental_scan(files, patience_ms=36 * 3_600_000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = sorted((r["path"], r["change"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        return got

    seen = scan(0, 1, [("a", "1"), ("b", "1"), (None, "1"), ("c", None)])
    assert seen == [("a", "new"), ("b", "new"), ("c", "new")]
    again = scan(1, 2, [("a", "1"), ("b", "2"), ("b", "2")])
    assert again == sorted(seen + [("b", "changed")])
    third = scan(2, 3, [("a", "1"), ("b", "2"), ("d", "1")])
    assert third == sorted(again + [("d", "new"), ("c", "deleted")])
    assert scan(3, 4, [("c", "1"), ("a", "1"), ("b", "2")]) == sorted(third + [("c", "new")])


def test_results_are_not_shuffled(spark, tmp_path):
    name = f"results_{uuid.uuid4().hex}"
    store.create_results(spark, name, str(tmp_path / "r"), buckets=4)
    put = lambda *some: store.put_results(spark, name, spark.createDataFrame(some, store.RESULTS))
    put(("r", "s", "a", "1"), ("r", "", "a", "1"), ("q", "s", "a", "1"), ("r", "s", "b", "1"))
    put(("r", "s", "a", "2"))
    wanted = spark.createDataFrame([("r", "s", "a"), ("r", "", "a"), ("q", "s", "a"), ("z", None, "a")], "repo string, commit_sha string, analyzer string")
    hits, misses = store.reuse_results(spark, name, wanted)
    assert rows(hits) == [("q", "s", "a", "1"), ("r", "s", "a", "2")] and misses.count() == 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") - plan.count("ReusedExchange") <= 2 and "SelectedBucketsCount" in plan  # those of the wanted keys
    store.invalidate_results(spark, name, "q")
    assert rows(store.result_stats(spark, name)) == [("a", 1, 1), ("b", 1, 1)]
    assert [(r["repo"], r["commits"], r["analyzers"], r["results"]) for r in store.list_results(spark, name).collect()] == [("r", 1, ["a", "b"], 2)]
    put(("q", "s", "a", "3"))
    assert store.stored_results(spark, name).count() == 3


def test_a_save_that_is_lost_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "graphs")
    store.save_graph(graph(spark, "ab", [("a", "b", "calls")]), root, "odd id/1", repo_name="Shop")

    def lost(*_):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(store, "_commit", lost)
    with pytest.raises(RuntimeError):
        store.save_graph(graph(spark, "xyz", []), root, "odd id/1")
    monkeypatch.undo()
    assert sorted(r["id"] for r in store.load_graph(spark, root, "odd id/1").nodes.collect()) == ["a", "b"]
    held = store.load_graph(spark, root, "odd id/1")
    store.save_graph(graph(spark, "c", []), root, "odd id/1", repo_name="Shop")
    assert held.nodes.count() == 2  # its version is still kept
    for k in range(3):
        store.save_graph(graph(spark, "cd"[: k % 2 + 1], []), root, f"g{k}", repo_name="Workshop")
    g = store.load_by_repo(spark, root, "SHOP")
    assert sorted((r["graph_id"], r["id"]) for r in g.nodes.collect()) == [("g0", "c"), ("g1", "c"), ("g1", "d"), ("g2", "c"), ("odd id/1", "c")]
    merged = store.load_and_merge(spark, root, ["g0", "no such", "odd id/1", "g1"])
    assert sorted(r["id"] for r in merged.nodes.collect()) == ["c", "d"]
    assert merged.nodes._jdf.queryExecution().optimizedPlan().toString().count("/nodes") <= 1


def _reach(ids, edges):
    out = {i: {i} for i in ids}
    grown = True
    while grown:
        grown = False
        for a, b in edges:
            for x in ids:
                if a in out[x] and b not in out[x]:
                    out[x].add(b)
                    grown = True
    return out


def _layers_by_hand(ids, edges):
    edges = {(a, b) for a, b in edges if a != b}
    left, layer, k = set(ids), {}, 0
    while free := {i for i in left if not any(b == i for _, b in edges)}:
        layer |= dict.fromkeys(free, k)
        left -= free
        edges = {(a, b) for a, b in edges if a not in free}
        k += 1
    return layer | dict.fromkeys(left, k)


@pytest.mark.parametrize("seed", range(2))
def test_components_cycles_and_layers_brute_force(spark, seed, few):
    r = random.Random(seed)
    n = 24
    ids = [f"n{i:02d}" for i in range(n)]
    edges = {(r.choice(ids), r.choice(ids)) for _ in range(r.choice((12, 26, 34)))}
    ring = ids[3:11]
    edges |= set(zip(ring, ring[1:] + ring[:1])) if seed % 2 else set(zip(ids[:12], ids[1:13]))
    g = graph(spark, ids, [(a, b, "depends_on") for a, b in edges])
    reach = _reach(ids, edges)
    own = {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}
    size = {c: sum(x == c for x in own.values()) for c in own.values()}
    assert dict(rows(K.strong_components(g))) == {i: c for i, c in own.items() if size[c] > 1}
    of, short = K.condensed(g)
    assert dict(rows(of)) == own and set(rows(short)) == {(own[a], own[b]) for a, b in edges if own[a] != own[b]}
    on = {i for i in ids if any(size[own[j]] > 1 and i in reach[j] for j in ids) and any(size[own[j]] > 1 and j in reach[i] for j in ids)}
    assert {x[0] for x in rows(K.cyclic_core(g))} == on
    assert dict(rows(K.layering(g))) == _layers_by_hand(ids, edges)
    whole = _layers_by_hand(set(own.values()), {(own[a], own[b]) for a, b in edges})
    assert dict(rows(K.layering(g, condense=True))) == {i: whole[own[i]] for i in ids}


def test_long_chains_and_rings_take_few_steps(spark, monkeypatch, few):
    n, steps = 2000, []
    plain = K.cut
    monkeypatch.setattr(K, "cut", lambda *a: (steps.append(1), plain(*a))[1])
    ids = [f"{i:05d}" for i in range(n)]
    chain = graph(spark, ids, [(a, b, "depends_on") for a, b in zip(ids, ids[1:])])
    assert [x[1] for x in rows(K.layering(chain))] == list(range(n)) and len(steps) < 60
    steps.clear()
    assert K.strong_components(chain).count() == 0 and len(steps) < 60
    steps.clear()
    tail = [(ids[-1], "a", "depends_on"), ("a", "b", "depends_on"), ("b", "a", "depends_on")]
    ring = graph(spark, [*ids, "a", "b"], [(a, b, "depends_on") for a, b in zip(ids, ids[1:] + ids[:1])] + tail)
    assert {x[1] for x in rows(K.strong_components(ring))} == {"00000", "a"} and len(steps) < 120
    assert set(rows(K.layering(ring, condense=True))) == {(i, 0) for i in ids} | {("a", 1), ("b", 1)}


def _names_by_hand(names, known):
    index, out = [(n.lower(), i) for n, i in known], {}
    for name in names:
        key = name.lower().strip()
        if key:
            hit = next((i for n, i in index if n == key), None) or next((i for n, i in index if key in n or n in key), None)
            if not hit:
                hit = "data_object:" + key.replace(" ", "_")
                index.append((key, hit))
            out.setdefault((name, hit))
    return sorted(out)


def test_names_made_on_the_way_brute_force(spark, few):
    r = random.Random(3)
    parts = ["orders", "order", "ord", "user", "users", "us", "table", "t", "line", "x"]
    for _ in range(2):
        asked = [" ".join(r.choice(parts) for _ in range(r.randint(1, 3))) + r.choice(("", " ")) for _ in range(60)] + ["Orders", "orders table", " "]
        r.shuffle(asked)
        known = [("User Base", "u1"), ("line x t", "l1"), ("ZZ", "z")]
        k = spark.createDataFrame([(n, i, s) for s, (n, i) in enumerate(known)], "name string, id string, seq long")
        n = spark.createDataFrame([(x, s) for s, x in enumerate(asked)], "name string, seq long")
        assert sorted((x["name"], x["id"]) for x in N.partial_name_resolve(n, k).collect()) == _names_by_hand(asked, known)
    both = N.partial_name_resolve(n.withColumn("graph", F.lit("a")).unionByName(spark.createDataFrame([("Orders", 1, "b"), ("orders table", 2, "b")], "name string, seq long, graph string")), k.withColumn("graph", F.lit("a")), by=("graph",))
    assert {x["id"] for x in both.where("graph = 'b'").collect()} == {"data_object:orders"} and both.where("graph = 'a'").count() == len(_names_by_hand(asked, known))


def test_odd_answers_are_passed_over(spark, few):
    known = spark.createDataFrame([("g", "f", "fn:f", "function", 1), ("g", "Orders", "t:o", "data", 2), ("h", "f", "fn:h", "function", 1)], "graph string, name string, id string, kind string, seq long")
    docs = [
        None, "", "[1]", "{", '{"layers": 5, "flows": [1, "x", null], "lineage": {"a": 1}}', '{"services": [{"name": null}, {"name": " "}], "flows": [{"name": "f", "steps": "many"}]}',
        '{"lineage": [{"function_name": "f", "reads": ["orders", "Old orders", "Orders ", 7, null], "writes": "orders", "transforms": [{"from_entity": "a", "to_entity": "a"}, {"from_entity": "a", "to_entity": "ab", "confidence": "x"}]}]}',
        '{"lineage": [{"function_name": "f", "confidence": 9, "reads": ["stock"], "writes": ["stock table"]}], "data_flows": [{"source": "f", "target": "stock", "flow_type": "Consume"}, {"source": "stock", "target": "nothing", "flow_type": "fly"}]}',
    ]
    answers = spark.createDataFrame([("g", k, d) for k, d in enumerate(docs)] + [("z", 0, docs[-1])], "graph string, answer int, doc string")
    got = Q.ingest_model_output(answers, known)
    assert {x["id"] for x in got.nodes.where("graph = 'g'").collect()} == {"data_object:7", "data_object:a", "data_object:stock"}
    edges = {(x["graph"], x["src"], x["type"], x["dst"]) for x in got.edges.collect()}
    assert {e for e in edges if e[0] == "g"} >= {("g", "fn:f", "reads", "t:o"), ("g", "fn:f", "reads", "data_object:stock"), ("g", "fn:f", "writes", "data_object:stock"), ("g", "fn:f", "consumes", "data_object:stock")}
    assert not any(e[0] == "z" and e[1].startswith("fn:") for e in edges) and {tuple(x) for x in got.unknown.collect()} == {("z", "lineage", "f")}
    assert Q.ingest_model_output(answers.limit(0), known).nodes.count() == 0


def test_rules_of_odd_answers(spark):
    rows_ = [("domain_model", None), ("domain_model", "[]"), ("no such", '{"a": 1}'), ("data_lineage", '{"lineage": null}'), ("business_flow", '{"flows": []}'), ("architecture", '{"layers": [], "assignments": [{"node_name": "x", "layer": "L", "confidence": null}]}')]
    got = {r["answer"]: (r["valid"], r["confidence"], sorted((x["place"], x["message"]) for x in r["issues"])) for r in Q.validate_response(spark.createDataFrame([(k, t, d) for k, (t, d) in enumerate(rows_)], "answer int, template string, doc string")).collect()}
    assert got[0] == got[1] == (False, 0.0, [("", "is no JSON object")]) and got[2] == (True, 0.0, [])
    assert got[3] == (False, 0.0, [("lineage", "is no list")]) and got[4] == (True, 0.0, [("flows", "none has 2 steps")])
    assert got[5] == (True, 0.0, [("assignments[0]", "unknown layer: L"), ("layers", "has fewer than 1 entries")])


def test_summary_of_small_graphs(spark, few):
    n = [("a", "r", "Repository", "Shop", '{"git_commit":"0123456789abcdef"}', 0), ("a", "m1", "Module", "src", '{"path":"src","language":"go"}', 1), ("a", "m2", "Module", "api", '{"path":"src/api"}', 2), ("a", "m3", "Module", "v1", '{"path":"src/api/v1"}', 3), ("a", "m4", "Module", "deep", '{"path":"src/api/v1/deep"}', 4),
         ("a", "t", "Table", "users", "{}", 5), ("a", "f", "Function", "f", None, 6), ("b", "x", "Odd", "x", None, 0)]
    nodes = spark.createDataFrame(n, "graph string, id string, type string, name string, props string, seq long")
    edges = spark.createDataFrame([("a", "m1", "f", "contains", "{}", 0), ("a", "f", "gone", "calls", "{}", 1)], "graph string, src string, dst string, type string, props string, seq long")
    got = {r["graph"]: r for r in Z.repo_summary(nodes, edges).collect()}
    assert got["a"]["text"].split("\n\n")[1] == "## Directory Structure\n- src\n  - api\n    - v1" and "- default (unknown): users" in got["a"]["text"]
    assert got["a"]["text"].startswith("# Repository: Shop\nLanguages: go | Files: 0 | Nodes: 7 | Edges: 2\nGit commit: 0123456789ab\n\n## Directory") and not got["a"]["truncated"]
    assert got["b"]["text"] == "# Repository: unknown\nLanguages: unknown | Files: 0 | Nodes: 1 | Edges: 0"
    short = {r["graph"]: r for r in Z.repo_summary(nodes, edges, budget=10).collect()}
    assert short["a"]["truncated"] and short["a"]["tokens"] == got["a"]["tokens"] == len(got["a"]["text"]) // 4 and len(short["a"]["text"]) // 4 <= 10
    assert Z.repo_summary(nodes.limit(0), edges.limit(0)).count() == 0


def test_odd_manifests_and_first_source_wins(spark):
    files = spark.createDataFrame([("a.yaml", "kind: Deployment\nmetadata: {name: web}\nspec: [1, 2]"), ("b.yaml", "kind: Deployment\nmetadata: [x]\nspec: {template: {spec: {containers: [7, {image: 'x/web:1', env: [{name: PG_URL}, 5]}]}}}"), ("c.yaml", "kind: [")], "path string, content string")
    got = D.scan_k8s(files)
    assert rows(got.select("path", "name", "image", "env")) == sorted([("a.yaml", "web", None, None), ("b.yaml", None, None, None), ("b.yaml", None, "x/web:1", None), ("b.yaml", None, None, "PG_URL")], key=str)
    k8s = spark.createDataFrame([("k", "Job", "run", None, "y/box:2", "PG_URL"), ("k", "Job", "", "n", None, None), ("k", "ConfigMap", "c", "n", None, None)], D.K8S)
    docker = spark.createDataFrame([("d", "image", "z/box:1")], "path string, kind string, value string")
    g = P.infra_graph(docker=docker, kubernetes=k8s)
    assert rows(g.edges.select("src", "dst", "type")) == [("Service::run", "Cluster::default", "deployed_on"), ("Service::run", "Database::PostgreSQL", "uses")]
    assert [(x["id"], '"z/box:1"' in x["props"]) for x in g.nodes.where("type = 'Component'").collect()] == [("Component::box", True)]
    assert P.infra_graph(kubernetes=k8s.limit(0)).nodes.count() == 0


def test_broker_of_files_without_one(spark):
    imports = spark.createDataFrame([("a", "os", 1), ("a", "kafka.errors", 2), ("b", "os", 1), ("c", None, 1)], "path string, module string, line int")
    classes = spark.createDataFrame([("a", "EventBus"), ("b", "my_event_bus"), ("c", "Bus"), ("d", None)], "path string, name string")
    assert rows(D.detect_broker(imports)) == [("a", "kafka")] and rows(D.detect_broker(imports, classes)) == [("a", "kafka"), ("b", "eventbus")]


def test_names_of_answers_are_not_sent_to_the_driver(spark, few, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "SENT", 0)
    docs = [f'{{"lineage": [{{"function_name": "f", "reads": ["new {k}", "old"], "writes": ["copy of new {k}"]}}], "services": [{{"name": "S"}}, {{"name": "T"}}], "dependencies": [{{"from_service": "S", "to_service": "T"}}]}}' for k in range(5)]
    answers = spark.createDataFrame([("g", k, d) for k, d in enumerate(docs)], "graph string, answer int, doc string")
    known = spark.createDataFrame([("g", "f", "fn:f", "function", 1), ("g", "Old", "t:o", "data", 2)], "graph string, name string, id string, kind string, seq long")
    plans = []
    monkeypatch.setattr(Q, "cut", lambda df, name="step", old=Q.cut: plans.append(df._jdf.queryExecution().toString()) or old(df, name))
    monkeypatch.setattr(N, "cut", lambda df, name="step", old=N.cut: plans.append(df._jdf.queryExecution().toString()) or old(df, name))
    got = Q.ingest_model_output(answers, known)
    assert got.edges.where("type = 'depends_on'").count() == 1 and got.edges.where("type = 'reads'").count() == 6
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)


def test_members_leave_a_task_in_small_pieces(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", "python", "")], "path string, language string, content string")
    runs = []
    with monkeypatch.context() as m:
        m.setattr(type(files), "mapInPandas", lambda self, f, schema: runs.append(f) or self)
        Y.extract_members(files)
    source = lambda k: f"def f{k}():\n" + "".join(f"    g{j}()\n" for j in range(300))
    asked = []
    batches = (asked.append(k) or pd.DataFrame({"path": [f"{k}.{i}.py" for i in range(100)], "content": [source(i) for i in range(100)]}) for k in range(3))
    got = []
    for k, piece in enumerate(runs[0](batches)):
        assert len(piece) <= 10_000 and (k or asked == [0])
        got += list(piece["path"])
    assert got == [f"{k}.{i}.py" for k in range(3) for i in range(100) for _ in range(301)]


def test_ranks_leave_one_step_on_disk_and_slices_change_nothing(spark, few, monkeypatch):
    r = random.Random(5)
    ids = [f"n{i}" for i in range(12)]
    links = [(r.choice(ids), r.choice([*ids[:6], "nobody"]), r.choice(("calls", "uses"))) for _ in range(40)] + [("nobody", "n1", "calls")]
    g = graph(spark, ids, links)
    pairs = {(a, b) for a, b, _ in links if "nobody" not in (a, b)}
    out = {i: sum(a == i for a, _ in pairs) for i in ids}
    rank = dict.fromkeys(ids, 1 / 12)
    for _ in range(4):
        lost = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.85 * (sum(rank[a] / out[a] for a, b in pairs if b == i) + lost / 12) + 0.15 / 12 for i in ids}
    want = {i: (sum(b == i for _, b in pairs), out[i], round(rank[i], 6)) for i in ids}
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    for slice_ in (5, 1 << 20):
        monkeypatch.setattr(X, "SLICE", slice_, raising=False)
        before = set(os.listdir(folder))
        ranks = {x["id"]: x["pagerank"] for x in X.pagerank(g, iterations=4).collect()}
        assert ranks == pytest.approx({i: w[2] for i, w in want.items()}, abs=1e-6)
        assert sum(x.startswith("pr-") and not x.startswith(("pr-ids", "pr-edges")) for x in set(os.listdir(folder)) - before) == 1
        got = {x["id"]: tuple(x)[1:] for x in X.metrics(g, iterations=4).select("id", "in_degree", "out_degree", "pagerank").collect()}
        assert {i: x[:2] for i, x in got.items()} == {i: w[:2] for i, w in want.items()} and {i: x[2] for i, x in got.items()} == ranks


def test_expanding_a_few_seeds_writes_no_table_of_all_edges(spark, few, monkeypatch):
    ids = [f"n{i}" for i in range(400)]
    links = [(ids[i], ids[i + 1], "calls") for i in range(399)] + [("n5", "n7", "uses"), ("n7", "n7", "uses"), ("n9", "gone", "uses")]
    g = graph(spark, ids, links)
    near = lambda s, d: (s if d == 0 else near(s | {b for a, b, _ in links if a in s} | {a for a, b, _ in links if b in s}, d - 1))
    written = []
    monkeypatch.setattr(T, "cut", lambda df, name="step", old=T.cut: written.append(old(df, name)) or written[-1])
    for depth, sent in ((1, 100_000), (2, 0), (0, 100_000)):
        monkeypatch.setattr(T, "SENT", sent, raising=False)
        got = T.graph_expand(g, spark.createDataFrame([("n5",), ("n8",), ("n5",), ("lost",)], "id string"), depth=depth)
        balls = [near({s}, depth) for s in ("n5", "n8", "lost")]
        assert {x["id"] for x in got.nodes.collect()} == set().union(*balls) & set(ids)
        assert sorted(tuple(x)[:3] for x in got.edges.collect()) == sorted(e for e in links if any({e[0], e[1]} <= b for b in balls))
    assert written and max(w.count() for w in written) < 40
