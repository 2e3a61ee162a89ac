import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, lexical_search, periodic_runs

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def runs_by_hand(x, least):
    best = {}
    for q in range(1, len(x) // 2 + 1):
        t = q
        while t < len(x):
            b = t
            while t < len(x) and x[t] == x[t - q]:
                t += 1
            if t - b + q >= max(least, 2 * q):
                best.setdefault((b - q, t), q)
            t += 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def some_text(r, n, k):
    x = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.7:
        a, p = r.randrange(n), r.randint(1, max(1, n // 3))
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    return x


def test_squares_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        x = some_text(r, r.randrange(0, 60), r.choice((1, 2, 3, 5, 30)))
        assert sorted((s, e - s, q) for (s, q), e in periodic_runs.squares(x).items()) == runs_by_hand(x, 2)
        w = [b"%d" % v for v in x]
        assert periodic_runs.runs_of([w, w[:7], w, []]) == [runs_by_hand(w, 12), [], runs_by_hand(w, 12), []]


def test_long_periods_and_powers():
    r = random.Random(2)
    base = [r.randrange(900) for _ in range(4000)]
    assert periodic_runs.squares(base * 5) .keys() >= {(0, 4000)}
    assert periodic_runs.squares([0] * 20000) == {(0, 1): 20000}
    fib, nxt = [0], [0, 1]
    while len(nxt) < 500:
        fib, nxt = nxt, nxt + fib
    assert sorted((s, e - s, q) for (s, q), e in periodic_runs.squares(nxt).items()) == runs_by_hand(nxt, 2)


def test_runs_of_rows_and_what_is_left(spark):
    long_ = " ".join(f"u{i}" for i in range(200_000)) + " x y z" * 50_000
    rows = [(1, "p q " + "a b c " * 5 + "z"), (1, "p q " + "a b c " * 5 + "z"), (None, "k " * 13), (2, None), (3, ""), (4, " \t\n"), (5, "ä " * 11), (6, long_)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit(1)).withColumn("Collapsed", F.lit("x"))
    got = Counter((r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"] if len(r["collapsed"]) < 99 else len(r["collapsed"])) for r in periodic_runs.periodic_runs(docs).collect())
    kept = len(long_) - len(" x y z") * 49_999
    assert got == Counter([(1, ((2, 15, 3),), "p q a b c z")] * 2 + [(None, ((0, 13, 1),), "k"), (2, (), ""), (3, (), ""), (4, (), ""), (5, (), " ".join("ä" * 11)), (6, ((200_000, 150_000, 3),), kept)])
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().astype({c: "Int64" for c in df.columns if c.endswith("_id")}))
    cur = con.execute(query)
    at = [c[0] for c in cur.description]
    return Counter(tuple(sorted(zip(at, row, strict=True))) for row in cur.fetchall())


def rows_of(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts with planted windows, copies, a null id and odd characters, and items of few words among them."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of", "É", "ß", "a1", "Ünï"]
    say = lambda n: "".join(r.choice(vocabulary) + r.choice((" ", "  ", ", ", "-", "\n", "_")) for _ in range(n))
    items = [(i, say(r.choice((3, 9, 10, 11, 25)))) for i in range(30)] + [(31, None), (32, " .,"), (33, "the"), (33, "the"), (None, "w1 w2 w3"), (34, "never said before")]
    texts = []
    for i in range(150):
        t = say(r.choice((0, 5, 40, 200)))
        if i % 3 == 0:
            w = (items[r.randrange(30)][1]).split(" ")
            t += " ".join(w[: r.randrange(3, 40)]).upper() + say(4)
        texts.append((i, t))
    rows = texts + texts[:20] + [(None, texts[3][1]), (900, None), (901, ""), (902, "The " * 400)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{at}/benchmark.parquet")
    return at, spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")


def test_queries_equal_their_sql(spark, corpus):
    at, docs, items = corpus
    for query, text in ((periodic_runs.op11_periodic_runs, periodic_runs.ORACLE), (decontaminate.op12_benchmark_decontamination, decontaminate.ORACLE), (lexical_search.op13_ranked_search, lexical_search.ORACLE)):
        known = docs if query is not periodic_runs.op11_periodic_runs else docs.where("doc_id is not null")
        if query is periodic_runs.op11_periodic_runs:
            known.write.mode("overwrite").parquet(f"{at}/known/documents.parquet")
        got = rows_of(query(spark, f"{at}/known" if known is not docs else at))
        assert got and got == sql(text, documents=known, benchmark=items)


def leaks_by_hand(text, items, size=10):
    at = [m.span() for m in WORD.finditer(lower(text))]
    w = [lower(text)[a:b] for a, b in at]
    hit, names = set(), set()
    for name, body in items:
        v = WORD.findall(lower(body or ""))
        for k in range(max(1, len(v) - size + 1) if v else 0):
            win = v[k : k + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    names.add("" if name is None else str(name))
    spans = []
    for j in sorted(hit):
        if spans and j - 1 in hit:
            spans[-1] = (spans[-1][0], at[j][1])
        else:
            spans.append(at[j])
    return len(w), len(hit), tuple(sorted(names)), tuple(spans)


def test_leaks_brute_force_in_one_and_many_automata(spark, corpus):
    _, docs, items = corpus
    rows, asked = docs.collect(), [(r["item_id"], r["text"]) for r in items.collect()]
    want = Counter((r["doc_id"], *leaks_by_hand(r["text"] or "", asked)) for r in rows)
    assert sum(k[2] > 0 for k in want) > 20
    for most in (1 << 20, 4000):
        got = decontaminate.contamination(docs.withColumn("items", F.lit(1)).withColumn("rid", F.lit(0)), items, most=most)
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(tuple(s) for s in r["spans"])) for r in got.collect()) == want
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}


def test_a_leak_at_the_end_of_a_text_of_some_megabytes(spark):
    text = "Straße ok. " * 300_000 + "One two; THREE four"
    docs = spark.createDataFrame([(1, text)], DOCS)
    got = decontaminate.contamination(docs, spark.createDataFrame([(7, "two three FOUR")], ITEMS)).head()
    (a, b), = got["spans"]
    assert (got["n_words"], got["n_hit"], got["items"], text[a:b]) == (600_004, 3, ["7"], "two; THREE four")


def scores_by_hand(rows, items, k):
    docs = [(i, WORD.findall(lower(t or ""))) for i, t in rows]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n_docs, length = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = Counter()
    for item, text in set(items):
        bag = Counter(WORD.findall(lower(text or "")))
        best = []
        for i, w, c in docs:
            m = 75 + 25 * len(w) * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in bag.items() if t in c)
            if score:
                best.append((-score, i is None, i or 0, i))
        out.update((item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(best, key=lambda x: x[:3])[:k], 1))
    return out


@pytest.mark.parametrize("settings", [{}, {"most": 900, "bundle": 7, "shard": 11}, {"owners": (1,), "shard": 40}, {"owners": (64, 16, 8, 4, 2, 1), "k": 3, "shard": 25}])
def test_search_brute_force(spark, corpus, settings):
    _, docs, items = corpus
    want = scores_by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], settings.get("k", 20))
    got = lexical_search.lexical_search(docs.withColumn("t", F.lit(1)).withColumn("RID", F.lit(0)), items.withColumn("i", F.lit(5)), **settings)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_search_without_rows(spark, corpus):
    _, docs, items = corpus
    assert lexical_search.lexical_search(docs.limit(0), items).count() == 0
    assert lexical_search.lexical_search(docs, items.limit(0)).count() == 0


def test_planted_texts_follow_the_rule(spark):
    r = random.Random(6)
    rows = [(i, " ".join(f"v{r.randrange(50)}" for _ in range(r.randrange(0, 40)))) for i in range(300)]
    got = {x["doc_id"]: x["t"] for x in spark.createDataFrame(rows, DOCS).select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    changed = 0
    for i, t in rows:
        h, w = zlib.crc32(str(i).encode()), t.split()
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
            changed += 1
        assert got[i].split() == w
    assert changed > 10
