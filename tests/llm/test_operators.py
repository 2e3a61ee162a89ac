import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import html_extract, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, token_counts, tokens, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (3, " \n\t ", "en", "s", 4), (None, "a b", None, None, 3), (4, "wörd " * 3000, "de", "t", 1), (4, "wörd " * 3000, "de", "t", 1)]


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("Text_Hash", F.lit(1)).withColumn("h", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_odd_rows_everywhere(spark, odd, empty):
    n = len(ODD)
    labels = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int").select("doc_id")
    for docs, m in ((odd, n), (empty, 0)):
        assert line_dedup.dedup_lines(docs, counts=True).count() == m
        assert quality_rules.judge(docs).count() == m
        assert token_counts.count_tokens(docs).select("doc_id").count() >= m
        assert quality_classifier.judge(docs, labels).count() == m
        assert near_dedup.classes(docs).count() == m
        assert toxicity.score_toxicity(docs, docs.withColumn("toxic", F.lit(1))).count() == m
        mixed = mixing.mix(docs)
        assert mixed.count() == m
        assert packing.pack_documents(docs).where("piece = 0").count() == m
        for out in (line_dedup.dedup_lines(docs), quality_classifier.keep_good(docs, labels), near_dedup.dedup(docs), mixing.apply_mix(docs, mixed)):
            assert out.columns == docs.columns
    assert near_dedup.dedup(odd).count() == 4


def test_line_dedup_keeps_the_first(spark):
    line = "all of this stays on every site"
    docs = spark.createDataFrame([(i, f"own line number {i}\n{line}", "en", f"s{i % 6}", 0) for i in range(12)], DOCS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_sites=5).collect()}
    assert got[0].endswith(line) and all(line not in got[i] for i in range(1, 12)) and got[5] == "own line number 5"
    assert all(line in r["text"] for r in line_dedup.dedup_lines(docs, min_sites=7).collect())


def test_repeated_words_brute_force(spark):
    r = random.Random(5)
    texts = [words(r, r.randrange(0, 60), r.choice((3, 8, 500))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["n_repeat_words"] for x in quality_rules.measure(docs).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + j for k, x in enumerate(g) if g.count(x) > 1 for j in range(3)})


def test_token_ids_are_the_tokenizer_s():
    r = random.Random(3)
    parts = list("ab c'd\n\t  .,!1²½é ß–’_<|>日\U0001f600́\x1c\x85") + ["'s", "  ", " \n", "<|endoftext|>", " 12", "the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 30))) for _ in range(3000)]
    e = tokens.encoder(tokens.default_path())
    assert e.ids(texts) == e._whole(texts)


def test_token_rules():
    n, cuts = np.array([2, 4, 2]), np.array([0, 3, 8])
    assert [token_counts.attribute(n, cuts, rule)[0].tolist() for rule in ("start", "end", "most")] == [[2, 1], [1, 2], [1, 2]]
    assert token_counts.attribute(n, cuts, "start")[1].tolist() == [1, 0]


def test_best_fit_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(30):
        cap = r.choice((10, 37, 100))
        items = [r.randrange(1, cap + 1) for _ in range(r.randrange(0, 200))]
        bins: list[int] = []
        for x in sorted(items, reverse=True):
            fit = [(room, i) for i, room in enumerate(bins) if room >= x]
            if fit:
                bins[min(fit)[1]] -= x
            else:
                bins.append(cap - x)
        counts = {x: items.count(x) for x in set(items)}
        plan, used = packing.best_fit(counts, cap), {}
        for length, _, n, first, offset in plan:
            for b in range(first, first + n):
                used.setdefault(b, []).append((offset, length))
        assert len(used) == len(bins) and sorted(sum(y for _, y in x) for x in used.values()) == sorted(cap - b for b in bins)
        for x in used.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length
            assert at <= cap


def test_packing_round_trip(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, words(r, r.choice((0, 3, 50, 900)))) for i in range(80)], "doc_id long, text string")
    rows = packing.pack_documents(docs, with_ids=True, capacity=64).collect()
    e = tokens.encoder(tokens.default_path())
    by: dict = {}
    for x in rows:
        assert x["length"] == len(x["ids"]) <= 64 and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        by.setdefault(x["doc_id"], []).append((x["start"], x["ids"]))
    for d in docs.collect():
        assert sum((i for _, i in sorted(by[d["doc_id"]])), []) == np.frombuffer(e.ids([d["text"]])[0], "<u4").tolist() + [2]
    for s in {x["sequence_id"] for x in rows}:
        own = sorted((x["offset"], x["length"]) for x in rows if x["sequence_id"] == s)
        assert [o for o, _ in own] == np.concatenate(([0], np.cumsum([n for _, n in own])[:-1])).tolist() and sum(n for _, n in own) <= 64


def test_mix_targets(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, words(r, r.randrange(1, 40)), "en", r.choice("aaaab") if i % 9 else None, 0) for i in range(900)], DOCS)
    rows = mixing.mix(docs).collect()
    sizes = {x["source"]: x["source_size"] for x in rows}
    target = {x["source"]: x["target"] for x in rows}
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(target[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    for s in sizes:
        own = [x for x in rows if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - target[s]) <= 40 and all(x["copies"] in (0, 1, 2) for x in own)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    out = mixing.apply_mix(docs, mixing.mix(docs))
    assert out.count() == sum(x["copies"] for x in rows)


def test_bit_sliced_search_is_exact(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 8))
    x[5] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 7 = 0"), block=64, chunk=16).collect()
    v = np.floor(x * 256).astype("i8")
    for q in range(0, 400, 7):
        s = v @ v[q]
        want = sorted((-int(s[i]), i) for i in range(400) if i != q)[:5]
        assert [(-y["score"], y["vec_id"]) for y in sorted((y for y in got if y["query_id"] == q), key=lambda y: y["rank"])] == want


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_alignment():
    r = random.Random(6)
    pairs, most = [], []
    for _ in range(400):
        a = [r.randrange(5) for _ in range(r.randrange(60))]
        b = [r.randrange(5) for _ in range(r.randrange(60))] if r.random() < 0.5 else [x for x in a if r.random() < 0.8]
        pairs.append((np.array(a, "u8"), np.array(b, "u8")))
        most.append(r.randrange(0, 50))
    for (a, b), m, d in zip(pairs, most, near_dedup.distances(pairs, most), strict=True):
        assert d == min(lev(a.tolist(), b.tolist()), m + 1)


def test_components_brute_force(spark):
    r = random.Random(8)
    links = [(bytes([r.randrange(120)]), bytes([r.randrange(120)])) for _ in range(90)] + [(bytes([200 + i]), bytes([201 + i])) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[find(a)] = find(b)
    got = {bytes(x["h"]): bytes(x["root"]) for x in near_dedup.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got.keys() == {x for l in links if l[0] != l[1] for x in l}
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x in got for y in got)


def test_near_copies_meet_and_others_do_not(spark):
    r = random.Random(9)
    rows, group = [], {}
    for g in range(12):
        base = words(r, r.choice((40, 150, 400)), 5000).split()
        for c in range(8):
            w = [f"x{r.random()}" if r.random() < 0.03 else x for x in base]
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    passage = words(r, 60, 5000)
    for _ in range(60):
        group[len(rows)] = len(rows) + 1000
        rows.append((len(rows), words(r, 45, 5000) + " " + passage + " " + words(r, 45, 5000)))
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[a] == got[b]) == (group[a] == group[b]) for a in group for b in group)


def test_scattered_edits_share_a_sketch():
    r = np.random.default_rng(4)
    met = 0
    for _ in range(300):
        a = r.integers(1, 1 << 62, r.integers(70, 400)).astype("u8")
        b = a.copy()
        b[r.permutation(len(a))[: len(a) // 5]] = r.integers(1, 1 << 62, len(a) // 5)  # edit similarity 0.8 at least
        met += bool((near_dedup.sketches_of(a) == near_dedup.sketches_of(b)).any())
    assert met >= 0.93 * 300


def test_wrapper_drops_what_a_host_repeats(spark):
    page = lambda i: f"<html><body><div class='top'>Daily News</div><div><p>Story {i} told &amp; retold</p><p>More of {i}</p><div>Follow us now</div></div><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(15)] + [(20, "http://solo.org", "<p>One<p>Two<br>three"), (21, None, None)], "page_id long, url string, html string")
    for limit in (html_extract.SENT_BYTES, -1):
        html_extract.SENT_BYTES, keep = limit, html_extract.SENT_BYTES
        try:
            got = {x["page_id"]: x["text"] for x in html_extract.extract_pages(pages).collect()}
        finally:
            html_extract.SENT_BYTES = keep
        assert got[3] == "Story 3 told & retold\nMore of 3" and got[20] == "One\nTwo three" and got[21] == ""


def test_simple_tree_matching():
    t = lambda label, *c: [label, 0, 1, list(c)]
    n, pairs = html_extract.match([t("a"), t("b", t("x")), t("c")], [t("b", t("x")), t("d"), t("c")])
    assert n == 3 and pairs == [(1, 0), (2, 2)]


def _texts(pages: list[str]) -> list[str]:
    wrapper = None
    for p in pages:
        own = html_extract.wrapper_of(p, html_extract.parse(p))
        wrapper = html_extract.merged(wrapper, own) if wrapper else own
    return [html_extract.extract(html_extract.parse(p), wrapper) for p in pages]


def test_wrapper_has_no_bound_by_position():
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    # names of one page each, with digits, as slugs and as words that no rule knows
    for name in (lambda i: f"id='post-{i}'", lambda i: f"id='a-slug-{word(i)}'", lambda i: f"class='{word(i)}'"):
        pages = [f"<body><div {name(i)}>Story {i}</div><ul><li>Follow us</li></ul></body>" for i in range(900)]
        wrapper = None
        for p in pages:
            own = html_extract.wrapper_of(p, html_extract.parse(p))
            wrapper = html_extract.merged(wrapper, own) if wrapper else own
        assert len(wrapper["tree"][3][0][3]) < 8 * html_extract.RARE
        assert [html_extract.extract(html_extract.parse(p), wrapper) for p in pages[::100]] == [f"Story {i}" for i in range(0, 900, 100)]


def test_all_sibling_runs_of_a_page_are_aligned():
    story = lambda i: "".join(f"<h3>Head {i} {j}</h3><p>Text {i} {j}</p>" for j in range(450 + i))
    got = _texts([f"<body>{story(i)}<div>Follow us</div></body>" for i in range(12)])
    assert all("Follow us" not in x and x.endswith(f"Text {i} {449 + i}") for i, x in enumerate(got))


def test_halved_alignment_is_as_large(monkeypatch):
    r = random.Random(5)
    tree = lambda d: [r.choice("abc"), 0, 1, [tree(d - 1) for _ in range(r.randrange(3))] if d else [], 0]
    for _ in range(40):
        a, b = ([tree(2) for _ in range(r.randrange(12))] for _ in "ab")
        monkeypatch.setattr(html_extract, "CELLS", 1 << 22)
        whole = html_extract.match(a, b)[0]
        monkeypatch.setattr(html_extract, "CELLS", 4)
        n, pairs = html_extract.match(a, b)
        assert n == whole and pairs == sorted(pairs) and all(a[i][0] == b[j][0] for i, j in pairs)


def test_a_name_alone_drops_nothing():
    text = lambda page: html_extract.extract(html_extract.parse(page), None)
    long = "<p>" + "The reform passed the house. " * 30 + "</p>"
    said = "The reform passed the house. " * 29 + "The reform passed the house."
    for inner in (f"<article>{long}</article>", f"<main>{long}</main>", long):
        assert text(f"<body><div class='site has-sidebar'>{inner}</div></body>") == said
        assert text(f"<body><div class='sidebar'>{inner}</div></body>") == said
    assert text(f"<form id='form'><article>{long}</article></form>") == said
    assert text("<article><div class='article-header'><h1>Title</h1></div><section id='social-reform'><h2>Social reform</h2><p>One.</p></section><h2 id='related-work'>Related work</h2><p>See <a class='related-item' href='/x'>this</a> one.</p></article>") == "Title\nSocial reform\nOne.\nRelated work\nSee this one."
    # the element's own text agrees with the name
    links = "<a href='/a'>More of this</a> <a href='/b'>More of that</a>"
    for noise in (f"<div class='related-posts'>{links}</div>", "<div class='ad'>Buy now</div>", "<div class='cookie-banner'>We use cookies</div>", f"<ul class='menu'><li>{links}</li></ul>", "<a class='share' href='/s'>Share</a>"):
        assert text(f"<body>{long}{noise}</body>") == said and text(f"<article>{long}{noise}</article>") == said
    assert text(f"<body><div class='sidebar'><article>Teaser</article></div><article>{long}</article></body>") == said
    # or its place on the host's pages does
    story = lambda i: f"Story {i} goes on and on. " * 80
    talk = [f"<body><p>{story(i)}</p><div class='comments'><h3>Said {i}</h3>{f'<p>I say {i} to this.</p>' * 30}</div></body>" for i in range(12)]
    assert _texts(talk) == [story(i).strip() for i in range(12)] and "I say 3" in text(talk[3])


def test_few_pages_make_a_wrapper_and_copies_do_not(spark):
    r = random.Random(3)
    page = lambda text: f"<body><div class='top'>Daily News</div><div><p>{text}</p></div></body>"
    texts = [words(r, 40) for _ in range(6)]
    hosts = {
        "three": texts[:3],
        "two": texts[:2],
        "near": [f"{texts[0]} at {i}" for i in range(12)],
        "same": [texts[0]] * 8 + texts[1:3],
    }
    rows = [(h, i, t) for h, ts in hosts.items() for i, t in enumerate(ts)]
    # text in its own element that only the copies have
    html = lambda h, t: page(t).replace("</p>", "</p><h3>Only here</h3>") if h == "same" and t == texts[0] else page(t)
    pages = spark.createDataFrame([(f"{h}{i}", f"http://{h}.org/{i}", html(h, t)) for h, i, t in rows], "page_id string, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_extract.extract_pages(pages).collect()}
    for h, i, t in rows:
        want = {"three": t, "same": f"Daily News\n{t}" + ("\nOnly here" if t == texts[0] else "")}.get(h, f"Daily News\n{t}")
        assert got[f"{h}{i}"] == want


def test_kneser_ney_sums_to_one_and_both_paths_agree(spark):
    r = random.Random(7)
    good = [(i, " ".join(r.choice(("the", "cat", "sat", "on", "a", "mat")) for _ in range(30)), "en") for i in range(60)]
    docs = spark.createDataFrame(good + [(100, "ZQ#! XJ%% QQ!! ##", "en"), (101, "", "en")], "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 50").select("doc_id")
    a = {x["doc_id"]: x for x in quality_classifier.judge(docs, trusted).collect()}
    b = {x["doc_id"]: x for x in quality_classifier.judge(docs, trusted, sent_rows=-1).collect()}
    assert not a[100]["kept"] and not a[101]["kept"] and sum(a[i]["kept"] for i in range(60)) >= 55
    assert all(x == 101 or a[x]["perplexity"] == pytest.approx(b[x]["perplexity"], rel=1e-4) for x in a)
    grams = quality_classifier.count_grams(spark.createDataFrame([("abracadabra" * 3, True)], "text string, train boolean"))
    some = [("dabr" + c, 0) for c in "bcdr"] + [("dabrZ", 0)]
    extra = spark.createDataFrame(some, "g string, c long").join(grams, "g", "left_anti")
    p = {x["g"]: np.exp(x["lp"]) for x in quality_classifier.resolve(grams.unionByName(extra)).collect()}
    assert sum(v for g, v in p.items() if g.startswith("dabr")) == pytest.approx(1, abs=1e-6)


def test_counterfactual_penalty_shrinks_identity_terms():
    memo, swap = toxicity._Features(), toxicity.swaps()
    texts = [(f"the women are {w} today number {i}", 1 if w == "awful" or i % 3 else 0) for i in range(120) for w in ("awful", "fine")]
    texts += [(f"the men are {w} today number {i}", int(w == "awful")) for i in range(120) for w in ("awful", "fine")]
    rows = [(toxicity.features(t, memo), toxicity.features(t, memo, swap), y) for t, y in texts]
    gap = []
    for penalty in (0.0, 50.0):
        w, b = toxicity.fit(rows, penalty)
        score = lambda t: 1 / (1 + np.exp(-(b + w[toxicity.features(t, memo)].sum())))  # noqa: B023, E731
        gap.append(abs(score("the women are fine") - score("the men are fine")))
        assert score("they are awful") > score("they are fine")
    assert gap[1] < 0.5 * gap[0]


def test_toxicity_gradient_brute_force():
    r = np.random.default_rng(3)
    lists = [[np.unique(r.integers(0, 9, 4)).astype("i4") for _ in range(7)] for _ in range(3)]
    x, gone, new = map(toxicity.Rows, lists)
    y, w, b = r.integers(0, 2, 7).astype("f8"), r.normal(size=9), 0.3
    y[:2] = 0, 1
    value = lambda w, b: toxicity.loss(w, b, x, gone, new, y, 0.7, 0.1)[0]
    score = lambda i: w[lists[0][i]].sum() + b
    weight = [0.5 / (y == t).sum() for t in y]
    want = sum(weight[i] * np.log1p(np.exp(-score(i) if y[i] else score(i))) for i in range(7))
    want += 0.7 * np.mean([(w[lists[1][i]].sum() - w[lists[2][i]].sum()) ** 2 for i in range(7)]) + 0.05 * (w**2).sum()
    got, g, gb = toxicity.loss(w, b, x, gone, new, y, 0.7, 0.1)
    assert got == pytest.approx(want) and gb == pytest.approx((value(w, b + 1e-6) - value(w, b - 1e-6)) / 2e-6, abs=1e-6)
    for k in range(9):
        e = np.eye(9)[k] * 1e-6
        assert g[k] == pytest.approx((value(w + e, b) - value(w - e, b)) / 2e-6, abs=1e-6)


def test_penalty_shrinks_the_gap_of_group_mentions(spark):
    # "muslim" comes with the label more often than "christian" does, and says nothing by itself
    r = random.Random(2)
    rows = []
    for i in range(600):
        bad = i % 2
        group = "muslim" if r.random() < (0.7 if bad else 0.3) else "christian"
        rows.append((i, f"my {group} neighbour {'' if r.random() < 0.5 else 'is awful' if bad else 'is lovely'} {words(r, 12, 60)}", bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "a muslim neighbour"), (2, "a christian neighbour"), (3, "so awful"), (4, "so lovely"), (5, None)], "doc_id long, text string")
    gap = []
    for penalty in (0.0, 30.0):
        s = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(asked, docs, penalty=penalty).collect()}
        gap.append(abs(s[1] - s[2]))
        assert s[3] > s[4] + 0.2
    assert gap[0] > 0.05 and gap[1] < 0.3 * gap[0]


def kneser_ney(texts, n):
    """Probability of the last character of a window of n: modified Kneser-Ney, straight from its definition."""
    from collections import Counter

    levels = {n: Counter(t[i : i + n] for t in ("\x02" * (n - 1) + t for t in texts) for i in range(len(t) - n + 1))}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def cut(k, c):
        n1, n2, n3, n4 = (sum(v == i for v in levels[k].values()) for i in (1, 2, 3, 4))
        if not n1 or not n2:
            return 0.5
        y, i = n1 / (n1 + 2 * n2), min(c, 3)
        d = {1: 1 - 2 * y * n2 / n1, 2: 2 - 3 * y * n3 / n2, 3: 3 - 4 * y * n4 / n3 if n3 else 1.5}[i]
        return min(max(d, 0.05), i - 1 + 0.95)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(levels[1]) + 1)
        after = {x: c for x, c in levels[k].items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        c, total = levels[k][g], sum(after.values())
        return (max(c - cut(k, c), 0) if c else 0) / total + sum(cut(k, x) for x in after.values()) / total * p(g[1:])

    return p


def test_kneser_ney_brute_force(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("aabc de") for _ in range(r.randrange(1, 40))) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(90, "zebra ade", "en"), (91, None, None)], "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 20").select("doc_id")
    model = kneser_ney([texts[i] for i in range(20) if zlib.crc32(str(i).encode()) % 5], quality_classifier.ORDER)
    for sent in (quality_classifier.SENT_ROWS, -1):
        got = {x["doc_id"]: x for x in quality_classifier.judge(docs, trusted, sent_rows=sent).collect()}
        for i, t in [*enumerate(texts), (90, "zebra ade")]:
            full = "\x02" * 4 + t
            want = np.exp(-np.mean([np.log(model(full[k : k + 5])) for k in range(len(t))]))
            assert got[i]["n_scored"] == len(t) and got[i]["perplexity"] == pytest.approx(want, rel=1e-9)
        assert got[91]["perplexity"] is None and not got[91]["kept"]


def test_window_counts_do_not_depend_on_chunks(spark, monkeypatch):
    r = random.Random(12)
    texts = ["".join(r.choice("ab cé\U0001f600") for _ in range(n)) for n in (0, 1, 4, 5, 300, 7)]
    docs = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "text string, train boolean").coalesce(1)
    want = sorted(map(tuple, quality_classifier.count_grams(docs).collect()))
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t)):
            g = ("\x02" * 4 + t)[k : k + 5]
            seen[g] = seen.get(g, 0) + (i % 2 == 0)
    assert want == sorted(seen.items())


def test_search_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, V string, part int, query_id int, score int"
    few = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, 2.0]), (3, [2.0, 2.0]), (4, [-1.0]), (5, []), (5, []), (6, []), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [-1.0, 0.0]), (100, [3.0]), (7, None), (8, [float("inf"), 0.0]), (9, [None, 1.0]), (150, [])]
    df = spark.createDataFrame([(i, v, "x", 1, 1, 1) for i, v in few], kind)
    sound = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in few if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for block in (1, 2, 64):
        got = {}
        for x in topk.top_k(df, df.where("vec_id % 50 = 0"), block=block, k=3).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
        want = {}
        for q, v in {(i, tuple(v)) for i, v in sound if i is not None and i % 50 == 0}:
            s = [(-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for i, w in sound if len(w) == len(v) and i != q]
            want.setdefault(q, []).extend((r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(s)[:3], 1))
        assert {q: sorted(x, key=str) for q, x in got.items()} == {q: sorted(x, key=str) for q, x in want.items() if x}
    assert topk.top_k(df.limit(0), df, k=2).count() == 0 == topk.top_k(df, df.limit(0)).count()
    big = spark.createDataFrame([(50, [1e15]), (51, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(big, big.where("vec_id = 50")).collect()
    far = spark.createDataFrame([(50, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 2"):
        topk.top_k(far, far).collect()
    # scores near the ends of a long are exact
    edge = spark.createDataFrame([(50, [11184810.0, -3.0]), (51, [11184810.5, 7.25]), (52, [-11184810.5, 7.25])], "vec_id long, embedding array<double>")
    got = [(x["vec_id"], x["score"]) for x in topk.top_k(edge, edge.where("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(51, 2863311360 * 2863311488 - 768 * 1856), (52, -2863311360 * 2863311488 - 768 * 1856)]


def mixed_by_hand(rows, seed=7):
    """Words taken of each (id, size, source): the rule of the docstring, one document after the other."""
    import hashlib

    by: dict = {}
    for i, size, s in rows:
        by.setdefault(s, []).append((i, size))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(z for _, z in by[s]) for s in names}
    w = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while over := [s for s in open_ if w[s] * left / sum(w[x] for x in open_) >= 2 * total[s]]:
        for s in over:
            target[s] = 2.0 * total[s]
            open_.discard(s)
        left = 1.5 * sum(total.values()) - sum(target.values())
    target |= {s: w[s] * left / sum(w[x] for x in open_) for s in open_}
    taken = {}
    for s in names:
        whole = int(target[s] / total[s] + 1e-12) if total[s] else 0
        rest, p, some = target[s] - whole * total[s], {}, sorted(((z, i) for i, z in by[s] if z), reverse=True)
        certain = 0
        while certain < len(some):
            slope = (rest - sum(z for z, _ in some[:certain])) / sum(z * z for z, _ in some[certain:])
            if slope * some[certain][0] <= 1:
                break
            certain += 1
        for k, (z, i) in enumerate(some):
            p[i] = 1.0 if k < certain else slope * z
        assert rest <= 0 or certain == len(some) or sum(p[i] * z for z, i in some) == pytest.approx(rest)
        u = {i: ((int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16)) + 0.5) / 16**12 for _, i in some}
        order = sorted((u[i] / (1 - u[i]) * ((1 - p[i]) / p[i]), i, z) for z, i in some) if rest > 0 else []
        got, chosen = 0, set()
        for _, i, z in order:
            if got + z > rest:
                break
            got += z
            chosen.add(i)
        more = [(abs(rest - got - z), q, i) for q, i, z in order if i not in chosen]
        if more and min(more)[0] < rest - got:
            chosen.add(min(more)[2])
        taken |= {i: z * (whole + (i in chosen)) for i, z in by[s]}
    return taken, target


def test_mix_brute_force(spark):
    r = random.Random(21)
    sizes = [(i, r.choice((0, 1, 3, 10, 30, 400)) if i % 50 else 3000, r.choice("aaaaabbcd") if i % 11 else None) for i in range(700)]
    docs = spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, n, s in sizes], DOCS)
    want, target = mixed_by_hand(sizes)
    rows = mixing.mix(docs).collect()
    assert {x["doc_id"]: x["taken"] for x in rows} == want and all(x["target"] == pytest.approx(target[x["source"]]) for x in rows)
    for s, t in target.items():  # one document of 3,000 words does not spoil a source
        assert abs(sum(x["taken"] for x in rows if x["source"] == s) - t) <= 0.01 * t


def test_mix_chooses_in_proportion_to_size(spark):
    docs = spark.createDataFrame([(i, "w " * (10 if i % 2 else 90), "en", "one", 0) for i in range(2000)] + [(5000 + i, "w " * 100, "en", "two", 0) for i in range(3000)], DOCS)
    more = {10: 0, 90: 0}
    for x in mixing.mix(docs, weights=(1, 3), share=0.6).where("source = 'one'").collect():
        more[x["size"]] += x["copies"]
    # 60,000 words of 1 in 4: p is slope * size, so long ones are taken nine times as often
    assert 6 < more[90] / more[10] < 13


def _site(r, i):
    menu = "".join(f"<li><a href='/{j}'>{words(r, 1)}</a></li>" for j in range(6))
    story = "".join(f"<div>{words(r, r.randrange(20, 60))}</div>" for _ in range(r.randrange(1, 9)))
    said = f"<body><ul>{menu}</ul><div class='x'>{words(r, 7)}</div><section><h1>Head {i}</h1>{story}</section><div class='y'>{words(r, 5)} <a href='/'>{words(r, 2)}</a></div></body>"
    return said, "\n".join([f"Head {i}", *(x.removesuffix("</div>") for x in story.split("<div>")[1:])])


def test_wrapper_finds_the_content_without_any_list(monkeypatch):
    # neither class names nor kinds of elements say what is a menu here, and no word of it repeats
    for name in ("NOISE", "MAIN", "DROPPED"):
        monkeypatch.setattr(html_extract, name, frozenset())
    r = random.Random(31)
    pages, want = zip(*(_site(r, i) for i in range(40)), strict=True)
    assert _texts(list(pages)) == list(want)
    alone = [html_extract.extract(html_extract.parse(p), None) for p in pages]
    assert all(a != w and w in a for a, w in zip(alone, want, strict=True))


def _full_site(r):
    """A page with headings, a list of links, a table and labels that are the article's own, and a notice and related links that aren't; the lines of its article."""
    say = lambda n: words(r, n, 9000) + "."
    head, last, note, end = say(5), say(25), say(40), say(12)
    first = [say(30) for _ in range(r.randint(1, 3))]
    links, cells = [say(4) for _ in range(6)], [say(2) for _ in range(6)]
    body = f"<h1>{head}</h1>" + "".join(f"<p>{t}</p>" for t in first) + "<p>We use your data to make this site better for all.</p>"
    body += f"<h2>Summary</h2><p>{last}</p><ul>" + "".join(f"<li><a href='/{t}'>{t}</a></li>" for t in links) + "</ul>"
    body += f"<section><h2>Conclusion</h2><p><b>Note:</b> {note}</p><p>{end}</p></section>"
    body += "<table><tr><th>Name</th><th>What</th></tr>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2], strict=True)) + "</table>"
    body += "<h3>You may also like</h3><ul>" + "".join(f"<li><a href='/r'>{say(4)}</a></li>" for _ in range(4)) + "</ul>"
    page = f"<html><body><div class='top'><a href='/'>home</a> <a href='/n'>news</a></div><div class='wrap'><div class='content'>{body}</div><div class='side'><p>{say(6)}</p></div></div><div class='bottom'>made by us</div></body></html>"
    return page, "\n".join([head, *first, "Summary", last, *links, "Conclusion", f"Note: {note}", end, "Name", "What", *cells])


@pytest.mark.parametrize("lists", [True, False])
def test_articles_keep_their_headings_links_and_tables(monkeypatch, lists):
    for name in () if lists else ("NOISE", "MAIN", "DROPPED"):
        monkeypatch.setattr(html_extract, name, frozenset())
    for seed in range(3):
        r = random.Random(seed)
        pages, want = zip(*(_full_site(r) for _ in range(20)), strict=True)
        assert _texts(list(pages)) == list(want)


def test_large_hosts_share_wrappers(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SHARED", 7)
    monkeypatch.setattr(html_extract, "SENT_BYTES", -1)
    r = random.Random(5)
    made = [(i, f"http://h{i % 3 if i < 60 else 0}.org/{i}", *_full_site(r)) for i in range(80)]
    for many in (0, 100):
        monkeypatch.setattr(html_extract, "MANY", many)
        got = html_extract.extract_pages(spark.createDataFrame([x[:3] for x in made], "page_id long, url string, html string"))
        assert {x["page_id"]: x["text"] for x in got.collect()} == {i: want for i, _, _, want in made}


def test_one_odd_page_does_not_spoil_a_constant():
    page = lambda i, note: f"<body><div><p>Story {i} as told</p><p>More {i}</p><div>{note}</div></div></body>"
    got = _texts([page(i, "Sign up here" if i != 7 else "Nothing to see") for i in range(20)])
    assert got[3] == "Story 3 as told\nMore 3" and got[7] == "Story 7 as told\nMore 7\nNothing to see"


def test_constant_members_of_long_runs_go(spark):
    # 90 paragraphs a page, of which six are on all pages, and one from the page on that ``since`` says
    notes = [f"House note {k}, the same words on every page" for k in range(6)]
    own = lambda i: [f"Story {i} part {j}" for j in range(84)]
    late = lambda i, since: ["A late note, also longer than what varies"] if i >= since else []
    page = lambda i, since: "<body><div>" + "".join(f"<p>{t}</p>" for t in [*own(i)[:40], *notes, *own(i)[40:], *late(i, since)]) + "</div></body>"
    assert _texts([page(i, 99) for i in range(12)]) == ["\n".join(own(i)) for i in range(12)]
    wrapper = None
    for i in range(400):
        one = html_extract.wrapper_of(page(i, 70), html_extract.parse(page(i, 70)))
        wrapper = html_extract.merged(wrapper, one) if wrapper else one
    assert html_extract.extract(html_extract.parse(page(3, 0)), wrapper) == "\n".join(own(3))
    run = wrapper["tree"][3][0][3][0][3][0]
    assert run[0] == "p" and len(run[7]) <= 91 * html_extract.RARE and len(html_extract._settled(wrapper["tree"])[3][0][3][0][3][0][7]) == 7
    rows = [(i, "http://a.example/x", page(i, 99)) for i in range(12)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {x["page_id"]: x["text"] for x in got} == {i: "\n".join(own(i)) for i in range(12)}


def test_wrappers_count_alike_in_any_order():
    r = random.Random(32)
    pages = [_site(r, i)[0] for i in range(30)]
    texts = []
    for _ in range(3):
        r.shuffle(pages)
        parts = []
        for lo in range(0, 30, 7):
            w = None
            for p in pages[lo : lo + 7]:
                own = html_extract.wrapper_of(p, html_extract.parse(p))
                w = html_extract.merged(w, own) if w else own
            parts.append(w)
        whole = parts[0]
        for w in parts[1:]:
            whole = html_extract.merged(whole, w)
        texts.append({p: html_extract.extract(html_extract.parse(p), whole) for p in pages})
    assert texts[0] == texts[1] == texts[2]


def test_deep_wide_and_broken_pages_give_rows(spark):
    import time

    deep, wide = "<div>" * 100_000 + "deep end", "<p>x" * 50_000
    quotes, inline = '<a "' * 100_000, "<b>" * 50_000 + "<i></span></p><p>" * 20_000 + "end"
    began = time.time()
    pages = [deep, wide, quotes, inline, quotes + ">", "<p>a<b", "", "<div><p>one</div>two<script>if (a < b) {</script>", "<![CDATA[a<b]]>"]
    df = spark.createDataFrame([(i, "http://odd.org/", p, 1, "x") for i, p in enumerate(pages)] + [(0, "http://odd.org/", deep, 1, "x"), (None, None, None, None, None)], "page_id long, url string, html string, id int, Host string")
    got = {x["page_id"]: x for x in html_extract.extract_pages(df).collect()}
    assert html_extract.extract_pages(df).count() == len(pages) + 2 and html_extract.extract_pages(df.limit(0)).count() == 0
    assert time.time() - began < 120
    assert got[0]["text"] == "deep end" and got[1]["text"] == "\n".join("x" * 50_000) and got[3]["text"].endswith("end")
    assert [got[i]["text"] for i in (5, 6, 7, 8)] == ["a<b", "", "one\ntwo", "a<b"] and got[None]["n_chars"] == 0
    assert got[2]["text"] == quotes and got[1]["n_chars"] == 99_999


def test_pages_share_tags_and_shapes(monkeypatch):
    r = random.Random(34)
    pages = [_site(r, i)[0] for i in range(30)]
    wrapper = None
    for p in pages:
        own = html_extract.wrapper_of(p, html_extract.parse(p))
        wrapper = html_extract.merged(wrapper, own) if wrapper else own
    alone = [html_extract.extract(html_extract.parse(p), dict(wrapper)) for p in pages]
    made, split, words = [], [], html_extract._SPLIT_NAME
    shapes = html_extract._Shapes
    monkeypatch.setattr(html_extract, "_Shapes", lambda *x: made.append(1) or shapes(*x))
    monkeypatch.setattr(html_extract, "_SPLIT_NAME", type("", (), {"split": lambda self, x: split.append(x) or words.split(x)})())
    tags = {}
    assert [html_extract.extract(html_extract.parse(p, tags), wrapper) for p in pages] == alone
    # one numbering of the wrapper, and each source of a tag read once
    assert len(made) == 1 and len(split) <= 4 * len(tags) and len(tags) < html_extract.TAGS

    # what pages leave behind is bounded by the wrapper, and what tags leave behind by their number
    monkeypatch.setattr(html_extract, "TAGS", 8)
    tags = {}
    for i in range(300):
        page = "<body>" + "".join(f"<{r.choice(['div', 'p', 'ul'])} class='c{i} {'abc'[i % 3] * (i % 7)}'>x</div>" for _ in range(9)) + "</body>"
        html_extract.extract(html_extract.parse(page, tags), wrapper)
        assert len(tags) <= 8 and wrapper["shapes"].held <= wrapper["shapes"].most + 200


def test_tags_are_read_alike_on_both_ways(monkeypatch):
    r = random.Random(35)
    bits = ["<", ">", '"', "'", "</", "/>", "<!--", "-->", "<![CDATA[", "]]>", " ", "\n", "&lt", "a", "<p>", "<div>", "</div>", "<DIV class='Menu > top'>", "<b\"c>", "<a href=x>", "</a>", "<br/>", "<script>", "</SCRIPT >", "</p \"", "<a <b>", "< p>"]
    show = lambda x: [x.label, x.silent, x.noise, x.named, x.depth, [c if isinstance(c, str) else show(c) for c in x.children if c]]
    pages, tags = ["".join(r.choice(bits) for _ in range(r.randrange(50))) for _ in range(500)], {}
    got = [show(html_extract.parse(p, tags)) for p in pages]
    monkeypatch.setattr(html_extract, "_PIECE", re.compile(r"(?!)"))
    assert got == [show(html_extract.parse(p)) for p in pages]


def test_quoted_ends_of_tags_are_looked_for_once():
    began = time.process_time()
    for odd in ("<a '>'", "<b '>' \""):
        root = html_extract.parse(odd * 20_000)
        assert root.children
    assert time.process_time() - began < 20


def test_simple_tree_matching_brute_force():
    def largest(a, b):  # of two forests, straight from its definition
        if not a or not b:
            return 0
        pair = 1 + largest(a[-1][3], b[-1][3]) if a[-1][0] == b[-1][0] else 0
        return max(largest(a[:-1], b), largest(a, b[:-1]), largest(a[:-1], b[:-1]) + pair)

    r = random.Random(33)
    tree = lambda d: [r.choice("abc"), 0, 1, [tree(d - 1) for _ in range(r.randrange(4))] if d else [], 0]
    for _ in range(60):
        a, b = ([tree(2) for _ in range(r.randrange(5))] for _ in "ab")
        assert html_extract.match(a, b)[0] == largest(a, b)


def test_token_counts_brute_force(spark):
    r = random.Random(51)
    parts = ["ab", "é", "日本", " the", "\n", "\n\n", "x\n", " y", "\U0001f600", "'s", "  ", "<|endoftext|>"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, section int, N_tokens string")
    e = tokens.encoder(tokens.default_path())
    for rule, cut in (("start", "\n"), ("end", "\n"), ("most", " "), ("start", "\n\n")):
        got = sorted(tuple(x[:6]) for x in token_counts.count_tokens(docs, rule=rule, sections=cut).collect())
        want = []
        for i, t in rows:
            t = t or ""
            split = t.split(cut)
            own = [x + cut for x in split[:-1]] + [split[-1]]
            spans, at, chars = [], 0, 0
            for x in own:
                spans.append((at, at + len(x.encode()), chars, len(x)))
                at, chars = at + len(x.encode()), chars + len(x)
            n, crossing = [0] * len(own), [0] * len(own)
            at = 0
            for k in np.frombuffer(e.ids([t])[0], "<u4"):
                size = e.byte_lengths()[k]
                share = [max(0, min(b, at + size) - max(a, at)) for a, b, _, _ in spans]
                hit = [s for s, x in enumerate(share) if x]
                to = hit[0] if rule == "start" else hit[-1] if rule == "end" else share.index(max(share))
                n[to] += 1
                crossing[to] += len(hit) > 1
                at += size
            want += [(i, s, c, m, n[s], crossing[s]) for s, (_, _, c, m) in enumerate(spans)]
        assert got == sorted(want)


def test_near_duplicates_recall_brute_force(spark):
    """Pairs at similarity 0.8 to 0.9, of every length on both sides of 64 words: at least nine in ten meet, and nothing else does."""
    r = random.Random(61)
    rows, pairs = [], []
    for n in [12, 20, 30, 45, 60, 62, 64, 65, 66, 68, 70, 90, 130, 200] * 6:
        a = words(r, n, 3000).split()
        b = list(a)
        for k in r.sample(range(n), max(1, int(n * r.choice((0.1, 0.15, 0.2))))):
            b[k] = f"new{r.random()}"
        pairs.append((len(rows), len(rows) + 1, n))
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    linked = [(a, b, n) for a, b, n in pairs if lev(texts[a].split(), texts[b].split()) <= near_dedup.limit(n, 0.8)]
    met = [(a, b, n) for a, b, n in linked if got[a] == got[b]]
    assert len(linked) == len(pairs) and len(met) >= 0.9 * len(linked)
    for some in ([x for x in linked if 60 <= x[2] <= 64], [x for x in linked if 65 <= x[2] <= 70]):
        assert sum(got[a] == got[b] for a, b, _ in some) >= 0.85 * len(some)
    assert all(got[a] == a for a, _, _ in pairs) and all(got[b] in (a, b) for a, b, _ in pairs)


def test_one_jump_is_never_below_the_distance():
    r = random.Random(71)
    for _ in range(400):
        a = [r.randrange(6) for _ in range(r.randrange(0, 30))]
        b = [x for x in a if r.random() < 0.9] if r.random() < 0.7 else [r.randrange(6) for _ in range(r.randrange(0, 30))]
        got = near_dedup.jump(np.array(a, "u8"), np.array(b, "u8"))
        assert got >= lev(a, b)
    x = np.arange(20, dtype="u8")
    assert near_dedup.jump(x, np.delete(x, 7)) == 1 and near_dedup.jump(x, np.concatenate((x[:5], x[8:]))) == 3 and near_dedup.jump(x[:0], x) == 20
