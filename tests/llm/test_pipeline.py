"""The stages of the pipeline, on rows of their own and as a whole against a brute-force version."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import near_dedup, packing, quality_classifier, tokens

from .test_operators import DOCS, ODD, kneser_ney, lev, mixed_by_hand, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good texts of two languages on seven sites, noise, a line on all sites, copies and near copies."""
    r, root = random.Random(41), str(tmp_path_factory.mktemp("corpus"))
    prose = lambda n: " ".join(r.choice("river stone water light garden winter summer morning evening letter window paper silver forest little".split()) for _ in range(n))
    line = "read more of our stories here"
    rows = []
    for i in range(60):
        text = "\n".join(prose(r.randrange(8, 40)) for _ in range(r.randrange(1, 4)))
        if i % 3 == 0:
            text += "\n" + line
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 7}", len(text)))
    for i in range(60, 72):  # near copies, two copies of one text, and noise
        base = rows[i - 60][1].split(" ")
        base[len(base) // 2] = f"edited{i}"
        rows.append((i, " ".join(base), "en", f"s{i % 5}", 1))
    rows += [(72, rows[5][1], "en", "s1", 1), (73, rows[5][1], "en", None, 1), (74, "x# q$ zz%% 9@9 !!! ~~ ^^", "en", "s2", 1), (75, "Ω≈ç√∫ ˜µ≤ ≥÷ åß∂", "de", "s3", 1)]
    rows.append((76, prose(1500), "en", "s4", 1))
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1 if i < 55 else 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{root}/labels.parquet")
    return root, rows


def by_hand(rows):
    """(doc_id, text) of the pipeline's first four stages, straight from their rules; a row for each copy."""
    train = [t for i, t, *_ in rows if i < 55 and zlib.crc32(str(i).encode()) % 5]
    model = kneser_ney(train, quality_classifier.ORDER)
    score = {}
    for i, t, *_ in rows:
        full = "\x02" * 4 + t
        score[i] = np.exp(-np.mean([np.log(model(full[k : k + 5])) for k in range(len(t))]))
    held = sorted(score[i] for i, *_ in rows if i < 55 and zlib.crc32(str(i).encode()) % 5 == 0)
    limit = held[int(np.ceil(0.98 * len(held))) - 1]
    docs = [(i, t, s) for i, t, _, s, _ in rows if score[i] <= limit * (1 + 1e-12)]

    sites, first = {}, {}
    for i, t, s in docs:
        for k, x in enumerate(t.split("\n")):
            x = x.strip(" \t\n\x0b\x0c\r")
            if len(x.split()) >= 3:
                sites.setdefault(x, set()).add(s or "")
                first[x] = min(first.get(x, (i, k)), (i, k))
    gone = lambda i, k, x: len(sites.get(x, ())) >= 5 and first[x] != (i, k)
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if not gone(i, k, x.strip())), s) for i, t, s in docs]

    root = {i: i for i, *_ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, t, _ in docs:
        for b, u, _ in docs:
            x, y = t.split(), u.split()
            longer = max(len(x), len(y))
            if a < b and find(a) != find(b) and min(len(x), len(y)) >= 0.8 * longer and lev(x, y) <= near_dedup.limit(longer, 0.8):
                root[max(find(a), find(b))] = min(find(a), find(b))
    docs = [d for d in docs if find(d[0]) == d[0]]

    taken, _ = mixed_by_hand([(i, len(t.split()), s) for i, t, s in docs])
    return [(i, t) for i, t, _ in docs for _ in range(taken[i] // len(t.split()))]


def test_pipeline_brute_force(spark, corpus):
    root, rows = corpus
    got = corpus_pipeline.run(spark, root).collect()
    want = by_hand(rows)
    e, pieces = tokens.encoder(tokens.default_path()), []
    for i, t in want:
        ids = np.frombuffer(e.ids([t])[0], "<u4").tolist() + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        pieces += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert 20 < len({i for i, _ in want}) < 60 and 74 not in {i for i, _ in want}
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(pieces)
    bins = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)][:-1]]).tolist() and sum(n for _, n in own) <= 1024
    room = []
    for n in sorted((p[3] for p in pieces), reverse=True):
        fit = [(x, k) for k, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(1024 - n)
    assert len(bins) == len(room)


def test_stages_keep_columns_and_take_odd_rows(spark, corpus):
    root, _ = corpus
    odd = spark.createDataFrame(ODD, DOCS).withColumn("Copies", F.lit(1)).withColumn("kept", F.lit("x"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, root)
            if name != "best-fit packing":
                assert out.columns == docs.columns, name
            assert docs.count() > 0 or out.count() == 0, name
            out.count()


def test_clean_documents_stay(spark, corpus):
    root, rows = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {x["doc_id"] for x in corpus_pipeline.quality(spark, docs, root).collect()}
    assert len(kept & set(range(60))) >= 57 and not kept & {74, 75}
    texts = {x["doc_id"]: x["text"] for x in corpus_pipeline.lines(spark, docs, root).collect()}
    assert len(texts) == len(rows) and sum("read more of our stories here" in t for t in texts.values()) == 1
    left = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, root).collect()}
    assert left == set(range(60)) | {74, 75, 76}


def test_packing_takes_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (1, "a b", 5, 6), (None, None, 5, 6)], "doc_id long, text string, length int, Piece int")
    got = sorted((x["doc_id"] or 0, x["length"]) for x in packing.pack_documents(docs).collect())
    assert got[0] == (0, 1) and got[1] == got[2] and got[1][0] == 1 and got[1][1] > 1
