"""Ranked lexical search by pipelined term partitioning: bundles of items visit the owners of their terms in turn.

The terms of all items are dealt to owners by document frequency, rare terms first; documents are
dealt to shards. A bundle of items carries sparse accumulators, scores by document, through a shard:
at each owner they meet the shard's postings of its terms by cogroup, and the integer contributions
are added. What the terms still to come can add at most is known, so an accumulator that can't reach
the k-th best score of its shard any more is let go, and none is begun that couldn't; that is exact.
The last owner keeps the k best rows of each shard, which are merged at the end.

Texts are read once, or once for each ``most`` bytes of distinct item terms. Only such blocks are
sent to tasks. Shards have about ``shard`` documents and bundles ``bundle`` items whatever the
documents hold, so no term, text or source makes a task larger than others; a shard's postings are
copied for each bundle.

Null texts have no terms; such documents and items give no rows, nor do documents of score 0. Equal
scores go by ascending id, null ids last; repeated documents are ranked each. Items that repeat id
and text count once, those of one id with different texts have k rows each. Long texts are counted
whole. Empty tables give no rows. Other columns are ignored, whatever their names. Products beyond a
long raise an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .decontaminate import byte_words, normalised

#: Owners: terms in at most one of so many documents, in turn.
OWNERS = (256, 16, 1)
TOP, SHARD, BUNDLE = 20, 4096, 256
#: Bytes of terms that are sent to tasks at a time.
MOST = 16 << 20
#: A term's part of a score is below its weight times this.
PART = 1_000_000


def _posted(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """rid, id, n, t, tf: the terms of each document that has words. sent: (key, broadcast list of (term, t))."""
    get = _opened(sent).get
    for batch in batches:
        keep, n, ends, t, tf = [], [], [0], [], []
        for k, text in enumerate(batch.column("text")):
            words = byte_words(text.as_py())
            if words:
                got = Counter(map(get, words))
                got.pop(None, None)
                keep.append(k)
                n.append(len(words))
                t += got.keys()
                tf += got.values()
                ends.append(len(t))
        ends_ = pa.array(ends, pa.int32())
        rows = pa.array(keep, pa.int32())
        yield pa.record_batch([batch.column("rid").take(rows), batch.column("id").take(rows), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends_, pa.array(t, pa.int64())), pa.ListArray.from_arrays(ends_, pa.array(tf, pa.int64()))], ["rid", "id", "n", "t", "tf"])


_vocabulary: dict[str, dict[bytes, int]] = {}


def _opened(sent) -> dict[bytes, int]:
    key, rows = sent
    if key not in _vocabulary:
        _vocabulary.clear()
        _vocabulary[key] = {term.encode(): t for term, t in rows.value}
    return _vocabulary[key]


def contributions(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The parts of scores that postings add: their frequencies, words of their documents, weights; docs and their words in all."""
    if len(n) and (int(n.max()) * 25 * docs >= 1 << 63 or int(tf.max()) * 1_000_000_000 >= 1 << 63):
        raise OverflowError("a product is beyond a long")
    m = 75 + 25 * n * docs // max(length, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # of no chunks
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    return column.flatten().to_numpy(zero_copy_only=False).astype("i8"), np.diff(column.offsets.to_numpy()).astype("i8")


def _owned(batches: Iterator[pa.RecordBatch], sent, owner: int, docs: int, length: int) -> Iterator[pa.RecordBatch]:
    """rid, id, t, part: of each document's postings those of an owner's terms, with what they add. sent: broadcast (t, owner, weight), by t."""
    terms, owners, weights = sent.value
    for batch in batches:
        t, size = _flat(batch.column("t"))
        tf, _ = _flat(batch.column("tf"))
        row = np.repeat(np.arange(len(size)), size)
        at = np.searchsorted(terms, t)
        mine = np.flatnonzero((owners[at] == owner) & (weights[at] > 0)) if len(terms) else np.zeros(0, "i8")
        n = batch.column("n").to_numpy()[row[mine]]
        part = contributions(tf[mine], n, weights[at[mine]], docs, length)
        rows, counts = np.unique(row[mine], return_counts=True)
        ends, take = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(rows)
        yield pa.record_batch([batch.column("rid").take(take), batch.column("id").take(take), pa.ListArray.from_arrays(ends, pa.array(t[mine])), pa.ListArray.from_arrays(ends, pa.array(part, pa.int64()))], ["rid", "id", "t", "part"])


STATE = "b bigint, s bigint, i bigint, terms array<struct<owner:int,t:bigint,times:bigint,weight:bigint>>, docs array<bigint>, ids array<bigint>, scores array<bigint>"
_STATE = pa.schema([("b", pa.int64()), ("s", pa.int64()), ("i", pa.int64()), ("terms", pa.list_(pa.struct([("owner", pa.int32()), ("t", pa.int64()), ("times", pa.int64()), ("weight", pa.int64())])))] + [(c, pa.list_(pa.int64())) for c in ("docs", "ids", "scores")])


def best_rows(rid: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k best rows by score, then id; an odd rid says that its id is null, which comes last."""
    return np.lexsort((ids, rid & 1, -score))[:k]


def visit(bundles: pa.Table, postings: pa.Table, owner: int, k: int, final: bool) -> pa.Table:
    """A bundle's items (STATE) after an owner's postings (rid, id, t, part) of a shard."""
    bundles = bundles.select(_STATE.names).cast(_STATE)
    t, size = _flat(postings.column("t"))
    part, _ = _flat(postings.column("part"))
    rids, ids = (postings.column(c).to_numpy().astype("i8") for c in ("rid", "id"))
    by_rid = np.argsort(rids)
    place = np.empty(len(rids), "i8")
    place[by_rid] = np.arange(len(rids))
    doc = np.repeat(place, size)
    rids, ids = rids[by_rid], ids[by_rid]
    order = np.argsort(t, kind="stable")
    t, part, doc = t[order], part[order], doc[order]
    states = []
    for row in bundles.to_pylist():
        mine = [x for x in row["terms"] if x["owner"] == owner]
        later = sum(x["times"] * x["weight"] * PART for x in row["terms"] if x["owner"] > owner)
        now = sum(x["times"] * x["weight"] * PART for x in mine)
        docs, own, score = (np.array(row[c], "i8") for c in ("docs", "ids", "scores"))  # by rid
        added = np.zeros(len(rids), "i8")
        for x in mine:
            a, b = np.searchsorted(t, x["t"], "left"), np.searchsorted(t, x["t"], "right")
            added[doc[a:b]] += part[a:b] * x["times"]  # a document has a term once
        if len(docs) and len(rids):
            at = np.minimum(np.searchsorted(rids, docs), len(rids) - 1)
            old = rids[at] == docs
            score[old] += added[at[old]]
            added[at[old]] = 0
        least = int(np.partition(score, -k)[-k]) if len(score) >= k else 0
        if now + later >= least:
            new = np.flatnonzero(added)
            docs, own, score = np.concatenate((docs, rids[new])), np.concatenate((own, ids[new])), np.concatenate((score, added[new]))
            least = int(np.partition(score, -k)[-k]) if len(score) >= k else 0
        keep = best_rows(docs, own, score, k) if final else np.flatnonzero(score + later >= least)
        if not final:
            keep = keep[np.argsort(docs[keep])]
        states.append(row | {"docs": docs[keep], "ids": own[keep], "scores": score[keep]})
    return pa.Table.from_pylist(states, _STATE)


def _visitor(owner: int, k: int, final: bool):
    return lambda bundles, postings: visit(bundles, postings, owner, k, final)


def lexical_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = TOP, owners: tuple[int, ...] = OWNERS, shard: int = SHARD, bundle: int = BUNDLE, most: int = MOST) -> DataFrame:
    """<item>, rank, <id>, score: the k documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    asked = written(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).distinct().withColumn("i", F.monotonically_increasing_id()), "items")
    bag = written(asked.select("i", F.explode(normalised(F.col("text"))).alias("term")).groupBy("i", "term").agg(F.count("*").alias("times")), "bag")
    words = written(bag.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    total = words.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("n")).head()["n"]
    blocks = max(1, -(-total // most))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    slim = slim.select((2 * F.col("rid") + F.col("id").isNull().cast("int")).alias("rid"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), "text")
    if blocks > 1:
        slim = written(slim, "texts")
    posted = []
    for b in range(blocks):
        sent = uuid4().hex, spark.sparkContext.broadcast([(r["term"], r["t"]) for r in words.where(block("t") == b).toLocalIterator()])
        posted.append(written(slim.mapInArrow(lambda batches, sent=sent: _posted(batches, sent), "rid bigint, id bigint, n bigint, t array<bigint>, tf array<bigint>"), "postings"))
        sent[1].unpersist()
    found = posted[0].agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).head()
    count, length = found["docs"], found["length"]
    every = posted[0]
    for p in posted[1:]:
        every = every.unionByName(p)
    df = every.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(owners) - 1)
    for o, part in reversed(list(enumerate(owners[:-1]))):
        owner = F.when(F.col("df") * part <= count, F.lit(o)).otherwise(owner)
    weighed = written(df.select("t", weight.alias("weight"), owner.cast("int").alias("owner")), "weights")
    shards, bundles = max(1, -(-count // shard)), max(1, -(-asked.count() // bundle))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    terms = F.collect_list(F.struct("owner", "t", "times", "weight")).alias("terms")  # an item's own
    of = bag.join(words, "term").join(weighed, "t").groupBy("i").agg(terms)
    none = F.array().cast("array<bigint>")
    state = of.select(F.pmod(F.xxhash64("i"), F.lit(bundles)).alias("b"), numbers(shards).alias("s"), "i", "terms", none.alias("docs"), none.alias("ids"), none.alias("scores"))
    maps = []
    for b in range(blocks):
        got = sorted((r["t"], r["owner"], r["weight"]) for r in weighed.where(block("t") == b).toLocalIterator())
        maps.append(spark.sparkContext.broadcast(tuple(np.array([r[c] for r in got], "i8") for c in range(3))))
    for o in range(len(owners)):
        parts = [p.mapInArrow(lambda batches, sent=sent, o=o: _owned(batches, sent, o, count, length), "rid bigint, id bigint, t array<bigint>, part array<bigint>") for p, sent in zip(posted, maps, strict=True)]
        mine = parts[0]
        for p in parts[1:]:
            mine = mine.unionByName(p)
        if blocks > 1:  # a document's rows of several blocks are one
            mine = mine.groupBy("rid", "id").agg(F.flatten(F.collect_list("t")).alias("t"), F.flatten(F.collect_list("part")).alias("part"))
        mine = mine.select(numbers(bundles).alias("b"), F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("s"), "rid", "id", "t", "part")
        final = o + 1 == len(owners)
        state = state.groupBy("b", "s").cogroup(mine.groupBy("b", "s")).applyInArrow(_visitor(o, k, final), STATE)
    rows = state.select("i", F.explode(F.arrays_zip("docs", "ids", "scores")).alias("r")).select("i", F.when(F.col("r.docs") % 2 == 0, F.col("r.ids")).alias("id"), F.col("r.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("i", "item"), "i").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_ranked_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(w) AS term FROM i) GROUP BY iid, term
), a AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term
), t AS (SELECT term, floor(1000 * ln((2 * a.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, a.n
), c AS (
  SELECT p.rid, p.term, t.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * a.n) // a.l))) AS part FROM p JOIN t USING (term) JOIN d USING (rid), a
), s AS (SELECT iid, rid, sum(times * part)::BIGINT AS score FROM c JOIN q USING (term) GROUP BY iid, rid
), r AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (iid) WHERE rank <= 20
"""
