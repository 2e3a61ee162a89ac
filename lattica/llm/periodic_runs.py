"""Periodic runs of words: stretches that repeat themselves, found by a suffix automaton with link-cut access.

Words are appended to a suffix automaton one by one. Its suffix links form a tree that is kept as a
link-cut tree; each appended word accesses the path from its state to the root, and the segments of
that path carry the place where their substrings occurred last. If a segment's longest substring has
L words, ended last at word j and ends now at word i, then words i - j apart are equal over the last
L words, and L >= i - j makes it a square. L reaches as far left as the equality does, so a square
names the start and the smallest period of its run, and the last square of a run names its end.

A run of at least ``least`` words with a period of at most half of it is covered by windows of
``least // 2`` words that occur twice within it, so only stretches that such windows cover, at
distances that fit into the stretch, go to the automaton. That test compares hashes in numpy, many
documents at a time, and lets too much through at worst. Documents stay where they are: no shuffle.

Null texts have no words, an empty text neither, both give no runs and an empty text. Each row gives
one row, repeated rows and ids too; a null id is kept. Very long texts take a few hundred bytes for
each word of a repeating stretch. Equal lengths of the longest run are resolved by start, then
period. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, words

LEAST = 12
#: Words that are hashed at a time.
CHUNK = 1 << 20


def squares(text: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) -> end of every maximal repetition of at least two periods; places are from 0, the end is exclusive."""
    n = len(text)
    size = 2 * n + 2
    # the automaton: state 1 is the root, 0 is none; a state's first transition stands in two lists, further ones in a dict
    length, link = [0] * size, [0] * size
    char, to, more = [-1] * size, [0] * size, {}
    # the link-cut tree: splay trees of path segments by depth; a segment's last occurrence stands at its splay root
    left, right, up, last_end = [0] * size, [0] * size, [0] * size, [0] * size
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if not inner:
                last_end[x] = last_end[y]
            elif (left[y] == x) == (left[z] == y):  # zig-zig: y over z first
                if left[z] == y:
                    b = left[z] = right[y]
                    right[y] = z
                else:
                    b = right[z] = left[y]
                    left[y] = z
                if b:
                    up[b] = z
                g = up[z]
                if g:
                    if left[g] == z:
                        left[g] = y
                    elif right[g] == z:
                        right[g] = y
                up[y], up[z] = g, y
                if not (g and (left[g] == y or right[g] == y)):
                    last_end[y] = last_end[z]
                    last_end[x] = last_end[z]
                z = g
            # x over y
            if left[y] == x:
                b = left[y] = right[x]
                right[x] = y
            else:
                b = right[y] = left[x]
                left[x] = y
            if b:
                up[b] = y
            if z:
                if left[z] == y:
                    left[z] = x
                elif right[z] == y:
                    right[z] = x
            up[x], up[y] = z, x

    states, last = 2, 1
    for i, c in enumerate(text, 1):
        cur = states
        states += 1
        length[cur] = i
        p = last
        q = 0
        while p:
            if char[p] == c:
                q = to[p]
                break
            if char[p] < 0:
                char[p], to[p] = c, cur
            elif p not in more:
                more[p] = {c: cur}
            else:
                q = more[p].get(c, 0)
                if q:
                    break
                more[p][c] = cur
            p = link[p]
        if not p:
            parent = 1
        elif length[p] + 1 == length[q]:
            parent = q
        else:
            parent = states
            states += 1
            length[parent] = length[p] + 1
            char[parent], to[parent] = char[q], to[q]
            if q in more:
                more[parent] = more[q].copy()
            link[parent], link[q] = link[q], parent
            while p:
                if char[p] == c:
                    if to[p] != q:
                        break
                    to[p] = parent
                elif p in more and more[p].get(c) == q:
                    more[p][c] = parent
                else:
                    break
                p = link[p]
            # the copy stands just above q and occurred last where q did: q's segment takes it in
            splay(q)
            a = left[parent] = left[q]
            if a:
                up[a] = parent
            left[q], up[parent] = parent, q
        link[cur] = up[cur] = parent
        last = cur
        # access: the path to the root becomes one segment, that ends at i
        below, v = 0, cur
        while v:
            if (y := up[v]) and (left[y] == v or right[y] == v):
                splay(v)
            j = last_end[v]
            if j:
                d = i - j
                if length[v] >= d:
                    found[i - length[v] - d, d] = i
            r = right[v]
            if r:
                last_end[r] = j
            right[v] = below
            below, v = v, up[v]
        last_end[below] = i
        splay(cur)
    return found


def stretches(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Places (from, to) in a row of documents' words, none across documents, that hold all of their runs; ends: where documents end.

    A run of ``least`` words or more is covered by windows that have their like within the run, at most half its length away.
    """
    w = least // 2
    n = len(codes) - w + 1
    if n <= 1:
        return []
    h = np.zeros(n, "u8")
    doc = np.searchsorted(ends, np.arange(len(codes)), "right")
    for k in range(w):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        h ^= h >> np.uint64(29)
    h = (h + doc[:n].astype("u8")) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.flatnonzero(doc[:n] == doc[w - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    near = np.full(n, len(codes), "i8")
    near[b] = b - a
    near[a] = np.minimum(near[a], b - a)
    keep = np.flatnonzero(near < len(codes))
    while len(keep):
        mark = np.zeros(len(codes) + 1, "i8")
        np.add.at(mark, keep, 1)
        np.add.at(mark, keep + w, -1)
        covered = np.cumsum(mark[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view("i1"), [0]))))
        # stretches of neighbouring documents may touch: they are parted where documents end
        cuts = ends[(ends > 0) & (ends < len(codes))]
        cuts = cuts[covered[cuts] & covered[cuts - 1]]
        start, stop = np.sort(np.concatenate((edge[::2], cuts))), np.sort(np.concatenate((edge[1::2], cuts)))
        size = stop - start
        of = np.searchsorted(start, keep, "right") - 1
        fit = (2 * near[keep] <= size[of]) & (size[of] >= least)
        if fit.all():
            return list(zip(start.tolist(), stop.tolist(), strict=True))
        keep = keep[fit]
    return []


def runs_of(parts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period. Texts are lists of words."""
    codes = np.concatenate([np.fromiter(map(hash, p), "i8", len(p)) for p in parts] or [np.zeros(0, "i8")]).view("u8")
    ends = np.cumsum([len(p) for p in parts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    for a, b in stretches(codes, ends, least):
        doc = int(np.searchsorted(ends, a, "right"))
        base = int(ends[doc]) - len(parts[doc])
        number: dict[bytes, int] = {}
        text = [number.setdefault(x, len(number)) for x in parts[doc][a - base : b - base]]
        out[doc] += [(a - base + s, e - s, d) for (s, d), e in squares(text).items() if e - s >= least]
    return [sorted(set(x)) for x in out]


def collapsed(words_: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words_)
    mark = np.zeros(len(words_) + 1, "i8")
    for s, m, q in runs:
        mark[s + q] += 1
        mark[s + m] -= 1
    keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()
    return b" ".join([words_[k] for k in keep])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch], least: int, chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, n, parts = 0, 0, []
        texts = batch.column("text")
        for k in range(len(texts)):
            parts.append((texts[k].as_py() or b"").split())  # ASCII white space of bytes: the word rule
            n += len(parts[-1])
            if n >= chunk or k + 1 == len(texts):
                runs = runs_of(parts, least)
                yield pa.record_batch([
                    batch.column("id").slice(begin, len(parts)),
                    pa.array([[{"start": s, "length": m, "period": q} for s, m, q in x] for x in runs], _RUN),
                    pa.array([collapsed(p, x).decode() for p, x in zip(parts, runs, strict=True)], pa.string()),
                ], ["id", "runs", "collapsed"])
                begin, n, parts = k + 1, 0, []


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """<id>, runs (start, length, period; by start, then period), collapsed: the text without what a run repeats."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    found = slim.mapInArrow(lambda batches: _find(batches, least, chunk), f"id {kind}, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's text: for one id in ten, the words from one on repeat a stretch of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    w = words(text)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")

    # a one-element array binds the words, so that they are split once
    made = F.get(F.transform(F.array(w), lambda x: F.when(F.size(x) > 0, repeated(x)).otherwise(F.lit(""))), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text)


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # the greatest length, of equal ones the smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("m"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.m").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.m) div (-best.q)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


#: Runs of equal windows of six words at one distance, islands of which are the runs; of periods of one stretch the smallest is its own.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  SELECT rid, doc_id, w, len(w) AS n, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295) AS h FROM d
), a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS g8 FROM c
), p AS (SELECT *, 1 + (n - a) // (3 + g8) AS p FROM a
), x AS (
  SELECT rid, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[(a + (i - a) % p) + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
), g AS (
  SELECT rid, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o) AS gram,
         lead(word, 5) OVER o IS NOT NULL AS whole
  FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)
), e AS MATERIALIZED (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS k FROM g WHERE whole) WHERE k > 1
), m AS (SELECT b.rid, b.i, b.i - a.i AS q FROM e a JOIN e b ON a.rid = b.rid AND a.gram = b.gram AND a.i < b.i
), s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m
), f AS (SELECT rid, q, min(i) - q AS start, max(i) + 6 - min(i) + q AS length FROM s GROUP BY rid, q, island
), r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM f WHERE length >= 12 AND length >= 2 * q GROUP BY rid, start, length
), gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r
), kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (rid, i) GROUP BY rid
), every AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         min({'m': -length, 's': start, 'q': period}) AS best FROM r GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.m AS length, best.q AS period, (-1000 * best.m) // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN every USING (rid) LEFT JOIN kept USING (rid)
"""
