"""Exact top-k inner-product search over a bit-sliced index.

A block of vectors is kept as bitmaps: bit b of dimension d of all its rows is one bitmap. A
query's scores are added up in that form: every set bit of a query component contributes the
dimension's slices, shifted, and carry-save adders reduce all bitmaps of one weight. For negative
components the complement is added and a constant taken off, so no sign is needed. The best rows
are then selected from the most significant score slice downward; rows that tie at the boundary
have equal scores and are resolved by id, and scores are read from the slices. Blocks give k rows
for each query, merged at the end.

A block's rows come to one task, are indexed once, and the queries stream past it; only where
blocks are fewer than ``tasks``, a block goes to several tasks with a part of the queries each, so
what is copied is bounded. Equal rows are one with a count of k at most before they are dealt.

Vectors that are null or hold null or non-finite components take no part. A vector meets those of
its own length only; it has no inner product with others. Rows that repeat an id are candidates
each, but never for a query of that id; rows of a null id are candidates, the last ones on a tie,
and no queries. Queries that repeat id and vector count once; those of one id with different
vectors have k rows each. Fewer candidates than k give all of them; an empty table gives no rows.
Components beyond 2**62 after scaling and scores beyond a long raise an error. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a block, queries that are worth a task of their own, and tasks below which blocks are copied.
BLOCK, CHUNK, TASKS, SCALE = 1 << 16, 256, 32, 256


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as array<long>; null if any is null or not finite. Raises an error beyond 2**62."""
    double = F.transform(vector, lambda x: x.cast("double"))
    sound = ~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(sound, F.transform(double, lambda x: F.when(F.abs(x * scale) < float(1 << 62), F.floor(x * scale).cast("long")).otherwise(F.raise_error("a component is beyond 2**62").cast("long"))))


def slices(x: np.ndarray) -> tuple[list[np.ndarray], int, int, int]:
    """x: (rows, dimensions). The bitmaps (bits, words) of each dimension of x - low, with low, bits and words."""
    low = int(x.min()) if x.size else 0
    bits = max(1, (int(x.max()) - low).bit_length()) if x.size else 1
    words = -(-len(x) // 64)
    shifted = (x - low).astype("u8")
    out = []
    for d in range(x.shape[1]):
        col = shifted[:, d]
        maps = np.zeros((bits, words * 64), "u1")
        for b in range(bits):
            maps[b, : len(x)] = (col >> np.uint64(b)) & np.uint64(1)
        out.append(np.packbits(maps, axis=1, bitorder="little").view("u8"))
    return out, low, bits, words


def added(index: list[np.ndarray], bits: int, words: int, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Score slices from the least significant one, and the constant below them: score = sum of slices + constant, for x - low."""
    weights: list[list[np.ndarray]] = [[]]
    constant = 0
    for d, q in enumerate(query.tolist()):
        maps = index[d]
        if q < 0:  # q * x = -q * (2**bits - 1 - x) + q * (2**bits - 1)
            constant += q * ((1 << bits) - 1)
            maps, q = ~maps, -q
        shift = 0
        while q:
            if q & 1:
                while len(weights) < shift + bits:
                    weights.append([])
                for b in range(bits):
                    weights[shift + b].append(maps[b])
            q >>= 1
            shift += 1
    out, w = [], 0
    while w < len(weights):
        level = weights[w]
        if w + 1 == len(weights) and len(level) > 1:
            weights.append([])
        while len(level) > 2:  # three bitmaps of a weight make one of it and a carry
            nxt = []
            m = len(level) // 3
            a, b, c = (np.stack(level[i : 3 * m : 3]) for i in range(3))
            ab = a ^ b
            carry = (a & b) | (ab & c)
            nxt = list(ab ^ c)
            weights[w + 1] += list(carry)
            level = nxt + level[3 * m :]
        if len(level) == 2:
            weights[w + 1].append(level[0] & level[1])
            level = [level[0] ^ level[1]]
        out.append(level[0] if level else np.zeros(words, "u8"))
        w += 1
    return out, constant


def select(score: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are surely among the k best, and of those that tie for what is left."""
    sure, tied = np.zeros_like(alive), alive
    for s in reversed(score):
        one = tied & s
        n = int(np.bitwise_count(sure | one).sum())
        if n > k:
            tied = one
        else:
            sure = sure | one
            tied = tied & ~s
            if n == k:
                return sure, np.zeros_like(alive)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view("u1"), bitorder="little"))


class Block:
    """The index of a block. ids ascend, so that ties resolve to the first rows; the last ``nulls`` rows have none."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nulls: int = 0):
        self.ids, self.n, self.own = ids, len(ids), ids[: len(ids) - nulls]
        self.index, self.low, self.bits, self.words = slices(x)
        self.every = np.packbits(np.pad(np.ones(len(x), "u1"), (0, self.words * 64 - len(x))), bitorder="little").view("u8")

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """(id, score) of the k best rows for a query."""
        score, constant = added(self.index, self.bits, self.words, query)
        constant += self.low * sum(query.tolist())
        alive = self.every
        a, b = np.searchsorted(self.own, query_id, "left"), np.searchsorted(self.own, query_id, "right")
        if a < b:
            alive = self.every.copy()
            for r in range(a, b):
                alive[r >> 6] &= ~np.uint64(1 << (r & 63))
        sure, tied = select(score, alive, k)
        rows = _rows(sure)
        if len(rows) < k:
            rows = np.concatenate((rows, _rows(tied)[: k - len(rows)]))
        out = []
        for r in rows.tolist():
            value = constant + sum(1 << w for w, s in enumerate(score) if int(s[r >> 6]) >> (r & 63) & 1)
            if not -(1 << 63) <= value < 1 << 63:
                raise OverflowError(f"the score of {query_id} and {self.ids[r]} is beyond a long")
            out.append((int(self.ids[r]) if r < len(self.own) else None, value))
        return out


def _search(batches, k: int):
    """Rows (part, kind, none, id, v, n, qh), in order of part, kind, none and id: the vectors (kind 0) of a part, then its queries."""
    part, held, block = None, [], None
    for pdf in batches:
        keys = list(zip(pdf["part"], pdf["dims"], strict=True))
        out: dict[str, list] = {"query_id": [], "qh": [], "id": [], "score": []}
        for key, kind, none, i, v, n, qh in zip(keys, pdf["kind"], pdf["none"], pdf["id"], pdf["v"], pdf["n"], pdf["qh"], strict=True):
            if key != part:
                part, held, block = key, [], None
            if kind == 0:
                held += [(i, v, none)] * n
                continue
            if block is None and held:
                x = np.array([v for _, v, _ in held], "i8").reshape(len(held), len(v))
                block = Block(np.array([i for i, _, _ in held], "i8"), x, sum(z for _, _, z in held))
                held = [None]
            for other, score in block.search(i, np.asarray(v, "i8"), k) if block else ():
                out["query_id"].append(i)
                out["qh"].append(qh)
                out["id"].append(other)
                out["score"].append(score)
        yield pd.DataFrame(out | {"id": pd.array(out["id"], "Int64")})


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = BLOCK, chunk: int = CHUNK, tasks: int = TASKS, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, <id>, score): the k rows of vectors with the largest integer inner product for each row of queries; ties to the smaller id."""
    take = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v")).where(F.col("v").isNotNull())
    # of rows that are equal in id and vector, k at most can be among the k best
    rows = written(take(vectors).groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")), "vectors")
    asked = written(take(queries).where(F.col("id").isNotNull()).distinct(), "queries")
    n, m = rows.count(), asked.count()
    blocks = max(1, -(-n // block))
    lanes = max(1, min(tasks // blocks, -(-m // chunk)))
    hash_ = F.xxhash64("id", "v")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = rows.withColumn("b", F.pmod(hash_, F.lit(blocks))).withColumn("lane", every(lanes)).withColumn("kind", F.lit(0)).withColumn("qh", F.lit(0).cast("long"))
    ask = asked.withColumn("lane", F.pmod(hash_, F.lit(lanes))).withColumn("qh", hash_).withColumn("b", every(blocks)).withColumn("kind", F.lit(1)).withColumn("n", F.lit(1))
    both = own.unionByName(ask).select(
        (F.col("b") * lanes + F.col("lane")).alias("part"), F.size("v").alias("dims"), "kind", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "v", "n", "qh"
    )
    dealt = both.repartition(min(blocks * lanes, 1 << 16), "part").sortWithinPartitions("part", "dims", "kind", "none", "id")
    best = dealt.mapInPandas(lambda batches: _search(batches, k), "query_id long, qh long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op9_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0
), p AS (
  SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])), 0)::BIGINT AS score
  FROM q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
