"""Best-fit-decreasing packing of documents into token sequences.

Only lengths decide where a piece goes, and a length is an integer up to the capacity. So the
distributed part counts pieces by length, the best-fit-decreasing run handles *all pieces of one
length at once* (a segment tree over remaining capacities finds the tightest open ones in
logarithmic time), and its plan, runs of pieces onto runs of sequences, is as good as packing
every document one by one. The plan's size follows from the capacity, not from the documents.

Pieces get their place in the plan by their rank within the length, from counts per bucket and
ranks within a bucket, so a length that a third of all documents share is split over tasks.

Null texts are packed as empty ones (the end id alone). Repeated rows and ids are packed each. Pieces
of one length are interchangeable in the plan and take their places by a hash of id, piece and ids, then by these. Very long
texts are cut into as many pieces as they need. An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import default_path, encoder

CAPACITY, END = 1024, 2


class Tightest:
    """A segment tree over remaining capacities 0..n: the smallest one of at least x that has open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, i: int, by: int) -> None:
        i += self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def at_least(self, x: int) -> int | None:
        i = x + self.size
        if self.tree[i]:
            return x
        while i > 1:  # up to the first right neighbour with open bins, then down to its left end
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, rank of the first piece, pieces, first sequence, offset): the runs of best-fit-decreasing over counts of pieces by length."""
    tree, open_ = Tightest(capacity), [[] for _ in range(capacity + 1)]
    plan, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                room, first, n = capacity, bins, None
            else:
                first, n = open_[room].pop()
            # a sequence that takes a piece is then the tightest one, until no other fits in: pieces fill one after the other
            per = room // length
            full = left // per
            take, each = (full if n is None else min(full, n), per) if full else (1, left)
            if n is None:
                bins += take
            else:
                tree.add(room, -take)
                if take < n:
                    open_[room].append((first + take, n - take))
            for k in range(each):
                plan.append((length, rank, take, first, capacity - room + k * length))
                rank += take
            left -= take * each
            open_[room - each * length].append((first, take))
            tree.add(room - each * length, take)
    return plan


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and ids (array<int>) if asked for. The first piece of a long document takes what full ones leave."""
    path = tokenizer or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            rows: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                for key, ids in zip(part["id"], enc.ids([x or "" for x in part["text"]]), strict=True):
                    ids += last
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows["id"].append(key)
                        rows["piece"].append(k)
                        rows["start"].append(a)
                        rows["length"].append(b - a)
                        rows["ids_crc32"].append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
                        if with_ids:
                            rows["ids"].append(np.frombuffer(ids, "<u4")[a:b].astype("i4"))
            if not with_ids:
                del rows["ids"]
            out = pd.DataFrame(rows)
            out["id"] = pd.Series(rows["id"], dtype=object)
            yield out

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return slim.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def pack(cut: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, per_bucket: int = 200_000) -> DataFrame:
    """cut (from pieces()) with sequence_id and offset; sequences are filled from 0 without gaps."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = pd.DataFrame(best_fit(counts, capacity), columns=["length", "rank", "n", "first", "offset"])
    plan = plan.sort_values(["length", "rank"], kind="stable").reset_index(drop=True)
    base = max([1, *counts.values()]) + 1
    keys = (plan["length"] * base + plan["rank"]).to_numpy("i8")
    ranks, firsts, offsets = (plan[c].to_numpy("i8") for c in ("rank", "first", "offset"))
    sent = spark.sparkContext.broadcast((base, keys, ranks, firsts, offsets))  # its size is bounded by the capacity

    buckets = sum(counts.values()) // per_bucket + 8
    dealt = cut.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("length").alias("__l"), F.col("__b").alias("__c"), F.coalesce(before, F.lit(0)).alias("__0"))
    own = F.row_number().over(Window.partitionBy("length", "__b").orderBy(id_col, "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("__r", own).join(starts, (F.col("length") == F.col("__l")) & (F.col("__b") == F.col("__c"))).withColumn("__rank", F.col("__0") + F.col("__r"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        base, keys, ranks, firsts, offsets = sent.value
        i = np.searchsorted(keys, length.to_numpy("i8") * base + rank.to_numpy("i8"), "right") - 1
        return pd.DataFrame({"sequence_id": firsts[i] + rank.to_numpy("i8") - ranks[i], "offset": offsets[i]})

    return ranked.withColumn("__p", place("length", "__rank")).select(*cut.columns, "__p.sequence_id", "__p.offset")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    return pack(written(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, capacity=capacity, end=end, with_ids=with_ids), "pieces"), id_col=id_col, capacity=capacity)


def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
