"""Perplexity under an interpolated modified Kneser-Ney model of characters.

Trusted texts give counts of character n-grams of order ``ORDER`` (every window that ends at a
character of the text, padded at its start). Lower orders count distinct continuations. Discounts
come from the counts of counts of each order. Counting is pre-aggregated per task, then by gram.

All windows of the texts to score, each once, are resolved against the counts by joins, order by
order, sharded by gram as Spark shuffles them; a window's log probability is then looked up for
each document. While the resolved windows are few (checked), they are sent to every task; beyond
that, documents' window counts meet them in a join. Both ways give the same sums, up to rounding.

The model learns from four fifths of the trusted rows; the others set the thresholds: a document is
rejected if its perplexity is above the ``quantile`` of held-out trusted texts of its language
(drawn towards that of all languages, the more the fewer they are: n of them weigh n / (n + PRIOR)). Texts without characters have no
perplexity and are rejected. Without held-out trusted texts nothing but those is rejected. A null
language is one of its own. Repeated rows are judged alike; further columns pass through. Very long
texts are scored in chunks; an empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

ORDER, QUANTILE = 5, 0.98
#: Held-out texts with which a language's own quantile weighs as much as that of all languages.
PRIOR = 30
SENT_ROWS, SENT_MARKS = 3_000_000, 1_000_000
_PAD = "\x02"
#: Characters that a task looks at together, and distinct windows that it holds before it lets them go: a worker needs some tens of MB.
_CHUNK, _HELD = 1 << 19, 400_000
_P = np.uint64(0x100000001B3)


def _hash(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - ORDER + 1
    h = np.zeros(max(0, n), "u8")
    for j in range(ORDER):
        h ^= codes[j : j + n]
        h *= _P
        h ^= h >> np.uint64(29)
    return h


def _chunks(texts):
    """Lists of (row, text) of about _CHUNK characters; long texts are cut with the overlap that windows need."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, len(t), _CHUNK):
            held.append((i, t[lo : lo + _CHUNK], t[max(0, lo - ORDER + 1) : lo]))
            size += len(held[-1][1])
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a chunk, and hash, start and row of all its windows; each text is led by what stands before it, or padding."""
    pieces, owner = [], []
    for i, t, before in part:
        lead = (_PAD * ORDER + before)[-(ORDER - 1) :]
        pieces.append(lead + t)
        owner.append((i, len(t)))
    raw = "".join(pieces)
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
    h = _hash(codes)
    at, starts, rows = 0, [], []
    for i, n in owner:
        starts.append(np.arange(at, at + n, dtype="i4"))
        rows.append(np.full(n, i, "i4"))
        at += n + ORDER - 1
    starts, rows = np.concatenate(starts), np.concatenate(rows)
    return codes, h[starts], starts, rows


def _windows(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code points of windows, a row each."""
    return codes[starts[:, None] + np.arange(ORDER, dtype="i4")]


def _grams(windows: np.ndarray) -> list[str]:
    raw = windows.tobytes().decode("utf-32-le", "surrogatepass")
    return [raw[i : i + ORDER] for i in range(0, len(raw), ORDER)]


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash is, in order, and the sum of its counts."""
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return order[first], np.add.reduceat(c[order], first)


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, c) of docs (text, train): every window once, with its count in the texts to learn from."""

    def run(batches):
        held = np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros((0, ORDER), "u4")
        for pdf in batches:
            train = pdf["train"].to_numpy(bool)
            for part in _chunks(pdf["text"]):
                codes, h, starts, rows = _rows(part)
                at, c = _summed(h, train[rows].astype("i8"))
                h, c, w = (np.concatenate((x, y)) for x, y in zip(held, (h[at], c, _windows(codes, starts[at])), strict=True))
                at, c = _summed(h, c)
                held = h[at], c, w[at]
                if len(at) > _HELD:
                    yield pd.DataFrame({"g": _grams(held[2]), "c": held[1]})
                    held = tuple(x[:0] for x in held)
        if len(held[0]):
            yield pd.DataFrame({"g": _grams(held[2]), "c": held[1]})

    return docs.select("text", "train").mapInPandas(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    r = counts.agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(r[f"n{i}"] or 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def resolve(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, lp): the log probability of the last character of every window, after those before it."""
    seen = grams.where(F.col("c") > 0)
    levels = {order: seen}
    for n in range(order - 1, 0, -1):  # distinct ways to extend a gram to the left
        levels[n] = written(levels[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")), f"continuations-{n}")
    vocabulary = levels[1].count() + 1
    p = None
    for n in range(1, order + 1):
        c = levels[n]
        d1, d2, d3 = _discounts(c)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        after = F.substring("g", 1, n - 1) if n > 1 else F.lit("")
        context = c.groupBy(after.alias("ctx")).agg(F.sum("c").cast("double").alias("total"), F.sum(cut).alias("kept"))
        asked = grams.select(F.substring("g", order - n + 1, n).alias("g")).distinct() if n < order else grams.select("g")
        asked = asked.withColumn("ctx", after).withColumn("low", F.substring("g", 2, n - 1) if n > 1 else F.lit(""))
        own = c.select("g", F.greatest(F.col("c") - cut, F.lit(0.0)).alias("own"))
        x = asked.join(own, "g", "left").join(context, "ctx", "left")
        x = x.withColumn("lower", F.lit(1.0 / vocabulary)) if p is None else x.join(p.withColumnRenamed("g", "low").withColumnRenamed("p", "lower"), "low")
        value = F.when(F.col("total").isNull(), F.col("lower")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("kept") * F.col("lower")) / F.col("total"))
        p = written(x.select("g", value.alias("p")), f"order-{n}")
    return p.select("g", F.log("p").alias("lp"))


def perplexities(docs: DataFrame, resolved: DataFrame, *, sent_rows: int = SENT_ROWS) -> DataFrame:
    """docs (with text) and n_scored, perplexity; docs has a column text."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != "text"]
    if resolved.count() <= sent_rows:
        def hashed(batches):
            for pdf in batches:
                codes = np.frombuffer("".join(pdf["g"]).encode("utf-32-le", "surrogatepass"), "<u4")
                h = _hash(codes)[::ORDER] if len(pdf) else np.zeros(0, "u8")
                yield pd.DataFrame({"h": h.view("i8"), "lp": pdf["lp"]})

        got = resolved.mapInPandas(hashed, "h long, lp double").toArrow()  # 16 bytes a row
        h = got["h"].to_numpy().view("u8")
        order = np.argsort(h)
        sent = spark.sparkContext.broadcast((h[order], got["lp"].to_numpy()[order]))
        del got, h, order

        def run(batches):
            keys, lps = sent.value
            for pdf in batches:
                total = np.zeros(len(pdf))
                for part in _chunks(pdf["text"]):
                    _, h, _, rows = _rows(part)
                    # sorted windows walk through the keys in order, which caches like
                    order = np.argsort(h)
                    lp = lps[np.searchsorted(keys, h[order])]
                    total += np.bincount(rows[order], weights=lp, minlength=len(pdf))
                out = pdf[rest].copy()
                out["n_scored"] = [len(t) for t in pdf["text"]]
                out["total"] = total
                yield out

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text") + ", n_scored long, total double"
        scored = docs.mapInPandas(run, schema)
    else:

        def spread(batches):
            for pdf in batches:
                for part in _chunks(pdf["text"]):
                    codes, h, starts, rows = _rows(part)
                    key = np.lexsort((h, rows))
                    new = np.concatenate(([True], (h[key][1:] != h[key][:-1]) | (rows[key][1:] != rows[key][:-1])))
                    first = np.flatnonzero(new)
                    n = np.diff(np.append(first, len(key)))
                    out = pdf[rest].iloc[rows[key[first]]].copy()
                    out["g"] = _grams(_windows(codes, starts[key[first]]))
                    out["n"] = n
                    yield out

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text") + ", g string, n long"
        some = docs.where(F.length("text") > 0).mapInPandas(spread, schema).join(resolved, "g")
        scored = some.groupBy(*rest).agg(F.sum("n").alias("n_scored"), F.sum(F.col("n") * F.col("lp")).alias("total"))
        none = docs.where(F.length("text") == 0).select(*rest, F.lit(0).cast("long").alias("n_scored"), F.lit(0.0).alias("total"))
        scored = scored.unionByName(none)
    return scored.withColumn("perplexity", F.when(F.col("n_scored") > 0, F.exp(-F.col("total") / F.col("n_scored")))).drop("total")


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, sent_rows: int = SENT_ROWS) -> DataFrame:
    """A row for each row of docs: id, t (hash of the text), lang, n_scored, perplexity, threshold, kept. trusted: the ids of texts to learn from."""
    mark = trusted.select(F.col(id_col).alias("__i")).where(F.col("__i").isNotNull()).distinct().withColumn("__on", F.lit(True))
    # up to so many marks the texts stay where they are
    fold = F.crc32(F.col("id").cast("string")) % 5
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.xxhash64(f"`{text_col}`").alias("t"), text.alias("text"))
    if mark.count() <= SENT_MARKS:
        mark = F.broadcast(mark)
    marked = marked.join(mark, F.col("id") == F.col("__i"), "left").withColumn("role", F.when(F.col("__on").isNull(), 0).when(fold != 0, 1).otherwise(2)).drop("__i", "__on")
    grams = written(count_grams(marked.select("text", (F.col("role") == 1).alias("train"))), "grams")
    scored = written(perplexities(marked, written(resolve(grams), "resolved"), sent_rows=sent_rows), "perplexities")
    held = scored.where((F.col("role") == 2) & F.col("perplexity").isNotNull())
    of = F.percentile_approx("perplexity", quantile, 10_000)
    limits = held.groupBy("lang").agg(of.alias("own"), F.count("*").alias("n")).select(F.col("lang").alias("__l"), "own", "n")
    everyone = held.agg(of.alias("e")).first()["e"]
    joined = scored.join(limits, F.col("lang") == F.col("__l"), "left")
    # between the quantile of the language and that of all, in logarithms: the more of its texts are held out, the nearer to its own
    share = F.col("n") / (F.col("n") + F.lit(float(PRIOR)))
    mixed = F.exp(share * F.log("own") + (1 - share) * F.lit(everyone and math.log(everyone)).cast("double"))
    threshold = F.coalesce(mixed, F.lit(everyone).cast("double"), F.lit(float("inf")))
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= threshold)
    return joined.select(F.col("id").alias(id_col), "t", "lang", "n_scored", "perplexity", threshold.alias("threshold"), F.coalesce(kept, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """docs without the rows that judge() rejects."""
    bad = judge(docs, trusted, id_col=id_col, text_col=text_col, lang_col=lang_col, **how).where(~F.col("kept")).select(F.col(id_col).alias("__i"), F.col("t").alias("__t"), F.col("lang").alias("__l")).distinct()
    k = docs.withColumn("__k", F.xxhash64(f"`{text_col}`"))
    on = (F.col("__k") == F.col("__t")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__i")) & (F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")) == F.col("__l"))
    return k.join(bad, on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def trusted_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")


def op5_quality_classifier(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return out.select("doc_id", "lang", F.col("n_scored").alias("n_chars_scored"), "perplexity", "threshold", "kept")
