"""Toxicity by a counterfactually regularised classifier.

A logistic model over hashed features of a text: its distinct words and word beginnings (inflected
and compound forms share those). For every labelled text, a counterfactual copy swaps identity
terms for others of their group; besides the label's loss, the squared change of the score between
the two is penalised, so the weights of neutral group mentions shrink. Every feature that a swap
changes takes part in the fit; others do if the labels differ in it clearly.

The fit uses a bounded sample of labelled ids, ``sample`` of each label at most, chosen by a digest
of the id; features are read from whole texts, in tasks, and every row is scored. The driver gets
the numbers of the features that take part and holds the weights. Labels, lang, source and ids are
never features. Null and empty texts get the score of no features. Repeated rows get equal scores.
Of labelled rows that share id and label, the text of the smallest hash counts; null labels are no
labels, and rows without an id are not learnt from. Without rows of both labels the score is the share of label 1, or 0 without any. Columns
other than id, text and label are ignored, so their names cannot clash. Very long texts are read
whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

DIMS, SAMPLE, PENALTY, DECAY, STEPS = 1 << 19, 8_000, 1.0, 3e-4, 200
#: A feature that no swap changes takes part if it is in as many texts of the sample and differs by as many standard errors between the labels.
LEAST_DF, LEAST_Z = 3, 3.0
#: Tasks that read the sample's features.
READERS = 48
PREFIXES = (4, 5, 6, 7, 8)
#: Groups of identity terms; a counterfactual swaps a term for another of its group.
IDENTITY = (
    ("women", "men", "nonbinary"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("immigrants", "natives", "refugees"), ("disabled", "abled"), ("old", "young"),
    ("africans", "europeans", "americans", "asians"), ("mexican", "french", "german", "spanish", "chinese", "african"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "inländer"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"\w+")


def swaps(groups=IDENTITY) -> dict[str, str]:
    return {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}


class _Features(dict):
    """Feature numbers of a word, kept up to a bound."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        keys = [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n - 1)]
        out = self[word] = tuple({zlib.crc32(k.encode()) & (DIMS - 1) for k in keys})
        return out


def features(text: str | None, memo: _Features, swap: dict[str, str] | None = None) -> np.ndarray:
    found = set(_WORD.findall((text or "").lower()))
    if swap is not None:
        found = {swap.get(w, w) for w in found}
    return np.fromiter({f for w in found for f in memo[w]}, "i4")


def chosen_features(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """(f) of counts (f, d1, d0, swapped): the features that take part, from their numbers of texts with and without the label."""
    pool = (F.col("d1") + F.col("d0")) / F.lit(float(n1 + n0))
    z = F.abs(F.col("d1") / F.lit(float(n1)) - F.col("d0") / F.lit(float(n0))) / F.sqrt(pool * (1 - pool) * F.lit(1 / n1 + 1 / n0) + 1e-12)
    return counts.where(F.col("swapped") | ((F.col("d1") + F.col("d0") >= LEAST_DF) & (z > LEAST_Z))).select("f")


class Rows:
    """Lists of feature numbers in a row, with where each begins."""

    def __init__(self, lists):
        self.n = len(lists)
        self.row = np.repeat(np.arange(self.n, dtype="i4"), [len(x) for x in lists])
        self.col = np.concatenate([np.zeros(0, "i4"), *lists]).astype("i4")

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, per: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.col, weights=per[self.row], minlength=d)


def loss(w: np.ndarray, bias: float, x: Rows, gone: Rows, new: Rows, y: np.ndarray, penalty: float, decay: float) -> tuple[float, np.ndarray, float]:
    """Loss and its gradient. x: features; gone, new: those that the counterfactual lacks and gains. Both labels weigh alike; the penalty is the mean squared change of the score."""
    n, d = len(y), len(w)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    z = x.dot(w) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    gap = gone.dot(w) - new.dot(w)
    value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + penalty * (gap**2).mean() + decay / 2 * (w**2).sum())
    err, pull = weight * (p - y), 2 * penalty * gap / n
    return value, x.back(err, d) + gone.back(pull, d) - new.back(pull, d) + decay * w, float(err.sum())


def descend(x: Rows, gone: Rows, new: Rows, y: np.ndarray, penalty: float = PENALTY, decay: float = DECAY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights (of DIMS features) and bias of a small loss. x: features; gone, new: those that the counterfactual lacks and gains."""
    w, bias = np.zeros(DIMS), 0.0
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return w, float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    m, v, mb, vb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g, gb = loss(w, bias, x, gone, new, y, penalty, decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.3 * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-10)
    return w, bias


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], penalty: float = PENALTY, decay: float = DECAY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """descend() for (features, features of the counterfactual, label)."""
    gone, new = (Rows([np.setdiff1d(r[i], r[1 - i], assume_unique=True) for r in rows]) for i in (0, 1))
    return descend(Rows([r[0] for r in rows]), gone, new, np.array([r[2] for r in rows], "f8"), penalty, decay, steps)


def sampled(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, label) of up to ``sample`` ids of each label. Ids are chosen without their texts, so that only those of the sample move."""
    own = text_col in labelled.columns
    key, text = F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`")
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(key, F.col(label_col).cast("int").alias("label"), *[text.alias("text")] * own)
    keys = rows.select("i", "label").where(F.col("i").isNotNull()).distinct()
    if not own:
        keys = keys.join(docs.select(key), "i", "left_semi")
    some = None
    for label in (0, 1):
        part = keys.where(F.col("label") == label).orderBy(F.xxhash64(F.lit("toxic"), "i"), "i").limit(sample)
        some = part if some is None else some.unionByName(part)
    some = F.broadcast(written(some, "toxic-sample"))  # at most 2 * sample ids
    found = rows.join(some, ["i", "label"], "left_semi") if own else docs.select(key, text.alias("text")).join(some, "i")
    return found.groupBy("i", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label").repartition(READERS)


def learn(docs: DataFrame, labelled: DataFrame, *, id_col: str, text_col: str, label_col: str, sample: int, groups, penalty: float) -> tuple[np.ndarray, float]:
    """Weights of all features, and the bias."""
    swap = swaps(groups)

    def read(batches):
        memo = _Features()
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t, memo) for t in pdf["text"]], "c": [features(t, memo, swap) for t in pdf["text"]], "label": pdf["label"]})

    rows = written(sampled(docs, labelled, id_col, text_col, label_col, sample).mapInPandas(read, "x array<int>, c array<int>, label int"), "toxic-features")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit([(np.zeros(0, "i4"), np.zeros(0, "i4"), y) for y in n], penalty)
    one = F.col("label") == 1
    seen = rows.select("label", F.explode("x").alias("f")).groupBy("f").agg(F.sum(one.cast("int")).alias("d1"), F.sum((~one).cast("int")).alias("d0"), F.lit(False).alias("swapped"))
    swapped = rows.select(F.explode(F.concat(F.array_except("x", "c"), F.array_except("c", "x"))).alias("f")).distinct()
    swapped = swapped.select("f", F.lit(0).alias("d1"), F.lit(0).alias("d0"), F.lit(True).alias("swapped"))
    used = chosen_features(seen.unionByName(swapped), n[1], n[0]).toArrow()["f"].to_numpy()  # DIMS numbers at most
    mask = np.zeros(DIMS, bool)
    mask[used] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def only(batches):
        mask = np.unpackbits(sent.value).view(bool)
        for pdf in batches:
            x, c = ([v[mask[v]] for v in pdf[k]] for k in ("x", "c"))
            gone = [np.setdiff1d(a, b, assume_unique=True) for a, b in zip(x, c, strict=True)]
            new = [np.setdiff1d(b, a, assume_unique=True) for a, b in zip(x, c, strict=True)]
            yield pd.DataFrame({"x": x, "gone": gone, "new": new, "label": pdf["label"]})

    got = rows.mapInPandas(only, "x array<int>, gone array<int>, new array<int>, label int").toArrow()  # of 2 * sample rows at most, the features that take part
    x, gone, new = (Rows([v.values.to_numpy() for v in got[c]]) for c in ("x", "gone", "new"))
    return descend(x, gone, new, got["label"].to_numpy().astype("f8"), penalty)


def score_toxicity(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, groups=IDENTITY, penalty: float = PENALTY) -> DataFrame:
    """id and score (0 to 1) of each row of docs; labelled: rows with id and label to learn from, and their own text unless it is that of docs."""
    w, bias = learn(docs, labelled, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample, groups=groups, penalty=penalty)
    sent = docs.sparkSession.sparkContext.broadcast((w.astype("f4"), bias))  # DIMS numbers
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        memo = _Features()
        w, bias = sent.value
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                z = bias + float(w[features(text, memo)].sum(dtype="f8"))
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pd.DataFrame({"id": pdf["id"], "score": np.array(out, "f8")})

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a null id has no remainder
    labels = table(spark, sf_dir, "labels").where(~held & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    scored = score_toxicity(docs, labels)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
