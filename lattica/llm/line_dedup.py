"""Removal of lines that many sites share.

A HyperLogLog sketch of sites is kept for each line hash; partial sketches merge in the
aggregation, so a line on a third of all pages costs one small row per task. Lines whose
estimate is within the sketch's error of the threshold get an exact distinct count.

A line is compared without white space at its ends. Lines of fewer than ``min_words`` words
stay. Of a line on ``min_sites`` sites or more, the occurrence with the smallest
(id, text hash, position) stays, all others go. A null site counts as one site, null or empty
texts have no lines and come back as they are, repeated rows are treated alike, and columns
other than the text pass through. Lines of any length are compared whole; an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, table, written

MIN_SITES, MIN_WORDS, LG_K = 5, 3, 12


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """(d, t, site, pos, a, b): every line that counts; a and b are independent hashes of it."""
    raw = docs.select(
        F.col(f"`{id_col}`").alias("d"),
        F.xxhash64(f"`{text_col}`").alias("t"),
        F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(f"`{text_col}`", "\n", -1)).alias("pos", "line"),
    )
    line = raw.withColumn("line", F.btrim("line", F.lit(SPACES)))
    enough = F.regexp_count("line", F.lit(WORD)) >= min_words
    return line.where(enough).select("d", "t", "site", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(a, b, first): the lines on min_sites sites or more, with the occurrence that stays."""
    margin = 4 * 1.04 / math.sqrt(2**lg_k)
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    spread = lines.groupBy("a", "b").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"),
        F.min(F.struct("d", "t", "pos")).alias("first"),
        F.count("*").alias("n"),
    )
    # a line on min_sites sites has as many occurrences; an estimate is only read for those
    seen = written(
        spread.where(F.col("n") >= min_sites).select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low),
        "line-spread",
    )
    sure = seen.where(F.col("sites") >= high).select("a", "b", "first")
    near = seen.where(F.col("sites") < high).select("a", "b", "first")
    exact = lines.select("a", "b", "site").join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("sites"))
    return sure.unionByName(near.join(exact.where(F.col("sites") >= min_sites).select("a", "b"), ["a", "b"], "left_semi"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K, counts: bool = False) -> DataFrame:
    """docs with cross-site boilerplate lines taken out of their texts; counts adds n_lines and n_removed (long), in place of columns so named."""
    # numbers alone, a small part of the texts: split and hashed once, read three times
    lines = written(_lines(docs, id_col, text_col, site_col, min_words), "lines")
    found = boilerplate(lines, min_sites, lg_k)
    gone = (
        lines.select("a", "b", "d", "t", "pos")
        .join(found, ["a", "b"])
        .where(~F.struct("d", "t", "pos").eqNullSafe(F.col("first")))
        .groupBy(F.col("d").alias("__d"), F.col("t").alias("__t"))
        .agg(F.collect_set("pos").alias("__gone"))
    )
    text = F.col(f"`{text_col}`")
    joined = docs.withColumn("__k", F.xxhash64(text)).join(gone, (F.col("__k") == F.col("__t")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__d")), "left")
    split = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    new = {text_col: F.when(F.col("__gone").isNull(), text).otherwise(kept)}
    if counts:
        new |= {"n_lines": F.coalesce(F.when(text == "", 0).otherwise(F.size(split)), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    low = {k.lower() for k in new}
    plain = [c for c in docs.columns if c.lower() not in low or c == text_col]
    return joined.select(*[new[c].alias(c) if c == text_col else docs[f"`{c}`"] for c in plain], *[v.alias(k) for k, v in new.items() if k != text_col])


def op1_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, source, unnest(range(len(ls))) AS pos,
         unnest(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS line FROM raw
), counted AS (
  SELECT * FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3
), found AS (
  SELECT line, min((doc_id, pos)) AS first FROM counted GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 5
), gone AS (
  SELECT doc_id, list(pos) AS ps FROM counted JOIN found USING (line) WHERE (doc_id, pos) <> first GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN g.ps IS NULL THEN d.text ELSE coalesce(list_aggregate(list_transform(list_filter(range(len(string_split(d.text, chr(10)))),
            lambda i: NOT list_contains(g.ps, i)), lambda i: string_split(d.text, chr(10))[i + 1]), 'string_agg', chr(10)), '') END AS text,
       CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(len(g.ps), 0) AS n_removed
FROM documents d LEFT JOIN gone g USING (doc_id)
"""
