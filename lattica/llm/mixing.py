"""Mixing of sources to target weights, with Pareto order sampling.

Every source gets a target in words by weight, capped at ``max_copies`` times its size, the excess
reshared by weight. The whole part of target / size is certain copies of every document; one more
copy is sampled for the rest of the target, with unequal probabilities: a document's inclusion
probability p is in proportion to its size, 1 at most, and in a source the sum of p * size is the
rest. Documents of p = 1 are certain; the others are ranked by the Pareto variable, the odds of a
uniform number over the odds of p, and taken in that order while they fit into the rest. The last
unit of the sample is, of all documents not taken, the one whose size comes nearest to the words
still missing (the first in order on a tie), if it brings the sum nearer to the rest. The uniform
number comes from a digest of the document, so reruns agree.

No source is ever in one task: probabilities come from counts by size, ranks are cut into buckets of
the order variable, whose words are summed, and only the one bucket in which a source's rest ends
is sorted.

Null or blank texts have size 0 and are never sampled: they get the certain copies, of 0 words. Null
sources are one source, last. Rows with equal ids share a uniform number, rows equal in id and text
follow each other; an empty table gives an empty result. Further columns pass through apply_mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS, SHARE, MAX_COPIES = (3, 1, 2), 1.5, 2
#: Buckets of the order variable between 0 and 1; certain documents are in one of their own before them.
BUCKETS = 1 << 14
#: Hexadecimal digits of the digest that make the uniform number.
DIGITS = 12


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) with target: weights repeat over sources in order of code points, null last."""
    spark = sizes.sparkSession
    kind = sizes.schema["source"].dataType.simpleString()
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    ranked = written(spark.createDataFrame(ordered, f"source {kind}, source_size long, i long"), "source-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("i", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_copies))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for a unit of weight
    while True:
        full = F.col("cap") <= F.col("w") * level
        r = ranked.agg(F.sum(F.when(full, F.col("cap"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open"), F.sum(full.cast("int")).alias("n")).first()
        new = (share * total - (r["full"] or 0.0)) / r["open"] if r["open"] else level
        if new <= level:  # no source is above its cap any more
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed alone."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def inclusion(slim: DataFrame, aim: DataFrame) -> DataFrame:
    """(s, slope): p is least(1, slope * size) for the documents of source s. slim: (source, size); aim: (s, rest).

    With all sizes in falling order, the largest ones are certain until slope * size is 1 or less for the next.
    """
    sizes = slim.where(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.join(aim.where(F.col("rest") > 0).select("s", "rest"), F.col("source").eqNullSafe(F.col("s")))
    before = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    words, n, size = F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)).cast("double"), F.col("n").cast("decimal(19,0)"), F.col("size").cast("decimal(9,0)")
    squares = F.sum(n * size * size).over(after).cast("double")
    found = sizes.withColumn("slope", (F.col("rest") - words) / squares).where(F.col("slope") * F.col("size") <= 1)
    return found.groupBy("s").agg(F.max_by("slope", "size").alias("slope"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: int = 7) -> DataFrame:
    """A row for each row of docs: id, source, size, source_size, target, copies, taken (= copies * size)."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), F.xxhash64(f"`{text_col}`").alias("t")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    aim = targets(sizes, weights=weights, share=share, max_copies=max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    aim = aim.select(F.col("source").alias("s"), "source_size", "target", whole.alias("whole"), F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0)).alias("rest"))
    slope = inclusion(slim, aim).withColumnRenamed("s", "o")
    aim = written(aim.join(slope, F.col("s").eqNullSafe(F.col("o")), "left").drop("o"), "mix-targets")
    p = F.least(F.lit(1.0), F.coalesce("slope", F.lit(1.0)) * F.col("size"))
    u = uniform(F.col("id"), seed)
    # q = (u / (1 - u)) / (p / (1 - p)); q / (1 + q) keeps its order and lies in 0..1. Without a slope every document is certain
    q = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))
    all_ = slim.join(aim, F.col("source").eqNullSafe(F.col("s"))).withColumn("p", p).drop("s", "slope")
    open_ = (F.col("rest") > 0) & (F.col("size") > 0)
    all_ = all_.withColumn("q", F.when(open_, q)).withColumn("b", F.when(F.col("q") > 0, F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS)).when(F.col("q") == 0, -1))
    by_bucket = all_.where(open_).groupBy("source", "b").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    by_bucket = by_bucket.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
    over = F.col("upto") > F.col("rest")
    # buckets before the one in which the rest ends are taken whole; without one, all are
    end, before = F.coalesce(F.min(F.when(over, F.col("b"))), F.lit(BUCKETS + 1)), F.coalesce(F.min(F.when(over, F.col("upto") - F.col("words"))), F.max("upto"))
    ends = written(by_bucket.groupBy(F.col("source").alias("s")).agg(end.alias("end"), before.alias("before")), "mix-ends")
    placed = all_.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    edge = placed.where(F.col("b") == F.col("end"))
    order = Window.partitionBy("source").orderBy("q", "id", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(order)).withColumn("more", (F.col("upto") <= F.col("rest")).cast("int"))
    rest = placed.where(~F.coalesce(F.col("b") == F.col("end"), F.lit(False))).withColumn("upto", F.lit(None).cast("long")).withColumn("more", F.coalesce((F.col("b") < F.col("end")).cast("int"), F.lit(0)))
    both = written(edge.unionByName(rest).select("id", "source", "size", "source_size", "target", "whole", "rest", "t", "q", "before", "upto", "more"), "mix-order")

    got = both.where(F.col("q").isNotNull()).groupBy(F.col("source").alias("s")).agg(F.first("rest").alias("r"), F.coalesce(F.max(F.when((F.col("more") == 1), F.col("upto"))), F.max("before")).alias("got"))
    gap = written(got.select("s", (F.col("r") - F.col("got")).alias("gap")), "mix-gaps")
    off = F.abs(F.col("gap") - F.col("size"))
    left = both.where(F.col("q").isNotNull() & (F.col("more") == 0)).join(gap, F.col("source").eqNullSafe(F.col("s")))
    key = F.struct(off.alias("off"), "q", "id", "t")
    last = left.where(off < F.col("gap")).groupBy("s").agg(F.min(key).alias("k")).select("s", F.col("k.q").alias("lq"), F.col("k.id").alias("li"), F.col("k.t").alias("lt"))
    # rows equal in id and text have equal keys: the first of them is the last unit
    hit = both.join(written(last, "mix-last"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    is_last = F.coalesce((F.col("more") == 0) & (F.col("q") == F.col("lq")) & F.col("id").eqNullSafe(F.col("li")) & (F.col("t") == F.col("lt")), F.lit(False))
    alike = hit.where(is_last).withColumn("add", (F.row_number().over(Window.partitionBy("source").orderBy("id", "t")) == 1).cast("int"))
    out = hit.where(~is_last).withColumn("add", F.lit(0)).unionByName(alike)
    out = out.withColumn("copies", (F.col("whole") + F.col("more") + F.col("add")).cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("t").alias("text_hash"))


def apply_mix(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row repeated as often as the mix takes it. Rows that are equal in id, text and source share a number of copies, in whole over all of them."""
    total = mixed.groupBy(F.col(id_col).alias("__i"), F.col(source_col).alias("__s"), F.col("text_hash").alias("__t")).agg(F.sum("copies").alias("__c"), F.count("*").alias("__m"))
    keyed = docs.withColumn("__k", F.xxhash64(f"`{text_col}`"))
    joined = keyed.join(total.where(F.col("__c") > 0), (F.col("__k") == F.col("__t")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__i")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__s")))
    # a row that occurs once has its copies; of equal rows each has the floor, and the first ones the remainder
    single = joined.where(F.col("__m") == 1).withColumn("__n", F.col("__c").cast("int"))
    many = joined.where(F.col("__m") > 1).withColumn("__r", F.row_number().over(Window.partitionBy("__k", id_col, "__s").orderBy(id_col)))
    many = many.withColumn("__n", (F.floor(F.col("__c") / F.col("__m")) + (F.col("__r") <= F.pmod(F.col("__c"), F.col("__m"))).cast("int")).cast("int")).drop("__r")
    both = single.unionByName(many).where(F.col("__n") > 0)
    return both.withColumn("__e", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((i - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0 * source_size AS cap FROM s
), o AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), lv AS (SELECT arg_min(level, cap / w) FILTER (WHERE level <= cap / w) AS level FROM o),
t AS (
  SELECT source, source_size, least(cap, w * lv.level)::DOUBLE AS target FROM w, lv
), r AS (
  SELECT *, target - whole * source_size AS rest FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t)
), c AS (
  SELECT d.source, d.size, count(*) AS n FROM d GROUP BY ALL HAVING size > 0
), k AS (
  SELECT c.source, c.size, (r.rest - coalesce(sum(c.n * c.size) OVER (PARTITION BY c.source ORDER BY c.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(c.n * c.size * c.size) OVER (PARTITION BY c.source ORDER BY c.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS slope
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source AND r.rest > 0
), sl AS (SELECT source, arg_max(slope, size) AS slope FROM k WHERE slope * size <= 1 GROUP BY source
), y AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest, least(1.0::DOUBLE, coalesce(sl.slope, 1.0::DOUBLE) * d.size) AS p
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN sl ON d.source IS NOT DISTINCT FROM sl.source
), z AS (
  SELECT *, CASE WHEN rest > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM y
), o2 AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM z WHERE q IS NOT NULL
), g AS (
  SELECT *, rest - coalesce(max(upto) FILTER (WHERE upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM o2
), h AS (
  SELECT *, upto > rest AND abs(gap - size) < gap AND row_number() OVER (PARTITION BY source, upto > rest ORDER BY abs(gap - size), q, doc_id) = 1 AS is_last FROM g
)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (whole + CASE WHEN upto <= rest OR is_last THEN 1 ELSE 0 END))::BIGINT AS taken FROM h
UNION ALL SELECT doc_id, size, source_size, round(target, 6), (size * whole)::BIGINT FROM z WHERE q IS NULL
"""
