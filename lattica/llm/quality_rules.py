"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule bounds ``100 * part / whole`` of two counts; a count is measured once per row, whatever
the number of rules. Null and blank texts have zero words and fail the base rule. Every row is
judged alone, so ties, repeats and further columns change nothing; a column of docs that has
the name of a measure gives way to it. Very long texts are measured whole, in memory that grows with
their words; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, table, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for was on are as with be by at from this or an "
    "der die das und zu den von mit des auf im dem ein eine nicht ist für sich "
    "de la le et les en un du une que est pour qui dans au "
    "el y los del se las por para con no una su lo"
).split()

#: (rule, part, whole, least percent, most percent); a bound of None does not hold.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 250, 1200),
    ("symbol_ratio", "n_symbols", "n_words", None, 10),
    ("stop_word_ratio", "n_stop_words", "n_words", 4, None),
    ("dup_line_ratio", "n_dup_lines", "n_lines", None, 40),
    ("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 90),
    ("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 30),
)


def compile_rules(rules=RULES) -> Column:
    """True if a row is within every bound; exact, as only integers are compared."""
    held = []
    for _, part, whole, least, most in rules:
        p, w = F.col(part) * 100, F.col(whole)
        held += [p >= w * least] * (least is not None) + [p <= w * most] * (most is not None)
    return reduce(lambda a, b: a & b, held, F.lit(True))


def measure(docs: DataFrame, text_col: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the further counts of RULES."""
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")
    rest = [c for c in docs.columns if c.lower() not in own]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    a = docs.select(*[F.col(f"`{c}`") for c in rest], text.alias("__x"), words(F.col(f"`{text_col}`")).alias("__w"))
    a = a.withColumn("__l", F.filter(F.split("__x", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    window = F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))
    a = a.withColumn("__h", F.when(F.size("__w") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    a = a.withColumn("__s", F.sort_array("__h"))
    a = a.withColumn("__any", F.size("__s") > F.size(F.array_distinct("__s")))
    pairs = F.sort_array(F.transform(F.col("__h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    a = a.withColumn("__p", F.when(F.col("__any"), pairs))
    twice = F.filter(F.col("__p"), lambda x, i: (x["h"] == F.get("__p", i + 1)["h"]) | (x["h"] == F.get("__p", i - 1)["h"]))
    a = a.withColumn("__q", F.when(F.col("__any"), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        F.col("__q"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    stop = F.size(F.filter("__w", lambda w: F.lower(w).isin(list(stop_words))))
    n = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.translate("__x", SPACES, "")),
        "n_symbols": F.length("__x") - F.length(F.translate("__x", SYMBOLS, "")),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(F.col("__any"), covered).otherwise(0),
        "n_stop_words": stop,
        "n_bullet_lines": F.size(F.filter("__l", lambda x: F.btrim(x, F.lit(SPACES)).rlike("^[-*•–]"))),
        "n_ellipsis_lines": F.size(F.filter("__l", lambda x: F.btrim(x, F.lit(SPACES)).rlike(r"(\.\.\.|…)$"))),
    }
    return a.select(*rest, *[v.cast("long").alias(k) for k, v in n.items()])


def judge(docs: DataFrame, text_col: str = "text", rules=RULES, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """measure() with base_failed and kept; nothing is dropped."""
    out = measure(docs, text_col)
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op2_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents
), win AS (
  SELECT doc_id, unnest(range(len(w) - 2)) AS i, unnest(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g
  FROM base WHERE len(w) >= 3
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT b.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda t: length(t))), 0)::BIGINT AS word_chars,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda t: lower(t) IN ({_STOPS}))) AS n_stop_words,
         len(list_filter(l, lambda t: regexp_matches(t, '^[\x20\x09-\x0D]*[-*•–]'))) AS nb,
         len(list_filter(l, lambda t: regexp_matches(t, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ne
  FROM base b LEFT JOIN cover c USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 250 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_stop_words >= 4 * n_words AND 100 * n_dup_lines <= 40 * n_lines AND 100 * nb <= 90 * n_lines AND 100 * ne <= 30 * n_lines AS kept,
       n_lines, n_stop_words FROM f
"""
