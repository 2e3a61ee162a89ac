"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns documents, the last one packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from lattica.llm.common import table, written

#: Perplexities of a model that is estimated from the corpus, alignments and token ids are beyond SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the quality classifier rejects; it learns from those that labels call good.

    Null and empty texts are rejected, repeated rows are judged alike, a null language is one of its
    own; without good rows only texts without characters go. An empty table stays empty.
    """
    return quality_classifier.keep_good(docs, quality_classifier.trusted_ids(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that five sources or more share, but for the first occurrence of each.

    A null source is one source, a null or empty text stays as it is, no row goes.
    """
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies.

    Null and empty texts are copies of one another, of rows that repeat id and text one stays, null
    ids only name a class without others.
    """
    return near_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as often as the mix takes it, none to twice.

    Texts without words have their certain copies only, null sources are one source, the last;
    equal rows share their copies, and an empty table stays empty.
    """
    return mixing.apply_mix(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, with their sequences; repeated rows are packed each, null texts as empty ones."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
