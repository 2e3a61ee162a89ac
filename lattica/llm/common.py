"""What the corpus operators share: word rules, the shared folder, slim tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import cut, forget, sweep

#: The white space that ends a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACES", "SPLIT", "WORD", "forget", "small_batches", "sweep", "table", "words", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, and lost executors cost nothing before it."""
    return cut(df, name)


@contextmanager
def small_batches(spark: SparkSession, bytes_: int = 8 << 20):
    """Within it tasks send Python batches of up to so many bytes, so that rows with several whole texts take little memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{bytes_}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text; none for null and blank ones."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))
