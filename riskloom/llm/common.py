"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import checkpointed, table  # noqa: F401

#: What separates words, as a Java and RE2 character class.
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """array<string>: the runs of characters outside BLANKS; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
