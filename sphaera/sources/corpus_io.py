"""A text corpus, one document per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.sources.lines import read_numbered_lines


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``docs(doc_id, text)``: ``doc_id`` is the 0-based line number; empty
    lines are documents too (each newline is a ``</s>`` in the reference)."""
    return read_numbered_lines(spark, path).select(F.col("line_no").alias("doc_id"), F.col("value").alias("text"))
