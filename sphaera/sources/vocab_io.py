"""Vocabulary files, ``word count`` per line, ``</s>`` first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.sources.lines import read_numbered_lines, write_ordered_lines


def vocab_lines(vocab: DataFrame) -> DataFrame:
    """``(idx, value)`` = ``word count`` in id order."""
    return vocab.select("idx", F.concat_ws(" ", F.col("word"), F.col("cn").cast("string")).alias("value"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """S3."""
    write_ordered_lines(vocab_lines(vocab), "idx", path)


def parse_vocab_lines(lines: DataFrame) -> DataFrame:
    """Word = first space/tab-separated field, count = the next field."""
    parts = F.split(F.regexp_replace(F.col("value"), "\r", ""), "[ \t]+")
    return lines.select(parts[0].alias("word"), parts[1].cast("bigint").alias("cn")).filter(
        (F.col("word") != "") & F.col("cn").isNotNull()
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(word, cn)`` as listed; :func:`sphaera.operators.vocab.import_vocab`
    re-applies min-count and the order."""
    return parse_vocab_lines(read_numbered_lines(spark, path))
