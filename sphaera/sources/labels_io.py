"""Label files and the metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.sources.lines import read_numbered_lines


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """One integer per line, 1-based in the file, 0-based out; the line
    number is the document."""
    return lines.select(F.col("line_no").alias("doc_id"), (F.trim("value").cast("int") - 1).alias("label"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, label)``."""
    return parse_label_lines(read_numbered_lines(spark, path))


def append_metrics(row: DataFrame, path: str) -> None:
    """Append the metric columns as one comma-separated line."""
    row.select(F.concat_ws(",", *[F.col(c).cast("string") for c in row.columns]).alias("value")).coalesce(1).write.mode(
        "append"
    ).text(path)
