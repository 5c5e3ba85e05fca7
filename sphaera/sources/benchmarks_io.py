"""Word-pair benchmark files into ``pairs(w1, w2, score)``.

Both words are lower-cased; a pair listed twice keeps its last score; pair
keys are ordered, so (a, b) and (b, a) are different pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.sources.lines import read_numbered_lines


def _last_wins(p: DataFrame) -> DataFrame:
    return p.groupBy("w1", "w2").agg(F.max_by("score", "line_no").alias("score"))


def _clean(col: str = "value"):
    # text-mode reading turns CRLF into LF and the newline is not part of the line
    return F.regexp_replace(F.col(col), "\r$", "")


def parse_wordsim_lines(lines: DataFrame) -> DataFrame:
    """CSV with a header; columns word 1, word 2, score; fields may be
    quoted, with a quote doubled inside."""
    row = F.from_csv(_clean(), "w1 string, w2 string, score double", {"escape": '"'})
    p = lines.filter(F.col("line_no") > 0).select("line_no", row.alias("r"))
    return _last_wins(p.select("line_no", F.lower("r.w1").alias("w1"), F.lower("r.w2").alias("w2"), "r.score"))


def parse_men_lines(lines: DataFrame) -> DataFrame:
    """Single-space separated; lines without exactly three fields are
    dropped."""
    parts = F.split(_clean(), " ")
    p = lines.filter(F.size(parts) == 3).select(
        "line_no", F.lower(parts[0]).alias("w1"), F.lower(parts[1]).alias("w2"), parts[2].cast("double").alias("score")
    )
    return _last_wins(p)


def parse_simlex_lines(lines: DataFrame) -> DataFrame:
    """Tab separated with a header; exactly ten fields; score is the
    fourth field."""
    parts = F.split(_clean(), "\t")
    p = lines.filter((F.col("line_no") > 0) & (F.size(parts) == 10)).select(
        "line_no", F.lower(parts[0]).alias("w1"), F.lower(parts[1]).alias("w2"), parts[3].cast("double").alias("score")
    )
    return _last_wins(p)


def read_pairs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    lines = read_numbered_lines(spark, path)
    parse = {"wordsim353": parse_wordsim_lines, "men": parse_men_lines, "simlex": parse_simlex_lines}[kind]
    return parse(lines).select(F.lit(kind).alias("benchmark"), "w1", "w2", "score")
