"""Exact deduplication by content sort (DataFrame functions only).

Sampled splitters range-partition the normalised bytes, an external sort puts
equal texts side by side, and every row is compared in full with its
neighbour. The sort key is (leading bytes, SHA-256 of the text, salt), so that
the splitters drawn by the range partitioner stay small however long the texts
are; the salt is a hash of the identifier and lets the splitters cut a group of
copies that holds a third of the rows into many tasks. The few pieces of such
a group are then merged by digest.

Defined cases: a null text counts as empty; rows with a null identifier belong
to the group of their text, and an identifier that is not null is preferred as
the one that stays; repeated rows with one identifier are one group in which
one row has ``kept``; an empty table gives an empty result. Other columns are
never touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_cut

LEAD_BYTES = 32
PREFIX = "__dd_"


def _sorted_runs(
    df: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None, keep: str, payload: bool
) -> DataFrame:
    """Rows with their run of equal texts: digest, run, salt and whether the
    row is the first of its run."""
    spark = df.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    cols = [F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(PREFIX + "row")] if payload else []
    rows = df.select(
        *cols, df[id_col].alias(PREFIX + "id"), text.alias(PREFIX + "t"),
        F.unhex(F.sha2(text, 256)).alias(PREFIX + "dig"),
        F.pmod(F.xxhash64(df[id_col]), F.lit(salts)).alias(PREFIX + "salt"),
    ).withColumn(PREFIX + "lead", F.substring(F.col(PREFIX + "t").cast("binary"), 1, LEAD_BYTES))
    key = [PREFIX + "lead", PREFIX + "dig", PREFIX + "salt"]
    ranged = rows.repartitionByRange(*key)
    best = F.col(PREFIX + "id")
    best = best.asc_nulls_last() if keep == "smallest" else best.desc_nulls_last()
    # the range partitioning already holds the window's groups together, so
    # this adds a sort and no exchange
    w = Window.partitionBy(*key).orderBy(F.col(PREFIX + "t"), best)
    same = F.coalesce(F.lag(PREFIX + "t").over(w) == F.col(PREFIX + "t"), F.lit(False))
    marked = ranged.withColumn(PREFIX + "first", ~same)
    # 1 for every group unless two texts share a SHA-256
    run = F.sum(F.col(PREFIX + "first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select(
        *([PREFIX + "row"] if payload else []), PREFIX + "id", PREFIX + "dig", PREFIX + "salt", PREFIX + "first",
        run.alias(PREFIX + "run"),
    )


def _groups(runs: DataFrame, keep: str) -> DataFrame:
    """One row per (digest, run, salt): the identifier that stays, the size of
    the whole group, and whether this piece holds the row that stays."""
    ident, key = F.col(PREFIX + "id"), [PREFIX + "dig", PREFIX + "run"]
    extreme = F.min if keep == "smallest" else F.max
    pieces = runs.groupBy(*key, PREFIX + "salt").agg(
        extreme(ident).alias(PREFIX + "best"), F.count(F.lit(1)).alias(PREFIX + "n")
    )
    w = Window.partitionBy(*key)
    order = F.col(PREFIX + "best")
    order = order.asc_nulls_last() if keep == "smallest" else order.desc_nulls_last()
    return pieces.select(
        *key, PREFIX + "salt",
        extreme(PREFIX + "best").over(w).alias(PREFIX + "keep"),
        F.sum(PREFIX + "n").over(w).alias(PREFIX + "size"),
        (F.row_number().over(w.orderBy(order, PREFIX + "salt")) == 1).alias(PREFIX + "wins"),
    )


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None, keep: str = "smallest",
) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256`` (of the normalised text). ``keep`` is ``smallest`` or
    ``largest``: which identifier of a group stays."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    runs = write_cut(_sorted_runs(df, id_col, text_col, normalise, keep, payload=False), "content-sort")
    key = [PREFIX + "dig", PREFIX + "run", PREFIX + "salt"]
    return runs.join(_groups(runs, keep), key).select(
        F.col(PREFIX + "id").alias(id_col),
        F.col(PREFIX + "keep").alias("keep_id"),
        F.col(PREFIX + "size").alias("group_size"),
        (F.col(PREFIX + "first") & F.col(PREFIX + "wins")).alias("kept"),
        F.lower(F.hex(PREFIX + "dig")).alias("text_sha256"),
    )


def drop_exact_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None, keep: str = "smallest",
) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they were."""
    runs = _sorted_runs(df, id_col, text_col, normalise, keep, payload=True)
    first = write_cut(runs.filter(PREFIX + "first"), "content-heads")
    key = [PREFIX + "dig", PREFIX + "run", PREFIX + "salt"]
    wins = _groups(first, keep).filter(PREFIX + "wins").select(*key)
    row = F.col(PREFIX + "row")
    return first.join(wins, key, "left_semi").select(*[row.getField(c).alias(c) for c in df.columns])
