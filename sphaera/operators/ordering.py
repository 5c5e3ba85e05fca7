"""Global order statistics without a single-partition window.

``row_number()/sum() OVER (ORDER BY ...)`` with no PARTITION BY runs in one
task. Instead the rows are range-partitioned on the sort key (a sampled,
balanced shuffle), each partition counts/sums itself, a prefix over the small
per-partition table gives every partition its offset, and a broadcast join
(one row per partition: a size bounded by the partition count) adds it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera.session import checkpoint_root


def _order_cols(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranged(df: DataFrame, order: list, num_partitions: int | None) -> DataFrame:
    """Range-partitioned, sorted rows with their partition id and a
    within-partition counter, materialised by a reliable checkpoint: the
    range bounds come from sampling, so two evaluations of an unmaterialised
    input could split it differently. The checkpoint fixes one split for both
    the per-partition totals and the rows, and survives executor loss."""
    spark = df.sparkSession
    checkpoint_root(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _order_cols(order)
    r = (
        df.repartitionByRange(n, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    return r.checkpoint(eager=True)


def with_global_index(
    df: DataFrame, order: list, out: str = "idx", start: int = 0, num_partitions: int | None = None
) -> DataFrame:
    """Add ``out`` = start + 0-based position of the row in ``order``.

    ``order`` must be a total order (break ties explicitly), otherwise equal
    keys are numbered in an arbitrary but fixed order.
    """
    r = _ranged(df, order, num_partitions)
    per = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (
        r.join(F.broadcast(per.select("_pid", "_off", "_m0")), "_pid")
        .withColumn(out, F.col("_off") + (F.col("_mono") - F.col("_m0")) + F.lit(start))
        .drop("_pid", "_mono", "_off", "_m0")
    )


def with_prefix_sum(
    df: DataFrame,
    order: list,
    value: str,
    out: str = "cum",
    inclusive: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = running sum of ``value`` in ``order`` (inclusive or not)."""
    r = _ranged(df, order, num_partitions)
    per = r.groupBy("_pid").agg(F.sum(value).alias("_s"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    frame = Window.partitionBy("_pid").orderBy("_mono")
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = F.coalesce(F.sum(value).over(frame), F.lit(0))
    return (
        r.join(F.broadcast(per.select("_pid", "_off")), "_pid")
        .withColumn(out, F.col("_off") + local)
        .drop("_pid", "_off", "_mono")
    )


def small_prefix(df: DataFrame, order: list, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """Prefix sum for tables whose size is bounded by construction (histograms
    over distinct counts, per-partition totals): one task is fine there."""
    w = Window.orderBy(*_order_cols(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
