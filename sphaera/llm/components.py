"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _star(neighbours: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all its neighbours."""
    least = neighbours.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    j = neighbours.join(least, neighbours["u"] == least["c"])
    return j.select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); the root is
    the least node of the component. Nulls and loops are left out. Groups are
    aggregated before they are shuffled and the joins with a hub's rows can be
    split; no group is gathered."""
    e = edges.filter(F.col("u") != F.col("v"))
    e = write_cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _state(e)
    while True:
        # large star: neighbours above u are hung on the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below are hung on the least of them
        small = _star(large)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        e = write_cut(hung.filter("u != v").distinct(), "cc")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
